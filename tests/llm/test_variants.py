"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelmill.llm import queries, variants

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(words, ratio=5):
    """Near words by the strings that are left when one code point goes, each pair tried in full."""
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_query_against_brute_force(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    made = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling_variants(spark, SF).collect()}
    assert made == brute(words) and any(v[0] for v in made.values()) and len(made) > 500


@pytest.mark.parametrize("frequent", [1, 6, 10**6])
def test_dense_words(spark, monkeypatch, frequent):
    """Few letters, so that lists are crowded and chains of forms are long; with dictionaries from all grams to none."""
    monkeypatch.setattr(variants, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(variants, "BOUNDED_CHARS", 0 if frequent == 6 else 255)
    draw = random.Random(frequent)
    words = {}
    while len(words) < 700:
        words["".join(draw.choice("abé") for _ in range(draw.randint(6, 9)))] = int(5 ** (draw.random() * 7)) + 1
    words["abc😀efg"] = 7
    words["abc😀ef"] = 90
    table = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string")
    made = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(table).collect()}
    assert made == brute(words) and any(v[1] != v[0] for v in made.values() if v[0])


def test_awkward_tables(spark):
    rows = [(None, 5), ("", 5), ("short", 99), ("colour", 3), ("colour", 4), ("colours", 35), ("colourz", 35), ("x" * 300_000, 1), ("x" * 299_999, 5)]
    made = {r.word: r for r in variants.group_variants(spark.createDataFrame(rows, "word string, n int")).collect()}
    assert set(made) == {"colour", "colours", "colourz", "x" * 300_000, "x" * 299_999}
    assert (made["colour"].n, made["colour"].form, made["colour"].n_near) == (7, "colours", 2) and made["colours"].form is None and made["colours"].n_near == 2
    assert made["x" * 300_000].root == "x" * 299_999
    assert variants.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        variants.near_pairs(spark.createDataFrame([], "word string, n long"), 3)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=12), st.integers(0, 12), st.sampled_from("abc"), st.sampled_from(["insert", "delete", "replace"]), st.sets(st.text("abc", min_size=2, max_size=4)))
def test_bound_of_affected_grams(word, at, char, kind, frequent):
    """Of any word's signature one gram stands in the signature of the edited word, at the same distance from an end."""
    at = min(at, len(word) - 1)
    other = word[:at] + {"insert": char + word[at:], "delete": word[at + 1 :], "replace": char + word[at + 1 :]}[kind]
    if other == word or len(other) < 6:
        return
    grams = {g: len(g) for g in frequent}
    mine, theirs = variants.signature(word, grams, 4), variants.signature(other, grams, 4)
    by = len(other) - len(word)
    shorter, longer = (mine, theirs) if by >= 0 else (theirs, mine)
    assert {(g, p + s) for g, p in shorter for s in {0, abs(by)}} & set(longer)
