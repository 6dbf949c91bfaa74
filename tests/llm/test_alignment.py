"""Alignment of two tokenizers against a plain version on the libraries' own output."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece

from voxelmill.llm import alignment, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, rows):
    """The contract, by nested loops."""
    first, second = libraries
    byte_of = alignment.byte_level_table()
    texts = {}
    for text in {t for _, t in rows}:
        texts[text] = None
        if not text:
            continue
        ids_a, ids_b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(byte_of[c] for c in first.id_to_token(k)) for k in ids_a]
        pieces = [second.id_to_piece(k) for k in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        links, groups, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        mine, theirs = [], []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b and i < len(ids_a):
                at_a += len(bytes_a[i])
                mine.append(ids_a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                theirs.append(ids_b[j])
                j += 1
            if at_a == at_b:
                groups.append((mine, theirs))
                mine, theirs = [], []
        owner_b = [k for k, part in enumerate(bytes_b) for _ in part]
        at_a = 0
        for part, a in zip(bytes_a, ids_a, strict=True):
            links += [(a, ids_b[k]) for k in sorted(set(owner_b[at_a : at_a + len(part)]))]
            at_a += len(part)
        texts[text] = (len(ids_a), len(ids_b), groups, links)
    counts = Counter()
    for _, text in rows:
        if texts[text]:
            counts.update(set(texts[text][3]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for doc, text in rows:
        if not texts[text]:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = texts[text]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def test_query_against_plain(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [(i, t[:1500] if t else t) for i, t in rows]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    assert made(alignment.measure(docs, A, public_tokenizers.PATTERN, B)) == plain(libraries, short)
    whole = queries.op12_alignment(spark, SF)
    assert whole.count() == len(rows) and whole.where("n_links > 0").count() > 100


@pytest.mark.parametrize("chunk_bytes", [1, 200, 1 << 24])
def test_awkward_texts(spark, libraries, chunk_bytes):
    draw = random.Random(chunk_bytes)
    odd = [None, "", " ", "  two  spaces ", "a\n\nb", "tab\there", "▁ block", "<0x41> <unk> <s>", "<|endoftext|> and more", "\U0001f642 中文 é", "ﬁ Ａ", "\x00\x01", "x" * 3000, "café naïve"]
    words = "the of Token izers align un even ly don't 12345 été".split()
    odd += [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(odd)] + [(100 + k, odd[-1]) for k in range(60)] + [(None, odd[-2]), (7, odd[7]), (7, odd[7])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, chunk string, n_a int")
    assert made(alignment.measure(docs, A, public_tokenizers.PATTERN, B, chunk_bytes=chunk_bytes)) == plain(libraries, rows)
    assert alignment.measure(docs.where("false"), A, public_tokenizers.PATTERN, B).count() == 0


def test_first_tokenizer_is_the_library(libraries):
    """All code points up to U+FFFF and some above, among letters, digits and spaces."""
    first = alignment.ByteLevel(open(A, encoding="utf-8").read(), public_tokenizers.PATTERN)
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}\n" for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    told = libraries[0].encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    assert [first.encode(t) for t in texts] == [e.ids for e in told]


def test_long_texts(spark, libraries):
    rows = [(1, "word " * 40_000), (2, "a" * 200_000), (3, " " * 200_000), (4, "é" * 200_000)]
    found = {r.doc_id: r for r in alignment.measure(spark.createDataFrame(rows, "doc_id long, text string"), A, public_tokenizers.PATTERN, B).collect()}
    for i, text in rows:
        n_a = len(libraries[0].encode(" " + text, add_special_tokens=False).ids)
        assert found[i].n_a in (0, n_a)
    assert found[1].n_groups > 0 and found[2].n_links > 0


def test_blanks_that_exhaust_the_pattern(libraries):
    """More blanks in a row than the library's pattern can take: the same ids by the other one."""
    first = alignment.ByteLevel(open(A, encoding="utf-8").read(), public_tokenizers.PATTERN)
    for text in (" " * 1_500_000 + "x", "a" + "\n" * 1_500_000):
        ids = first.encode(text)
        assert b"".join([first.table[k] for k in ids]) == b" " + text.encode() and ids == libraries[0].encode(" " + text, add_special_tokens=False).ids
