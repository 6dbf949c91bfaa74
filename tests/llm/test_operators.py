"""Each operator against a brute-force version, and on awkward tables."""

import base64
import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from voxelmill.llm import bpe, decontam, exact, html, minhash, pii, quality, repeats, sharding, token_counts, words
from tests.llm.more_pages import LAST_PAGES, MORE_PAGES
from tests.llm.pages import PAGES
from voxelmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def small(seed, n=60):
    """Random documents with copies, near copies, shared passages, nulls, empties and repeated rows."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(60)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(30))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "short")]
    for i in range(4, n):
        kind = draw.random()
        if kind < 0.2 and i > 6:
            text = rows[draw.randrange(4, i)][1]
        elif kind < 0.35 and i > 6:
            w = (rows[draw.randrange(4, i)][1] or "x").split(" ")
            w[draw.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            text = " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 150)))
            if kind > 0.7:
                text += "\n" + passage + ". " + text[:20]
        rows.append((i, text))
    return rows + [rows[-1], (None, "no id " + passage), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return small(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, []).cache()


def test_sharding(spark, docs, rows, nothing):
    found = sharding.shard_by_bytes(docs, shards=7).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((i, size(t)) for i, t in rows)
    total, largest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    for shard, members in by.items():
        assert 0 <= shard < 7 and sorted(m.slot for m in members) == list(range(len(members)))
        assert abs(sum(m["size"] for m in members) - total / 7) <= largest
    assert sharding.shard_by_bytes(nothing).count() == 0
    # one text holds most rows
    hot = table(spark, [(i, "" if i % 3 else f"text {i}" * 9) for i in range(3000)])
    spread = [r.n for r in sharding.shard_by_bytes(hot, 5).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert max(spread) - min(spread) <= 300


def test_shards_keep_equal_texts(spark):
    draw = random.Random(8)
    texts = [f"text {k} " * draw.randint(1, 30) for k in range(400)]
    rows = [(i, draw.choice(texts)) for i in range(3000)] + [(None, texts[0])] * 40
    # one text alone takes a third of the bytes, of rows without an identifier
    rows += [(None, "hot " * 100)] * 600 + [(4000, None), (4001, "")]
    named = spark.createDataFrame([(None if i is None else f"n{i}", t, 1) for i, t in rows], "doc_id string, text string, shard int")
    for docs, shards in ((table(spark, rows), 7), (named, 12)):
        found = sharding.shard_by_bytes(docs, shards).collect()
        assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in docs.select("doc_id").collect())
        homes, filled, slots = defaultdict(set), Counter(), defaultdict(list)
        for r in found:
            homes[r["size"], r.text_crc32].add(r.shard)
            filled[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
        share = sum(filled.values()) / shards
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(filled) == shards
        assert max(abs(n - share) for n in filled.values()) < share / 16
        hot = homes.pop((416, 0xFFFFFFFF & __import__("zlib").crc32(b"hot " * 100)))
        assert len(hot) == -(-600 * 416 // -(-sum(filled.values()) // shards))
        assert all(len(h) == 1 for h in homes.values())


def test_html_against_markup():
    model = html.fit(html.example_pages(300))
    page = "<html><head><title>T</title><script>if (a<b) x()</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div><article><h1>A  title&amp;more</h1><p>First <b>bold</b>\n text that goes on. And on.<br>Same block.<p>Second paragraph, which is long enough to read.</article><div class=comments><div class=comment><p>Nice post, thanks for it. I liked it.</p></div></div><footer>&copy; me</footer>"
    assert model.extract(page) == "A title&more\n\nFirst bold text that goes on. And on. Same block.\n\nSecond paragraph, which is long enough to read."
    assert model.extract(None) == model.extract("") == model.extract("<!-- only") == ""
    right = wrong = 0
    for page in html.example_pages(100, seed=99):
        nodes = html.parse(page)
        for node, chance in zip(nodes, model.marginals(nodes), strict=True):
            if node.text is not None:
                ok = (chance >= 0.5) == (node.label == 1)
                right, wrong = right + ok, wrong + (not ok)
    assert right / (right + wrong) > 0.95


def test_html_of_ordinary_pages():
    model = html.fit(html.example_pages())
    got = {name: model.extract(page) for name, (page, _) in PAGES.items()}
    assert got == {name: text for name, (_, text) in PAGES.items()}
    for pages in (MORE_PAGES, LAST_PAGES):  # not at hand when the model was made: one page of each set keeps a menu
        got = {name: model.extract(page) for name, (page, _) in pages.items()}
        assert all(got.values()) and sum(got[name] != text for name, (_, text) in pages.items()) <= 2
    many = [f"Paragraph number {k} tells something. It goes on for a while, and ends." for k in range(3000)]
    assert model.extract("<html><body>" + "".join(f"<p>{t}</p>" for t in many) + "</body></html>") == "\n\n".join(many)
    began = time.time()
    html.parse("<b>" * 20_000 + "<p>x" * 20_000)
    html.parse("<div>" * 20_000 + "x")
    assert time.time() - began < 10


class Article(HTMLParser):
    """Text blocks inside the article element, without comments: for pages of the table's own template."""

    def __init__(self):
        super().__init__()
        self.inside, self.skip, self.blocks, self.now = 0, 0, [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        names = dict(attrs).get("class") or ""
        if self.skip or any(w in names.split() for w in ("comments", "comment", "ad")):
            self.skip += tag not in ("br", "img", "input", "p", "b", "hr")
        if tag in ("p", "h1", "h2", "div", "article", "ul", "li", "table", "tr", "td", "section", "footer"):
            self.cut()
        if tag == "br":
            self.now.append(" ")
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.cut()
        if self.skip and tag not in ("p", "b", "br"):
            self.skip -= 1
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside > 0 and not self.skip:
            self.now.append(data)


def test_html_query_against_articles(spark):
    made = {r.page_id: r for r in Q.op2_html(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(made) == len(pages)
    for page in pages:
        told = Article()
        told.feed(page.html)
        assert made[page.page_id].text == "\n\n".join(told.blocks) and made[page.page_id].n_chars == len(made[page.page_id].text)


def test_html_handling(spark):
    model = html.fit(html.example_pages(200))
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "<p>One sentence, and more of it.</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, nodes string")
    made = html.extract_pages(pages, model)
    assert made.columns == ["page_id", "html", "nodes", "text"]
    assert Counter((r.page_id, r.text) for r in made.collect()) == Counter({(1, ""): 1, (2, ""): 2, (3, "One sentence, and more of it."): 1})
    assert html.extract_pages(pages.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        html.extract_pages(made, model)


def test_message_passing_is_exact():
    model = html.fit(html.example_pages(100))
    nodes = html.parse("<div class=content><p>Some words here.</p><ul><li><a>x</a></li></ul></div><footer>end</footer>")
    got, n = model.marginals(nodes), len(nodes)
    weight = np.zeros(n)
    total = 0.0
    for states in range(1 << n):
        y = [(states >> k) & 1 for k in range(n)]
        p = 1.0
        for k, node in enumerate(nodes):
            p *= np.exp(np.clip(model.unary(node), -30, 30)) if y[k] else 1.0
            p *= not (y[k] and node.text is None and not any(y[c] for c in node.children))
            if k:
                p *= model.pair(nodes[node.parent].tag, node.tag)[y[node.parent]][y[k]]
        total += p
        weight += p * np.array(y)
    assert got == pytest.approx(weight / total, abs=1e-9)


def test_html_query(spark):
    assert Q.op2_html(spark, SF).where("n_chars > 0").count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_minhash(spark, docs, rows, nothing):
    signed, stored, weights = minhash.weighted_bags(docs)
    picked = minhash.picked_bags(signed.select("id").distinct(), signed, stored)
    bags = {r.id: (r.bag, r.counts, r.frequency) for r in spark.table(picked).collect()}
    found = {r.doc_id: r for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None}
    # frequencies, by sets of shingles
    bag = lambda t: Counter(zip(*[(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))[k:] for k in range(5)], strict=False)) or Counter([tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))] if (t or "").strip() else [])
    df = Counter(s for _, t in rows for s in bag(t))
    total = len(rows)
    idf = {s: 1 + np.log((total + 1) / (n + 1)) for s, n in df.items()}
    own = {i: {s: n * idf[s] for s, n in bag(t).items()} for i, t in rows if i is not None}
    parent = {i: i for i in own}
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in own:
        for j in own:
            if i < j and own[i] and own[j]:
                least = sum(min(w, own[j].get(s, 0)) for s, w in own[i].items())
                similarity = least / (sum(own[i].values()) + sum(own[j].values()) - least)
                assert minhash.weighted_jaccard(bags[i], bags[j], weights) == pytest.approx(similarity)
                if similarity >= 0.8 - 1e-9:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    assert {i: found[i].class_id for i in own} == {i: root(i) for i in own}
    assert all(r.kept == (r.doc_id == r.class_id) for r in found.values())
    assert minhash.near_duplicates(nothing).count() == 0


def test_minhash_names_and_clashes(spark, rows):
    texts = [(None if i is None else f"d{i:03}", t, i, True) for i, t in rows]
    named = spark.createDataFrame(texts, "name string, text string, _dropped long, kept boolean")
    by_number = {r.doc_id: r for r in minhash.near_duplicates(table(spark, rows)).collect()}
    by_name = {r.doc_id: r for r in minhash.near_duplicates(named, "name").collect()}
    assert {i: by_name[f"d{i:03}"].class_id for i in by_number if i is not None} == {i: f"d{r.class_id:03}" for i, r in by_number.items() if i is not None}
    stays = minhash.keep_one(named, "name")
    assert stays.columns == named.columns
    assert Counter(r["name"] for r in stays.collect()) == Counter(n for n, *_ in texts if n is None or by_name[n].kept)


def test_minhash_one_family(spark):
    """Two thousand texts share three quarters of their words; a few pairs of them are near copies."""
    draw = random.Random(3)
    shared = [f"t{k}" for k in range(90)]
    rows = [(i, " ".join(shared + [f"w{draw.randrange(10**9)}" for _ in range(30)])) for i in range(2000)]
    pairs = set()
    for i in range(2000, 2040):
        of = draw.randrange(2000)
        rows.append((i, rows[of][1] + " end"))
        pairs.add((of, i))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    first = {}
    for of, i in sorted(pairs):
        first.setdefault(of, of)
    assert {i: c for i, c in found.items() if c != i} == {i: of for of, i in pairs}


def test_minhash_near_copies_of_a_large_family(spark, tmp_path):
    """A quarter of all texts are edited copies of one, which most of them resemble more than one another."""
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(10**9)}"
    origin = [word() for _ in range(100)]
    rows = [(1000, " ".join(origin))] + [(i, " ".join(word() for _ in range(100))) for i in range(1, 450)]
    for i in range(1001, 1150):
        copy = list(origin)
        copy[draw.randrange(10, 40)], copy[draw.randrange(50, 90)] = word(), word()
        rows.append((i, " ".join(copy)))
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.class_id for r in Q.op3_minhash(spark, str(tmp_path)).collect()}
    assert found == {i: min(i, 1000) for i, _ in rows}
    kept = corpus_pipeline.keep_one_near_copy(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i <= 1000)


def test_minhash_among_copies(spark, docs, rows):
    """Classes by brute force where frequencies are multiples of each text's median one."""
    shingles, counts, begins, _ = minhash._bags([(t or "").encode() for _, t in rows])
    _, which, texts = np.unique(shingles, return_inverse=True, return_counts=True)
    own = {}
    for (i, _), a, b in zip(rows, begins[:-1], begins[1:], strict=True):
        if i is not None and a < b:
            df = np.maximum(1, texts[which[a:b]] / np.sort(texts[which[a:b]])[(b - a - 1) // 2])
            own[i] = dict(zip(shingles[a:b].tolist(), (counts[a:b] * (1 + np.log((len(rows) + 1) / (df + 1)))).tolist(), strict=True))
    root = {i: i for i, _ in rows if i is not None}
    for i, j in itertools.combinations(sorted(own), 2):
        least = sum(min(w, own[j].get(s, 0)) for s, w in own[i].items())
        if least / (sum(own[i].values()) + sum(own[j].values()) - least) >= 0.7 - 1e-9 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, threshold=0.7, among_copies=True).collect() if r.doc_id is not None}
    assert found == root


def test_bags_pack():
    draw = np.random.default_rng(4)
    for n in [*range(1, 200), 5000]:
        own = np.unique(draw.integers(0, 1 << 48, n, dtype=np.uint64))
        assert (minhash.unpack_bag(minhash.pack_bag(own)) == own).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 10), (4, 5), (20, 5), (30, 31), (31, 10)]
    found = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 20: 1, 9: 9, 10: 9, 30: 9, 31: 9}
    assert minhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    """Each checkpoint and each exchange of a round is as many files as there are tasks, whatever the rows."""
    made, cut = [], minhash.cut_lineage
    monkeypatch.setattr(minhash, "cut_lineage", lambda df: made.append(df) or cut(df))
    stars = [(5, 1), (9, 1), (1, 7), (2, 3)]
    found = {r.node: r.root for r in minhash.components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert found == {1: 1, 5: 1, 7: 1, 9: 1, 2: 2, 3: 2}
    assert len(made) == 2


def test_samples_agree_as_often_as_bags_are_similar():
    draw = np.random.default_rng(1)
    shingles = np.sort(draw.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    a, b = draw.random(300) * 3 + 0.1, draw.random(300) * 3 + 0.1
    sampler = minhash.Sampler(600)
    agree = (sampler(shingles, a, np.array([0, 300])) == sampler(shingles, b, np.array([0, 300]))).mean()
    assert agree == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.06)


def test_quality(spark, docs, nothing):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(big, labels)
    scored = quality.with_score(big.select("doc_id", "text"), model).join(labels, "doc_id").where(quality.remainder(F.col("doc_id")) == quality.HELD_OUT)
    right = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95 and 0 < len(model.rules) < 200
    odd = quality.with_score(docs.withColumn("bytes", F.lit("clash")), model)
    assert odd.columns == [*docs.columns, "bytes", "score"] and odd.where("score >= 0 and score <= 1").count() == docs.count()
    assert quality.with_score(nothing, model).count() == 0
    one = quality.fit(docs, spark.createDataFrame([(5, 1), (None, 0), (6, None)], "doc_id long, quality int"))
    assert one.rules == () and quality.fit(docs, labels.limit(0)).intercept == 0.0


def brute_repeats(rows):
    last = 1 << 62
    docs = sorted(((last if i is None else i), (t or "").encode()) for i, t in rows)
    first = {}
    for i, b in docs:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = Counter()
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[(None if i == last else i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    return out


@pytest.mark.parametrize("seed, most", [(5, 5000), (6, 5000), (5, 1), (6, 2)])
def test_repeats(spark, seed, most, nothing):
    rows = small(seed, 80)
    found = repeats.repeated_spans(table(spark, rows), most_contexts=most).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found) == brute_repeats(rows)
    assert repeats.repeated_spans(nothing).count() == 0


def test_run_length_index():
    strings = [b"abababab" * 8, b"b" + b"abababab" * 7, b"x" * 60, b"x" * 55]
    sizes = np.array([len(s) for s in strings])
    index = repeats.RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), sizes, np.array([1, 2, 3, 4]))
    assert len(index.run_start) < index.rows / 2
    ordered = sorted((s[k:] + b"\xff", n) for n, s in enumerate(strings) for k in range(len(s) + 1))
    for length, members, rows in index.stream():
        for member, row in zip(members, rows, strict=True):
            assert ordered[row][0] == strings[member][-length:] + b"\xff"


def test_token_counts(spark, docs, rows, nothing):
    scores = token_counts.piece_scores(open(RANKS, "rb").read())

    def best(token):
        table_ = [(0.0, 0)]
        for e in range(1, len(token) + 1):
            table_.append(max(((table_[b][0] + scores[token[b:e]], table_[b][1] - 1) for b in range(max(0, e - 140), e) if token[b:e] in scores)))
        return -table_[-1][1]

    pieces = tiktoken_like(public_tokenizers.PATTERN)
    found = token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN).collect()
    for r in found:
        own = pieces(r.text or "")
        assert (r.n_pre_tokens, r.n_tokens) == (len(own), sum(best(t.encode()) for t in own))
    assert token_counts.count_tokens(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs.withColumn("n_tokens", F.lit(1)), RANKS, public_tokenizers.PATTERN)


def tiktoken_like(pattern):
    import regex

    return regex.compile(pattern).findall


def test_exact(spark, docs, rows, nothing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    keep = {n: min((i for i in ids if i is not None), default=None) for n, ids in groups.items()}
    found = exact.exact_dedup(docs).collect()
    digest = {hashlib.sha256(n.encode()).hexdigest(): n for n in groups}
    assert Counter((r.doc_id, digest[r.text_sha256], r.keep_id, r.group_size) for r in found) == Counter((i, norm(t), keep[norm(t)], len(groups[norm(t)])) for i, t in rows)
    assert Counter(digest[r.text_sha256] for r in found if r.kept) == Counter(dict.fromkeys(groups, 1))
    assert exact.exact_dedup(nothing).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("norm", "h", "salt", "head", "kept")})
    kept = exact.keep_first(clash)
    assert kept.columns == clash.columns and kept.count() == len(groups)
    staying = {r.doc_id for r in found if r.kept} - {None}
    assert {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None} == {i: t for i, t in rows if i in staying}


def test_exact_with_a_hot_text(spark):
    rows = [(i, "same  text" if i % 2 else "same text") for i in range(900)] + [(1000 + i, f"t{i}") for i in range(300)] + [(None, "same text")]
    found = exact.exact_dedup(table(spark, rows)).collect()
    hot = [r for r in found if r.group_size > 1]
    assert len(hot) == 901 and {r.keep_id for r in hot} == {0} and {r.group_size for r in hot} == {901} and [r.doc_id for r in hot if r.kept] == [0]


def find_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_and_shingles(rows):
    texts = [(t or "").encode() for _, t in rows] + [b"A-b  C\xc3\xa9 9", b""]
    hashes, starts, ends, first = words.hash_words(texts)
    told = {}
    for k, text in enumerate(texts):
        own = find_words(text.decode())
        assert first[k + 1] - first[k] == len(own)
        for h, s, e, w in zip(hashes[first[k] : first[k + 1]].tolist(), starts[first[k] :], ends[first[k] :], own, strict=False):
            assert text[s:e].lower() == w.encode() and told.setdefault(w, h) == h
    assert len(set(told.values())) == len(told)
    size = words.PIECE_BYTES
    words.PIECE_BYTES = 7
    try:
        assert (words.hash_words(texts)[0] == hashes).all()
    finally:
        words.PIECE_BYTES = size


def test_decontamination(spark, rows, nothing, monkeypatch):
    draw = random.Random(2)
    long = [find_words(t) for _, t in rows if len(find_words(t)) > 30]
    items = [(1, " ".join(long[0][3:20])), (2, "Short, Item"), (3, None), (4, " ".join(long[1][:9])), (10, "zz " + " ".join(long[0][5:16])), (1, " ".join(long[0][3:20])), (None, " ".join(long[2][1:14])), (5, "...")]
    docs = [*rows, (500, "before short ITEM; after"), (501, "zz"), (502, " ".join(long[1][:8]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        w, hit, held = find_words(text), set(), set()
        for item, t in items:
            own = find_words(t)
            n = min(10, len(own))
            for a in range(len(own) - n + 1 if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[a : a + n]:
                        hit |= set(range(p, p + n))
                        held |= {item} - {None}
        return len(w), sorted(hit), sorted(held)

    for blocks in (decontam.BLOCK_WORDS, 20):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", blocks)
        monkeypatch.setattr(decontam, "BLOCKS_PER_PASS", 2)
        for r in decontam.mark_contamination(table(spark, docs), benchmark).collect():
            c = r.contamination
            assert (c.n_words, [k for s in c.spans for k in range(s.first_word, s.first_word + s.words)], list(c["items"])) == brute(r.text)
    clean = {r.doc_id: r.text for r in decontam.decontaminate(table(spark, docs), benchmark, max_coverage=1.0).collect()}
    assert clean[500] == "before ; after" and clean[0] is None and clean[501] == "zz"
    dropped = {r.doc_id for r in decontam.decontaminate(table(spark, [(1, "short item"), (2, "a short item of a long text")]), benchmark).collect()}
    assert dropped == {2} and draw
    named = spark.createDataFrame([(f"q{i}" if i else None, t) for i, t in items], "item_id string, text string")
    odd = table(spark, docs).withColumns({"found": F.lit(1), "_found": F.lit("x"), "contamination": F.lit(2)})
    by_name = decontam.mark_contamination(odd, named, into="marks").collect()
    assert [[x[1:] for x in r.marks["items"]] for r in by_name] == [sorted(map(str, brute(r.text)[2])) for r in by_name]
    assert decontam.decontaminate(odd, named).columns == odd.columns and {r.doc_id: r.text for r in decontam.decontaminate(odd, named, max_coverage=1.0).collect()} == clean
    assert decontam.decontaminate(nothing, benchmark).count() == 0 and decontam.decontaminate(table(spark, docs), benchmark.limit(0)).count() == len(docs)


def test_equal_hashes_are_not_equal_words():
    real = words.hash_words
    matcher = decontam.Matcher([(1, b"one two three")])
    for text, expected in ((b"one two three", {1}), (b"one two tree", set())):
        hashes, starts, ends, first = real([text])
        hit, items = np.zeros(3, dtype=bool), [set()]
        hashes = real([b"one two three"])[0]  # as if the words of both had these hashes
        matcher.mark([text], hashes, starts, ends, first, hit, items)
        assert items == [expected] and hit.all() == bool(expected)


def test_bpe(spark, docs, rows, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    told = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(4)
    letters = " \t\n\r\x0b\x1c\x85\xa0　'sdtlmveABC123½²é漢字한글🙂<|endoftext|>$%"
    texts = [t or "" for _, t in rows] + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(3000)] + ["a" * 3000, " " * 2000, "#" * 5000]
    texts += ["".join(draw.choice(["the", "est", "q", "ing", "zx"]) for _ in range(90_000)), "".join(map(chr, draw.choices(range(0x4E00, 0x9000), k=60_000)))]
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == told.encode_ordinary(text) and encoder.decode(ids) == text.encode()
    found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    back = bpe.decode(found, RANKS).collect()
    assert Counter(bytes(r.text_bytes).decode() for r in back) == Counter(t or "" for _, t in rows)
    assert all(r.decoded_sha256 == hashlib.sha256(bytes(r.text_bytes)).hexdigest() and r.n_tokens == len(r.ids) for r in back)
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pii(spark, docs, nothing):
    rows = [
        (1, "mail a.b-c@mail4.example.com or +1 (788) 555-0037, ip 64.147.79.24."), (2, "card 4111 1111 1111 1111 and 1805396481774514, 1984-02-29 31/12/1999 30.02.2001"),
        (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###'), (4, None), (5, ""), (6, "IBAN DE89370400440532013000 DE88370400440532013000 ssn 123-45-6789"), (7, "again 4111111111111111 a.b-c@mail4.example.com"),
        (8, "x9 version 1.2.3 year 1999 12345"),
    ]
    found = {r.doc_id: r for r in pii.pseudonymise(table(spark, rows), "k").collect()}
    text = {i: r.pseudonymised for i, r in found.items()}
    assert text[4] is None and text[5] == "" and text[8] == rows[7][1] and found[8].pii_counts == {}
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", t)))
    for i in (2, 6, 7):
        assert shape(text[i]) == shape(dict(rows)[i])
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', text[3])
    for _, old in rows[:5] + rows[6:]:
        for value in re.findall(r"\S*@\S+|[0-9]{4}[0-9 ]{9,}[0-9]|[0-9a-f]{40}|555-[0-9]{4}|64\.147\S+|1984-02-29|31/12/1999", old or ""):
            assert not any(value in (t or "") for t in text.values()), value
    luhn = lambda n: sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(n))) % 10 == 0
    card = re.search(r"[0-9]{4}(?: [0-9]{4}){3}", text[2])[0].replace(" ", "")
    assert luhn(card) and card in text[7] and "30.02.2001" in text[2] and "DE88370400440532013000" in text[6]
    iban = re.search(r"DE[0-9]{20}", text[6])[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    mail = lambda t: re.search(r"\S+@\S+", t)[0]
    assert mail(text[1]) == mail(text[7]) and found[2].pii_counts == {"number": 2, "date": 2}
    assert pii.pseudonymise(nothing, "k").count() == 0 and pii.pseudonymise(docs, "k").count() == docs.count()


def test_pii_is_a_permutation(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert numbers.select(pii.permute_text(F.col("v"), "k", "t", [pii.DIGITS]).alias("p")).where("p rlike '^[0-9]{3}$'").distinct().count() == 1000
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    assert days.select(pii.pseudonym(F.col("v"), F.lit("date"), "k").alias("p")).distinct().count() == 3000


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        assert docs.count() > 0, k
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def hub(draw, copies=1100, close=30):
    """Texts just under the threshold to each other, and two tight clusters that only the last text connects."""
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(200)]
    texts = [[*base[:195], *(word() for _ in range(5))] for _ in range(copies)]
    left = [*base[:195], *(word() for _ in range(5))]
    middle = [*left[:199], word()]
    right = [*(word() for _ in range(6)), *middle[6:]]
    texts += [[word(), *left[1:]] for _ in range(close)] + [[*right[:199], word()] for _ in range(close)] + [middle]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_minhash_in_one_large_bucket(spark, monkeypatch):
    rows = hub(random.Random(3))
    docs = table(spark, rows)
    shingles, counts, begins, _ = minhash._bags([t.encode() for _, t in rows])
    _, which, texts = np.unique(shingles, return_inverse=True, return_counts=True)
    value = counts * (1 + np.log((len(rows) + 1) / (texts[which] + 1)))
    bags = [dict(zip(shingles[a:b].tolist(), value[a:b].tolist(), strict=True)) for a, b in itertools.pairwise(begins)]
    totals = np.array([sum(b.values()) for b in bags])
    holders = defaultdict(list)
    for i, bag in enumerate(bags):
        for s, w in bag.items():
            holders[s].append((i, w))
    least = np.zeros((len(rows), len(rows)))
    for held in holders.values():
        at, w = (np.array(x) for x in zip(*held, strict=True))
        least[np.ix_(at, at)] += np.minimum(w[:, None], w[None, :])
    similar = least / (totals[:, None] + totals[None, :] - least)
    root = list(range(len(rows)))
    for u, v in np.argwhere(np.triu(similar >= 0.8 - 1e-9, 1)):
        a, b = sorted((root[u], root[v]))
        root = [a if r == b else r for r in root]
    assert root[-2] == root[-1] == root[-32] and max(Counter(root).values()) == 61
    # all texts share one bucket
    made = minhash.weighted_bags

    def one_bucket(*given):
        signed, *rest = made(*given)
        return signed.withColumn("bands", F.array(F.lit(0).cast("long"))), *rest

    monkeypatch.setattr(minhash, "weighted_bags", one_bucket)
    whole = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [whole[i] for i, _ in rows] == root
    bins = np.array([minhash.binned(shingles[a:b], value[a:b]) for a, b in itertools.pairwise(begins)])
    u, v = np.triu_indices(len(rows), 1)
    u, v = u[::7], v[::7]
    assert (minhash.similarity_bound(bins[u], totals[u], bins[v], totals[v]) >= similar[u, v] - 1e-4).all()


def test_pipeline_is_taken_up_again(spark, tmp_path, monkeypatch):
    """A run that dies in its last stage; the next one begins there."""
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    calls, stages = [], list(corpus_pipeline.STAGES)

    def counted(k):
        name, stage = stages[k]

        def run(*args):
            calls.append(k)
            made = stage(*args)
            return made.withColumn("lost", F.raise_error(F.lit("lost"))) if k == 4 and calls.count(4) == 1 else made

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(k) for k in range(5)])
    with pytest.raises(Exception, match="lost"):
        corpus_pipeline.run(spark, SF, str(tmp_path))
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF, str(tmp_path)).collect()} == whole
    assert calls == [0, 1, 2, 3, 4, 4]
