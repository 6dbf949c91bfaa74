"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the word sequences of the benchmark items. Every document is
streamed through it word by word, tracking the longest match that ends at each
word; a match that holds a whole window (ten item words, or a whole shorter item)
marks its words. Marked spans can then be cut out of the text, and documents that
are mostly benchmark text dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm import words
from voxelmill.session import cut_lineage

#: Item words in one automaton. The benchmark is read in blocks of about this size,
#: so neither the driver nor a broadcast ever holds more of it at once.
BLOCK_WORDS = 100_000
#: Automata that one pass over the documents holds in memory.
BLOCKS_PER_PASS = 4
WINDOW_WORDS = 10


class SuffixAutomaton:
    """Suffix automaton of many sequences, with the items that hold each window."""

    def __init__(self, items: Iterable[tuple[int | None, list[int]]], window: int = WINDOW_WORDS) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.full: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        items = [(item, seq) for item, seq in items if seq]
        for _, seq in items:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self.shortest = min((min(window, len(seq)) for _, seq in items), default=0)
        for item, seq in items:
            state = length = 0
            for word in seq:
                state, length = self.step(state, length, word)
                if length >= window:
                    self.full.setdefault(self.holder(state, window), set()).add(item)
            if len(seq) < window:
                self.short.setdefault(self.holder(state, len(seq)), {}).setdefault(len(seq), set()).add(item)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state that ``word`` leads to from ``parent``, cloned if it also stands for longer strings."""
        old = self.next[parent][word]
        if self.length[old] == self.length[parent] + 1:
            return old
        twin = self._new(self.length[parent] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = twin
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, word)
        return state

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Longest suffix of the current match that ``word`` continues."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def holder(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, seq: list[int], mark: Iterable[int] | None = None) -> Iterator[tuple[int, int, set]]:
        """(start, end, items) of every window that occurs in ``seq``."""
        state = length = 0
        for at, word in enumerate(seq):
            state, length = self.step(state, length, word)
            if length >= self.window:
                yield at + 1 - self.window, at + 1, self.full[self.holder(state, self.window)]
            if self.short:
                up = state
                while up > 0:
                    for size, items in self.short.get(up, {}).items():
                        if size <= length:
                            yield at + 1 - size, at + 1, items
                    up = self.link[up]


class Matcher:
    """An automaton behind the hashed vocabulary of its items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW_WORDS) -> None:
        hashes, starts, ends, first = words.hash_words([text for _, text in items])
        self.vocabulary, one, ids = np.unique(hashes, return_index=True, return_inverse=True)
        owner = np.searchsorted(first, one, side="right") - 1
        self.words = [words.fold(items[o][1][a:b]) for o, a, b in zip(owner.tolist(), starts[one].tolist(), ends[one].tolist(), strict=True)]
        ids = ids.tolist()
        self.automaton = SuffixAutomaton(((item, ids[first[k] : first[k + 1]]) for k, (item, _) in enumerate(items)), window)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.vocabulary >> np.uint64(44)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes[maybe]
        out[maybe[known]] = at[known]
        return out

    def mark(self, texts: list[bytes], hashes: np.ndarray, begin: np.ndarray, end_: np.ndarray, first: np.ndarray, hit: np.ndarray, items: list[set]) -> None:
        """Set ``hit`` for marked words and add each document's items. Words outside the vocabulary end every match.

        Words meet by their hashes; a window counts if its words are also the same bytes.
        """
        if not len(self.vocabulary):
            return
        ids = self.ids(hashes)
        known = np.concatenate(([False], ids >= 0, [False]))
        # matches end with their document
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edges[0::2], edges[1::2]
        inner = first[1:-1]
        cut = inner[known[inner] & known[np.minimum(inner + 1, len(known) - 1)]] if len(inner) else inner
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        keep = ends - starts >= self.automaton.shortest
        starts, ends = starts[keep], ends[keep]
        docs = np.searchsorted(first, starts, side="right") - 1
        for start, end, doc in zip(starts.tolist(), ends.tolist(), docs.tolist(), strict=True):
            sure = start  # words before this one are the same bytes
            for lo, hi, found in self.automaton.scan(ids[start:end].tolist()):
                a, b = start + lo, start + hi
                if all(self.words[ids[w]] == words.fold(texts[doc][begin[w] : end_[w]]) for w in range(max(a, sure), b)):
                    hit[a:b] = True
                    items[doc] |= found
                    sure = b if a <= sure else sure


def _spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    flags = np.concatenate(([False], hit, [False]))
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return [{"first_word": int(a), "words": int(b - a), "start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(edges[0::2], edges[1::2], strict=True)]


_SPAN = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = "struct<n_words:bigint,spans:array<struct<first_word:bigint,words:bigint,start:bigint,end:bigint>>,items:array<{}>>"


def _scan_batches(batches: Iterator[pa.RecordBatch], column: int, matchers: list) -> Iterator[pa.RecordBatch]:
    """``batches`` with the structs of their last column, marks so far or null, brought up to date."""
    own = [m.value for m in matchers]
    for batch in words.pieces(batches):
        texts = words.as_bytes(batch.column(column))
        carried = batch.column(batch.num_columns - 1).to_pylist()
        found = []
        for lo, hi in words.portions(texts):
            hashes, starts, ends, first = words.hash_words(texts[lo:hi])
            hit = np.zeros(len(hashes), dtype=bool)
            items: list[set] = [set() for _ in range(lo, hi)]
            for k in range(lo, hi):
                if carried[k]:
                    items[k - lo] |= set(carried[k]["items"] or ())
                    for span in carried[k]["spans"] or ():
                        a = first[k - lo] + span["first_word"]
                        hit[a : a + span["words"]] = True
            for matcher in own:
                matcher.mark(texts[lo:hi], hashes, starts, ends, first, hit, items)
            busy = np.add.reduceat(np.concatenate((hit, [False])), first[:-1]) * (np.diff(first) > 0) if hi > lo else ()
            for k in range(hi - lo):
                a, b = first[k], first[k + 1]
                found.append({"n_words": int(b - a), "spans": _spans(hit[a:b], starts[a:b], ends[a:b]) if busy[k] else [], "items": sorted(x for x in items[k] if x is not None)})
        columns = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(found, type=batch.schema.types[-1])]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _matchers(benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> Iterator[list]:
    """Broadcast automata of the benchmark's blocks, as many at a time as one pass holds."""
    texts = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(bytes_) // (BLOCK_WORDS * 6)))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for begin in range(0, blocks, BLOCKS_PER_PASS):
        matchers = []
        for block in range(begin, min(blocks, begin + BLOCKS_PER_PASS)):
            rows = dealt.where(F.col("block") == block).select("item", "text").collect()
            matchers.append(benchmark.sparkSession.sparkContext.broadcast(Matcher([(r["item"], r["text"].encode()) for r in rows], window)))
        yield matchers


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, into: str = "contamination"
) -> DataFrame:
    """Add ``into``: a struct of ``n_words``, marked ``spans`` and ``items`` (ids with an occurring window, ascending).

    A span has the index of its first word, its number of words, and its first and
    last byte + 1 in the UTF-8 text. Null texts have no words; an item without words
    matches nothing; a null item_id marks words but is not listed; repeated items are
    one; all columns of ``docs`` stay. Items keep the type of their identifiers, which
    are whole numbers or strings. A column called ``into`` must not exist yet. An empty
    benchmark marks nothing.
    """
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists already; name another with into=")
    out = docs.withColumn(into, F.lit(None).cast(_FOUND.format(benchmark.schema[item_col].dataType.simpleString())))
    schema = out.schema
    column = docs.columns.index(text_col)
    before = None
    for matchers in _matchers(benchmark, item_col, item_text_col, window):
        out = out if before is None else cut_lineage(out)
        out = before = out.mapInArrow(lambda batches, m=matchers: _scan_batches(batches, column, m), schema)
    return out


def hit_words(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda total, s: total + s["words"])


def _cut(batches: Iterator[pa.RecordBatch], column: int, least: int, most: float) -> Iterator[pa.RecordBatch]:
    """Texts without their spans, and without the marks; rows with too many marked words go."""
    for batch in batches:
        texts, kept, rows = batch.column(column).to_pylist(), [], []
        for row, (text, found) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
            if sum(span["words"] for span in found["spans"]) > most * found["n_words"]:
                continue
            spans = [span for span in found["spans"] if span["words"] >= least]
            if spans:
                raw, at, pieces = text.encode(), 0, []
                for span in spans:
                    pieces.append(raw[at : span["start"]])
                    at = span["end"]
                text = (b"".join(pieces) + raw[at:]).decode()
            kept.append(text)
            rows.append(row)
        columns = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(batch.num_columns - 1)]
        columns[column] = pa.array(kept, type=columns[column].type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_span_words: int = 1, max_coverage: float = 0.5, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Cut marked spans of at least ``min_span_words`` words; drop documents of which more than ``max_coverage`` is marked.

    Text outside the spans stays as it is, byte for byte. Columns and documents
    without marks stay unchanged, whatever the columns are called; a text that is null
    stays null; repeated rows are treated alike; an empty table stays empty.
    """
    # columns go by their places, so that no name can clash with the marks
    marks = _FOUND.format(benchmark.schema[item_col].dataType.simpleString())
    out = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).withColumn("found", F.lit(None).cast(marks))
    schema, column = out.schema, docs.columns.index(text_col)
    *first, last = _matchers(benchmark, item_col, item_text_col, window)
    for matchers in first:
        out = cut_lineage(out.mapInArrow(lambda batches, m=matchers: _scan_batches(batches, column, m), schema))
    # the last automata and the cut are one pass
    return out.mapInArrow(lambda batches: _cut(_scan_batches(batches, column, last), column, min_span_words, max_coverage), docs.schema)


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), wn AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM wn), dg AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw CROSS JOIN ks WHERE len(w) >= k)
), h AS (SELECT doc_id, item_id, dg.k, i FROM dg JOIN wn ON dg.g = wn.g AND dg.k = wn.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
