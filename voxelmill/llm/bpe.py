"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut into pre-tokens by the tokenizer's pattern. Distinct pre-tokens that
are no token themselves are bucketed by length into padded matrices; in every round
each row merges its leftmost pair of minimum rank, found by a hashed pair lookup,
and the matrix is compacted by the one column that every row gives up.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxelmill.llm import words

#: Distinct pre-tokens that a worker remembers; then it starts afresh.
REMEMBERED = 100_000
#: Characters of texts that a worker encodes at once, one text at least.
PORTION_CHARS = 1 << 18
#: A longer pre-token takes its rounds in a list of neighbours with a heap of pairs, since a matrix copies the whole row each round.
LONG_BYTES = 2048
#: Rank files are broadcast; a larger one is refused.
MOST_RANK_BYTES = 64 << 20

_NONE = np.int32(np.iinfo(np.int32).max)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(rank_file: str) -> bytes:
    """Content of a rank file (one base64 token and its rank a line), checked in size."""
    with open(rank_file, "rb") as file:
        content = file.read(MOST_RANK_BYTES + 1)
    if len(content) > MOST_RANK_BYTES:
        raise ValueError(f"{rank_file} is larger than {MOST_RANK_BYTES} bytes")
    return content


class PairTable:
    """Open-addressed hash table from a pair of token ids to the id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, dtype=np.uint64) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.uint64),) * 3
        bits = max(4, int(len(pairs) * 2.5).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        key, value = ((left << np.uint64(32)) | right).astype(np.int64), merged.astype(np.int32)
        slot = self._slots(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = key[free]  # of several with one slot the last is stored
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) & self.mask

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; the largest integer where a pair doesn't merge or one side is padding (-1)."""
        key = (left.astype(np.int64) << 32) | right
        out = np.full(key.shape, _NONE, dtype=np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        flat, found = key.reshape(-1), out.reshape(-1)
        slot = self._slots(flat[open_])
        while len(open_):
            at = self.keys[slot]
            hit = at == flat[open_]
            found[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (at != -1)
            open_, slot = open_[more], (slot[more] + 1) & self.mask
        return out


class Vocabulary:
    def __init__(self, content: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
        self.pairs = PairTable(self.ranks)
        self.merged: dict[int, int] | None = None
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.first = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        # \s as the Unicode property, which the pattern's dialect means
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def _merge(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pre-tokens of at most ``width`` bytes."""
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        for k, row in enumerate(rows):
            ids[k, : len(row)] = self.first[np.frombuffer(row, dtype=np.uint8)]
        done: list[np.ndarray] = [ids[:0, 0]] * len(rows)
        own = np.arange(len(rows))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(own):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(own), dtype=np.int64)
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(own), _NONE)
            over = best == _NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[own[k]] = ids[k][ids[k] >= 0]
                live = ~over
                own, ids, ranks, at, best = own[live], ids[live], ranks[live], at[live], best[live]
                if not len(own):
                    break
            n, w = ids.shape
            line = np.arange(n)
            ids[line, at] = best
            keep = np.ones((n, w), dtype=bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), dtype=bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, w - 2)
            for side in (at - 1, at):
                fits = np.flatnonzero((side >= 0) & (side < w - 2))
                ranks[fits, side[fits]] = self.pairs(ids[fits, side[fits]], ids[fits, side[fits] + 1])
        return done

    def _merge_long(self, row: bytes) -> np.ndarray:
        """As ``_merge``, the leftmost pair of minimum rank first, in n log n steps."""
        if self.merged is None:
            held = np.flatnonzero(self.pairs.keys != -1)
            self.merged = dict(zip(self.pairs.keys[held].tolist(), self.pairs.values[held].tolist(), strict=True))
        rank = self.merged.get
        ids = self.first[np.frombuffer(row, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, (x, y) in enumerate(itertools.pairwise(ids)) if (r := rank(x << 32 | y)) is not None]
        heapq.heapify(heap)
        while heap:
            r, at = heapq.heappop(heap)
            to = after[at]
            if ids[at] < 0 or to >= n or rank(ids[at] << 32 | ids[to]) != r:
                continue  # one side has been merged since
            ids[at], ids[to] = r, -1
            after[at] = far = after[to]
            if far < n:
                before[far] = at
            for left, right in ((before[at], at), (at, far)):
                if left >= 0 and right < n and (r := rank(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode(self, pre_tokens: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pre_tokens)
        buckets: dict[int, list[int]] = {}
        for k, token in enumerate(pre_tokens):
            rank = self.ranks.get(token)
            if rank is not None:
                out[k] = np.array([rank], dtype=np.int32)
            elif len(token) > LONG_BYTES:
                out[k] = self._merge_long(token)
            else:
                buckets.setdefault((len(token) - 1).bit_length(), []).append(k)
        for bits, members in buckets.items():
            width = 1 << bits
            step = max(1, (1 << 18) // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                longest = max(len(pre_tokens[k]) for k in part)
                for k, ids in zip(part, self._merge([pre_tokens[k] for k in part], longest), strict=True):
                    out[k] = ids
        return out


class _Numbered(dict):
    """Numbers new keys in order of appearance."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes texts, remembering the ids of distinct pre-tokens."""

    def __init__(self, content: bytes, pattern: str) -> None:
        self.vocabulary = Vocabulary(content, pattern)
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbered()
        self.flat, self.lengths = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self._forget()
        known = len(self.number)
        number = self.number.__getitem__
        numbers = [np.array(list(map(number, self.vocabulary.pieces(text))), dtype=np.int64) for text in texts]
        if len(self.number) > known:
            fresh = [t.encode() for t in list(self.number)[known:]]
            ids = self.vocabulary.encode(fresh)
            self.flat = np.concatenate([self.flat, *ids])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))])
        begins = np.concatenate(([0], np.cumsum(self.lengths)))
        out = []
        for own in numbers:
            sizes = self.lengths[own]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[own] - ends + sizes, sizes)
            out.append(self.flat[at])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(content, pattern: str) -> Encoder:
    """One encoder for each worker process and broadcast rank file."""
    key = (content.value.__hash__(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content.value, pattern)
    return _encoders[key]


def _run(batches: Iterator[pa.RecordBatch], column: int, content, pattern: str, ids_wanted: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(content, pattern)
    for batch in words.pieces(batches):
        texts = [t or "" for t in batch.column(column).to_pylist()]
        for lo, hi in words.portions(texts, PORTION_CHARS):
            encoded = encoder.encode(texts[lo:hi])
            columns = [batch.column(k).slice(lo, hi - lo) for k in range(batch.num_columns)]
            digests = [[len(ids) for ids in encoded], [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in encoded], [hashlib.sha256(encoder.decode(ids)).hexdigest() for ids in encoded]]
            kinds = [pa.int64(), pa.string(), pa.string()]
            arrays = columns + [pa.array(values, type=kind) for values, kind in zip(digests, kinds, strict=True)]
            names = [*batch.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids_wanted:
                arrays.append(pa.array(encoded, type=pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", id_cols: list[str] | None = None, ids: bool = True) -> DataFrame:
    """Encode every text and decode it again.

    Returns the columns ``id_cols`` (all but the text by default) and ``n_tokens``,
    ``ids_sha256`` (ids as little-endian unsigned 32-bit integers), ``decoded_sha256``
    and, unless ``ids`` is false, the ``ids`` themselves. A null text is the empty
    text: no ids, digests of nothing. Special tokens are ordinary text. Input columns
    of the same names as results are refused. The rank file is read on the driver and
    broadcast (64 MB at most).
    """
    kept = [c for c in docs.columns if c != text_col] if id_cols is None else id_cols
    clash = {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} & set(kept)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would clash with results; leave them out of id_cols")
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    source = docs.select(*kept, text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != text_col)
    schema = f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def drop_text(batches, column=len(kept)):
        for batch in _run(batches, column, content, pattern, ids):
            yield batch.remove_column(column)

    return source.mapInArrow(drop_text, schema)


def decode(tokens: DataFrame, rank_file: str, ids_col: str = "ids", into: str = "text_bytes") -> DataFrame:
    """Add the bytes that the ids stand for; null ids give null, an id outside the vocabulary fails."""
    content = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    schema = tokens.withColumn(into, tokens[ids_col].cast("string").cast("binary")).schema
    column = tokens.columns.index(ids_col)

    def run(batches):
        table: list[bytes] = []
        for line in content.value.splitlines():
            token, rank = line.split()
            table += [b""] * (int(rank) + 1 - len(table))
            table[int(rank)] = base64.b64decode(token)
        for batch in batches:
            made = [None if ids is None else b"".join([table[i] for i in ids]) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, type=pa.binary())], names=[*batch.schema.names, into])

    return tokens.mapInArrow(run, schema)
