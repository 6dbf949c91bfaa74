"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; A-Z are
lowered, nothing else is. Hashes depend on the words alone, so they agree between
tasks and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once; a longer text is cut into pieces at a separator.
PIECE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[0x00:0x30] = 0
_FOLD[0x3A:0x41] = 0
_FOLD[0x5B:0x61] = 0
_FOLD[0x7B:0x80] = 0
_FOLD_BYTES = _FOLD.tobytes()
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, (1 << 18) + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_piece(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.empty(len(folded) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(folded, 0, out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power_tables(len(folded) + 1)
    sums = np.zeros(len(folded) + 1, dtype=np.uint64)
    np.cumsum(folded * up[: len(folded)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their start and end bytes in their own text, and where each text's words begin (one more than texts)."""
    buffer = b"\0".join(texts).translate(_FOLD_BYTES)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(texts)]
    found, at = [], 0
    while at < len(buffer):
        to = min(at + PIECE_BYTES, len(buffer))
        if to < len(buffer):
            cut = buffer.rfind(b"\0", at, to)
            to = cut if cut > at else (buffer.find(b"\0", to) % (len(buffer) + 1))
        h, s, e = _hash_piece(np.frombuffer(buffer, dtype=np.uint8, count=to - at, offset=at))
        found.append((h, s + at, e + at))
        at = max(to, at + 1)
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, dtype=np.int64)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.concatenate((np.searchsorted(starts, begins), [len(starts)])).astype(np.int64)
    shift = np.repeat(begins, np.diff(first))
    return hashes, starts - shift, ends - shift, first


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text, and where each text's begin; a shorter text, if not empty, is one shingle."""
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(made))).astype(np.int64)
    total = int(offsets[-1])
    if not total:
        return np.empty(0, dtype=np.uint64), offsets
    at = np.arange(total) - np.repeat(offsets[:-1], made) + np.repeat(first[:-1], made)
    left = np.repeat(first[1:], made) - at
    padded = np.concatenate((hashes, np.zeros(width, dtype=np.uint64)))
    out = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        word = padded[at + k]
        word[left <= k] = 0
        out = (out + word) * _BASE
    return mix(out), offsets


def portions(texts: list[bytes], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes, one text at least and 32,768 at most."""
    lo, size = 0, 0
    for k, text in enumerate(texts):
        if k > lo and (size + len(text) > most or k - lo >= 1 << 15):
            yield lo, k
            lo, size = k, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def fold(text: bytes) -> bytes:
    """A-Z lowered, separators as null bytes."""
    return text.translate(_FOLD_BYTES)


def pieces(batches: Iterator, rows: int = 256) -> Iterator:
    """The rows of Arrow batches in small batches, so that few of them are Python objects at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is the empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
