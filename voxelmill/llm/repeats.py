"""Removal of repeated passages with run-length indexes.

A byte goes if a 50-byte string that covers it also starts in an earlier document.

The corpus is cut into parts by ranges of the identifier. In each part every 50-byte
window names an anchor, the 32-byte string of smallest hash inside it, so equal windows
name equal anchors. What an anchor's windows can see, up to 18 bytes on either side, is
its context. Contexts are compared in buckets of anchors:

1. a context that an earlier part holds too covers all its windows;
2. distinct contexts of one anchor are indexed: a run-compressed Burrows-Wheeler
   transform with samples at its run ends is built over them, each is streamed backward
   through the runs, and every place where the match with an earlier document is at least
   50 bytes long is marked.

A part sends every context once, however many of its documents hold it, so a passage in
a third of all documents takes one entry a part. An anchor with very many contexts, as at
the edge of such a passage, sends its 50-byte windows instead, each to a bucket of its
own. So parts and buckets stay of bounded size; nothing passes through the driver but the
splitters of the parts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm import words
from voxelmill.session import shuffle_partitions

#: Length of the strings, of anchors, and how many anchors a string holds.
LENGTH, ANCHOR = 50, 32
CHOICES = LENGTH - ANCHOR + 1
SIDE = LENGTH - ANCHOR
#: Parts, and buckets of both steps, for each shuffle partition. A part sends a row to each bucket
#: that it has something for, so the rows of a step are the fewer of parts * buckets and contexts.
PARTS_PER_PARTITION, BUCKETS_PER_PARTITION, INDEXES_PER_PARTITION = 2, 4, 4
#: A bucket of contexts is indexed slice by slice, which bounds an index without more rows.
SLICES = 32
#: Text whose anchors are looked for at once.
PORTION_BYTES = 1 << 18
#: An anchor with more distinct contexts is compared window by window.
MOST_CONTEXTS = 5_000
#: UTF-8 never holds this byte.
SEPARATOR = 0xFF

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_UPPER = np.uint64(0xFFFFFFFF00000000)


class Anchors:
    """Anchors of a batch of texts: owner, place and hash; and the hash of each one's context."""

    def __init__(self, texts: list[bytes]) -> None:
        found = []
        for lo, hi in words.portions(texts, PORTION_BYTES):
            if sum(map(len, texts[lo:hi])) >= LENGTH:
                owner, *rest = _anchors(texts[lo:hi])
                found.append((owner + lo, *rest))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        self.owner, self.place, self.hash, self.context = (np.concatenate(x) for x in zip(empty, *found, strict=True))
        # a class is an anchor with one context; entries are in order of the upper halves of both hashes
        order = np.argsort((self.hash & _UPPER) | (self.context >> np.uint64(32)))
        h, c = self.hash[order], self.context[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(order) else np.empty(0, dtype=bool)
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.entry_hash, self.entry_context = h[new], c[new]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` neighbours, from the place of the first; shorter by width - 1."""
    out, span = x, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[:-rest], out[rest:]) if rest else out


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    up, down = words._power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=sums[1:])
    n = len(buffer) - ANCHOR + 1
    hashes = words.mix((sums[ANCHOR:] - sums[:n]) * down[:n])
    np.minimum(hashes, _TOP - np.uint64(1), out=hashes)
    # a window starts where its text still has 50 bytes
    inside = np.zeros(len(buffer) + 1, dtype=np.int8)
    long_ = sizes >= LENGTH
    inside[(ends - sizes)[long_]] += 1
    inside[(ends - LENGTH + 1)[long_]] -= 1
    least = _slide(hashes, CHOICES, np.minimum)
    least = np.where(np.cumsum(inside)[: len(least)] > 0, least, np.uint64(0))
    pad = np.zeros(CHOICES - 1, dtype=np.uint64)
    most = _slide(np.concatenate((pad, least, pad)), CHOICES, np.maximum)
    at = np.flatnonzero(most == hashes)
    owner = np.searchsorted(ends, at, side="right")
    begin, end = (ends - sizes)[owner], ends[owner]
    left, right = np.maximum(at - SIDE, begin), np.minimum(at + LENGTH, end)
    span = (sums[right] - sums[left]) * down[left]
    context = words.mix(span ^ words.mix(((right - left) * 128 + (at - left)).astype(np.uint64)))
    return owner, at - begin, hashes[at], context


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(content: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(content, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


def _bucket_cuts(entry_hash: np.ndarray, buckets: int) -> tuple[list[int], list[slice]]:
    """Buckets that entries, in order of the hash, fall into, and the entries of each; a bucket takes an equal range of hashes."""
    bucket = ((entry_hash >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), dtype=bool), bucket[1:] != bucket[:-1])))
    ends = np.append(starts[1:], len(bucket))
    return bucket[starts].tolist(), [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)]


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return words.as_bytes(table.column("text").combine_chunks()), table.column("i").to_numpy()


def _send_classes(buckets: int):
    """From each part to every bucket: its distinct contexts, as 4 bytes of the anchor and 6 of the context."""

    def run(table: pa.Table) -> pa.Table:
        texts, _ = _texts(table)
        part = table.column("part")[0].as_py()
        found = Anchors(texts)
        some, cuts = _bucket_cuts(found.entry_hash, buckets)
        anchors = [_pack(found.entry_hash[k] >> np.uint64(8), 4) for k in cuts]
        contexts = [_pack(found.entry_context[k] >> np.uint64(16), 6) for k in cuts]
        return pa.table({"bucket": pa.array(some, pa.int32()), "part": pa.array([part] * len(some), pa.int32()), "anchors": pa.array(anchors, pa.binary()), "contexts": pa.array(contexts, pa.binary())})

    return run


#: What a bucket answers for each entry: an earlier part holds the context; the anchor has other contexts; very many.
EARLIER, OTHERS, MANY = 1, 2, 4


def _answer_classes(table: pa.Table, most: int) -> pa.Table:
    parts = table.column("part").to_numpy()
    anchors = [_unpack(x, 4) for x in table.column("anchors").to_pylist()]
    contexts = [_unpack(x, 6) for x in table.column("contexts").to_pylist()]
    sizes = np.array([len(x) for x in anchors])
    anchor, context = np.concatenate(anchors), np.concatenate(contexts)
    holder = np.repeat(parts, sizes)
    both = (anchor << np.uint64(32)) | (context >> np.uint64(16))
    order = np.argsort(both)
    alone = np.concatenate(([True], both[order][1:] != both[order][:-1], [True]))
    shared = np.flatnonzero(~(alone[1:] & alone[:-1]))  # only what isn't alone needs the rest of the order
    some = order[shared]
    order[shared] = some[np.lexsort((holder[some], context[some], both[some]))]
    a, c = anchor[order], context[order]
    new_anchor = np.concatenate(([True], a[1:] != a[:-1]))
    new_class = new_anchor | np.concatenate(([True], c[1:] != c[:-1]))
    classes = np.add.reduceat(new_class.astype(np.int64), np.flatnonzero(new_anchor))
    held = np.repeat(np.where(classes > most, OTHERS | MANY, np.where(classes > 1, OTHERS, 0)), np.diff(np.append(np.flatnonzero(new_anchor), len(a))))
    owner = holder[order]
    first = np.repeat(owner[new_class], np.diff(np.append(np.flatnonzero(new_class), len(a))))
    answer = np.empty(len(order), dtype=np.uint8)
    answer[order] = np.where(owner > first, EARLIER, 0) + held
    pieces = np.split(answer, np.cumsum(sizes)[:-1])
    some = [k for k, x in enumerate(pieces) if x.any()]
    return pa.table({"part": pa.array(parts[some], pa.int32()), "bucket": table.column("bucket").combine_chunks().take(pa.array(some, pa.int64())), "answer": pa.array([pieces[k].tobytes() for k in some], pa.binary())})


def _answers(found: Anchors, table: pa.Table, buckets: int) -> np.ndarray:
    out = np.zeros(len(found.entry_hash), dtype=np.uint8)
    place = dict(zip(*_bucket_cuts(found.entry_hash, buckets), strict=True))
    for bucket, answer in zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist(), strict=True):
        out[place[bucket]] = np.frombuffer(answer, dtype=np.uint8)
    return out


def _first_holders(found: Anchors, ids: np.ndarray) -> np.ndarray:
    """For each entry the smallest identifier among its holders."""
    out = np.full(len(found.entry_hash), np.iinfo(np.int64).max)
    np.minimum.at(out, found.entry, ids[found.owner])
    return out


def _context_bounds(found: Anchors, texts: list[bytes], k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(texts[o]) for o in found.owner[k]], dtype=np.int64)
    return np.maximum(found.place[k] - SIDE, 0), np.minimum(found.place[k] + LENGTH, sizes)


class Windows:
    """Distinct windows of the contexts of crowded anchors in a part, in order, each with its first document."""

    def __init__(self, found: Anchors, texts: list[bytes], first: np.ndarray, entries: np.ndarray) -> None:
        one = np.zeros(len(found.entry_hash), dtype=np.int64)
        one[found.entry] = np.arange(len(found.entry))
        begin, end = _context_bounds(found, texts, one[entries])
        seen: dict[bytes, int] = {}
        entry, offset, window = [], [], []
        for e, o, b, to in zip(entries.tolist(), found.owner[one[entries]].tolist(), begin.tolist(), end.tolist(), strict=True):
            for k in range(to - b - LENGTH + 1):
                entry.append(e)
                offset.append(k)
                window.append(seen.setdefault(texts[o][b + k : b + k + LENGTH], len(seen)))
        order = sorted(range(len(seen)), key=list(seen).__getitem__)
        place = np.empty(len(seen), dtype=np.int64)
        place[order] = np.arange(len(seen))
        self.content = sorted(seen)
        self.entry, self.offset = np.array(entry, dtype=np.int64), np.array(offset, dtype=np.uint32)
        self.window = place[np.array(window, dtype=np.int64)] if window else np.empty(0, dtype=np.int64)
        self.first = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.window, first[self.entry])

    def buckets(self, buckets: int) -> dict[int, tuple[list[int], list[int]]]:
        """Windows that go to each bucket, and the slice of each."""
        out: dict[int, tuple[list[int], list[int]]] = {}
        for k, content in enumerate(self.content):
            rest, bucket = divmod(zlib.crc32(content), buckets)
            members, slices = out.setdefault(bucket, ([], []))
            members.append(k)
            slices.append(rest % SLICES)
        return out

    def mark(self, marks: np.ndarray, first: np.ndarray, elsewhere: np.ndarray) -> None:
        """Set the bits of windows that an earlier document holds, here or ``elsewhere``."""
        hit = elsewhere[self.window] | (self.first[self.window] < first[self.entry])
        np.bitwise_or.at(marks, self.entry[hit], np.uint32(1) << self.offset[hit])


_CONTEXTS = {"bucket": pa.int32(), "part": pa.int32(), "entries": pa.binary(), "slices": pa.binary(), "first": pa.binary(), "sizes": pa.binary(), "bytes": pa.binary()}
_CONTEXTS_SQL = "bucket int, part int, entries binary, slices binary, first binary, sizes binary, bytes binary"


def _send_contexts(buckets: int, indexes: int):
    """From each part to the buckets: the bytes of contexts that it holds first and whose anchor has others.

    One more row, in a bucket of its own, carries to the last step which entries an
    earlier part holds, and which go by windows, a bit each.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _CONTEXTS.items()})
        texts, ids = _texts(left)
        found = Anchors(texts)
        answer = _answers(found, right, buckets)
        open_ = (answer & OTHERS > 0) & (answer & EARLIER == 0)
        crowded = open_ & (answer & MANY > 0)
        wanted = np.flatnonzero(open_ & ~crowded)
        first = _first_holders(found, ids)
        windows = Windows(found, texts, first, np.flatnonzero(crowded))
        one = np.zeros(len(found.entry_hash), dtype=np.int64)
        one[found.entry] = np.arange(len(found.entry))
        begin, end = _context_bounds(found, texts, one[wanted])
        content = [texts[o][b:e] for o, b, e in zip(found.owner[one[wanted]].tolist(), begin.tolist(), end.tolist(), strict=True)]
        some, cuts = _bucket_cuts(found.entry_hash[wanted], indexes)
        part = left.column("part")[0].as_py()
        slices = (((found.entry_hash[wanted] >> np.uint64(32)) * np.uint64(indexes * SLICES)) >> np.uint64(32)) % np.uint64(SLICES)
        rows = [(indexes + part, part, None, None, None, None, np.packbits(np.concatenate((answer & EARLIER > 0, crowded))).tobytes())]
        for b, k in zip(some, cuts, strict=True):
            rows.append((b, part, wanted[k].astype("<u4").tobytes(), slices[k].astype(np.uint8).tobytes(), first[wanted[k]].astype("<i8").tobytes(), (end - begin)[k].astype(np.uint8).tobytes(), b"".join(content[k])))
        for b, (members, slices) in windows.buckets(indexes).items():
            entries = (np.array(members) + len(answer)).astype("<u4")
            rows.append((b, part, entries.tobytes(), bytes(slices), windows.first[members].astype("<i8").tobytes(), bytes([LENGTH]) * len(members), b"".join(windows.content[k] for k in members)))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(_CONTEXTS.items())})

    return run


class RunLengthIndex:
    """Burrows-Wheeler transform of short strings, as runs with sampled ends.

    Strings are given in order of their documents, each ends with a separator, and equal
    suffixes are in order of their strings. ``stream`` walks every string backward through
    the runs and yields the row of each suffix; ``earlier`` tells whether an earlier
    document shares the first 50 bytes of a row's suffix.
    """

    def __init__(self, content: np.ndarray, sizes: np.ndarray, documents: np.ndarray) -> None:
        self.sizes, self.documents = sizes, documents
        ends = np.cumsum(sizes + 1)
        text = np.full(int(ends[-1]), SEPARATOR, dtype=np.uint8)
        text[np.arange(len(content)) + np.repeat(np.arange(len(sizes)), sizes)] = content
        n = len(text)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        # ranks by 8, 24 and at last 72 bytes, more than any string has
        padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : n + k]
        left = ends[owner] - np.arange(n)  # bytes up to the separator, with it
        for k in range(1, 8):  # what follows a separator doesn't count
            shorter = left == k
            key[shorter] &= ~np.uint64((1 << (8 * (8 - k))) - 1)
        by8 = self._ranks(key)
        by24 = self._ranks(self._joined(by8, (8, 16), left))
        same50 = self._joined(by24, (24, LENGTH - 24), left)
        whole = self._ranks(self._joined(by24, (24, 48), left))
        # equal suffixes stay in order of their strings
        order = (np.sort((whole << np.uint64(32)) | np.arange(n, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        before = text[order - 1]  # row of the first string's start wraps to the last separator
        change = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        run_size = np.diff(np.append(change, n))
        self.run_start, self.run_byte = change, before[change]
        by_byte = np.argsort(self.run_byte, kind="stable")
        self.run_to = np.empty(len(change), dtype=np.int64)  # where the first row of a run goes in one backward step
        self.run_to[by_byte] = np.cumsum(run_size[by_byte]) - run_size[by_byte]
        self.first_sample, self.last_sample = owner[order[change]], owner[order[change + run_size - 1]]
        self.run_of = np.repeat(np.arange(len(change), dtype=np.int32), run_size)
        # rows with the same first 50 bytes, and the first document among them
        head = same50[order]
        border = np.concatenate(([True], head[1:] != head[:-1]))
        self.range_of = (np.cumsum(border) - 1).astype(np.int32)
        self.range_first = np.minimum.reduceat(documents[owner[order]], np.flatnonzero(border))
        self.rows = n

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        sorted_ = key[order]
        out = np.empty(len(key), dtype=np.uint64)
        out[order] = np.cumsum(np.concatenate(([1], (sorted_[1:] != sorted_[:-1]).astype(np.int64))))
        return out

    @classmethod
    def _joined(cls, rank: np.ndarray, steps: tuple[int, int], left: np.ndarray) -> np.ndarray:
        """A number for the ranks at a place and ``steps`` bytes on, in their order; 0 stands beyond the separator."""
        out, width = rank, int(rank.max(initial=1)).bit_length()
        for step in steps:
            ahead = np.zeros(len(rank), dtype=np.uint64)
            ahead[:-step] = rank[step:]
            ahead[left <= step] = 0
            if int(out.max(initial=0)).bit_length() + width > 64:
                out = cls._ranks(out)
            out = (out << np.uint64(width)) | ahead
        return out

    def back(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one byte longer."""
        run = self.run_of[rows]
        return self.run_to[run] + rows - self.run_start[run]

    def stream(self):
        """(bytes from the end, strings that are so long, rows of these suffixes), from short to long."""
        strings = np.arange(len(self.sizes))
        rows = self.rows - len(strings) + strings
        for length in range(1, int(self.sizes.max(initial=0)) + 1):
            more = self.sizes[strings] >= length
            strings, rows = strings[more], self.back(rows[more])
            yield length, strings, rows

    def earlier(self, strings: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.range_first[self.range_of[rows]] < self.documents[strings]


def _earlier_windows(index: RunLengthIndex) -> np.ndarray:
    """For each string of the index a bit for each of its windows that an earlier document holds."""
    marks = np.zeros(len(index.sizes), dtype=np.uint32)
    for length, strings, rows in index.stream():
        if length >= LENGTH:
            hit = strings[index.earlier(strings, rows)]
            marks[hit] |= np.uint32(1) << (index.sizes[hit] - length).astype(np.uint32)
    return marks


_MARKS = {"part": pa.int32(), "entries": pa.binary(), "marks": pa.binary()}


def _index_contexts(table: pa.Table) -> pa.Table:
    """Answers for each context: a bit for each of its windows that an earlier document holds."""
    if not table.column("entries")[0].is_valid:  # what a part sent on to itself
        return pa.table([table.column("part"), table.column("entries"), table.column("bytes")], schema=pa.schema(_MARKS))
    column = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
    entries, slices, first, sizes = column("entries", "<u4"), column("slices", np.uint8), column("first", "<i8"), column("sizes", np.uint8)
    holder = np.repeat(np.arange(table.num_rows), [len(x) for x in entries])
    entry, slice_, document, size = np.concatenate(entries), np.concatenate(slices), np.concatenate(first), np.concatenate(sizes).astype(np.int64)
    content = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint8)
    begin = np.cumsum(size) - size
    bits = np.empty(len(entry), dtype=np.uint32)
    by_slice = np.lexsort((document, slice_))
    for order in np.split(by_slice, np.flatnonzero(np.diff(slice_[by_slice])) + 1):
        sizes_ = size[order]
        at = np.arange(sizes_.sum()) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_) + np.repeat(begin[order], sizes_)
        bits[order] = _earlier_windows(RunLengthIndex(content[at], sizes_, document[order]))
    parts, out = table.column("part").to_numpy(), {"part": [], "entries": [], "marks": []}
    for k in range(table.num_rows):
        lo, hi = np.searchsorted(holder, [k, k + 1])
        own = lo + np.flatnonzero(bits[lo:hi])
        if len(own):
            out["part"].append(int(parts[k]))
            out["entries"].append(entry[own].astype("<u4").tobytes())
            out["marks"].append(bits[own].astype("<u4").tobytes())
    return pa.table({n: pa.array(out[n], t) for n, t in _MARKS.items()})


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _mark_bytes(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Removed spans of the texts of a part, from what its buckets answered."""
    if not left.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.binary())})
    texts, ids = _texts(left)
    found = Anchors(texts)
    n = len(found.entry_hash)
    first = _first_holders(found, ids)
    answers = [(None if e is None else np.frombuffer(e, dtype="<u4"), m) for e, m in zip(right.column("entries").to_pylist(), right.column("marks").to_pylist(), strict=True)]
    flags = next((np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=2 * n).astype(bool) for e, m in answers if e is None), np.zeros(2 * n, dtype=bool))
    held, windows = flags[:n], Windows(found, texts, first, np.flatnonzero(flags[n:]))
    marks = np.zeros(n + len(windows.content), dtype=np.uint32)
    for entries, bits in answers:
        if entries is not None:
            marks[entries] |= np.frombuffer(bits, dtype="<u4")
    windows.mark(marks, first, marks[n:] > 0)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    base = np.cumsum(sizes) - sizes
    change = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
    covered = held[found.entry] | (ids[found.owner] > first[found.entry])
    full = np.flatnonzero(covered)
    begin, end = _context_bounds(found, texts, full)
    shift = base[found.owner[full]]
    np.add.at(change, begin + shift, 1)
    np.add.at(change, end + shift, -1)
    some = np.flatnonzero(~covered & (marks[found.entry] > 0))
    begin, _ = _context_bounds(found, texts, some)
    own, shift = marks[found.entry[some]], base[found.owner[some]]
    for bit in range(CHOICES):
        hit = (own >> np.uint32(bit)) & np.uint32(1) > 0
        np.add.at(change, begin[hit] + shift[hit] + bit, 1)
        np.add.at(change, begin[hit] + shift[hit] + bit + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans, kept = [], []
    for k, text in enumerate(texts):
        flags = gone[base[k] : base[k] + sizes[k]]
        if not flags.any():
            spans.append([])
            kept.append(text)
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2], strict=True)])
        kept.append(np.frombuffer(text, dtype=np.uint8)[~flags].tobytes())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})


#: Rows without an identifier come after all others and count as one document.
NO_ID = (1 << 63) - 1


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: removed byte ranges and the bytes that stay.

    Texts are judged as they came, by their UTF-8 bytes; a null text is empty; texts
    under 50 bytes lose nothing. Rows that share an identifier are one document, so they
    don't remove each other's bytes. Rows without an identifier come last, as one
    document, and have null as doc_id. Matches never cross texts. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    parts, buckets, indexes = partitions * PARTS_PER_PARTITION, partitions * BUCKETS_PER_PARTITION, partitions * INDEXES_PER_PARTITION
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quantiles = rows.agg(F.percentile_approx("i", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or []
    edges = sorted(set(quantiles))
    step = max(1, int(len(edges) ** 0.5))
    coarse = F.size(F.filter(F.array(*map(F.lit, edges[::step])), lambda e: e <= F.col("i"))) if edges else F.lit(0)
    groups = F.array(*[F.array(*map(F.lit, edges[k : k + step])) for k in range(0, len(edges), step)]) if edges else F.array(F.array(F.lit(0)))
    fine = F.size(F.filter(F.get(groups, F.col("coarse") - 1), lambda e: e <= F.col("i")))
    cut = rows.withColumn("coarse", coarse).select(F.when(F.col("coarse") == 0, 0).otherwise((F.col("coarse") - 1) * step + fine).cast("int").alias("part"), "i", "text")

    by_part = cut.groupBy("part")
    classes = by_part.applyInArrow(_send_classes(buckets), "bucket int, part int, anchors binary, contexts binary")
    answers = classes.groupBy("bucket").applyInArrow(lambda table: _answer_classes(table, most_contexts), "part int, bucket int, answer binary")
    contexts = by_part.cogroup(answers.groupBy("part")).applyInArrow(_send_contexts(buckets, indexes), _CONTEXTS_SQL)
    marks = contexts.groupBy("bucket").applyInArrow(_index_contexts, "part int, entries binary, marks binary")
    found = by_part.cogroup(marks.groupBy("part")).applyInArrow(_mark_bytes, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))

