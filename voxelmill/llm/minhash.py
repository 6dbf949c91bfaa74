"""Near-duplicate detection by consistent weighted sampling.

Texts are bags of five-word shingles weighted by TF-IDF. Improved consistent weighted
sampling draws samples whose chance to agree is the weighted Jaccard similarity; they
are grouped into bands, texts that share a band become candidates, and candidates are
verified by the weighted Jaccard similarity of their whole bags.

Texts are shingled once, into a table of bags that is bucketed by chunk: the texts that one
task read one after another. Chunks send their distinct shingles to ranges of shingles,
which add up document frequencies and send them back, so every shingle has its true
frequency, no table of them is broadcast, and the bags themselves don't move. Only bags of
candidates do; they get a table bucketed by the identifier, which all later joins use.

No group is expanded into its pairs. Texts with the same words are one class and enter
once, through the smallest identifier. In each band bucket every member is verified
against a leader, the member that meets most texts. Members that nothing connects with
it meet the others by prefixes: of two texts that are similar enough, the rarest shingles
that make up a share of the weight of one less the threshold have one in common, so pairs
without such a shingle are ruled out by proof. What shares one, and is not connected yet,
is verified. Verified links are joined to connected components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm import words
from voxelmill.session import bucketed_table, cut_lineage, drop_table, shuffle_partitions

WIDTH, THRESHOLD = 5, 0.8
#: How the queries look for near copies, in families of copies too.
COPIES = {"threshold": 0.7, "among_copies": True}
#: A pair at 0.8 shares a band with a chance of 1 - (1 - 0.8^3)^9 = 0.998, at 0.7 of 0.977.
BANDS, ROWS = 9, 3
#: Shingles after which a chunk of bags is full.
CHUNK_SHINGLES = 1 << 20
#: Text for each range of shingles, and the least when there are fewer ranges than shuffle partitions.
RANGE_BYTES, LEAST_RANGE_BYTES = 8 << 20, 1 << 18
#: Buckets of tables at most.
MOST_BUCKETS = 10_000
#: Pairs that share one copy of their smaller member's bag.
PAIRS_PER_COPY = 1024
#: Members of a bucket that meet at once, and sums of weights that bound a pair's similarity there.
BLOCK, BINS = 128, 512
#: Bytes of texts that a worker shingles at once, and shingles that it samples at once.
PORTION_BYTES, PORTION_SHINGLES = 1 << 18, 1 << 16
#: Rounding of sums of weights.
SLACK = 1e-6

_SHINGLE_BYTES = 6
_MASK = np.uint64((1 << 48) - 1)
_TABLE_BITS = 16


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles of each text in order, how often each occurs, where each text's begin, and 128-bit word-sequence keys."""
    hashes, _, _, first = words.hash_words(texts)
    made, offsets = words.shingles(hashes, first, WIDTH)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(offsets))
    packed = np.sort((owner << np.uint64(48)) | (made >> np.uint64(16)))
    new = np.concatenate(([True], packed[1:] != packed[:-1])) if len(packed) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate((at, [len(packed)])))
    begins = np.searchsorted(packed[at] >> np.uint64(48), np.arange(len(texts) + 1, dtype=np.uint64))
    # the order of words matters for the key: each hash is turned by its place in the text
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(words.mix(hashes ^ words.mix(place.astype(np.uint64) + np.uint64(salt)))))) for salt in (1, 1 << 40)]
    keys = np.column_stack([s[first[1:]] - s[first[:-1]] for s in sums]) if len(texts) else np.empty((0, 2), dtype=np.uint64)
    return packed[at] & _MASK, counts, begins, keys.view(np.int64)


def _pack(values: np.ndarray, width: int = _SHINGLE_BYTES) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _unpack(content: bytes, width: int = _SHINGLE_BYTES) -> np.ndarray:
    raw = np.frombuffer(content, dtype=np.uint8).reshape(-1, max(1, width))
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


def pack_bag(shingles: np.ndarray) -> bytes:
    """Sorted 48-bit numbers: the lower 40 bits of each as they are, the upper 8 as steps; few numbers as they are."""
    if len(shingles) < 64:
        return b"\0" + _pack(shingles).tobytes()
    steps = np.zeros(len(shingles) + 256, dtype=bool)
    steps[(shingles >> np.uint64(40)).astype(np.int64) + np.arange(len(shingles))] = True
    return b"\1" + _pack(shingles, 5).tobytes() + np.packbits(steps).tobytes()


def unpack_bag(content: bytes) -> np.ndarray:
    if not content[0]:
        return _unpack(content[1:])
    n = (len(content) - 33) * 8 // 41  # 5 bytes and a bit each, and 256 bits
    out = _unpack(content[1 : 1 + 5 * n], 5)
    steps = np.flatnonzero(np.unpackbits(np.frombuffer(content, dtype=np.uint8, offset=1 + 5 * n)))
    return out | ((steps - np.arange(n)).astype(np.uint64) << np.uint64(40))


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, chunk, key_a, key_b, bag, counts`` of texts that have a word; counts are null where every shingle occurs once."""
    chunk, held = TaskContext.get().partitionId() << 24, 0
    for batch in words.pieces(batches):
        texts = words.as_bytes(batch.column(1))
        for lo, hi in words.portions(texts, PORTION_BYTES):
            shingles, counts, begins, keys = _bags(texts[lo:hi])
            some = np.flatnonzero(np.diff(begins))
            often = [counts[begins[k] : begins[k + 1]] for k in some]
            if held > CHUNK_SHINGLES:
                chunk, held = chunk + 1, 0
            held += len(shingles)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(some)),
                    pa.array(np.full(len(some), chunk)),
                    pa.array(keys[some, 0]),
                    pa.array(keys[some, 1]),
                    pa.array([pack_bag(shingles[begins[k] : begins[k + 1]]) for k in some], type=pa.binary()),
                    pa.array([c.astype("<u4").tobytes() if c.max() > 1 else None for c in often], type=pa.binary()),
                ],
                names=["id", "chunk", "key_a", "key_b", "bag", "counts"],
            )


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all bags, one bag after another, and where each bag begins."""
    bags = [unpack_bag(x) for x in table.column("bag").to_pylist()]
    return np.concatenate(bags), np.concatenate(([0], np.cumsum([len(x) for x in bags])))


def _counts(column, begins: np.ndarray) -> np.ndarray:
    out = np.ones(int(begins[-1]), dtype=np.int64)
    for k, counts in enumerate(column.to_pylist()):
        if counts is not None:
            out[begins[k] : begins[k + 1]] = np.frombuffer(counts, dtype="<u4")
    return out


def _narrow(values: np.ndarray) -> bytes:
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _widen(content: bytes, n: int) -> np.ndarray:
    return np.frombuffer(content, dtype=f"<u{len(content) // n}")


_ASKED = {"bucket": pa.int32(), "chunk": pa.int64(), "n": pa.int32(), "first": pa.int64(), "gaps": pa.binary(), "texts": pa.binary()}


def _ask(buckets: int):
    """From a chunk to every range of shingles: its distinct ones there, as gaps, and how many of its texts hold each."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shingles, texts = np.unique(_flat(table)[0], return_counts=True)
        bucket = ((shingles >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(24)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shingles)], strict=True):
            gaps = np.diff(shingles[a:b])
            width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
            rows.append((int(bucket[a]), key[0].as_py(), b - a, int(shingles[a]), _pack(gaps, width).tobytes(), _narrow(texts[a:b])))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(_ASKED.items())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """To each chunk the document frequencies of the shingles that it sent."""
    shingles, texts = [], []
    for row in table.to_pylist():
        n, gaps = row["n"], row["gaps"]
        own = np.full(n, row["first"], dtype=np.uint64)
        own[1:] += np.cumsum(_unpack(gaps, len(gaps) // max(1, n - 1)), dtype=np.uint64)
        shingles.append(own)
        texts.append(_widen(row["texts"], n).astype(np.int64))
    _, which = np.unique(np.concatenate(shingles), return_inverse=True)
    frequency = np.bincount(which, np.concatenate(texts)).astype(np.int64)[which]
    pieces = np.split(frequency, np.cumsum([len(x) for x in shingles])[:-1])
    return pa.table([table.column("chunk"), table.column("bucket"), table.column("n"), pa.array(map(_narrow, pieces), type=pa.binary())], names=["chunk", "bucket", "n", "frequency"])


class Weights:
    """TF-IDF of shingles in a corpus of ``total`` documents.

    ``among_copies`` takes frequencies as multiples of the bag's median one, so that what a
    text shares with all its copies counts no less than the words that were edited.
    """

    def __init__(self, total: int, among_copies: bool = False) -> None:
        self.total, self.among_copies = total, among_copies

    def __call__(self, counts: np.ndarray, frequency: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if self.among_copies:
            frequency = np.maximum(1.0, frequency / np.repeat(_medians(frequency, begins), np.diff(begins)))
        return counts * (1.0 + np.log((self.total + 1.0) / (frequency + 1.0)))


def _medians(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The lower median of each bag's 32-bit values; bags must not be empty."""
    sizes = np.diff(begins)
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    packed = np.sort((owner << np.uint64(32)) | values.astype(np.uint64))
    return (packed[begins[:-1] + (sizes - 1) // 2] & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Sampler:
    """Improved consistent weighted sampling; the random variables of a shingle come from a table, addressed by a hash for each sample."""

    def __init__(self, samples: int, seed: int = 11) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        size = 1 << _TABLE_BITS
        r, c = draw.gamma(2.0, 1.0, size), draw.gamma(2.0, 1.0, size)
        self.r, self.inverse, self.log_c, self.beta = (x.astype(np.float32) for x in (r, 1 / r, np.log(c), draw.random(size)))
        self.factors = [np.uint64(int(x) * 2 + 1) for x in draw.integers(1 << 62, size=samples)]

    def __call__(self, shingles: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A row of 64-bit samples for each bag; bags must not be empty."""
        sizes = np.diff(begins)
        starts = begins[:-1]
        log_w = np.log(weights).astype(np.float32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        spread = words.mix(shingles)
        out = np.empty((len(sizes), len(self.factors)), dtype=np.uint64)
        for k, factor in enumerate(self.factors):
            z = ((spread * factor) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            beta, r = self.beta[z], self.r[z]
            t = np.floor(log_w * self.inverse[z] + beta)
            score = self.log_c[z] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(score, starts)
            hit = np.flatnonzero(score == least[owner])
            hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]
            out[:, k] = words.mix(spread[hit] ^ words.mix(t[hit].astype(np.int64).astype(np.uint64) + np.uint64(k << 32)))
        return out


def _sign(weights: Weights, fields: pa.Schema):
    """For each bag of a chunk the frequencies of its shingles and the bands of its samples."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return fields.empty_table()
        shingles, begins = _flat(left)
        right = right.sort_by("bucket")
        answers = zip(right.column("frequency").to_pylist(), right.column("n").to_pylist(), strict=True)
        distinct, which = np.unique(shingles, return_inverse=True)
        frequency = np.concatenate([_widen(x, n).astype(np.uint32) for x, n in answers])
        if len(frequency) != len(distinct):
            raise ValueError("a chunk of bags changed between two readings of its documents; write them down first")
        frequency = frequency[which]
        value = weights(_counts(left.column("counts"), begins), frequency, begins)
        sampler = Sampler(BANDS * ROWS)
        bands = np.empty((left.num_rows, BANDS), dtype=np.uint64)
        lo = 0
        while lo < left.num_rows:
            hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + PORTION_SHINGLES, side="right")) - 1)
            a, b = begins[lo], begins[hi]
            drawn = sampler(shingles[a:b], value[a:b], begins[lo : hi + 1] - a).reshape(hi - lo, BANDS, ROWS)
            hashed = drawn[:, :, 0]
            for k in range(1, ROWS):
                hashed = words.mix(hashed * np.uint64(31) + drawn[:, :, k])
            bands[lo:hi] = hashed
            lo = hi
        # of repeated rows one is enough, and rows without an identifier were only counted
        ids, keys = left.column("id").to_pylist(), left.column("key_a").to_pylist()
        one = {(i, k): at for at, (i, k) in enumerate(zip(ids, keys, strict=True)) if i is not None}
        own = [_narrow(frequency[x:y]) for x, y in itertools.pairwise(begins.tolist())]
        lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.reshape(-1).view(np.int64))
        made = pa.table([*(left.column(c) for c in ("id", "chunk", "key_a", "key_b")), lists, pa.array(own, pa.binary())], schema=fields)
        return made.take(pa.array(list(one.values()), pa.int64()))

    return run


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def weighted_bags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", among_copies: bool = False) -> tuple[DataFrame, str, Weights]:
    """``id, chunk, key_a, key_b, bands, frequency`` of every text that has a word and an identifier; the name of the table of bags; the weights.

    The table has ``id, chunk, key_a, key_b, bag, counts``: the distinct shingles in order and
    how often each occurs (null: once); ``frequency`` says in how many documents. All rows
    count as documents. Drop the table with ``session.drop_table``.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    if kind not in _KINDS:
        raise ValueError(f"{id_col!r} is {kind}; identifiers are whole numbers or strings")
    total, size = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(1, -(-size // RANGE_BYTES), min(shuffle_partitions(spark), -(-size // LEAST_RANGE_BYTES)))
    rows = source.mapInArrow(_bag_rows, f"id {kind}, chunk long, key_a long, key_b long, bag binary, counts binary")
    stored = bucketed_table(rows, "chunk", min(MOST_BUCKETS, ranges))
    bags, weights = spark.table(stored).groupBy("chunk"), Weights(total, among_copies)
    asked = bags.applyInArrow(_ask(ranges), "bucket int, chunk long, n int, first long, gaps binary, texts binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, n int, frequency binary")
    fields = pa.schema([("id", _KINDS[kind]), ("chunk", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("frequency", pa.binary())])
    signed = bags.cogroup(answered.groupBy("chunk")).applyInArrow(_sign(weights, fields), f"id {kind}, chunk long, key_a long, key_b long, bands array<long>, frequency binary")
    return cut_lineage(signed), stored, weights


def _pick(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a chunk the bags that are wanted, with the frequencies of their shingles."""
    wanted = dict(zip(zip(right.column("id").to_pylist(), right.column("key_a").to_pylist(), strict=True), right.column("frequency").to_pylist(), strict=True))
    place = {key: at for at, key in enumerate(zip(left.column("id").to_pylist(), left.column("key_a").to_pylist(), strict=True)) if key in wanted}
    made = left.select(["id", "bag", "counts"]).take(pa.array(list(place.values()), pa.int64()))
    return made.append_column("frequency", pa.array([wanted[key] for key in place], pa.binary()))


def picked_bags(ids: DataFrame, signed: DataFrame, stored: str) -> str:
    """Name of a table ``id, bag, counts, frequency`` of the distinct ``ids``, bucketed by ``id``."""
    bags = ids.sparkSession.table(stored)
    wanted = signed.select("id", "chunk", "key_a", "frequency").join(ids.hint("shuffle_hash"), "id")
    kind = ids.schema["id"].dataType.simpleString()
    picked = bags.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(_pick, f"id {kind}, bag binary, counts binary, frequency binary")
    buckets = min(MOST_BUCKETS, shuffle_partitions(ids.sparkSession))
    return bucketed_table(picked.repartition(buckets, "id"), "id", buckets)


def _decoded(bag: bytes, counts: bytes | None, frequency: bytes, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shingles = unpack_bag(bag)
    df = _widen(frequency, len(shingles)).astype(np.int64)
    return shingles, weights(1 if counts is None else np.frombuffer(counts, dtype="<u4"), df, np.array([0, len(df)])), df


def weighted_jaccard(a: tuple[bytes, bytes | None, bytes], b: tuple[bytes, bytes | None, bytes], weights: Weights) -> float:
    """Of two rows' ``bag, counts, frequency``."""
    (x, v, _), (y, w, _) = _decoded(*a, weights), _decoded(*b, weights)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = np.flatnonzero(y[at] == x)
    least = np.minimum(v[same], w[at[same]]).sum()
    return float(least / (v.sum() + w.sum() - least))


_BAG = ("bag", "counts", "frequency")


def verified(edges: DataFrame, bags: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Of the distinct pairs ``u < v``, those similar enough, with ``similarity``.

    ``meets`` says how many pairs ``u`` has, about; the bag of a busy ``u`` is copied, and its
    pairs are dealt out among the copies.
    """
    salted = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("meets") / PAIRS_PER_COPY)).cast("int").alias("salt"))
    ids = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    some = bags.select("id", *_BAG).join(ids.hint("shuffle_hash"), "id", "left_semi")
    left, right = (some.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in _BAG]) for side in ("u", "v"))
    copies = left.join(salted.select("u", "salt").distinct().hint("merge"), "u")
    one = copies.join(salted.hint("merge"), ["u", "salt"])
    both = right.join(one.hint("merge"), "v").select("u", "v", *[f"{c}_{side}" for side in ("u", "v") for c in _BAG])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            values = [weighted_jaccard(r[:3], r[3:], weights) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, type=pa.float64())], names=["u", "v", "similarity"])

    kind = edges.schema["u"].dataType.simpleString()
    return both.mapInArrow(compare, f"u {kind}, v {kind}, similarity double").where(F.col("similarity") >= threshold - SLACK / 1000)


def _prefixes(weights: Weights, threshold: float):
    """Of each bag the shingles that a similar one must share: the rarest, up to more than ``1 - threshold`` of the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            found = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(3, 6)), strict=True):
                shingles, value, df = _decoded(*row, weights)
                order = np.lexsort((shingles, df))
                sums = np.cumsum(value[order])
                found.append(shingles[order[: int(np.searchsorted(sums, (1 - threshold + SLACK) * sums[-1], side="right")) + 1]])
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *(batch.column(k).take(owner) for k in range(3))], names=["shingle", "id", "root", "open"])

    return run


def _bin_sums(weights: Weights):
    """Of each bag the sum of its weights, and sums in bins of shingles, as 16-bit floats, never too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            totals, bins = [], []
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                shingles, value, _ = _decoded(*row, weights)
                totals.append(float(value.sum()))
                bins.append(binned(shingles, value).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.float64()), pa.array(bins, pa.binary())], names=["id", "total", "bins"])

    return run


def binned(shingles: np.ndarray, value: np.ndarray) -> np.ndarray:
    sums = np.bincount((words.mix(shingles) % np.uint64(BINS)).astype(np.int64), value, BINS)
    with np.errstate(over="ignore"):
        small = sums.astype(np.float16)
    return np.where(small < sums, np.nextafter(small, np.float16(np.inf)), small)


def similarity_bound(bins_a: np.ndarray, total_a: np.ndarray, bins_b: np.ndarray, total_b: np.ndarray) -> np.ndarray:
    """No pair of a row of ``a`` and the same row of ``b`` is more similar than this: texts share at most the smaller sum of each bin."""
    least = np.minimum(bins_a, bins_b).astype(np.float64).sum(axis=1)
    least = np.minimum(least, np.minimum(total_a, total_b))
    return least / (total_a + total_b - least)


def _common(held_a: pa.ListArray, held_b: pa.ListArray, below: int | None = None) -> np.ndarray:
    """Which rows of ``a`` and ``b`` hold a common number, smaller than ``below`` if that is given."""
    sides = [(held.flatten().to_numpy(), np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())) for held in (held_a, held_b)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    if below is not None:
        common = common[common < below]
    marks = []
    for held, (values, owner) in zip((held_a, held_b), sides, strict=True):
        both = np.isin(values, common)
        mark = np.zeros((len(held), len(common)), dtype=np.float32)
        mark[owner[both], np.searchsorted(common, values[both])] = 1
        marks.append(mark)
    return marks[0] @ marks[1].T > 0


def _apart(threshold: float):
    """Of two blocks of a bucket, the pairs in different components, one of them open, that share a prefix's shingle, meet in no bucket of a smaller number and aren't ruled out by the bound."""

    def unpack(block: pa.StructArray):
        root, open_, total = (block.field(k).to_numpy(zero_copy_only=False) for k in ("root", "open", "total"))
        return block.field("id"), root, open_, total, np.frombuffer(b"".join(block.field("bins").to_pylist()), dtype=np.float16).reshape(len(root), BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ids, root_a, open_a, total_a, bins_a), (jds, root_b, open_b, total_b, bins_b) = (unpack(batch.column(c)[k].values) for c in (0, 1))
                meet = (root_a[:, None] != root_b[None, :]) & (open_a[:, None] | open_b[None, :]) & (np.minimum(total_a[:, None], total_b[None, :]) >= (threshold - SLACK) * np.maximum(total_a[:, None], total_b[None, :]))
                a, b = (batch.column(c)[k].values for c in (0, 1))
                if meet.any():
                    meet &= ~_common(a.field("buckets"), b.field("buckets"), batch.column(2)[k].as_py())
                if not meet.any():
                    continue
                x, y = np.nonzero(meet & _common(a.field("held"), b.field("held")))
                # a bound that isn't a number is no proof
                left = ~(similarity_bound(bins_a[x], total_a[x], bins_b[y], total_b[y]) < threshold - 1e-4)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[left])), jds.take(pa.array(y[left]))], names=["a", "b"])

    return run


def with_leaders(members: DataFrame) -> DataFrame:
    """``members`` with the ``leader`` of each bucket: the member that meets most texts in all its buckets, as the origin of a family does."""
    # a text has a cell in each band, so no window is large
    met = members.withColumn("met", F.sum("members").over(Window.partitionBy("id")))
    first = met.groupBy("band", "cell").agg(F.max(F.struct("met", F.xxhash64("id").alias("by"), "id")).alias("first"))
    return members.join(first.hint("merge"), ["band", "cell"]).select("band", "cell", "id", "members", F.col("first.id").alias("leader"))


def stars(members: DataFrame) -> DataFrame:
    """Distinct pairs of a leader ``u`` and a member ``v`` of its bucket; ``meets`` as ``verified`` takes it."""
    return members.where("id <> leader").groupBy(F.col("leader").alias("u"), F.col("id").alias("v")).agg(F.max("members").alias("meets"))


def unconnected(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, cell, id`` of the members that nothing connects with their leader."""
    own = members.where("id <> leader and members > 2").join(roots.select(F.col("node").alias("id"), F.col("root").alias("own")), "id", "left")
    both = own.join(roots.select(F.col("node").alias("leader"), F.col("root").alias("other")), "leader", "left")
    return both.where(F.coalesce("own", "id") != F.coalesce("other", "leader")).select("band", "cell", "id")


def left_over(members: DataFrame, star: DataFrame, roots: DataFrame, bags: DataFrame, weights: Weights, threshold: float) -> DataFrame | None:
    """Distinct pairs ``u < v``, ``meets`` of members that share a bucket's fate, are not in ``star`` and may be similar enough though they aren't connected.

    A member that nothing connects with its leader is open. Open members and all others of
    their buckets are grouped by the shingles of their prefixes. Those in groups that hold
    an open one and several components go back to their buckets, where blocks of them meet.
    """
    unmatched = cut_lineage(unconnected(members, roots))
    if unmatched.isEmpty():
        return None
    near = cut_lineage(members.join(unmatched.select("band", "cell").distinct(), ["band", "cell"], "left_semi").select("id", F.xxhash64("band", "cell").alias("bucket")))
    marked = near.select("id", F.lit(False).alias("open")).unionByName(unmatched.select("id", F.lit(True).alias("open"))).groupBy("id").agg(F.max("open").alias("open"))
    placed = marked.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.xxhash64(F.coalesce("root", "id")).alias("root"), "open")
    kind = members.schema["id"].dataType.simpleString()
    prefixes = cut_lineage(
        bags.select("id", *_BAG).join(placed.hint("shuffle_hash"), "id").select("id", "root", "open", *_BAG).mapInArrow(_prefixes(weights, threshold), f"shingle long, id {kind}, root long, open boolean")
    )
    groups = prefixes.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("open").alias("some")).where("some and lo <> hi").select("shingle")
    inside = cut_lineage(prefixes.join(groups.hint("merge"), "shingle").groupBy("id", "root", "open").agg(F.collect_list("shingle").alias("held")))
    sums = bags.select("id", *_BAG).join(inside.select("id").hint("shuffle_hash"), "id", "left_semi").mapInArrow(_bin_sums(weights), f"id {kind}, total double, bins binary")
    dealt = near.join(inside.select("id"), "id")
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed_in = dealt.join(sizes.hint("merge"), "bucket").groupBy("id").agg(F.collect_list(F.struct("bucket", "n")).alias("dealt"))
    texts = inside.join(sums, "id").join(placed_in, "id").select("id", "root", "open", "total", "bins", "held", F.col("dealt.bucket").alias("buckets"), F.explode("dealt").alias("at"))
    blocks_of = F.ceil(F.col("at.n") / BLOCK).cast("int")
    blocks = cut_lineage(
        texts.groupBy(F.col("at.bucket").alias("bucket"), blocks_of.alias("blocks"), F.pmod(F.xxhash64("id"), blocks_of).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("id", "root", "open", "total", "bins", "held", "buckets")).alias("group"))
    )
    asking = blocks.select("bucket", F.col("group").alias("asked"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    pairs = asking.join(blocks.select("bucket", "block", "group"), ["bucket", "block"]).select("asked", "group", "bucket").mapInArrow(_apart(threshold), f"a {kind}, b {kind}")
    tried = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    apart = cut_lineage(pairs.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().join(tried.hint("merge"), ["u", "v"], "left_anti"))
    return apart.join(apart.groupBy("u").agg(F.count(F.lit(1)).alias("meets")), "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``; the root is the smallest node it is connected with.

    Rounds of large and small stars until every component is a star around its smallest
    node; each round is written to the checkpoint folder.
    """
    edges = cut_lineage(edges.select("u", "v").where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # in a star the smaller ends of a node's edges are all the same node
        least = cut_lineage(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.max(F.least("u", "v")).alias("most")))
        if least.where("m <> most").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        down = both.join(least.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut_lineage(small.where("u <> v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, among_copies: bool = False) -> DataFrame:
    """One row per document: ``doc_id, copy_of, class_id, class_size, kept``.

    ``copy_of`` is the smallest identifier of the texts with the same words in the same
    order, ``class_id`` the smallest of all that verified links connect; the document
    with that identifier is ``kept``. Texts without words and rows without an
    identifier have no duplicates: they are classes of their own. Repeated rows are
    copies; rows that share an identifier count as one document. Identifiers are whole
    numbers or strings. An empty table gives an empty result, other columns are ignored.
    ``among_copies`` weights shingles as ``Weights`` says.
    """
    spark = docs.sparkSession
    signed, stored, weights = weighted_bags(docs, id_col, text_col, among_copies)
    reps = cut_lineage(signed.groupBy("key_a", "key_b").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")))
    cells = reps.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "cell"))
    shared = cells.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = cut_lineage(cells.join(shared.hint("merge"), ["band", "cell"]).select("band", "cell", "id", "members"))
    members = cut_lineage(with_leaders(members))
    star = cut_lineage(stars(members))
    candidates = picked_bags(members.select("id").distinct(), signed, stored)
    drop_table(spark, stored)
    bags = spark.table(candidates)
    links = cut_lineage(verified(star, bags, weights, threshold).select("u", "v"))
    roots = components(links)
    apart = left_over(members, star, roots, bags, weights, threshold)
    if apart is not None:
        more = verified(apart, bags, weights, threshold).select("u", "v")
        # the stars found so far stand for the links they were made of
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    copies = signed.select(F.col("id").alias("doc_id"), "key_a", "key_b").join(reps.select("key_a", "key_b", "rep"), ["key_a", "key_b"]).select("doc_id", "rep")
    # rows that share an identifier take the smallest class
    classed = copies.join(roots, copies["rep"] == roots["node"], "left").groupBy("doc_id").agg(F.min("rep").alias("copy_of"), F.min(F.coalesce("root", "rep")).alias("class_id"))
    rows = docs.select(F.col(id_col).alias("doc_id")).join(classed, "doc_id", "left").select("doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("class_id", "doc_id").alias("class_id"))
    # both sides are written first, so that the join can split the rows of a large class
    rows = cut_lineage(rows)
    drop_table(spark, candidates)
    sizes = cut_lineage(rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).where("class_id is not null"))
    return rows.join(sizes, "class_id", "left").select("doc_id", "copy_of", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, among_copies: bool = False) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows without an identifier and texts without words stay; of rows that share the
    identifier that stays, all stay. An empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col, threshold, among_copies)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
