"""Sharding by sampled splitters.

Size-weighted samples of the record keys give quantile boundaries; records are
range-partitioned by them, ranges that turn out overfull are subdivided with
samples of their own, and exact totals of the ranges place every group of equal
texts in a shard, so that all shards get the same share of bytes.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.session import cut_lineage

_LEAST = -(1 << 63)

#: Bytes that every record takes besides its text.
RECORD_BYTES = 16
#: Ranges per shard; more ranges make smaller tasks, not other shards.
RANGES_PER_SHARD = 8
#: Keys drawn for each range: the sample on the driver holds ranges * draws keys.
DRAWS_PER_RANGE = 16
#: A range is overfull beyond so many times the mean of bytes or rows.
OVERFULL = 3.0
#: Rounds of subdivision; what stays overfull after them are repeated rows.
ROUNDS = 2
#: Groups of equal texts beyond this part of a shard's share are placed one by one: 64 * shards at most.
HEAVY = 1 / 64


def _range_of(key: Column, bounds: list[tuple[str, int]]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def literal(b: tuple[str, int]) -> Column:
        return F.struct(F.lit(b[0]).alias("h"), F.lit(b[1]).cast("long").alias("i"))

    at_most = lambda rows: F.size(F.filter(F.array(*map(literal, rows)), lambda b: b <= key))
    first = at_most([g[0] for g in groups])
    fine = F.array(*[F.array(*map(literal, g)) for g in groups])
    inside = F.size(F.filter(F.get(fine, first - 1), lambda b: b <= key))
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * step + inside)


def _draw(rows: DataFrame, weight: Column, total: float, size: int, seed: str) -> list[tuple[str, int]]:
    """About ``size`` keys, each drawn with a chance in proportion to its weight, by a hash; ``total`` is the weight of all."""
    u = F.pmod(F.xxhash64("h", "i", "size", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return [(r["h"], r["i"]) for r in rows.where(u < weight * F.lit(size / total)).select("h", "i").collect()]


def _quantiles(keys: list[tuple[str, int]], pieces: int) -> list[tuple[str, int]]:
    keys = sorted(keys)
    return sorted({keys[len(keys) * k // pieces] for k in range(1, pieces)}) if keys else []


def _place(heavy: list[tuple[str, int]], all_bytes: int, shards: int) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """Pieces (text, number, bytes of a piece, shard) of heavy groups, and what every shard still takes of the others.

    The largest piece goes to the emptiest shard, again and again; only a group that
    exceeds a shard's share has more than one piece.
    """
    share = max(1, -(-all_bytes // shards))
    pieces = []
    for h, size in heavy:
        n = -(-size // share)
        pieces += [(-(-size // n), h, k) for k in range(n)]
    filled = [(0, s) for s in range(shards)]
    placed = []
    for size, h, k in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        held, shard = heapq.heappop(filled)
        heapq.heappush(filled, (held + size, shard))
        placed.append((h, k, size, shard))
    # the rest fills all shards to one level
    rest, level = all_bytes - sum(size for _, size in heavy), 0.0
    for n, (held, _) in enumerate(sorted(filled), 1):
        if n == 1 or held < level:
            level = (rest + sum(x for x, _ in sorted(filled)[:n])) / n
    return placed, [max(0, int(level - held)) for held, _ in sorted(filled, key=lambda x: x[1])]


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every record to one of ``shards`` shards of near equal bytes; equal texts share a shard.

    Returns ``doc_id, size, text_crc32, shard, slot``. The size of a record is its
    UTF-8 bytes plus 16 (null text: 16, and equal to the empty text). Groups of equal
    texts that take more than a 64th of a shard's share are placed first, the largest in
    the emptiest shard; all others follow each other in order of the md5 of their text and
    fill the shards to one level, so a shard is off its level by less than one such group.
    A group that exceeds a whole share can't stay together: it is cut into as few equal
    pieces as fit. Slots count from 0 in every shard. Identifiers keep their type; rows
    without one are records too; repeated rows are separate records; an empty table gives
    an empty result; other columns are ignored.

    Only key, size and checksum leave the scan. The sample on the driver has about
    ``shards * 8 * 16`` keys, the table of ranges some thousand rows, that of heavy groups
    ``shards * 64`` at most.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = cut_lineage(
        docs.select(
            F.md5(text.cast("binary")).alias("h"),
            F.col(id_col).alias("doc_id"),
            # any order inside a group will do, if it tells rows apart
            F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(id_col)).alias("i"),
            (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    totals = records.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    all_bytes, all_rows = totals["bytes"] or 0, totals["rows"] or 1
    groups = records.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > F.lit(all_bytes / shards * HEAVY))
    heavy = {r["h"]: r["bytes"] for r in groups.collect()}
    ranges = shards * RANGES_PER_SHARD
    # by size, and half of it by count, so that a range is bounded in rows as well
    weight = F.col("size") / F.lit(float(max(all_bytes, 1))) + F.lit(1.0 / all_rows)
    # only heavy groups are cut by the ends of ranges
    whole = lambda bounds: sorted({(h, i if h in heavy else _LEAST) for h, i in bounds})
    bounds = whole(_quantiles(_draw(records, weight, 2.0, ranges * DRAWS_PER_RANGE, "0"), ranges))
    key = F.struct(F.col("h"), F.col("i"))
    for round_ in range(1, ROUNDS + 1):
        filled = records.groupBy(_range_of(key, bounds).alias("range")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        overfull = (
            filled.withColumn("times", F.greatest(F.col("bytes") * ranges / F.lit(float(max(all_bytes, 1))), F.col("rows") * ranges / F.lit(float(all_rows))))
            .where((F.col("times") > OVERFULL) & (F.col("rows") > DRAWS_PER_RANGE))
            .select("range", "times", "bytes", "rows")
            .collect()
        )
        finer = set(bounds)
        if overfull:
            inside = records.where(_range_of(key, bounds).isin([r["range"] for r in overfull]))
            pieces = int(sum(r["times"] for r in overfull)) + len(overfull)
            share = sum(r["bytes"] / max(all_bytes, 1) + r["rows"] / all_rows for r in overfull)
            finer |= set(whole(_quantiles(_draw(inside, weight, share, pieces * DRAWS_PER_RANGE, str(round_)), pieces)))
        if len(finer) == len(bounds):
            break
        bounds = sorted(finer)

    # bytes and rows before every record: of all records for heavy groups, of the others among themselves
    placed, room = _place(sorted(heavy.items()), all_bytes, shards)
    told = json.dumps([{"h": h, "piece_bytes": size, "piece": k, "shard": shard} for h, k, size, shard in placed])
    pieces = F.from_json(F.lit(told), "array<struct<h:string,piece_bytes:long,piece:int,shard:int>>")
    sizes = spark.range(1).select(F.explode(pieces).alias("p")).select("p.*")  # without Python workers
    is_heavy = sizes.where("piece = 0").select("h", "piece_bytes")
    ranged = records.join(F.broadcast(is_heavy), "h", "left").withColumn("range", _range_of(key, bounds)).withColumn("light", F.col("piece_bytes").isNull())
    counted = ranged.select("*", F.when(F.col("light"), F.col("size")).otherwise(0).alias("b"), F.col("light").cast("long").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy("range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    starts = sums.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("size", "rows", "b", "n")])
    inner = Window.partitionBy("range").orderBy("h", "i", "doc_id")
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "h").orderBy("i", "doc_id")
    at = (
        counted.join(F.broadcast(starts), "range")
        .withColumn("all_begin", F.col("size_before") + F.sum("size").over(so_far) - F.col("size"))
        .withColumn("begin", F.col("b_before") + F.sum("b").over(so_far) - F.col("b"))
        .withColumn("rank", F.when(F.col("light"), F.col("n_before") + F.sum("n").over(so_far)).otherwise(F.col("rows_before") + F.row_number().over(inner)))
        .withColumn("group_begin", F.first("begin").over(group))
    )
    at = cut_lineage(at.select("doc_id", "h", "size", "text_crc32", "light", "piece_bytes", "all_begin", "group_begin", "rank"))
    heads = at.where(~F.col("light")).groupBy("h").agg(F.min("all_begin").alias("head"))
    ends = [sum(room[: k + 1]) for k in range(shards)]
    filled_by = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("group_begin"))), F.lit(max((k for k in range(shards) if room[k]), default=0)))
    dealt = (
        at.join(F.broadcast(heads), "h", "left")
        .withColumn("piece", F.floor((F.col("all_begin") - F.col("head")) / F.col("piece_bytes")).cast("int"))
        .join(F.broadcast(sizes.select("h", "piece", F.col("shard").alias("own"))), ["h", "piece"], "left")
        .withColumn("shard", F.coalesce("own", filled_by).cast("int"))
        # a shard's rows come in runs: its light groups, and each of its pieces
        .withColumn("run", F.when(F.col("light"), F.lit("")).otherwise(F.concat_ws(":", "h", "piece")))
    )
    runs = dealt.groupBy("shard", "run").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("rows"))
    offset = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("shard", "run", "first_rank", offset.alias("offset"))
    return dealt.join(F.broadcast(runs), ["shard", "run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - F.col("first_rank")).cast("long").alias("slot"))
