"""Exact dedup by content sort.

Rows are range-partitioned on their normalised bytes by sampled splitters, sorted
inside each range so that equal texts are adjacent, and compared in full with
their neighbours; of equal texts the row with the smallest identifier stays.

Skew: a text held by more than ``rows / (4 * partitions)`` rows is salted into
pieces of about that size. There are at most ``4 * partitions`` such texts and
``8 * partitions`` pieces, so the two lookups that find and rejoin them are
broadcast with a known bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.session import shuffle_partitions

#: Runs of the six ASCII white-space characters that are not one plain space already.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Characters of the text at the head of the sort key; the bytes after them are compared too.
HEAD_CHARS = 64
#: A text is salted from this many rows on, however small the table is.
LEAST_HOT_ROWS = 64


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Mark the row that stays of every group of equal texts.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``
    and, if ``carry`` is given, a struct ``carried`` with those input columns.

    * null texts equal empty ones;
    * a null identifier sorts after all others; ``keep_id`` is null only if the whole group has none;
    * of repeated rows (same identifier, same text) exactly one has ``kept``;
    * an empty table gives an empty result; other columns of the input are ignored.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text, norm = F.col(text_col), normalised(F.col(text_col))
    columns = [F.col(id_col).alias("doc_id"), norm.alias("norm")]
    if carry is not None:
        # the text itself travels only where it differs from its normalised form
        columns += [F.struct(*[F.col(c) for c in carry if c != text_col]).alias("rest"), F.when(text != norm, text).alias("raw"), text.isNull().alias("no_text")]
    keyed = docs.select(*columns).withColumn("h", F.xxhash64("norm"))

    limit = max(LEAST_HOT_ROWS, docs.count() // (4 * parts))
    hot = docs.select(F.xxhash64(norm).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > limit)
    salted = keyed.join(F.broadcast(hot), "h", "left").withColumn(
        "salt", F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("copies") / limit))).cast("long")
    )
    ranged = salted.withColumn("head", F.substring("norm", 1, HEAD_CHARS)).repartitionByRange(parts, "head", "h", "salt")

    run = Window.partitionBy("head", "h", "salt", "norm").orderBy(F.col("doc_id").asc_nulls_last())
    marked = (
        ranged.withColumn("place", F.row_number().over(run))
        .withColumn("run_first", F.first("doc_id").over(run))
        .withColumn("run_rows", F.count(F.lit(1)).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    # the pieces of a salted text meet again, one row for each
    pieces = marked.where(F.col("copies").isNotNull() & (F.col("place") == 1)).groupBy("h", "norm").agg(
        F.min("run_first").alias("keep_all"), F.sum("run_rows").alias("rows_all"), F.collect_list(F.struct("salt", "run_first")).alias("pieces")
    )
    joined = pieces.select(F.col("h").alias("p_h"), "keep_all", "rows_all", F.explode("pieces").alias("p"))
    whole = marked.join(
        F.broadcast(joined),
        (F.col("h") == F.col("p_h")) & (F.col("salt") == F.col("p.salt")) & F.col("run_first").eqNullSafe(F.col("p.run_first")) & F.col("copies").isNotNull(),
        "left",
    )
    keep_id = F.when(F.col("p_h").isNotNull(), F.col("keep_all")).otherwise(F.col("run_first"))
    out = [
        F.col("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("rows_all", "run_rows").cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"),
    ]
    if carry is not None:
        own = F.when(~F.col("no_text"), F.coalesce("raw", "norm"))
        out.append(F.struct(*[(own if c == text_col else F.col("rest")[c]).alias(c) for c in carry]).alias("carried"))
    return whole.select(*out)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return exact_dedup(docs, id_col, text_col, carry=docs.columns).where("kept").select("carried.*")


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
  sha256(norm) AS text_sha256
FROM n
"""
