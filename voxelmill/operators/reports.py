"""Aggregations and reports over series, quality cells, files and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions.text import is_truthy_low

NO_REASON = "未提供原因"


def series_summary(df: DataFrame, folder: str, position: str, columns: list[str]) -> DataFrame:
    """Rows of each folder, and the columns of its first row."""
    first = F.min_by(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]), F.col(position))
    return df.groupBy(folder).agg(F.count(F.lit(1)).alias("file_count"), first.alias("_first")).select(folder, "file_count", "_first.*")


def column_widths(df: DataFrame) -> DataFrame:
    """Display width of each column: longest text or heading plus 2, at most 50."""
    longest = df.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(c))) + 2, F.lit(50)).alias("width")) for c in df.columns])
    return longest.select(F.explode(pairs).alias("p")).select("p.*")


def accession_quality(cells: DataFrame) -> DataFrame:
    """Totals and low counts by accession and file, and by accession alone (file null), in one pass."""
    low = is_truthy_low(F.col("low_raw"))
    return cells.rollup("accession", "file").agg(F.count(F.lit(1)).alias("total"), F.count_if(low).alias("low"), F.grouping_id().alias("level")).where("level < 3").drop("level")


def reason_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit(NO_REASON))
    return cells.where(is_truthy_low(F.col("low_raw"))).groupBy(*keys, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def global_report(cells: DataFrame) -> DataFrame:
    totals = cells.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_truthy_low(F.col("low_raw"))).alias("low"))
    return totals.select("total", "low", F.greatest(F.col("total") - F.col("low"), F.lit(0)).alias("normal"), percent(F.col("low"), F.col("total")).alias("low_percent"))


def reason_bars(cells: DataFrame) -> DataFrame:
    """Reasons of all accessions with their share of the largest; there are as many rows as reasons."""
    counts = reason_counts(cells, [])
    return counts.select("reason", "n", F.round(100.0 * F.col("n") / counts.agg(F.max("n")).scalar(), 1).alias("bar"))


def top_reason(cells: DataFrame, key: str = "accession") -> DataFrame:
    """The most frequent reason of each key; of equals the first by name."""
    counts = reason_counts(cells, [key])
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "reason")).alias("b")).select(key, F.col("b.reason").alias("reason"), (-F.col("b.m")).alias("n"))


def batch_distribution(cells: DataFrame, fixed: Column, normal: Column, low: Column) -> DataFrame:
    """Rows by state; fixed goes before normal, normal before low, the rest is unknown."""
    state = F.when(fixed, "fixed").when(normal, "normal").when(low, "low").otherwise("unknown")
    return cells.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def transfer_statistics(transfers: DataFrame, key: str) -> DataFrame:
    """Megabytes, seconds and their ratio; no seconds give no rate."""
    sums = transfers.groupBy(key).agg(F.sum("bytes").alias("b"), F.sum("seconds").alias("s"))
    return sums.select(key, (F.col("b") / 1048576).alias("mb"), F.col("s").alias("seconds"), F.try_divide(F.col("b") / 1048576, F.col("s")).alias("mb_per_s"))


def failure_summary(failures: DataFrame, key: str, most: int = 2) -> DataFrame:
    tries = failures.groupBy(key).agg(F.count(F.lit(1)).alias("tries"))
    return tries.agg(F.count(F.lit(1)).alias("failed"), F.count_if(F.col("tries") < most).alias("retryable"), F.count_if(F.col("tries") >= most).alias("permanent"))


def plane_of_counts(axial: Column, sagittal: Column, coronal: Column) -> Column:
    """The axis with fewest slices; of equals axial, then sagittal."""
    options = [F.struct(n.alias("n"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (n, name) in enumerate(((axial, "axial"), (sagittal, "sagittal"), (coronal, "coronal")))]
    return F.array_min(F.array(*options))["name"]


def merged_sheets(sheets: dict[str, DataFrame], key: str = "accession") -> DataFrame:
    """Sheets of several accessions under one another; columns that some lack are null, the accession is set anew."""
    out = None
    for name, sheet in sheets.items():
        own = sheet.withColumn(key, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def sheet_cleanup(items: DataFrame, size: str, accessed: str, target: float, threshold: float) -> DataFrame:
    """What to delete, oldest access first, until enough has gone; nothing while the total is under the threshold.

    The running sum goes by days first and then inside the one day that crosses the line,
    so no task sorts all items.
    """
    day = F.to_date(accessed)
    days = items.groupBy(day.alias("_day")).agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("_day", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_day").orderBy(accessed, "item").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0.0))
    return (
        items.withColumn("_day", day).join(F.broadcast(starts), "_day").withColumn("_gone", gone).where((F.col("_total") >= threshold) & (F.col("_gone") < F.col("_total") - target)).drop("_day", "_before", "_total", "_gone")
    )
