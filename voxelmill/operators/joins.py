"""Joins between series, files, records and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order, as repeated answers overwrite each other."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_row")).select(key, "_row.*")


def routed(files: DataFrame, folders: DataFrame, fallback: str) -> DataFrame:
    """Each file's folder by its series, or the fallback."""
    return files.join(folders, "series_key", "left").withColumn("folder", F.coalesce("folder", F.lit(fallback)))


def by_position(left: DataFrame, right: DataFrame, key: str, order_left: str, order_right: str) -> DataFrame:
    """Join the k-th rows of both sides inside each key; the left side keeps all its rows."""
    numbered = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return numbered(left, order_left).join(numbered(right, order_right), [key, "_n"], "left").drop("_n")


def overlaid(base: Column, over: Column) -> Column:
    """Two maps merged; the second wins. Needs no session setting for repeated keys."""
    return F.map_zip_with(base, over, lambda _, a, b: F.coalesce(b, a))


def pending(requested: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return requested.join(completed, key, "left_anti")


def resumed(requested: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return requested.join(completed, key, "left_semi")


def not_in_use(items: DataFrame, active: DataFrame, name: str, task: str) -> DataFrame:
    """Items whose name holds no active task's identifier.

    Names start with their task's identifier up to the first underscore or are it; the
    equi-join on that part takes the place of comparing every item with every task.
    """
    return items.join(active.select(F.col(task).cast("string").alias("_task")).distinct(), F.split_part(F.col(name), F.lit("_"), F.lit(1)) == F.col("_task"), "left_anti")


def not_named(items: DataFrame, active: DataFrame, name: str, task: str) -> DataFrame:
    """Items whose name holds no active task's identifier anywhere.

    The parts of a name that are as long as some identifier meet the identifiers in an
    equi-join, so that no item is compared with every task. The lengths are collected:
    there are no more of them than the longest name has characters. An empty identifier
    is in every name, a null one in none; items without a name stay.
    """
    tasks = active.select(F.col(task).cast("string").alias("_task")).where(F.col("_task").isNotNull()).distinct()
    longest = items.agg(F.max(F.length(name))).first()[0] or 0
    sizes = [r[0] for r in tasks.select(F.length("_task").alias("n")).where(F.col("n") <= longest).distinct().collect()]
    if not sizes:
        return items
    def parts_of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(name) - max(n, 1) + 1), lambda p: F.substring(F.col(name), p, F.lit(n)))
        return F.when(F.length(name) >= max(n, 1), cut).otherwise(F.array().cast("array<string>"))

    parts = [parts_of(n) for n in sorted(sizes)]
    if 0 in sizes:
        parts.append(F.array(F.lit("")))
    named = items.select(name).distinct().select(F.col(name).alias("_name"), F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("_task"))
    used = named.join(tasks, "_task", "left_semi").select("_name").distinct()
    return items.join(used, F.col(name) == F.col("_name"), "left_anti")


def matched_stems(books: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """For each image the workbook of the same stem, else the first, by stem, where one stem holds the other, inside ``key``."""
    exact = images.join(books.select(key, F.col("stem").alias("book")), (images[key] == books[key]) & (images["stem"] == F.col("book")), "left").drop(books[key])
    left = exact.where("book is null").drop("book")
    near = left.join(books.select(F.col(key).alias("_k"), F.col("stem").alias("book")), (F.col(key) == F.col("_k")) & (F.contains("stem", F.col("book")) | F.contains("book", F.col("stem"))), "left").drop("_k")
    first = near.groupBy(*left.columns).agg(F.min("book").alias("book"))
    return exact.where("book is not null").unionByName(first)


def checked(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Counts of verified and corrupted files among those with a checksum, and the first five corrupted names."""
    joined = files.join(checksums.select("path", F.col("md5").alias("_md5")), "path").select("path", (F.col("md5") == F.col("_md5")).alias("_same"))
    counts = joined.agg(F.count_if("_same").alias("verified"), F.count_if(~F.col("_same")).alias("corrupted"))
    five = joined.where(~F.col("_same")).orderBy("path").limit(5)
    return counts.crossJoin(five.agg(F.concat_ws(",", F.array_sort(F.collect_list("path"))).alias("first_corrupted")))


def resolved_thresholds(keys: DataFrame, overrides: DataFrame, defaults: DataFrame, fallback: DataFrame) -> DataFrame:
    """Threshold by modality and name: an override, else the modality's default, else the global one.

    All three tables hold settings: dozens of rows.
    """
    o = overrides.select("modality", "name", F.col("value").alias("_o"))
    d = defaults.select("modality", "name", F.col("value").alias("_d"))
    g = fallback.select("name", F.col("value").alias("_g"))
    return keys.join(o, ["modality", "name"], "left").join(d, ["modality", "name"], "left").join(g, "name", "left").select(*keys.columns, F.coalesce("_o", "_d", "_g").alias("value"))


def slice_rows(volumes: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """For each slice of a volume of ``n_slices`` its record, wrapping round when there are fewer."""
    ranked = records.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(key)))
    sizes = ranked.groupBy(key).agg(F.first("_of").alias("_size"))
    slices = volumes.select(key, F.explode(F.sequence(F.lit(0), F.col("n_slices").cast("int") - 1)).alias("z")).join(sizes, key)
    return slices.withColumn("_n", (F.col("z") % F.col("_size")).cast("int")).join(ranked.drop("_of"), [key, "_n"]).drop("_n", "_size")


def cloned_entries(outputs: DataFrame, entries: DataFrame) -> DataFrame:
    """For NPZ files the entry of the volume they were made of, ``.nii.gz`` before ``.nii``; files with an entry of their own are left out."""
    stem = outputs.select("file", F.regexp_replace("file", r"\.npz$", "").alias("_stem")).join(entries.select("file"), "file", "left_anti")
    own = entries.select(F.regexp_replace("file", r"\.nii(\.gz)?$", "").alias("_stem"), F.struct(F.when(F.endswith("file", F.lit(".gz")), 0).otherwise(1).alias("_rank"), "entry").alias("_e")).where(entries["file"].rlike(r"\.nii(\.gz)?$"))
    return stem.join(own, "_stem").groupBy("file").agg(F.min("_e").alias("_e")).select("file", "_e.entry")


def existing(wanted: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """Outputs that the listing has."""
    return wanted.join(listing.select(key).distinct(), key, "left_semi")


def storage_class(modality: Column) -> Column:
    # Storage classes of the standard; MR stands for all others.
    classes = {"CT": "1.2.840.10008.5.1.4.1.1.2", "MR": "1.2.840.10008.5.1.4.1.1.4", "PT": "1.2.840.10008.5.1.4.1.1.128", "NM": "1.2.840.10008.5.1.4.1.1.20"}
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(modality)), F.lit(classes["MR"]))
