"""Flows of stages that a rerun takes up where they stopped, and tables replaced one of many."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions import pixels as P
from voxelmill.operators.barrier import settled

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def fingerprint(table: DataFrame) -> str:
    """A digest of a table's schema and rows, whatever their order; one pass that sums two hashes of each row."""
    columns = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in table.columns]
    hashes = [F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)") for seed in (1, 2)] if columns else [F.lit(0), F.lit(0)]
    told = table.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(hashes)]).first()
    return hashlib.sha256(repr((table.schema.jsonValue(), *told)).encode()).hexdigest()[:32]


def run_stages(source: DataFrame, stages: list[Stage], folder: str, key: str | None = None) -> DataFrame:
    """Apply the stages one after another, each to what the one before wrote below ``folder``.

    A stage is done when Spark's writer has put its mark. A rerun on the same rows with
    the same stages begins at the first stage after the last one done; on other rows it
    begins anew in a place of its own. What a stage read is deleted once the stage is
    done, so that one stage's rows are kept at a time. Stages are known by their names:
    one that now does something else needs another name or folder. ``key`` takes the
    place of the rows' fingerprint where the caller knows what the stages read.
    """
    spark = source.sparkSession
    names = [name for name, _ in stages]
    key = hashlib.sha256(repr((key if key is not None else fingerprint(source), names)).encode()).hexdigest()[:32]
    places = [f"{folder}/{key}/{k}-{re.sub(r'[^A-Za-z0-9]+', '-', name)}" for k, name in enumerate(names)]
    done = max((k for k, place in enumerate(places) if exists(spark, f"{place}/_SUCCESS")), default=-1)
    for k in range(done + 1, len(stages)):
        rows = source if k == 0 else spark.read.parquet(places[k - 1])
        stages[k][1](rows).write.mode("overwrite").parquet(places[k])
        if k:
            delete(spark, places[k - 1])
    return spark.read.parquet(places[-1]) if stages else source


def replace_tables(rows: DataFrame, folder: str, table: str = "sheet") -> None:
    """Put the tables that ``rows`` hold, by their column ``table``, in the place of those of the same names; others keep their files."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(table).parquet(folder)


def apply_fixes(images: DataFrame, orientation: Column, photometric: Column) -> DataFrame:
    """Mend images of ``data, n_rows, n_cols`` where the flags ask for it.

    Adds ``fixed`` (values), ``fixes`` (names of the fixes that were made, in their order)
    and ``errors`` (``fix: why`` of those that could not be made); an image with an error
    keeps its values and has no fixes, as if it had not been touched. A missing flag asks
    for nothing.
    """
    data = F.col("data")
    wrong = (
        F.when(data.isNull(), "no pixels")
        .when(F.size(data) != F.col("n_rows") * F.col("n_cols"), "size differs from rows and columns")
        .when(F.exists(data, lambda v: v.isNull() | F.isnan(v)), "values that are no numbers")
    )
    asked = [("orientation_flip_x", F.coalesce(orientation, F.lit(False)), lambda v: P.flipped_columns(v, F.col("n_cols"))), ("photometric_inversion", F.coalesce(photometric, F.lit(False)), P.mirrored)]
    made = settled(images, {"_wrong": wrong, "_asked": F.filter(F.array(*[F.when(flag, name) for name, flag, _ in asked]), lambda n: n.isNotNull()), "fixed": data})
    for name, _, fix in asked:
        # each fix reads what the one before it made
        made = settled(made, {"fixed": F.when(F.col("_wrong").isNull() & F.array_contains("_asked", name), fix(F.col("fixed"))).otherwise(F.col("fixed"))})
    none = F.array().cast("array<string>")
    failed = F.transform("_asked", lambda n: F.concat(n, F.lit(": "), F.col("_wrong")))
    return made.withColumn("fixes", F.when(F.col("_wrong").isNull(), F.col("_asked")).otherwise(none)).withColumn("errors", F.when(F.col("_wrong").isNull(), none).otherwise(failed)).drop("_wrong", "_asked")
