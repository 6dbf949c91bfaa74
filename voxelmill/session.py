"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "voxelmill", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VOXELMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); in local mode, as in tests, a temporary one where the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxelmill-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bucketed_table(df: DataFrame, column: str, buckets: int) -> str:
    """Name of a table with the rows of ``df``, written to the shared folder in buckets of ``column``: joins on it need no exchange of these rows."""
    spark = df.sparkSession
    database = "voxelmill_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{shared_folder(spark)}/tables'")
    name = f"{database}.t{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(buckets, column).saveAsTable(name)
    return name


def drop_table(spark: SparkSession, name: str) -> None:
    """Delete a table that ``bucketed_table`` wrote; nothing may read it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
