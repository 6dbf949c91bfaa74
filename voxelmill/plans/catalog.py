"""Collects the registered queries of all plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelmill.operators import mr
from voxelmill.plans import fixtures, image_queries, mr_queries, stream_queries, table_queries, volume_queries

MODULES = [mr_queries, table_queries, image_queries, stream_queries, volume_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MR series of every study with all derived columns."""
    return mr.clean_series(fixtures.mr_series(spark, sf_dir))
