"""A barrier between projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``df.withColumns(made)``, with columns that are evaluated once whatever uses them later.

    The optimizer merges chains of projections and copies an expression into everything
    that reads it; it doesn't merge them across a generator of one row.
    """
    held = "_settled"
    while held in df.columns:
        held += "_"
    one = df.select("*", F.explode(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))).alias(held))
    value = lambda name: F.col(f"{held}.{name}").alias(name)
    return one.select(*[value(c) if c in made else F.col(c) for c in df.columns], *[value(c) for c in made if c not in df.columns])
