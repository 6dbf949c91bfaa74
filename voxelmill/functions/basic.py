"""Numbers, lists and words in tag strings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """The text as a double; null if it is none, or not a number. Comparisons with null are not true, as is wanted."""
    # texts that can't be numbers are sorted out first: a failing cast costs a caught exception
    value = F.when(F.rlike(text.cast("string"), F.lit("[0-9]|[iI][nN][fF]")), text.try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, parts: list[str] | tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts))


def number_list(text: Column) -> Column:
    """A list literal such as ``[1.0, 0.0]`` as an array of doubles; null if it is none."""
    return F.from_json(text, "array<double>")


def parts_of(text: Column) -> Column:
    """Values of a multi-valued tag that are set apart by backslashes."""
    return F.split(text, r"\\")


def rounded_list(text: Column, decimals: int = 2) -> Column:
    """List literals rounded half to even: ``NA`` for null, ``INVALID`` for what is no list. No negative zeros."""
    rounded = F.transform(number_list(text), lambda v: F.bround(v, decimals) + F.lit(0.0))
    told = let(rounded, lambda values: F.when(values.isNull() | F.exists(values, lambda v: v.isNull()), "INVALID").otherwise(values.cast("string")))
    return F.when(text.isNull(), "NA").otherwise(told)


def rounded_or_na(value: Column, decimals: int = 1) -> Column:
    return F.coalesce((F.bround(value, decimals) + F.lit(0.0)).cast("string"), F.lit("NA"))


def tag_text(values: Column) -> Column:
    """An array of tag values as text: one value bare, several as a list, none as the empty text."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).when(F.size(values) > 1, F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))).otherwise("")
