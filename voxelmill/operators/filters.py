"""Filters and projections over series, files, tasks and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.basic import contains_any, number, parts_of
from voxelmill.functions.rules import DERIVED_KEYWORDS, FLAT_MODALITIES, VOLUME_MODALITIES


def by_modality(df: DataFrame, wanted: str | None, column: str = "modality") -> DataFrame:
    """Rows of the modalities in a comma list, whatever their case; no list keeps all."""
    names = [n.strip().upper() for n in (wanted or "").split(",") if n.strip()]
    return df.where(F.upper(column).isin(names)) if names else df


def derived_by_type(image_type: Column) -> Column:
    """The first value decides; SECONDARY alone is not derived."""
    return F.coalesce(F.upper(F.trim(F.get(parts_of(image_type), F.lit(0)))) == "DERIVED", F.lit(False))


def derived_by_description(description: Column, keywords: list[str] | tuple[str, ...] = DERIVED_KEYWORDS) -> Column:
    return F.coalesce(contains_any(F.upper(description), tuple(keywords)), F.lit(False))


def without_derived(df: DataFrame, keywords: list[str] | tuple[str, ...] = DERIVED_KEYWORDS) -> DataFrame:
    return df.where(~derived_by_type(F.col("image_type")) & ~derived_by_description(F.col("series_desc"), keywords))


def keywords_tidied(words: Column) -> Column:
    """Trimmed upper-case words without blanks or repeats, in order of appearance."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.trim(w) != ""), lambda w: F.upper(F.trim(w))))


def with_thickness(df: DataFrame) -> DataFrame:
    """Series whose thickness is missing or above zero."""
    return df.where(F.coalesce(number(F.col("slice_thickness")) > 0, F.lit(True)))


def count_status(n_files: Column, modality: Column, least: int | None) -> Column:
    """What the archive's count says of a series; nothing is dropped for it."""
    counted = F.upper(modality).isin(*VOLUME_MODALITIES)
    return F.when(~counted | F.lit(not least or least <= 0), "not_checked").when(n_files >= (least or 0), "enough").when(n_files == 0, "unknown").otherwise("few")


def with_least_files(df: DataFrame, least: int | None) -> DataFrame:
    """Drop volume series, and those of no known modality, that have too few files."""
    if not least or least <= 0:
        return df
    counted = F.upper("modality").isin(*VOLUME_MODALITIES) | (F.coalesce("modality", F.lit("")) == "")
    return df.where(~counted | (F.col("n_files") >= least))


def template_of(modality: Column) -> Column:
    up = F.upper(modality)
    return F.when(up.isin("DR", "DX", "CR"), "DX").when(F.contains(up, F.lit("MR")), "MR").when(up.isin("CT", "MG"), up).otherwise("MR")


def is_flat(modality: Column) -> Column:
    """Modalities with a record for each file; others have one for each series."""
    return F.upper(modality).isin(*FLAT_MODALITIES)


def project_tags(df: DataFrame, names: list[str], tags: str = "tags") -> DataFrame:
    """One text column for each tag of a template; a missing tag is the empty text."""
    return df.select(*[c for c in df.columns if c != tags], *[F.coalesce(F.col(tags)[n], F.lit("")).alias(n) for n in names])


def ordered_columns(columns: list[str], priority: list[str], important: list[str]) -> list[str]:
    first = [c for c in [*priority, *important] if c in columns]
    return [*dict.fromkeys(first), *[c for c in columns if c not in first]]


def accepted_files(df: DataFrame, least_bytes: int = 128) -> DataFrame:
    """Files with an instance identifier and a header's worth of bytes; ``reject_reason`` is null for them."""
    reason = F.when(F.col("sop_uid").isNull() | (F.col("sop_uid") == ""), "no_instance_uid").when(F.col("length") < least_bytes, "too_small")
    return df.withColumn("reject_reason", reason)


def validation_error(host: Column, port: Column, title: Column) -> Column:
    """The first thing wrong with connection settings, or null."""
    p = port.try_cast("int")
    return (
        F.when(host.isNull() | (F.trim(host) == "") | (F.length(host) > 255), "host")
        .when(p.isNull() | ~p.between(1, 65535), "port")
        .when(title.isNull() | ~F.rlike(title, F.lit(r"^[\x20-\x7E]{1,16}$")), "title")
    )


def expired(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return df.where(F.col("end_time") < now - F.make_interval(hours=F.lit(hours)))
