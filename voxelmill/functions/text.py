"""Names, paths, sizes and markup, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_name(name: Column) -> Column:
    """A name that every file system takes: no reserved characters, white space or doubled marks, 50 characters at most."""
    out = F.regexp_replace(name, r'[<>"/\\|?*:\[\]]', "_")
    for pattern, mark in ((r"\.\s+", "_"), (r"\s+", "_"), (r"\.+", "."), ("_+", "_")):
        out = F.regexp_replace(out, pattern, mark)
    out = F.btrim(F.substring(F.btrim(out, F.lit("._ ")), 1, 50), F.lit("."))
    return F.when(name.isNull() | (out == ""), "Unknown").otherwise(out)


def series_folder(series_number: Column, description: Column) -> Column:
    """``007_Name``: the number is padded to three digits and never cut."""
    digits = series_number.cast("string")
    return F.concat(F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), F.lit("_"), folder_name(description))


def converted_name(accession: Column, path: Column) -> Column:
    return F.concat_ws("/", F.coalesce(F.nullif(F.trim(accession), F.lit("")), F.lit("Unknown")), base_name(path))


def workbook_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(base_name(path), r"(?i)^dicom_metadata_?", ""), r"\.[^.]*$", "")


def image_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?i)(\.nii\.gz|\.[^.]*)$", "")


def renamed_output(path: Column, to: str) -> Column:
    """The volume's path with another extension."""
    return F.regexp_replace(path, r"(?i)\.(nii\.gz|nii|npz|dcm)$", to)


def html_escaped(text: Column) -> Column:
    out = text
    # The five characters of markup.
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(reference))
    return out


def human_size(bytes_: Column) -> Column:
    """``1.5 KB``: two decimals at most, without trailing zeros."""
    unit = F.least(F.floor(F.log(1024.0, bytes_) + 1e-12), F.lit(3)).cast("int")
    value = F.regexp_replace(F.format_string("%.2f", bytes_ / F.pow(F.lit(1024.0), unit)), r"\.?0+$", "")
    return F.when(bytes_ == 0, "0 Bytes").otherwise(F.concat_ws(" ", value, F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), unit + 1)))


def elapsed(seconds: Column) -> Column:
    whole = F.floor(seconds)
    minutes, hours = F.floor(whole / 60), F.floor(whole / 3600)
    return (
        F.when(seconds < 60, F.concat(whole.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(minutes.cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), F.floor((whole % 3600) / 60).cast("string"), F.lit("m")))
    )


def is_truthy_low(value: Column) -> Column:
    """Whether a quality cell says low: 1, true, yes and like words; a number if its whole part is 1."""
    text = F.lower(F.trim(value))
    # Words for low quality.
    said = text.isin("1", "true", "yes", "y", "低质量", "poor", "bad")
    return F.coalesce(said | (F.floor(text.try_cast("double")) == 1), F.lit(False))


def has_extension(path: Column, *extensions: str) -> Column:
    return F.rlike(F.lower(path), F.lit(r"\.(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))


def env_key(key: Column) -> Column:
    """``QC_MR_STD_MIN`` as a struct of modality and threshold name; null for other keys."""
    rest = F.regexp_extract(key, "^QC_([A-Z]+)_([A-Z0-9_]+)$", 2)
    return F.when(rest != "", F.struct(F.regexp_extract(key, "^QC_([A-Z]+)_", 1).alias("modality"), F.lower(rest).alias("name")))
