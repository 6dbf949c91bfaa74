"""The MR pipeline: features, hardware, class, dynamic phases, enhancement.

Input columns are named as in the series table (``study_uid, series_key, protocol_name,
series_desc, image_type, ...``). Stages 1 to 3 are projections; stage 4 exchanges by
dynamic set, stage 5 joins one row a study.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions import series as S
from voxelmill.functions.basic import number, rounded_list, rounded_or_na
from voxelmill.functions.rules import THRESHOLD_NAMES, MrRules
from voxelmill.operators.barrier import settled
from voxelmill.operators.ranking import dense_index
from voxelmill.session import cut_lineage

NUMBERS = {"tr": "repetition_time", "te": "echo_time", "ti": "inversion_time", "b": "b_value", "etl": "echo_train_length"}
#: Columns that tables may lack; they read as null.
OPTIONAL = ("scan_options", "flip_angle", "model_name", "inversion_time", "b_value", "echo_train_length", "slice_thickness")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def atomic_features(df: DataFrame, rules: MrRules = S.RULES) -> DataFrame:
    name, image = S.lowered(F.col("protocol_name")), S.lowered(F.col("image_type"))
    made = df.withColumns({"protocolName_lower": name, "imageType_lower": image})
    name, image = F.col("protocolName_lower"), F.col("imageType_lower")
    return made.withColumns(
        {
            "standardOrientation": S.orientation(F.col("iop"), name, rules),
            "standardDimension": F.coalesce(F.col("mr_acquisition_type"), F.lit("nan")),
            "isFatSuppressed": S.fat_suppressed(F.col("scanning_sequence"), number(_column(df, "inversion_time")), F.col("image_type"), _column(df, "scan_options"), name, rules),
            "isContrastEnhanced": F.rlike(name, F.lit(rules.contrast_pattern)),
            "hasMotionCorrection": F.rlike(name, F.lit(rules.motion_pattern)),
            "refinedImageType": S.refined_image_type(image, name),
        }
    )


def hardware_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "standardFieldStrength": S.field_strength(number(F.col("field_strength"))),
            "standardManufacturer": S.manufacturer(F.col("manufacturer")),
            "cleanedModelName": S.model_name(_column(df, "model_name")),
        }
    )


def with_thresholds(df: DataFrame, rules: MrRules = S.RULES, into: str = "limit") -> DataFrame:
    """Thresholds of the field strength, or the default row's: a constant map, no join."""
    limits = {strength: F.struct(*[F.lit(v).alias(n) for n, v in zip(THRESHOLD_NAMES, values, strict=True)]) for strength, values in rules.thresholds.items()}
    own = F.try_element_at(F.create_map(*[part for strength, row in limits.items() for part in (F.lit(strength), row)]), F.col("standardFieldStrength"))
    return df.withColumn(into, F.coalesce(own, limits["default"]))


def classify(df: DataFrame, rules: MrRules = S.RULES) -> DataFrame:
    """Add ``sequenceClass``, as ``series.sequence_class`` has it.

    The parts of the rules stand behind barriers: what asks for the class later must not
    repeat them, and each is generated code short enough for the JVM's compiler.
    """
    name, own = F.col("protocolName_lower"), lambda part: F.col(f"_class.{part}")
    numbers = F.struct(*[number(_column(df, c)).alias(k) for k, c in NUMBERS.items()])
    scanning, variant = (F.lower(F.coalesce(c, F.lit("nan"))) for c in ("scanning_sequence", "sequence_variant"))
    made = settled(with_thresholds(df, rules), {"_class": numbers})
    named = S.class_by_name(name, F.col("series_desc"), F.col("refinedImageType"), rules)
    made = settled(made, {"_family": S.family_of(scanning, variant, name, own("etl"), rules), "_named": named})
    timed = S.class_by_physics(name, scanning, F.col("_family"), *[own(k) for k in ("tr", "te", "ti", "b")], F.col("limit"), rules)
    made = settled(made, {"_timed": timed})
    hinted = S.class_by_hint(name, F.col("standardDimension"), F.col("_family"), rules)
    made = settled(made, {"_hinted": hinted})
    suffix = S.class_suffix(name, F.col("series_desc"), F.col("image_type"), F.col("hasMotionCorrection"), rules)
    made = settled(made, {"sequenceClass": F.coalesce(F.concat(F.coalesce("_named", "_timed", "_hinted"), suffix), F.lit("UNKNOWN"))})
    return made.drop("limit", "_class", "_family", "_named", "_timed", "_hinted")


def fingerprint(df: DataFrame) -> Column:
    """What series of one dynamic acquisition have in common: place, class and timing."""
    numbers = [rounded_or_na(number(_column(df, c))) for c in ("slice_thickness", "repetition_time", "echo_time", "flip_angle")]
    return F.concat_ws("_", rounded_list(F.col("ipp")), rounded_list(F.col("iop")), F.col("sequenceClass"), *numbers)


def with_fingerprint(df: DataFrame, rules: MrRules = S.RULES) -> DataFrame:
    """Add ``fingerprint``, null where a series takes no part, and ``seriesTime``."""
    eligible = df["study_uid"].isNotNull() & ~df["sequenceClass"].isin(*rules.not_dynamic)
    return df.withColumns({"fingerprint": F.when(eligible, fingerprint(df)), "seriesTime": number(F.col("series_time"))})


def dynamic_sets(df: DataFrame, rules: MrRules = S.RULES) -> DataFrame:
    """Add ``fingerprint`` (null where a series takes no part), ``set_size``, ``set_timed``, ``set_first`` and ``set_place``, by time.

    A series that takes no part is a set of its own, so that the many that don't, or that
    have no study, are spread over all tasks.
    """
    made = with_fingerprint(df, rules)
    alone = F.when(F.col("fingerprint").isNull(), F.xxhash64("series_key"))
    by_time = Window.partitionBy("study_uid", "fingerprint", alone).orderBy(F.col("seriesTime").asc_nulls_last(), "series_key")
    # one order for all four: a second window without it would sort again
    of_set = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return made.withColumns(
        {
            "set_size": F.count(F.lit(1)).over(of_set),
            "set_timed": F.count("seriesTime").over(of_set),
            "set_first": F.min("series_key").over(of_set),
            "set_place": F.row_number().over(by_time),
        }
    )


def is_dynamic() -> Column:
    return F.col("fingerprint").isNotNull() & (F.col("set_size") > 1) & (F.col("set_timed") > 0)


def dynamic_phase() -> Column:
    """The earliest series of a set is PRE, later ones POST_1, POST_2 and on; others have the empty text."""
    return F.when(is_dynamic(), F.when(F.col("set_place") == 1, "PRE").otherwise(F.concat(F.lit("POST_"), (F.col("set_place") - 1).cast("string")))).otherwise("")


def group_numbers(series: DataFrame) -> DataFrame:
    """Number the dynamic sets 1, 2, ... by study, size from large to small, first series; needs ``fingerprint`` and ``seriesTime``."""
    sized = series.where("fingerprint is not null").groupBy("study_uid", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.count("seriesTime").alias("timed"), F.min("series_key").alias("first"))
    return _numbered(sized.where("n > 1 and timed > 0").select("study_uid", "fingerprint", "n", "first"))


def _numbered(groups: DataFrame) -> DataFrame:
    # the sets are few beside the series: they are written once and then sorted
    return dense_index(cut_lineage(groups), [F.col("study_uid"), F.col("n").desc(), F.col("first")], "dynamicGroup").select("study_uid", "fingerprint", "dynamicGroup")


def latest_enhanced(df: DataFrame) -> DataFrame:
    """``study_uid, latest``: the time of a study's last series with an agent; a sum of few columns, whatever a study's size."""
    given = S.enhanced_by_agent(S.lowered(F.col("protocol_name")), F.col("contrast_agent"))
    return df.where(given & F.col("study_uid").isNotNull()).groupBy("study_uid").agg(F.max(number(F.col("series_time"))).alias("latest"))


def propagate(df: DataFrame, latest: DataFrame, class_: str = "sequenceClass") -> DataFrame:
    """T1 series without a phase that come after the study's ``latest`` enhanced one become enhanced too.

    A join and no window, so that the rows of a very large study can be split.
    """
    late = (F.col("dynamicPhase") == "") & F.contains(class_, F.lit("T1")) & (F.col("seriesTime") > F.col("_latest"))
    return (
        df.join(latest.select("study_uid", F.col("latest").alias("_latest")), "study_uid", "left")
        .withColumn("_late", F.coalesce(late, F.lit(False)))
        .withColumn("dynamicPhase", F.when(F.col("_late"), "POST_PROPAGATED").otherwise(F.col("dynamicPhase")))
        .withColumn("isContrastEnhanced", F.col("isContrastEnhanced") | F.col("_late"))
        .drop("_latest", "_late")
    )


#: What the last stages need of a classified series besides the columns that are asked for.
_LAST = ("study_uid", "series_key", "fingerprint", "seriesTime", "sequenceClass", "dynamicPhase", "isContrastEnhanced", "set_size", "set_timed", "set_first", "set_place")


def clean_series(df: DataFrame, rules: MrRules = S.RULES, numbered: bool = True, columns: list[str] | None = None) -> DataFrame:
    """All stages: the table with its derived columns, or the ``columns`` that are named.

    The classified table with its sets is written once to the shared folder; the sets,
    a row each, are read back from it and numbered. Only columns that are asked for are
    exchanged and written. ``numbered=False`` leaves the global numbers out and writes
    nothing; the sets are then told apart by study and fingerprint.
    """
    classified = classify(hardware_features(atomic_features(df, rules)), rules)
    sets = dynamic_sets(classified, rules)
    phased = sets.withColumn("dynamicPhase", dynamic_phase()).withColumn("isContrastEnhanced", S.enhanced_by_agent(F.col("protocolName_lower"), F.col("contrast_agent")))
    if not numbered:
        latest = latest_enhanced(df)
    else:
        if columns is not None:
            phased = phased.select(*[c for c in phased.columns if c in columns or c in _LAST])
        phased = cut_lineage(phased)
        # from what was written, so that the table isn't made a second time
        latest = phased.where(F.col("isContrastEnhanced") & F.col("study_uid").isNotNull()).groupBy("study_uid").agg(F.max("seriesTime").alias("latest"))
        firsts = phased.where(is_dynamic() & (F.col("set_place") == 1)).select("study_uid", "fingerprint", F.col("set_size").alias("n"), F.col("set_first").alias("first"))
        phased = phased.join(_numbered(firsts), ["study_uid", "fingerprint"], "left")
    made = propagate(phased, latest).drop("set_size", "set_timed", "set_first", "set_place")
    return made if columns is None else made.select(*columns)
