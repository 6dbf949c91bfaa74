"""Features and class of an MR series, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelmill.functions.basic import contains_any, let, number, number_list, parts_of
from voxelmill.functions.rules import DESCRIPTION_RULES, MANUFACTURERS, NAME_RULES, PLANE_SPELLINGS, SUFFIX_WORDS, MrRules

RULES = MrRules()


def lowered(text: Column) -> Column:
    """Lower case; a missing value reads ``nan``, as stringified frames have it."""
    return F.lower(F.coalesce(text, F.lit("nan")))


def normal_of(orientation: Column) -> Column:
    """Cross product of the row and column direction in a six-number list; null for other lists."""

    def cross(v: Column) -> Column:
        at = lambda k: F.get(v, F.lit(k))
        made = F.array(at(1) * at(5) - at(2) * at(4), at(2) * at(3) - at(0) * at(5), at(0) * at(4) - at(1) * at(3))
        return F.when((F.size(v) == 6) & ~F.exists(v, lambda x: x.isNull()), made)

    return let(number_list(orientation), cross)


def plane_of(normal: Column, ratio: float = RULES.oblique_ratio) -> Column:
    """SAG, COR or AX by the largest part of the normal, OBL if none dominates; null for a null normal."""

    def named(n: Column) -> Column:
        x, y, z = (F.get(n, F.lit(k)) for k in range(3))
        largest = F.array_max(n)
        return F.when(largest * largest < F.lit(ratio) * (x * x + y * y + z * z), "OBL").when(x == largest, "SAG").when(y == largest, "COR").when(z == largest, "AX")

    return let(F.transform(normal, F.abs), named)


def plane_by_name(name: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    out = F.lit("UNKNOWN")
    for plane, parts in reversed((words or RULES.orientation_words).items()):
        out = F.when(contains_any(name, parts), plane).otherwise(out)
    return out


def orientation(iop: Column, name: Column, rules: MrRules = RULES) -> Column:
    return F.coalesce(plane_of(normal_of(iop), rules.oblique_ratio), plane_by_name(name, rules.orientation_words))


def fat_suppressed(scanning: Column, ti: Column, image_type: Column, options: Column, name: Column, rules: MrRules = RULES) -> Column:
    """Inversion recovery in the fat range, a water image, the scan option, or a word of the name."""
    inversion = F.contains(F.upper(scanning), F.lit("IR")) & ti.between(*rules.fat_ti)
    water = F.arrays_overlap(parts_of(F.upper(image_type)), F.array(*map(F.lit, rules.water_parts)))
    option = F.contains(F.upper(options), F.lit("FS"))
    no = F.lit(False)
    return F.coalesce(inversion, no) | F.coalesce(water, no) | F.coalesce(option, no) | F.coalesce(contains_any(name, rules.fat_words), no)


def refined_image_type(image_type: Column, name: Column) -> Column:
    """Both arguments in lower case."""
    return (
        F.when(contains_any(image_type, ("derived", "secondary")), "DERIVED")
        .when(F.contains(image_type, F.lit("localizer")) | contains_any(name, RULES.localizer_words), "LOCALIZER")
        .when(F.contains(image_type, F.lit("original")) & F.contains(image_type, F.lit("primary")), "ORIGINAL")
        .otherwise("OTHER")
    )


def subtype_suffix(name: Column, description: Column, image_type: Column) -> Column:
    """Water, fat and phase images of one acquisition are told apart; so are the echoes of a T2* series."""
    text = F.concat_ws(" ", name, F.lower(F.coalesce(description, F.lit(""))))
    parts = parts_of(F.upper(F.coalesce(image_type, F.lit(""))))
    echo = F.regexp_replace(F.element_at(F.split(text, "echo"), -1), r"\D", "")
    out = F.when(F.contains(text, F.lit("t2_star_echo")) & (echo != ""), F.concat(F.lit("_ECHO"), echo)).otherwise("")
    for suffix, exact, inside in reversed(SUFFIX_WORDS):
        out = F.when(F.array_contains(parts, exact) | contains_any(text, inside), suffix).otherwise(out)
    return out


def field_strength(tesla: Column) -> Column:
    """Left-closed bins; a missing value reads ``nan``."""
    return F.when(tesla < 1, "Low-Field").when(tesla < 2, "1.5T").when(tesla < 4, "3.0T").when(tesla.isNotNull(), "High-Field").otherwise("nan")


def manufacturer(name: Column) -> Column:
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("Other")
    for label, parts in reversed(MANUFACTURERS):
        out = F.when(contains_any(low, parts), label).otherwise(out)
    return out


def model_name(name: Column) -> Column:
    return F.trim(lowered(name))


def family_of(scanning: Column, variant: Column, name: Column, etl: Column, rules: MrRules) -> Column:
    gradient = F.when(F.contains(variant, F.lit("ss")), "GRE_STEADY_STATE").when(F.contains(variant, F.lit("sp")), "GRE_SPOILED").otherwise("GRE")
    spin = F.when(contains_any(name, rules.single_shot_words) | (etl > rules.single_shot_etl), "SE_SingleShot").when(etl > 1, "TSE").otherwise("SE")
    return F.when(F.contains(scanning, F.lit("gr")), gradient).when(F.contains(scanning, F.lit("se")), spin)


def class_by_name(name: Column, description: Column, refined: Column, rules: MrRules = RULES) -> Column:
    """The class that words of the name or the description settle, else null."""
    described = F.lower(F.coalesce(description, F.lit("nan")))
    out = F.when(contains_any(name, rules.localizer_words) | (refined == "LOCALIZER"), "LOCALIZER")
    for label, parts in NAME_RULES:
        out = out.when(contains_any(name, parts), label)
    for label, parts in DESCRIPTION_RULES:
        out = out.when(contains_any(described, parts), label)
    return out


def class_by_physics(name: Column, scanning: Column, family: Column, tr: Column, te: Column, ti: Column, b_value: Column, limit: Column, rules: MrRules = RULES) -> Column:
    """The class by diffusion weight, inversion and timing, else null; ``scanning`` in lower case."""
    weighted = (
        F.when(family == "SE_SingleShot", "T2_SE_SingleShot")
        .when(te > limit["t2_te_min"], F.concat(F.lit("T2_"), family))
        .when((tr < limit["t1_tr_max"]) & (te < limit["t1_te_max"]), F.concat(F.lit("T1_"), family))
        .when((tr > limit["t2_tr_min"]) & (te < limit["pd_te_max"]) & F.contains(name, F.lit("pd")), F.concat(F.lit("PD_"), family))
    )
    recovery = (ti >= limit["flair_ti_min"]) | ti.between(F.lit(rules.fat_ti[0]), limit["stir_ti_max"])
    return (
        F.when(b_value > rules.dwi_b_min, F.when(F.contains(name, F.lit("dti")), "DTI").otherwise("DWI"))
        .when(F.contains(scanning, F.lit("ep")) & contains_any(name, rules.fmri_words), "fMRI_BOLD")
        .when(ti >= limit["flair_ti_min"], "T2_FLAIR")
        .when(recovery, "T2_STIR")
        .otherwise(weighted)
    )


def class_by_hint(name: Column, dimension: Column, family: Column, rules: MrRules = RULES) -> Column:
    """The class that the name hints at, else null."""
    has = lambda *parts: contains_any(name, parts)
    known = F.coalesce(family, F.lit("UNKNOWN"))
    # an inversion recovery is classified already, so here the family counts as it is
    spin = F.when(contains_any(name, rules.tse_words), "TSE").when(has("se"), "SE")
    t1_plain = F.when(has("mpr") & has("iso") & (dimension == "3D"), "GRE_FLASH3D").otherwise("NAME_BASED")
    return (
        F.when(has("tse_dark_fluid"), "T2_FLAIR")
        .when(has("t1"), F.concat(F.lit("T1_"), F.coalesce(family, spin, t1_plain)))
        .when(has("pd"), F.concat(F.lit("PD_"), known))
        .when(has("flair"), "T2_FLAIR")
        .when(has("stir"), "T2_STIR")
        .when(has("dwi", "diff"), "DWI")
        .when(has("t2"), F.concat(F.lit("T2_"), F.coalesce(family, spin, F.lit("NAME_BASED"))))
    )


def class_suffix(name: Column, description: Column, image_type: Column, motion: Column, rules: MrRules = RULES) -> Column:
    corrected = F.when(contains_any(name, rules.motion_words) | F.coalesce(motion, F.lit(False)), "_MC").otherwise("")
    return F.concat(subtype_suffix(name, description, image_type), corrected)


def sequence_class(
    name: Column, description: Column, scanning: Column, variant: Column, image_type: Column, refined: Column, dimension: Column, motion: Column,
    tr: Column, te: Column, ti: Column, b_value: Column, etl: Column, limit: Column, rules: MrRules = RULES,
) -> Column:
    """Class of a series: by name, else by physics, else by what the name hints at; then suffixes.

    ``limit`` is a struct of the thresholds that hold for the field strength. ``name`` is
    in lower case; numbers are null where missing, and then meet no condition.
    """
    scanning, variant = (F.lower(F.coalesce(c, F.lit("nan"))) for c in (scanning, variant))
    family = family_of(scanning, variant, name, etl, rules)
    base = F.coalesce(class_by_name(name, description, refined, rules), class_by_physics(name, scanning, family, tr, te, ti, b_value, limit, rules), class_by_hint(name, dimension, family, rules))
    return F.coalesce(F.concat(base, class_suffix(name, description, image_type, motion, rules)), F.lit("UNKNOWN"))


def agent_given(agent: Column) -> Column:
    """An agent is named and its name does not say no; the empty text counts as named."""
    return F.coalesce(~F.contains(F.lower(agent), F.lit("no")), F.lit(False))


def enhanced_by_agent(name: Column, agent: Column) -> Column:
    return F.coalesce(F.startswith(name, F.lit("t1")), F.lit(False)) & agent_given(agent)


def enhanced_by_phase(name: Column, agent: Column, phase: Column, class_: Column, rules: MrRules = RULES) -> Column:
    """The same question answered from phases and protocol words; not for diffusion, T2 and localizers."""
    hinted = F.coalesce(F.startswith(phase, F.lit("POST")), F.lit(False)) | F.coalesce(F.rlike(name, F.lit(rules.contrast_pattern)), F.lit(False))
    return hinted & agent_given(agent) & ~F.coalesce(contains_any(class_, ("DWI", "T2", "LOCALIZER")), F.lit(True))


def preview_type(name: Column, image_type: Column, tr: Column, te: Column, ti: Column) -> Column:
    """Coarse contrast of an MR image, which picks the window of its preview: by words, inversion, timing, words again."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *parts: contains_any(low, parts)
    timed = F.when(te > 80, "T2").when((tr < 800) & (te < 30), "T1").when((tr > 2000) & (te < 30), "PD")
    worded = (
        F.when(contains_any(low, RULES.localizer_words), "LOCALIZER")
        .when(has("flair", "tse_dark_fluid"), "FLAIR")
        .when(has("stir"), "STIR")
        .when(has("dwi", "diff"), "DWI")
        .when(has("adc") | F.coalesce(F.contains(F.lower(image_type), F.lit("adc")), F.lit(False)), "ADC")
    )
    inverted = F.when(ti >= 2000, "FLAIR").when(ti.between(100, 250), "STIR")
    named = F.when(has("t1"), "T1").when(has("t2"), "T2").when(has("pd"), "PD")
    return F.coalesce(worded, inverted, F.when(tr.isNotNull(), timed), named, F.lit("UNKNOWN"))


def tidy_orientation(label: Column, iop: Column, name: Column) -> Column:
    """One of AX, SAG and COR: spellings are read, oblique or unknown labels decided by the normal, the rest by name, else AX."""
    spellings = F.create_map(*[F.lit(x) for pair in PLANE_SPELLINGS.items() for x in pair])
    up = F.upper(F.trim(F.coalesce(label, F.lit("UNKNOWN"))))
    read = F.coalesce(F.try_element_at(spellings, up), up)
    low = F.lower(F.coalesce(name, F.lit("")))
    named = F.when(contains_any(low, ("sag", "sg")), "SAG").when(contains_any(low, ("cor", "cr")), "COR").when(contains_any(low, ("ax", "tra")), "AX")
    measured = F.when(read.isin("OBL", "UNKNOWN", ""), plane_of(normal_of(iop), 0.0))
    return F.when(read.isin("AX", "SAG", "COR"), read).otherwise(F.coalesce(measured, named, F.lit("AX")))


def slice_thickness(thickness: Column, spacing: Column) -> Column:
    return F.coalesce(number(thickness), number(spacing))
