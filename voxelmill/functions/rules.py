"""Rule data of the MR series classifier, as parameters with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Word lists and thresholds of the classification rules.
DERIVED_KEYWORDS = (
    "MPR", "MIP", "MINIP", "SSD", "VRT", "VR", "CPR", "CURVED", "3D", "THICK", "SCOUT", "TOPOGRAM", "SURVEY",
    "REF", "REFERENCE", "LOC", "BATCH", "AVERAGE", "SUM", "REFORMAT", "PROJECTION", "RAYSUM", "KEY", "ROI", "DOSE", "TRACKER",
)
VOLUME_MODALITIES = ("CT", "MR", "MRI", "PT", "NM", "US")
FLAT_MODALITIES = ("DR", "MG", "DX", "CR")

ORIENTATION_WORDS = {"AX": ("ax", "tra", "trans"), "SAG": ("sag", "sg"), "COR": ("cor", "cr"), "OBL": ("obl", "oblique")}
NAME_RULES = (
    ("T1_MAP", ("t1_map", "t1map")),
    ("T2_MAP", ("t2_map", "t2map")),
    ("ADC", ("adc",)),
    ("FA_MAP", ("fa_map",)),
    ("SUBTRACTION", ("sub", "subtract")),
    ("MRA", ("mra", "mrv", "tof")),
    ("SWI", ("swi", "swan")),
    ("PWI", ("pwi", "perf", "dsc")),
    ("MRS", ("mrs", "svs", "csi", "spectro")),
)
DESCRIPTION_RULES = (("BREATH MOVEMENT", ("resp",)), ("MIP", ("mip",)))
SUFFIX_WORDS = (
    ("_WATER", "WATER", ("water",)),
    ("_FAT", "FAT", ("fat",)),
    ("_INPHASE", "INPHASE", ("in_phase", "inphase")),
    ("_OUTPHASE", "OUTPHASE", ("out_phase", "outphase")),
)
MANUFACTURERS = (
    ("Siemens", ("siemens",)),
    ("Philips", ("philips",)),
    ("GE", ("ge medical", "ge healthcare")),
    ("UIH", ("uih", "united imaging")),
    ("Anke", ("anke",)),
    ("Canon", ("canon",)),
    ("Fujifilm", ("fujifilm",)),
    ("Hitachi", ("hitachi",)),
    ("Mindray", ("mindray",)),
    ("Shimadzu", ("shimadzu",)),
)
#: field strength: t1_tr_max, t1_te_max, t2_tr_min, t2_te_min, pd_te_max, flair_ti_min, stir_ti_max
FIELD_THRESHOLDS = {
    "3.0T": (1800.0, 40.0, 2500.0, 75.0, 50.0, 2000.0, 300.0),
    "1.5T": (1200.0, 40.0, 2000.0, 70.0, 50.0, 1800.0, 250.0),
    "Low-Field": (1000.0, 50.0, 1800.0, 80.0, 60.0, 1500.0, 200.0),
    "default": (1500.0, 40.0, 2000.0, 75.0, 50.0, 1800.0, 250.0),
}
THRESHOLD_NAMES = ("t1_tr_max", "t1_te_max", "t2_tr_min", "t2_te_min", "pd_te_max", "flair_ti_min", "stir_ti_max")
NOT_DYNAMIC = ("DWI", "DTI", "ADC", "FA", "MRS", "PWI", "ASL", "LOCALIZER", "DERIVED", "SUBTRACTION", "MAP", "fMRI_BOLD", "SWI", "T2")
PLANE_SPELLINGS = {"OLB": "OBL", "OB": "OBL", "OBLIQUE": "OBL", "SAGITTAL": "SAG", "CORONAL": "COR", "AXIAL": "AX", "TRANSVERSE": "AX", "TRA": "AX"}
CONTRAST_PATTERN = r"\+c|post|gd|enh|contrast|增强|dyn"
MOTION_PATTERN = "propeller|blade|radial|star"


@dataclass(frozen=True)
class MrRules:
    """What a user may change about the classifier."""

    oblique_ratio: float = 0.9
    orientation_words: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ORIENTATION_WORDS))
    fat_ti: tuple[float, float] = (100.0, 250.0)
    fat_words: tuple[str, ...] = ("fs", "fatsat", "spair", "stir", "fat sep", "dixon")
    water_parts: tuple[str, ...] = ("W", "WATER")
    contrast_pattern: str = CONTRAST_PATTERN
    motion_pattern: str = MOTION_PATTERN
    localizer_words: tuple[str, ...] = ("localizer", "survey", "scout")
    dwi_b_min: float = 50.0
    fmri_words: tuple[str, ...] = ("fmri", "bold")
    single_shot_words: tuple[str, ...] = ("haste", "ssfse")
    single_shot_etl: float = 128.0
    tse_words: tuple[str, ...] = ("tse", "fse")
    motion_words: tuple[str, ...] = ("blade", "propeller")
    not_dynamic: tuple[str, ...] = NOT_DYNAMIC
    thresholds: dict[str, tuple[float, ...]] = field(default_factory=lambda: dict(FIELD_THRESHOLDS))
