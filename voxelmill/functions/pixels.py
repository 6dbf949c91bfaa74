"""Pixel arrays as column expressions: statistics, quality rules, windows, geometry.

An image is an array of doubles in row-major order with its numbers of rows and
columns, so one image is one row and is judged inside one task, without an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelmill.functions.basic import let, number_list

#: More pixels than this are thinned to every k-th.
MOST_PIXELS = 200_000

# Thresholds by modality, the other ones hold for all.
GLOBAL_THRESHOLDS = {"dynamic_range_min": 20.0, "std_min": 5.0, "unique_ratio_min": 0.01, "low_ratio_threshold": 0.6, "high_ratio_threshold": 0.6, "series_low_quality_ratio": 0.3, "seg_bright_threshold": 0.05, "seg_max_components": 10.0}
MODALITY_THRESHOLDS = {
    **{m: {"dynamic_range_min": 10.0, "std_min": 3.0, "unique_ratio_min": 0.001} for m in ("DX", "DR", "MG", "CR")},
    "CT": {"dynamic_range_min": 20.0, "std_min": 5.0, "unique_ratio_min": 0.01},
    "MR": {"dynamic_range_min": 15.0, "std_min": 5.0, "unique_ratio_min": 0.008},
}
# Reason codes and their descriptions.
REASONS = {
    "no_pixel_data": "No pixel data available",
    "empty_data": "Empty pixel data",
    "dynamic_range_invalid": "Invalid dynamic range",
    "dynamic_range_low": "Low dynamic range",
    "contrast_low": "Low contrast",
    "complexity_low": "Low complexity",
    "under_exposed": "Under-exposed",
    "over_exposed": "Over-exposed",
    "grayscale_inverted": "Grayscale inverted (border brighter than center)",
    "segmentation_mask": "Segmentation mask detected (binary-like image with continuous white regions)",
    "read_error": "Error reading image data",
    "file_not_found": "File not found",
    "unsupported_format": "Unsupported file format",
    "nifti_orientation_error": "NIfTI orientation error (dcm2niix bug detected)",
    "fixed_orientation": "Fixed: NIfTI orientation corrected",
    "fixed_grayscale": "Fixed: Grayscale inversion corrected",
    "fixed_both": "Fixed: Both orientation and grayscale corrected",
}


def finite(data: Column) -> Column:
    return F.filter(data, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def thinned(data: Column, most: int = MOST_PIXELS) -> Column:
    step = F.greatest(F.floor(F.size(data) / most), F.lit(1)).cast("int")
    return F.when(F.size(data) <= most, data).otherwise(F.filter(data, lambda x, i: i % step == 0))


def tissue(data: Column, modality: Column) -> Column:
    """MR and CT without background, if more than a twentieth is left."""
    top = F.array_max(data)
    kept = F.filter(data, lambda x: x > top * 0.001)
    return F.when(modality.isin("MR", "CT") & (F.size(kept) > F.size(data) * 0.05), kept).otherwise(data)


def mean(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda total, x: total + x) / F.size(data)


def deviation(data: Column) -> Column:
    return let(mean(data), lambda m: F.sqrt(F.aggregate(data, F.lit(0.0), lambda total, x: total + (x - m) * (x - m)) / F.size(data)))


def quantile(ordered: Column, share: float) -> Column:
    """Linear interpolation between neighbours of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    return let(F.get(ordered, low), lambda a: a + (F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) - a) * (at - low))


def share_of(data: Column, test) -> Column:
    return F.size(F.filter(data, test)) / F.nullif(F.size(data), F.lit(0))


def pixel_statistics(data: Column, modality: Column) -> Column:
    """Struct of what the quality rules look at: p2, p98, range, std, unique_ratio, mean, low_ratio, high_ratio, n."""

    def of_sorted(x: Column) -> Column:
        made = F.struct(
            quantile(x, 0.02).alias("p2"), quantile(x, 0.98).alias("p98"), deviation(x).alias("std"), (F.size(F.array_distinct(x)) / F.size(x)).alias("unique_ratio"), mean(x).alias("mean"), F.size(x).alias("n")
        )

        def tails(s: Column) -> Column:
            span = F.greatest(s["p98"] - s["p2"], F.lit(1e-6))
            return F.struct(
                s["p2"].alias("p2"), s["p98"].alias("p98"), (s["p98"] - s["p2"]).alias("range"), s["std"].alias("std"), s["unique_ratio"].alias("unique_ratio"), s["mean"].alias("mean"),
                share_of(x, lambda v: v <= s["p2"] + 0.01 * span).alias("low_ratio"), share_of(x, lambda v: v >= s["p98"] - 0.01 * span).alias("high_ratio"), s["n"].alias("n"),
            )

        return let(made, tails)

    flat = let(thinned(finite(data)), lambda x: F.array_sort(tissue(x, modality)))
    return F.when(F.size(finite(data)) > 0, let(flat, of_sorted))


def border_excess(data: Column, rows: Column, cols: Column) -> Column:
    """Mean of a frame a tenth wide less the mean of the rest; null if there is no rest."""
    frame = F.greatest(F.floor(F.least(rows, cols) * 0.1), F.lit(1)).cast("int")

    def edge(i: Column) -> Column:
        r, c = F.floor(i / cols), i % cols
        return (r < frame) | (r >= rows - frame) | (c < frame) | (c >= cols - frame)

    inside, outside = F.filter(data, lambda x, i: ~edge(i)), F.filter(data, lambda x, i: edge(i))
    return F.when((F.size(inside) > 0) & (F.size(outside) > 0), mean(outside) - mean(inside))


def threshold(modality: Column, name: str, overrides: dict[tuple[str, str], float] | None = None) -> Column:
    """Threshold of a modality: override, its default, the global default."""
    out = F.lit(GLOBAL_THRESHOLDS[name])
    for m, own in MODALITY_THRESHOLDS.items():
        if name in own:
            out = F.when(modality == m, F.lit(own[name])).otherwise(out)
    for (m, n), value in (overrides or {}).items():
        if n == name:
            out = F.when(modality == m, F.lit(value)).otherwise(out) if m != "DEFAULT" else F.when(~modality.isin(*MODALITY_THRESHOLDS), F.lit(value)).otherwise(out)
    return out


def quality_reasons(stats: Column, excess: Column, modality: Column, masked: Column | None = None, overrides: dict[tuple[str, str], float] | None = None) -> Column:
    """Reason codes in a fixed order; none for a good image. A range of zero stops the list."""
    t = lambda name: threshold(modality, name, overrides)
    span = F.greatest(stats["range"], F.lit(1e-6))
    under = (stats["mean"] < stats["p2"] + 0.1 * span) | (stats["low_ratio"] > t("low_ratio_threshold"))
    over = (stats["mean"] > stats["p98"] - 0.1 * span) | (stats["high_ratio"] > t("high_ratio_threshold"))
    rules = {
        "dynamic_range_low": stats["range"] < t("dynamic_range_min"),
        "contrast_low": stats["std"] < t("std_min"),
        "complexity_low": stats["unique_ratio"] < t("unique_ratio_min"),
        "under_exposed": under,
        "over_exposed": over,
        "grayscale_inverted": excess > 0.1 * span,
        "segmentation_mask": F.lit(False) if masked is None else masked,
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    return F.when(stats.isNull(), F.array(F.lit("empty_data"))).when(stats["range"] <= 0, F.array(F.lit("dynamic_range_invalid"))).otherwise(found)


def described(reasons: Column) -> Column:
    """Descriptions set apart by semicolons; an unknown code stands for itself, none reads Normal."""
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.when(F.size(reasons) == 0, "Normal").otherwise(F.array_join(F.transform(reasons, lambda r: F.coalesce(F.try_element_at(table, r), r)), "; "))


def after_fixes(reasons: Column, orientation_fixed: Column, grayscale_fixed: Column) -> Column:
    """Repaired errors leave the list and a note takes their place; struct of low and reasons."""
    left = F.array_except(reasons, F.array_compact(F.array(F.when(orientation_fixed, "nifti_orientation_error"), F.when(grayscale_fixed, "grayscale_inverted"))))
    note = F.when(orientation_fixed & grayscale_fixed, "fixed_both").when(orientation_fixed, "fixed_orientation").when(grayscale_fixed, "fixed_grayscale")
    all_ = F.array_compact(F.concat(left, F.array(note)))
    return F.struct((F.size(left) > 0).alias("low"), all_.alias("reasons"))


# --- values ----------------------------------------------------------------------------


def rescaled(data: Column, slope: Column, intercept: Column) -> Column:
    s, i = F.coalesce(slope, F.lit(1.0)), F.coalesce(intercept, F.lit(0.0))
    return F.transform(data, lambda x: x * s + i)


def inverted(data: Column) -> Column:
    top = F.array_max(data)
    return F.transform(data, lambda x: top - x)


def mirrored(data: Column) -> Column:
    """Values turned round inside their own range."""
    top, low = F.array_max(data), F.array_min(data)
    return F.transform(data, lambda x: top - (x - low))


def windowed(data: Column, center: Column, width: Column, negative: Column) -> Column:
    """Eight-bit grey values of a window, cut off to whole numbers."""
    low = center - width / 2
    grey = lambda x: F.floor(F.least(F.greatest((x - low) / width, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return F.transform(data, lambda x: F.when(negative, 255 - grey(x)).otherwise(grey(x)))


def window_given(center: Column, width: Column) -> Column:
    """Struct of the first values of both tags; null if either is missing or the width is no width."""
    first = lambda c: F.split(c, r"\\")[0].try_cast("double")
    return F.when(first(center).isNotNull() & (first(width) > 1e-6), F.struct(first(center).alias("center"), first(width).alias("width")))


def window_estimate(data: Column, modality: Column) -> Column:
    """Soft tissue for CT, mean and deviation for MG, the 5th to 95th percentile else: an estimate without tags, see ``window_by_tags``."""
    x = F.array_sort(finite(data))
    percentiles = let(x, lambda s: F.struct(((quantile(s, 0.05) + quantile(s, 0.95)) / 2).alias("center"), F.greatest(quantile(s, 0.95) - quantile(s, 0.05), F.lit(1.0)).alias("width")))
    spread = let(x, lambda s: F.struct(mean(s).alias("center"), F.greatest(deviation(s) * 3, F.lit(1.0)).alias("width")))
    return F.when(modality == "CT", F.struct(F.lit(40.0).alias("center"), F.lit(400.0).alias("width"))).when(modality == "MG", spread).otherwise(percentiles)


def window_by_tags(data: Column, modality: Column, sequence: Column, bits_stored: Column) -> Column:
    """Struct of center and width by modality; ``sequence`` is the preview type of an MR image, X-ray images without bits stored have 12."""

    def ends(low: Column, high: Column) -> Column:
        top = F.when(high <= low, low + 1.0).otherwise(high)
        return F.struct(((low + top) / 2).alias("center"), (top - low).alias("width"))

    around = lambda m, w: ends(m - w / 2, m + w / 2)
    percentiles = lambda x: ends(quantile(x, 0.05), quantile(x, 0.95))
    wide = lambda x, times: around(mean(x), F.greatest(deviation(x) * times, F.array_max(x) - F.array_min(x)))

    def of_mr(x: Column) -> Column:
        by_type = F.when(sequence.isin("T1", "FLAIR", "STIR"), wide(x, 4)).when(sequence.isin("T2", "DWI"), wide(x, 5))
        return by_type.when(sequence == "LOCALIZER", ends(F.array_min(x), F.array_max(x))).otherwise(percentiles(x))

    kind = F.upper(F.coalesce(modality, F.lit("")))
    x = F.array_sort(finite(data))
    made = (
        F.when(kind == "CT", ends(F.lit(-160.0), F.lit(240.0)))
        .when(kind == "MR", let(tissue(x, kind), of_mr))
        .when(kind.isin("DX", "DR", "CR", "RF"), ends(F.lit(0.0), F.pow(F.lit(2.0), F.coalesce(bits_stored, F.lit(12))) - 1.0))
        .when(kind == "MG", let(x, lambda s: around(mean(s), deviation(s) * 3)))
        .otherwise(let(x, percentiles))
    )
    return F.when(F.size(x) == 0, ends(F.lit(0.0), F.lit(1.0))).otherwise(made)


def stretched(data: Column, top: int = 4095) -> Column:
    low, high = F.array_min(data), F.array_max(data)
    span = F.when(high > low, high - low).otherwise(1.0)
    return F.transform(data, lambda x: F.floor((x - low) / span * top).cast("int"))


# --- geometry --------------------------------------------------------------------------


def flipped_columns(data: Column, cols: Column) -> Column:
    return F.transform(data, lambda x, i: F.get(data, (i - i % cols + cols - 1 - i % cols).cast("int")))


def transposed(data: Column, rows: Column, cols: Column) -> Column:
    return F.transform(data, lambda x, i: F.get(data, ((i % rows) * cols + F.floor(i / rows)).cast("int")))


def reversed_zyx(data: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """(X, Y, Z) row-major, all axes flipped, as (Z, Y, X) row-major."""

    def source(i: Column) -> Column:
        z, y, x = F.floor(i / (ny * nx)), F.floor(i / nx) % ny, i % nx
        return (((nx - 1 - x) * ny + (ny - 1 - y)) * nz + (nz - 1 - z)).cast("int")

    return F.transform(data, lambda _, i: F.get(data, source(i)))


def middle_slice(data: Column, nz: Column, size: Column) -> Column:
    """Slice ``nz // 2`` of a (Z, Y, X) volume with ``size`` pixels a slice."""
    return F.slice(data, (F.floor(nz / 2) * size + 1).cast("int"), size)


def first_volume(data: Column, size: Column) -> Column:
    return F.slice(data, F.lit(1), size)


def affine(iop: Column, ipp: Column, row_spacing: Column, col_spacing: Column, slice_spacing: Column) -> Column:
    """Sixteen numbers of the matrix from voxels to right-anterior-superior millimetres; the unit matrix without orientation."""
    unit = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])

    def made(v: Column, p: Column) -> Column:
        row, col = [F.get(v, F.lit(k)) for k in range(3)], [F.get(v, F.lit(k)) for k in range(3, 6)]
        normal = [row[(k + 1) % 3] * col[(k + 2) % 3] - row[(k + 2) % 3] * col[(k + 1) % 3] for k in range(3)]
        sign = (-1.0, -1.0, 1.0)
        lines = [[sign[k] * col[k] * col_spacing, -sign[k] * row[k] * row_spacing, sign[k] * normal[k] * slice_spacing, sign[k] * F.get(p, F.lit(k))] for k in range(3)]
        matrix = F.array(*[x + F.lit(0.0) for line in lines for x in line], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
        return F.when((F.size(v) == 6) & (F.size(p) == 3), matrix).otherwise(unit)

    return _of_lists(iop, ipp, made)


def _of_lists(iop: Column, ipp: Column, body) -> Column:
    """``body`` of the two lists, each of which is parsed once a row, however often its numbers are used."""
    return let(number_list(iop), lambda v: let(number_list(ipp), lambda p: body(v, p)))


def voxel_sizes(matrix: Column) -> Column:
    return F.array(*[F.sqrt(sum((F.get(matrix, F.lit(r * 4 + c)) * F.get(matrix, F.lit(r * 4 + c)) for r in range(3)), F.lit(0.0))) for c in range(3)])


def axis_matrix(matrix: Column) -> Column:
    """The nearest matrix along the axes: voxel sizes with the sign of each column's largest part, and the translation."""
    at = lambda r, c: F.get(matrix, F.lit(r * 4 + c))
    sizes = voxel_sizes(matrix)

    def cell(r: int, c: int) -> Column:
        if c == 3:
            return at(r, 3)
        if r != c:
            return F.lit(0.0)
        parts = [F.abs(at(k, c)) for k in range(3)]
        top = F.greatest(*parts)
        largest = F.when(parts[0] == top, at(0, c)).when(parts[1] == top, at(1, c)).otherwise(at(2, c))
        return F.get(sizes, F.lit(c)) * F.when(largest < 0, -1.0).otherwise(1.0)

    return F.array(*[cell(r, c) for r in range(3) for c in range(4)], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def orientation_error(modality: Column, has_metadata: Column, has_iop: Column, matrix: Column) -> Column:
    """Flat X-ray images whose metadata lacks the orientation, or whose axes are swapped."""
    swapped = F.abs(F.get(matrix, F.lit(1))) > F.abs(F.get(matrix, F.lit(5)))
    return modality.isin("DX", "DR", "CR", "RF") & F.when(has_metadata, ~has_iop).otherwise(swapped)


def fit_inside(height: Column, width: Column, to_height: Column, to_width: Column) -> Column:
    """Size and offsets of an image scaled into a canvas and centred."""
    scale = F.least(to_height / height, to_width / width)
    h, w = F.floor(height * scale).cast("int"), F.floor(width * scale).cast("int")
    return F.struct(h.alias("height"), w.alias("width"), F.floor((to_height - h) / 2).cast("int").alias("top"), F.floor((to_width - w) / 2).cast("int").alias("left"))


def flat_affine(iop: Column, ipp: Column, row_spacing: Column, col_spacing: Column) -> Column:
    """Matrix of a single X-ray image: by its orientation and position, else rows along y and columns along x."""
    zero, one = F.lit(0.0), F.lit(1.0)
    standard = F.array(zero, col_spacing, zero, zero, row_spacing, zero, zero, zero, zero, zero, one, zero, zero, zero, zero, one)

    def made(v: Column, p: Column) -> Column:
        row, col = [F.get(v, F.lit(k)) for k in range(3)], [F.get(v, F.lit(k)) for k in range(3, 6)]
        normal = [row[(k + 1) % 3] * col[(k + 2) % 3] - row[(k + 2) % 3] * col[(k + 1) % 3] for k in range(3)]
        lines = [[s * row[k] * row_spacing, s * col[k] * col_spacing, s * normal[k], s * F.coalesce(F.get(p, F.lit(k)), zero)] for k, s in enumerate((-1.0, -1.0, 1.0))]
        return F.when(F.size(v) == 6, F.array(*[x + zero for line in lines for x in line], zero, zero, zero, one)).otherwise(standard)

    return _of_lists(iop, ipp, made)


def quality_cell(reasons: Column, legacy: Column | None = None) -> Column:
    """Struct of the 0/1 value and its text; a bare legacy number has no text unless it is 0."""
    fixed_only = F.forall(reasons, lambda r: F.startswith(r, F.lit("fixed_")))
    judged = F.struct(F.when(fixed_only, 0).otherwise(1).alias("value"), described(reasons).alias("reason"))
    if legacy is None:
        return judged
    return F.when(reasons.isNotNull(), judged).when(legacy.isNotNull(), F.struct(legacy.cast("int").alias("value"), F.when(legacy == 0, "Normal").otherwise("").alias("reason")))
