"""Volumes and images as arrays: canonical axes, orthogonal slices, resampling.

Volumes have their first axis fastest, images are row by row. What a row needs once
(axes, sizes, weights) is bound by an outer ``transform`` over one element, so that it
isn't worked out again for every value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelmill.functions.pixels import axis_matrix, voxel_sizes

#: A ratio of spacings this near to one leaves a slice as it is.
SAME_SPACING = 0.02


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decomposable(matrix: Column) -> Column:
    """Whether a matrix has finite numbers only and no axis without length."""
    finite = F.forall(matrix, lambda v: ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(finite & F.forall(voxel_sizes(matrix), lambda v: v > 0), F.lit(False))


def repaired(matrix: Column) -> Column:
    """The matrix itself, or the nearest one along the axes where it can't be decomposed.

    There a size that is no positive number becomes 1, a translation that isn't finite 0.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    mended = lambda v, k: F.when(~bad(v) & ((v != 0) | ~k.isin(0, 5, 10)), v).otherwise(F.when(k.isin(0, 5, 10), 1.0).otherwise(0.0))
    return bound(matrix, lambda m: F.when(decomposable(m), m).otherwise(F.transform(axis_matrix(m), mended)))


def axis_plan(matrix: Column) -> Column:
    """For the world axes right, anterior, superior: the voxel axis along each, and whether it runs the other way.

    Voxel axes choose in the order of their largest direction cosine, each the world axis
    nearest to it that is left. Axes are taken as orthogonal.
    """
    cosines = lambda m: bound(voxel_sizes(m), lambda sizes: F.transform(m, lambda v, k: v / F.get(sizes, k % 4)))

    def columns(c: Column) -> Column:
        # cosines are rounded where they are compared, so that ties go to the first axis
        part = lambda r, k: F.get(c, F.lit(r * 4 + k))
        near = lambda r, k: F.round(F.abs(part(r, k)), 12)
        to = lambda k: F.array(*[F.struct(near(r, k).alias("by"), F.lit(-r).alias("turn"), (part(r, k) < 0).alias("flip")) for r in range(3)])
        return F.array(*[F.struct((-F.greatest(*[near(r, k) for r in range(3)])).alias("k"), F.lit(k).alias("axis"), to(k).alias("to")) for k in range(3)])

    taken = F.array().cast("array<struct<world:int,axis:int,flip:boolean>>")

    def choose(chosen: Column, column: Column) -> Column:
        best = F.array_max(F.filter(column["to"], lambda t: ~F.exists(chosen, lambda o: o["world"] == -t["turn"])))
        return bound(best, lambda b: F.concat(chosen, F.array(F.struct((-b["turn"]).alias("world"), column["axis"].alias("axis"), b["flip"].alias("flip")))))

    order = bound(bound(matrix, cosines), lambda c: F.aggregate(F.array_sort(columns(c)), taken, choose))
    return F.transform(F.array_sort(order), lambda o: F.struct(o["axis"].alias("axis"), o["flip"].alias("flip")))


def canonical(data: Column, shape: Column, matrix: Column) -> Column:
    """The first volume with its axes in the order and direction of right, anterior, superior: struct of ``shape, data``.

    Null where there are under three axes or the values don't fill the shape.
    """
    size = lambda k: F.get(shape, F.lit(k))
    steps = F.array(F.lit(1), size(0), size(0) * size(1))

    def gather(plan: Column) -> Column:
        axis = [F.get(plan, F.lit(k))["axis"] for k in range(3)]
        flip = [F.get(plan, F.lit(k))["flip"] for k in range(3)]
        sizes = [F.get(shape, a) for a in axis]
        step = [F.get(steps, a) for a in axis]
        start = sum((F.when(f, (n - 1) * s).otherwise(0) for f, n, s in zip(flip, sizes, step, strict=True)), F.lit(0))
        told = F.struct(*[n.alias(f"n{k}") for k, n in enumerate(sizes)], *[F.when(f, -s).otherwise(s).alias(f"s{k}") for k, (f, s) in enumerate(zip(flip, step, strict=True))], start.alias("start"))

        def values(t: Column) -> Column:
            at = lambda i: t["start"] + i % t["n0"] * t["s0"] + F.floor(i / t["n0"]) % t["n1"] * t["s1"] + F.floor(i / (t["n0"] * t["n1"])) * t["s2"]
            places = F.sequence(F.lit(0), t["n0"] * t["n1"] * t["n2"] - 1)
            return F.struct(F.array(t["n0"], t["n1"], t["n2"]).alias("shape"), F.transform(places, lambda i: F.get(data, at(i).cast("int"))).alias("data"))

        return bound(told, values)

    voxels = size(0) * size(1) * size(2)
    return F.when((F.size(shape) >= 3) & (voxels > 0) & (F.size(data) >= voxels), bound(axis_plan(repaired(matrix)), gather))


def orthogonal_slices(volume: Column) -> Column:
    """The middle slice along each axis of a struct ``shape, data``: ``axial`` (x, y), ``sagittal`` (y, z), ``coronal`` (x, z), the first of them fastest."""
    nx, ny, nz = (F.get(volume["shape"], F.lit(k)) for k in range(3))
    mid = lambda n: F.floor(n / 2).cast("int")
    take = lambda count, at: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(volume["data"], at(i).cast("int")))
    axial = F.slice(volume["data"], mid(nz) * nx * ny + 1, nx * ny)
    sagittal = take(ny * nz, lambda i: mid(nx) + nx * i)
    coronal = take(nx * nz, lambda i: i % nx + nx * (mid(ny) + ny * F.floor(i / nx)))
    return F.when(volume.isNotNull(), F.struct(axial.alias("axial"), sagittal.alias("sagittal"), coronal.alias("coronal")))


def taps(size: Column, target: Column) -> Column:
    """For each of ``target`` places along an axis of ``size``: the first source place and the weights from there on.

    Linear interpolation; where the axis shrinks the triangle is widened by the scale, so
    that every source value counts.
    """
    scale = size / target
    wide = F.greatest(scale, F.lit(1.0))

    def one(i: Column) -> Column:
        center = (i + 0.5) * scale
        low, high = F.greatest(F.floor(center - wide + 0.5), F.lit(0)), F.least(F.floor(center + wide + 0.5), size)
        raw = F.transform(F.sequence(low, F.greatest(high - 1, low)), lambda x: F.greatest(1 - F.abs((x - center + 0.5) / wide), F.lit(0.0)))
        return bound(raw, lambda w: F.struct(low.cast("int").alias("low"), F.transform(w, lambda v: v / F.aggregate(w, F.lit(0.0), lambda a, b: a + b)).alias("weights")))

    return F.transform(F.sequence(F.lit(0), target - 1), one)


def _weighted(tap: Column, value: Callable[[Column], Column], eight_bit: bool) -> Column:
    total = F.aggregate(F.transform(tap["weights"], lambda w, k: w * value(tap["low"] + k)), F.lit(0.0), lambda a, b: a + b)
    return F.floor(total + 0.5).cast("double") if eight_bit else total


def with_rows(data: Column, cols: Column, rows: Column, target: Column, eight_bit: bool = False) -> Column:
    """An image of ``rows`` x ``cols`` with ``target`` rows; 8-bit values are rounded."""

    def scaled(image: Column) -> Column:
        line = lambda t: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: _weighted(t, lambda r: F.get(image, (r * cols + c).cast("int")), eight_bit))
        return F.flatten(F.transform(taps(rows, target), line))

    return bound(data, scaled)


def with_cols(data: Column, cols: Column, rows: Column, target: Column, eight_bit: bool = False) -> Column:
    """An image of ``rows`` x ``cols`` with ``target`` columns."""

    def scaled(image: Column) -> Column:
        cell = lambda r, t: _weighted(t, lambda c: F.get(image, (r * cols + c).cast("int")), eight_bit)
        lines = lambda ts: F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(ts, lambda t: cell(r, t))))
        return bound(taps(cols, target), lines)

    return bound(data, scaled)


def _whole(value: Column) -> Column:
    """To the nearest whole number, halves to the even one, and one at least."""
    return F.greatest(F.bround(value, 0).cast("int"), F.lit(1))


def with_aspect(data: Column, cols: Column, rows: Column, ratio: Column, eight_bit: bool = False) -> Column:
    """Height times ``ratio``; struct of ``rows, data``. A ratio that is missing or not positive changes nothing."""
    target = F.when(ratio > 0, _whole(rows * ratio)).otherwise(rows)
    return F.struct(target.alias("rows"), F.when(target == rows, data).otherwise(with_rows(data, cols, rows, target, eight_bit)).alias("data"))


def physical_height(data: Column, cols: Column, rows: Column, row_spacing: Column, col_spacing: Column, eight_bit: bool = False) -> Column:
    """A slice stretched to its physical height unless its spacings differ by under 2 %."""
    ratio = row_spacing / col_spacing
    return with_aspect(data, cols, rows, F.when(F.abs(ratio - 1) >= SAME_SPACING, ratio), eight_bit)


def letterboxed(data: Column, cols: Column, rows: Column, side: int = 896, eight_bit: bool = False) -> Column:
    """An image scaled so that its longer side is ``side``, in the middle of a square of zeros; an empty image stays as it is."""
    scale = F.lit(float(side)) / F.greatest(cols, rows)
    new = F.struct(_whole(rows * scale).alias("rows"), _whole(cols * scale).alias("cols"))

    def placed(size: Column) -> Column:
        scaled = with_rows(with_cols(data, cols, rows, size["cols"], eight_bit), size["cols"], rows, size["rows"], eight_bit)
        top, left = F.floor((side - size["rows"]) / 2), F.floor((side - size["cols"]) / 2)

        def cell(image: Column, i: Column) -> Column:
            r, c = F.floor(i / side) - top, i % side - left
            inside = (r >= 0) & (r < size["rows"]) & (c >= 0) & (c < size["cols"])
            return F.when(inside, F.get(image, (r * size["cols"] + c).cast("int"))).otherwise(0.0)

        return bound(scaled, lambda image: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: cell(image, i)))

    return F.when((cols > 0) & (rows > 0), bound(new, placed)).otherwise(data)
