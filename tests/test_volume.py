"""Volumes and resampling against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import volume as V
from voxelmill.operators import joins as J
from voxelmill.operators import mr
from voxelmill.plans import catalog, fixtures
from voxelmill.sources import volumes


def test_canonical_against_numpy(spark):
    rows, told = [], {}
    draw = np.random.default_rng(4)
    for n, (order, signs) in enumerate(itertools.product(itertools.permutations(range(3)), itertools.product([1, -1], repeat=3))):
        affine = np.eye(4)
        affine[:3, :3] = draw.uniform(-0.2, 0.2, (3, 3))
        for axis, (world, sign) in enumerate(zip(order, signs, strict=True)):
            affine[world, axis] = sign * (axis + 1.5)
        values = draw.integers(0, 99, (2, 3, 4)).astype(float)
        rows.append((n, values.ravel(order="F").tolist(), [2, 3, 4], affine.ravel().tolist()))
        told[n] = volumes.canonical(values, affine)[0]
    table = spark.createDataFrame(rows, "n int, data array<double>, shape array<int>, affine array<double>")
    for r in table.select("n", V.canonical(F.col("data"), F.col("shape"), F.col("affine")).alias("v")).select("n", "v", V.orthogonal_slices(F.col("v")).alias("o")).collect():
        out = told[r.n]
        assert tuple(r.v.shape) == out.shape and r.v.data == out.ravel(order="F").tolist()
        x, y, z = (k // 2 for k in out.shape)
        assert (r.o.axial, r.o.sagittal, r.o.coronal) == (out[:, :, z].ravel(order="F").tolist(), out[x].ravel(order="F").tolist(), out[:, y].ravel(order="F").tolist())


def test_matrices_that_need_repair(spark):
    nan = float("nan")
    cases = [([nan] * 12 + [0.0, 0.0, 0.0, 1.0], [2, 2, 2]), ([-2.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3.0, 0, 0, 0, 0, 1], [2, 2, 2]), (np.eye(4).ravel().tolist(), [2, 2, 2, 3]), (np.eye(4).ravel().tolist(), [4, 2]), (None, [2, 2, 2])]
    rows = [(n, [float(v) for v in range(24)], shape, None if m is None else [float(v) for v in m]) for n, (m, shape) in enumerate(cases)]
    table = spark.createDataFrame(rows, "n int, data array<double>, shape array<int>, affine array<double>")
    found = {r.n: r.v for r in table.select("n", V.canonical(F.col("data"), F.col("shape"), F.col("affine")).alias("v")).collect()}
    assert found[0].data == [float(v) for v in range(8)]  # no axis is known: as it is
    assert found[1].data == [1.0, 0.0, 3.0, 2.0, 5.0, 4.0, 7.0, 6.0]  # the axis that is known is turned round
    assert found[2].data == [float(v) for v in range(8)] and found[3] is None


def triangle(size, target):
    """The weights of a widened triangle, as a matrix."""
    scale = size / target
    wide = max(scale, 1.0)
    w = np.maximum(0, 1 - np.abs((np.arange(size)[None] + 0.5 - (np.arange(target)[:, None] + 0.5) * scale) / wide))
    return w / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("eight_bit", [False, True])
def test_resampling_against_matrices(spark, eight_bit):
    draw = np.random.default_rng(5)
    image = draw.integers(0, 256, (6, 5)).astype(float)
    rounded = (lambda a: np.floor(a + 0.5)) if eight_bit else (lambda a: a)
    table = spark.createDataFrame([(k, image.ravel().tolist(), r) for k, r in enumerate([0.2, 1.0, 1.4, 2.5, None, -1.0, 0.01])], "k int, data array<double>, ratio double")
    col = F.col("data")
    for r in table.select("k", "ratio", V.with_aspect(col, F.lit(5), F.lit(6), F.col("ratio"), eight_bit).alias("a"), V.letterboxed(col, F.lit(5), F.lit(6), 17, eight_bit).alias("b"), V.physical_height(col, F.lit(5), F.lit(6), F.lit(1.019), F.lit(1.0), eight_bit).alias("c")).collect():
        rows = 6 if not r.ratio or r.ratio <= 0 else max(1, round(6 * r.ratio))
        right = image if rows == 6 else rounded(triangle(6, rows) @ image)
        assert r.a.rows == rows and np.allclose(r.a.data, right.ravel(), atol=1e-9)
        assert r.c.rows == 6 and r.c.data == image.ravel().tolist()
        canvas = np.zeros((17, 17))
        wide = rounded(image @ triangle(5, 14).T)
        canvas[:, 1:15] = rounded(triangle(6, 17) @ wide)
        assert np.allclose(r.b, canvas.ravel(), atol=1e-9)


def test_not_named(spark):
    items = spark.createDataFrame([("a-t1-b",), ("t12",), ("x",), (None,), ("",), ("t1",), ("t1",)], "item string")
    named = lambda ids: sorted(J.not_named(items, spark.createDataFrame([(i,) for i in ids], "task string"), "item", "task").toPandas()["item"].tolist(), key=str)
    assert named(["t1", None, "longer than any name"]) == ["", None, "x"]
    assert named([]) == sorted(["a-t1-b", "t12", "x", None, "", "t1", "t1"], key=str)
    assert named([""]) == [None] and named(["t12"]) == ["", None, "a-t1-b", "t1", "t1", "x"]


def test_lists_are_parsed_once_a_row(spark):
    """However many numbers of the matrix are used: parsing is most of the work."""
    for name in ("i03_affine", "i04_flat_affine", "i05_axis_matrix", "i11_orientation_error", "f46_voxel_sizes"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 2, name


def test_clean_series_of_few_columns(spark, monkeypatch):
    """Only what is asked for is written, the rows stay the same, and the series are made once."""
    series = fixtures.mr_series(spark, "/root/testdata/sf0.001")
    some = ["series_key", "sequenceClass", "isContrastEnhanced", "dynamicPhase", "dynamicGroup"]
    whole = mr.clean_series(series).select(*some).collect()
    written, cut = [], mr.cut_lineage
    monkeypatch.setattr(mr, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    made = mr.clean_series(series, columns=some)
    assert made.columns == some and sorted(made.collect()) == sorted(whole)
    assert set(written[0]) == {*mr._LAST, *some} - {"dynamicGroup"}
    assert "lineitem" not in made._jdf.queryExecution().optimizedPlan().toString() and "l_orderkey" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_the_class_are_short_code(spark):
    """The rules of the class run as generated code, in no lambda."""
    plan = catalog.queries()["f09_sequence_class"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
