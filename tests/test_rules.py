"""One row for each branch and on both sides of each threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import basic as B
from voxelmill.functions import pixels as P
from voxelmill.functions import series as S
from voxelmill.functions import text as T
from voxelmill.operators import images, mr

BASE = dict(
    series_key=1, study_uid="s", protocol_name="x", series_desc="", image_type="ORIGINAL\\PRIMARY", scanning_sequence="SE", sequence_variant="NONE", mr_acquisition_type="2D", repetition_time="5000", echo_time="10",
    inversion_time="", b_value="", echo_train_length="1", field_strength="1.5", manufacturer="x", contrast_agent=None, iop=None, ipp=None, series_time="1", slice_thickness="1",
)
SCHEMA = ", ".join(f"{k} {'long' if k == 'series_key' else 'string'}" for k in BASE)


def classes(spark, *changes):
    rows = [tuple({**BASE, "series_key": k, **c}.values()) for k, c in enumerate(changes)]
    df = mr.classify(mr.hardware_features(mr.atomic_features(spark.createDataFrame(rows, SCHEMA))))
    return [r[0] for r in df.orderBy("series_key").select("sequenceClass").collect()]


def test_physics_thresholds(spark):
    cases = [
        (dict(b_value="50"), "UNKNOWN"), (dict(b_value="50.1"), "DWI"), (dict(b_value="51", protocol_name="dti"), "DTI"),
        (dict(inversion_time="99"), "UNKNOWN"), (dict(inversion_time="100"), "T2_STIR"), (dict(inversion_time="250"), "T2_STIR"), (dict(inversion_time="251"), "UNKNOWN"), (dict(inversion_time="1800"), "T2_FLAIR"),
        (dict(echo_time="70"), "UNKNOWN"), (dict(echo_time="70.1"), "T2_SE"), (dict(repetition_time="1199", echo_time="39"), "T1_SE"), (dict(repetition_time="1200", echo_time="39"), "UNKNOWN"),
        (dict(echo_time="71", echo_train_length="2"), "T2_TSE"), (dict(echo_time="71", echo_train_length="129"), "T2_SE_SingleShot"), (dict(echo_time="71", echo_train_length="128"), "T2_TSE"),
        (dict(protocol_name="pd_x", echo_time="49"), "PD_SE"), (dict(scanning_sequence="GR", sequence_variant="SS", echo_time="71"), "T2_GRE_STEADY_STATE"),
        (dict(echo_time="nan", repetition_time="nan"), "UNKNOWN"), (dict(scanning_sequence="EP", protocol_name="bold"), "fMRI_BOLD"),
    ]
    assert classes(spark, *[c for c, _ in cases]) == [e for _, e in cases]


def test_names_win_and_suffixes_follow(spark):
    cases = [
        (dict(protocol_name="localizer", b_value="900"), "LOCALIZER"), (dict(protocol_name="t1_map"), "T1_MAP"), (dict(protocol_name="subtle"), "SUBTRACTION"), (dict(series_desc="MIP thin"), "MIP"),
        (dict(protocol_name="t2 blade", echo_time="71"), "T2_SE_MC"), (dict(echo_time="71", series_desc="water"), "T2_SE_WATER"), (dict(echo_time="71", image_type="ORIGINAL\\PRIMARY\\FAT"), "T2_SE_FAT"),
        (dict(protocol_name="t1 mpr iso", scanning_sequence="EP", mr_acquisition_type="3D"), "T1_GRE_FLASH3D"), (dict(protocol_name="t1", scanning_sequence="EP"), "T1_NAME_BASED"),
        (dict(protocol_name="t2 tse_dark_fluid", scanning_sequence="EP"), "T2_FLAIR"), (dict(protocol_name="t2 t1", scanning_sequence="EP"), "T1_NAME_BASED"), (dict(protocol_name="t2_star_echo_2", scanning_sequence="EP"), "T2_NAME_BASED_ECHO2_MC"),
        (dict(protocol_name=None, series_desc=None, scanning_sequence=None), "UNKNOWN"),
    ]
    assert classes(spark, *[c for c, _ in cases]) == [e for _, e in cases]


def test_field_strength_bins(spark):
    df = spark.createDataFrame([(0.99,), (1.0,), (1.99,), (2.0,), (4.0,), (None,)], "t double").select(S.field_strength(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == ["Low-Field", "1.5T", "1.5T", "3.0T", "High-Field", "nan"]


def test_dynamic_sets(spark):
    rows = [{**BASE, "series_key": k, "series_time": t, "protocol_name": "t1 dyn", "contrast_agent": "gd", "ipp": "[0.0, 0.0, 1.0]"} for k, t in enumerate(["30", "10", "20", ""])]
    rows += [{**BASE, "series_key": 10, "series_time": "99", "protocol_name": "t1 late", "scanning_sequence": "EP", "ipp": "[9.0, 0.0, 1.0]"}, {**BASE, "series_key": 11, "study_uid": None}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    found = {r["series_key"]: r for r in mr.clean_series(df).collect()}
    assert [found[k]["dynamicPhase"] for k in range(4)] == ["POST_2", "PRE", "POST_1", "POST_3"]
    assert found[10]["dynamicPhase"] == "POST_PROPAGATED" and found[10]["isContrastEnhanced"]
    assert found[11]["dynamicPhase"] == "" and found[11]["dynamicGroup"] is None and found[0]["dynamicGroup"] == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("303. X  Elbow<a>[b]",), ("...",), (None,), ("y" * 80,)], "n string").select(T.folder_name(F.col("n")).alias("f"))
    assert [r.f for r in df.collect()] == ["303_X_Elbow_a_b", "Unknown", "Unknown", "y" * 50]
    sizes = spark.createDataFrame([(0,), (1536,), (1048576,)], "b long").select(T.human_size(F.col("b")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["0 Bytes", "1.5 KB", "1 MB"]
    lows = spark.createDataFrame([("YES",), ("1.9",), ("2",), (None,), ("",)], "v string").select(T.is_truthy_low(F.col("v")).alias("l"))
    assert [r.l for r in lows.collect()] == [True, True, False, False, False]
    lists = spark.createDataFrame([("[1.005, -0.001]",), ("abc",), (None,)], "v string").select(B.rounded_list(F.col("v")).alias("l"))
    assert [r.l for r in lists.collect()][1:] == ["INVALID", "NA"]


def test_pixels_match_numpy(spark):
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(100, 40, (6, 8)), 3)
    df = spark.createDataFrame([(x.ravel().tolist(), 6, 8)], "data array<double>, r int, c int")
    s = df.select(P.pixel_statistics(F.col("data"), F.lit("DX")).alias("s")).first().s
    assert (s.p2, s.p98) == pytest.approx(tuple(np.percentile(x, [2, 98]))) and s.std == pytest.approx(x.std())
    turned = df.select(P.transposed(F.col("data"), F.col("r"), F.col("c")).alias("t"), P.flipped_columns(F.col("data"), F.col("c")).alias("f"), P.mirrored(P.mirrored(F.col("data"))).alias("m")).first()
    assert turned.t == x.T.ravel().tolist() and turned.f == x[:, ::-1].ravel().tolist() and turned.m == pytest.approx(x.ravel().tolist())
    volume = draw.normal(size=(2, 3, 4))
    v = spark.createDataFrame([(volume.ravel().tolist(),)], "data array<double>").select(P.reversed_zyx(F.col("data"), F.lit(2), F.lit(3), F.lit(4)).alias("v")).first().v
    assert v == np.flip(volume).transpose(2, 1, 0).ravel().tolist()


def test_quality_of_odd_images(spark):
    rows = [(1, "DX", None), (2, "DX", []), (3, "DX", [5.0] * 4), (4, "DX", [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "image_id int, modality string, data array<double>").withColumn("n_rows", F.lit(2)).withColumn("n_cols", F.lit(2))
    found = {r.image_id: r.reasons for r in images.image_quality(df, masks=False).collect()}
    assert found == {1: ["no_pixel_data"], 2: ["empty_data"], 3: ["dynamic_range_invalid"], 4: ["empty_data"]}


def test_components():
    mask = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 0], [1, 0, 1, 1]], dtype=bool)
    assert images.component_count(mask) == 4 and images.component_count(np.zeros((3, 3), bool)) == 0


def test_queries_over_all_studies(spark):
    from voxelmill.plans import catalog
    from voxelmill.session import read_table

    sf = "/root/testdata/sf0.001"
    assert catalog.queries()["s01_study_query"](spark, sf).count() == read_table(spark, sf, "lineitem").select("l_orderkey").distinct().count()
    assert catalog.queries()["j10_u04_resumed"](spark, sf).count() == read_table(spark, sf, "orders").where("o_orderstatus = 'F'").count()


def test_window_by_tags(spark):
    from voxelmill.functions.pixels import window_by_tags

    data = [0.0] * 8 + [10.0, 20.0, 30.0, 40.0, 50.0, 160.0]
    x = np.array(data[8:])
    p5, p95 = np.percentile(x, [5, 95])
    q5, q95 = np.percentile(data, [5, 95])
    cases = {
        ("MR", "T1", None): (x.mean(), max(x.std() * 4, 150)), ("MR", "T2", None): (x.mean(), max(x.std() * 5, 150)), ("MR", "LOCALIZER", None): (85, 150), ("MR", "PD", None): ((p5 + p95) / 2, p95 - p5),
        ("DX", None, 14): (8191.5, 16383), ("CR", None, None): (2047.5, 4095), ("ct", None, None): (40, 400), ("MG", None, 12): (np.mean(data), np.std(data) * 3), ("US", None, None): ((q5 + q95) / 2, q95 - q5),
    }
    rows = spark.createDataFrame([(*k, data, k in cases) for k in cases] + [("DX", None, None, [], False), ("US", None, None, [3.0, 3.0], False)], "m string, s string, b int, data array<double>, full boolean")
    found = rows.select("m", "s", "b", "full", window_by_tags(F.col("data"), F.col("m"), F.col("s"), F.col("b")).alias("w")).collect()
    assert {(r.m, r.s, r.b): tuple(r.w) for r in found if r.full} == {k: pytest.approx(v) for k, v in cases.items()}
    assert [tuple(r.w) for r in found if not r.full] == [(0.5, 1.0), (3.5, 1.0)]


def test_component_count_against_spreading():
    draw = np.random.default_rng(5)
    for share in (0.1, 0.4, 0.6, 0.9):
        mask = draw.random((17, 13)) < share
        left, found = set(zip(*np.nonzero(mask), strict=True)), 0
        while left:
            found, front = found + 1, [left.pop()]
            while front:
                r, c = front.pop()
                for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if near in left:
                        left.remove(near)
                        front.append(near)
        assert images.component_count(mask) == found


def test_masks_of_images_without_pixels(spark):
    rows = [(1, "MR", None, 2, 2), (2, "MR", [], 0, 0), (3, "MR", [1.0, 2.0, 3.0], 2, 2), (4, None, [1.0, 2.0, 3.0, 900.0], 2, 2), (5, "US", [1.0, 900.0, 1.0, 900.0], 2, 2), (6, "MR", [1.0, 900.0, 1.0, 900.0], 2, 2)]
    df = spark.createDataFrame(rows, "image_id int, modality string, data array<double>, n_rows int, n_cols int")
    found = {r.image_id: r.reasons for r in images.image_quality(df).collect()}
    assert found[1] == ["no_pixel_data"] and found[2] == ["empty_data"]
    assert "segmentation_mask" in found[6] and "segmentation_mask" not in found[5]
    assert {r.image_id: r.low for r in images.low_quality_png(df).collect()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True}
