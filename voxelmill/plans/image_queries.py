"""Queries of pixel arrays: 8 x 8 images made of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import pixels as P
from voxelmill.functions.series import preview_type
from voxelmill.operators import images as I
from voxelmill.plans import fixtures as X
from voxelmill.session import read_table

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


_MOD = "CASE label % 5 WHEN 0 THEN 'MR' WHEN 1 THEN 'DX' WHEN 2 THEN 'CT' WHEN 3 THEN 'MG' ELSE 'US' END"


#: Tags of the made images, which have none of their own.
_TAGS = {
    "name": "element_at(array('localizer', 't2 flair', 'stir', 'dwi', 'adc map', 'ax t1', 'plain'), cast(floor(image_id / 5) % 7 + 1 as int))",
    "image_type": "'ORIGINAL'",
    "tr": "floor(image_id / 5) % 4 * 700.0 + 500",
    "te": "floor(image_id / 5) % 5 * 25.0",
    "ti": "case floor(image_id / 5) % 11 when 0 then 2200.0 when 1 then 150.0 end",
    "bits": "case when floor(image_id / 5) % 3 > 0 then 10 + floor(image_id / 5) % 7 end",
}


def images(s, d):
    """Label 0 has a small range; pixels are rounded so that both engines sum the same numbers."""
    data = F.transform("embedding", lambda v: F.round(v.cast("double") * F.when(F.col("label") == 0, 10).otherwise(1000), 3))
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.expr(_MOD).alias("modality"), "label", data.alias("data"), F.lit(8).alias("n_rows"), F.lit(8).alias("n_cols"))


PX = f"""WITH im AS (SELECT vec_id AS image_id, {_MOD} AS modality, label, list_transform(embedding, lambda v: round(v::DOUBLE * CASE WHEN label = 0 THEN 10 ELSE 1000 END, 3)) AS data FROM embeddings),
px AS (SELECT image_id, modality, label, unnest(data) AS x, generate_subscripts(data, 1) - 1 AS i FROM im),
tis AS (SELECT px.* FROM px JOIN (SELECT image_id, max(x) AS top, count(*) AS n FROM px GROUP BY 1) USING (image_id) JOIN (SELECT image_id, count(*) FILTER (x > m * 0.001) AS k FROM px JOIN (SELECT image_id, max(x) AS m FROM px GROUP BY 1) USING (image_id) GROUP BY 1) USING (image_id)
  WHERE NOT (modality IN ('MR','CT') AND k > n * 0.05) OR x > top * 0.001),
st AS (SELECT image_id, any_value(modality) AS modality, quantile_cont(x, 0.02) AS p2, quantile_cont(x, 0.98) AS p98, stddev_pop(x) AS std, count(DISTINCT x)::DOUBLE / count(*) AS uniq, avg(x) AS mean, count(*) AS n FROM tis GROUP BY 1),
tl AS (SELECT image_id, avg((x <= p2 + 0.01 * greatest(p98 - p2, 1e-6))::INT) AS lo, avg((x >= p98 - 0.01 * greatest(p98 - p2, 1e-6))::INT) AS hi FROM tis JOIN st USING (image_id) GROUP BY 1),
bd AS (SELECT image_id, avg(x) FILTER (i // 8 IN (0, 7) OR i % 8 IN (0, 7)) - avg(x) FILTER (NOT (i // 8 IN (0, 7) OR i % 8 IN (0, 7))) AS excess FROM px GROUP BY 1)"""
_RULES = """list_filter([CASE WHEN p98 - p2 < CASE modality WHEN 'MR' THEN 15 WHEN 'DX' THEN 10 WHEN 'MG' THEN 10 ELSE 20 END THEN 'dynamic_range_low' END,
  CASE WHEN std < CASE WHEN modality IN ('DX','MG') THEN 3 ELSE 5 END THEN 'contrast_low' END,
  CASE WHEN uniq < CASE modality WHEN 'MR' THEN 0.008 WHEN 'DX' THEN 0.001 WHEN 'MG' THEN 0.001 ELSE 0.01 END THEN 'complexity_low' END,
  CASE WHEN mean < p2 + 0.1 * greatest(p98 - p2, 1e-6) OR lo > 0.6 THEN 'under_exposed' END,
  CASE WHEN mean > p98 - 0.1 * greatest(p98 - p2, 1e-6) OR hi > 0.6 THEN 'over_exposed' END,
  CASE WHEN excess > 0.1 * greatest(p98 - p2, 1e-6) THEN 'grayscale_inverted' END], lambda r: r IS NOT NULL)"""
QC = PX + f", qc AS (SELECT image_id, modality, {_RULES} AS reasons FROM st JOIN tl USING (image_id) JOIN bd USING (image_id))"


def _judged(s, d):
    return I.image_quality(images(s, d), masks=False)


def _stats(s, d):
    return images(s, d).select("image_id", P.pixel_statistics(F.col("data"), F.col("modality")).alias("s"))


_add("a05_a06_a07_p13_p14_statistics", lambda s, d: _stats(s, d).select("image_id", F.round("s.p2", 8).alias("p2"), F.round("s.p98", 8).alias("p98"), F.round("s.std", 6).alias("std"), F.round("s.unique_ratio", 6).alias("unique_ratio"), F.round("s.mean", 9).alias("mean"), F.round("s.low_ratio", 6).alias("low_ratio"), F.round("s.high_ratio", 6).alias("high_ratio"), F.col("s.n").cast("long").alias("n")),
     PX + " SELECT image_id, round(p2, 8) AS p2, round(p98, 8) AS p98, round(std, 6) AS std, round(uniq, 6) AS unique_ratio, round(mean, 9) AS mean, round(lo, 6) AS low_ratio, round(hi, 6) AS high_ratio, n FROM st JOIN tl USING (image_id)")
_add("a08_border_excess", lambda s, d: images(s, d).select("image_id", F.round(P.border_excess(F.col("data"), F.col("n_rows"), F.col("n_cols")), 6).alias("excess")), PX + " SELECT image_id, round(excess, 6) AS excess FROM bd")
_add("i09_f30_image_quality", lambda s, d: _judged(s, d).select("image_id", F.array_join("reasons", ",").alias("reasons"), "low"), QC + " SELECT image_id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS low FROM qc")
_add("f28_f49_j14_described", lambda s, d: _judged(s, d).select("image_id", P.described(F.col("reasons")).alias("told"), F.col("low").cast("int").alias("code")),
     QC + f", e(k, v) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in P.REASONS.items())}), u AS (SELECT image_id, unnest(reasons) AS k, generate_subscripts(reasons, 1) AS i FROM qc) SELECT image_id, coalesce((SELECT string_agg(v, '; ' ORDER BY i) FROM u JOIN e USING (k) WHERE u.image_id = qc.image_id), 'Normal') AS told, (len(reasons) > 0)::INT AS code FROM qc")
_add("f31_f47_fixed", lambda s, d: _judged(s, d).select("image_id", P.after_fixes(F.col("reasons"), F.col("image_id") % 2 == 0, F.array_contains("reasons", "grayscale_inverted")).alias("f")).select("image_id", "f.low", F.array_join("f.reasons", ",").alias("reasons")),
     QC + ", g AS (SELECT image_id, list_filter(reasons, lambda r: r <> 'grayscale_inverted') AS r, list_contains(reasons, 'grayscale_inverted') AS g FROM qc) SELECT image_id, len(r) > 0 AS low, array_to_string(list_filter(list_append(r, CASE WHEN g AND image_id % 2 = 0 THEN 'fixed_both' WHEN image_id % 2 = 0 THEN 'fixed_orientation' WHEN g THEN 'fixed_grayscale' END), lambda x: x IS NOT NULL), ',') AS reasons FROM g")
_add("a10_series_quality", lambda s, d: I.series_quality(_judged(s, d), "modality").select("modality", "images", F.round("ratio", 9).alias("ratio"), "low"), QC + " SELECT modality, count(*) AS images, round(avg((len(reasons) > 0)::INT), 9) AS ratio, avg((len(reasons) > 0)::INT) > 0.3 AS low FROM qc GROUP BY 1")
_add("a11_reason_counters", lambda s, d: _judged(s, d).agg(*[F.count_if(F.array_contains("reasons", r)).alias(r) for r in ("contrast_low", "grayscale_inverted", "under_exposed")]), QC + " SELECT count(*) FILTER (list_contains(reasons, 'contrast_low')) AS contrast_low, count(*) FILTER (list_contains(reasons, 'grayscale_inverted')) AS grayscale_inverted, count(*) FILTER (list_contains(reasons, 'under_exposed')) AS under_exposed FROM qc")
_add("a12_reason_summary", lambda s, d: I.reason_summary(_judged(s, d).withColumn("series", F.col("image_id") % 50), "series"),
     QC + f", e(k, v) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in P.REASONS.items())}), r AS (SELECT image_id, image_id % 50 AS series, unnest(reasons) AS k, generate_subscripts(reasons, 1) AS at_ FROM qc), c AS (SELECT series, k, count(*) AS n, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, min(image_id * 100 + at_)) AS o FROM r GROUP BY 1, 2), l AS (SELECT series, string_agg(concat(v, ':', n), ', ' ORDER BY o) AS t FROM c JOIN e USING (k) WHERE o <= 3 GROUP BY 1), s AS (SELECT image_id % 50 AS series, avg((len(reasons) > 0)::INT) AS a FROM qc GROUP BY 1) SELECT series, CASE WHEN t IS NULL THEN 'Normal' ELSE concat(round_even(a * 100, 0)::INT, '% files with issues - ', t) END AS summary FROM s LEFT JOIN l USING (series)")
_add("j13_thresholds", lambda s, d: images(s, d).select("image_id", P.threshold(F.col("modality"), "dynamic_range_min", {("MR", "dynamic_range_min"): 17.0}).alias("t")), PX + " SELECT image_id, CASE modality WHEN 'MR' THEN 17.0 WHEN 'DX' THEN 10.0 WHEN 'MG' THEN 10.0 ELSE 20.0 END::DOUBLE AS t FROM im")
_add("w11_thinned", lambda s, d: images(s, d).select("image_id", F.size(P.thinned(F.col("data"), 20)).alias("n"), F.get(P.thinned(F.col("data"), 20), F.lit(1)).alias("second")), PX + " SELECT image_id, 22 AS n, data[4] AS second FROM im")


def _hash(column, name="sum"):
    """A weighted sum over an array: one number that depends on every place."""
    return F.round(F.aggregate(F.transform(column, lambda x, i: x * (i + 1)), F.lit(0.0), lambda t, x: t + x), 3).alias(name)


_SUM = "round(list_sum(list_transform({0}, lambda x, i: x * i)), 3) AS sum"
_add("i01_rescaled", lambda s, d: images(s, d).select("image_id", _hash(P.rescaled(F.col("data"), F.lit(2.0), F.lit(-1.0)))), PX + " SELECT image_id, " + _SUM.format("list_transform(data, lambda y: y * 2.0 - 1.0)") + " FROM im")
_add("i02_inverted", lambda s, d: images(s, d).select("image_id", _hash(P.inverted(F.col("data")))), PX + ", m AS (SELECT *, list_max(data) AS top FROM im) SELECT image_id, round(list_sum(list_transform(data, lambda x, i: (top - x) * i)), 3) AS sum FROM m")
_add("i12_flipped", lambda s, d: images(s, d).select("image_id", _hash(P.flipped_columns(F.col("data"), F.col("n_cols")))), PX + " SELECT image_id, round(sum(x * (i - i % 8 + 7 - i % 8 + 1)), 3) AS sum FROM px GROUP BY 1")
_add("i13_i14_mirrored", lambda s, d: images(s, d).select("image_id", _hash(P.mirrored(F.col("data")))), PX + ", m AS (SELECT *, list_max(data) AS top, list_min(data) AS low FROM im) SELECT image_id, round(list_sum(list_transform(data, lambda x, i: (top - (x - low)) * i)), 3) AS sum FROM m")
_add("i15_windowed", lambda s, d: images(s, d).select("image_id", _hash(F.transform(P.windowed(F.col("data"), F.lit(100.0), F.lit(900.0), F.col("label") == 3), lambda x: x.cast("double")))),
     PX + ", g AS (SELECT image_id, i, label, floor(least(greatest((x - (100.0 - 450.0)) / 900.0, 0), 1) * 255) AS v FROM px) SELECT image_id, round(sum(CASE WHEN label = 3 THEN 255 - v ELSE v END * (i + 1)), 3) AS sum FROM g GROUP BY 1")
_add("i16_window_estimate", lambda s, d: images(s, d).select("image_id", P.window_estimate(F.col("data"), F.col("modality")).alias("w")).select("image_id", F.round("w.center", 8).alias("center"), F.round("w.width", 8).alias("width")),
     PX + ", q AS (SELECT image_id, any_value(modality) AS m, quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b, avg(x) AS mean, stddev_pop(x) AS sd FROM px GROUP BY 1) SELECT image_id, round(CASE m WHEN 'CT' THEN 40 WHEN 'MG' THEN mean ELSE (a + b) / 2 END, 8) AS center, round(CASE m WHEN 'CT' THEN 400 WHEN 'MG' THEN greatest(sd * 3, 1) ELSE greatest(b - a, 1) END, 8) AS width FROM q")
_add("i16_f18_window_by_tags", lambda s, d: images(s, d).select("image_id", P.window_by_tags(F.col("data"), F.col("modality"), preview_type(*[F.expr(_TAGS[k]) for k in ("name", "image_type", "tr", "te", "ti")]), F.expr(_TAGS["bits"])).alias("w")).select("image_id", F.round("w.center", 8).alias("center"), F.round("w.width", 8).alias("width")),
     PX + """, k AS (SELECT image_id, image_id // 5 % 7 AS k, image_id // 5 % 4 * 700 + 500 AS tr, image_id // 5 % 5 * 25 AS te, CASE image_id // 5 % 11 WHEN 0 THEN 2200 WHEN 1 THEN 150 END AS ti, CASE WHEN image_id // 5 % 3 > 0 THEN 10 + image_id // 5 % 7 ELSE 12 END AS bits FROM im),
  t AS (SELECT image_id, bits, CASE WHEN k < 5 THEN ['LOCALIZER', 'FLAIR', 'STIR', 'DWI', 'ADC'][k::INT + 1] WHEN ti = 2200 THEN 'FLAIR' WHEN ti = 150 THEN 'STIR' WHEN te > 80 THEN 'T2' WHEN te < 30 AND tr < 800 THEN 'T1' WHEN te < 30 AND tr > 2000 THEN 'PD' WHEN k = 5 THEN 'T1' ELSE 'UNKNOWN' END AS t FROM k),
  q AS (SELECT image_id, any_value(modality) AS m, quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b, avg(x) AS mean, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM tis GROUP BY 1),
  r AS (SELECT image_id, CASE WHEN m = 'MR' AND t IN ('T1', 'FLAIR', 'STIR') THEN mean WHEN m = 'MR' AND t IN ('T2', 'DWI') THEN mean WHEN m = 'MR' AND t = 'LOCALIZER' THEN (lo + hi) / 2 WHEN m = 'CT' THEN 40 WHEN m = 'DX' THEN (2 ** bits - 1) / 2 WHEN m = 'MG' THEN mean ELSE (a + b) / 2 END AS c,
    CASE WHEN m = 'MR' AND t IN ('T1', 'FLAIR', 'STIR') THEN greatest(sd * 4, hi - lo) WHEN m = 'MR' AND t IN ('T2', 'DWI') THEN greatest(sd * 5, hi - lo) WHEN m = 'MR' AND t = 'LOCALIZER' THEN hi - lo WHEN m = 'CT' THEN 400 WHEN m = 'DX' THEN 2 ** bits - 1 WHEN m = 'MG' THEN sd * 3 ELSE b - a END AS w FROM q JOIN t USING (image_id))
  SELECT image_id, round(CASE WHEN w > 0 THEN c ELSE c - w / 2 + 0.5 END, 8) AS center, round(CASE WHEN w > 0 THEN w ELSE 1 END, 8) AS width FROM r""")  # fmt: skip
_add("i19_i24_p21_middle_slice", lambda s, d: images(s, d).select("image_id", _hash(P.middle_slice(P.first_volume(F.col("data"), F.lit(48)), F.lit(3), F.lit(16)))), PX + " SELECT image_id, round(sum(x * (i - 15)), 3) AS sum FROM px WHERE i BETWEEN 16 AND 31 GROUP BY 1")
_add("i07_reversed_zyx", lambda s, d: images(s, d).select("image_id", _hash(P.reversed_zyx(F.col("data"), F.lit(2), F.lit(4), F.lit(8)))),
     PX + " SELECT image_id, round(sum(x * ((7 - i % 8) * 8 + (3 - i // 8 % 4) * 2 + (1 - i // 32) + 1)), 3) AS sum FROM px GROUP BY 1")
# five images are a series; its slices are stacked by z
_add(
    "i08_series_stacks",
    lambda s, d: images(s, d).groupBy(F.floor(F.col("image_id") / 5).alias("series")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("image_id")).alias("z"), "data"))), lambda v: v["data"])).alias("data")).select("series", _hash(F.col("data"))),
    PX + """, o AS (SELECT *, image_id // 5 AS series, row_number() OVER (PARTITION BY image_id // 5 ORDER BY image_id DESC) - 1 AS z FROM im),
  u AS (SELECT series, z, unnest(data) AS x, generate_subscripts(data, 1) AS i FROM o)
  SELECT series, round(sum(x * (z * 64 + i)), 3) AS sum FROM u GROUP BY 1""",
)
_add("i20_transposed", lambda s, d: images(s, d).select("image_id", _hash(P.transposed(F.col("data"), F.lit(4), F.lit(16)))), PX + " SELECT image_id, round(sum(x * (i % 16 * 4 + i // 16 + 1)), 3) AS sum FROM px GROUP BY 1")
_add("i22_a27_stretched", lambda s, d: images(s, d).select("image_id", _hash(F.transform(P.stretched(F.col("data")), lambda x: x.cast("double")))),
     PX + ", m AS (SELECT image_id, min(x) AS lo, max(x) AS hi FROM px GROUP BY 1) SELECT image_id, round(sum(floor((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 4095) * (i + 1)), 3) AS sum FROM px JOIN m USING (image_id) GROUP BY 1")
_add("i28_fit_inside", lambda s, d: images(s, d).select("image_id", P.fit_inside(F.col("image_id") % 90 + 10, F.lit(64), F.lit(100), F.lit(128)).alias("f")).select("image_id", "f.height", "f.width", "f.top", "f.left"),
     PX + ", h AS (SELECT image_id, (image_id % 90 + 10)::DOUBLE AS h, least(100 / (image_id % 90 + 10)::DOUBLE, 128 / 64::DOUBLE) AS k FROM im), z AS (SELECT image_id, floor(h * k)::INT AS height, floor(64 * k)::INT AS width FROM h) SELECT image_id, height, width, floor((100 - height) / 2)::INT AS top, floor((128 - width) / 2)::INT AS left FROM z")

FX = f"WITH fx AS ({X.duck(X.SERIES)}), v AS (SELECT *, try_cast(iop AS DOUBLE[]) AS o, try_cast(ipp AS DOUBLE[]) AS p FROM fx)"
_AFF = """CASE WHEN len(o) = 6 THEN [-o[4]*0.5, o[1]*0.7, -(o[2]*o[6]-o[3]*o[5])*2.0, -p[1], -o[5]*0.5, o[2]*0.7, -(o[3]*o[4]-o[1]*o[6])*2.0, -p[2], o[6]*0.5, -o[3]*0.7, (o[1]*o[5]-o[2]*o[4])*2.0, p[3], 0, 0, 0, 1] ELSE [1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1]::DOUBLE[] END"""


def _affine(s, d):
    return X.series(s, d).select("series_key", P.affine(F.col("iop"), F.col("ipp"), F.lit(0.7), F.lit(0.5), F.lit(2.0)).alias("m"), "modality", "iop")


_add("i03_affine", lambda s, d: _affine(s, d).select("series_key", _hash(F.col("m"))), FX + f" SELECT series_key, round(list_sum(list_transform({_AFF}, lambda x, i: x * i)), 3) AS sum FROM v")
_add("f46_voxel_sizes", lambda s, d: _affine(s, d).select("series_key", *[F.round(F.get(P.voxel_sizes(F.col("m")), F.lit(k)), 9).alias(n) for k, n in enumerate("xyz")]),
     FX + f", a AS (SELECT series_key, {_AFF} AS m FROM v) SELECT series_key, round(sqrt(m[1]*m[1]+m[5]*m[5]+m[9]*m[9]), 9) AS x, round(sqrt(m[2]*m[2]+m[6]*m[6]+m[10]*m[10]), 9) AS y, round(sqrt(m[3]*m[3]+m[7]*m[7]+m[11]*m[11]), 9) AS z FROM a")
_add(
    "i05_axis_matrix",
    lambda s, d: _affine(s, d).select("series_key", F.transform(P.axis_matrix(F.col("m")), lambda x: F.round(x, 6)).alias("m")).select("series_key", _hash(F.col("m"))),
    FX + f""", a AS (SELECT series_key, {_AFF} AS m FROM v),
  c AS (SELECT series_key, m, unnest([0, 1, 2]) AS k FROM a),
  p AS (SELECT series_key, m, k, [m[k + 1], m[k + 5], m[k + 9]] AS col FROM c),
  g AS (SELECT series_key, m, k, sqrt(col[1] * col[1] + col[2] * col[2] + col[3] * col[3]) AS size, col[list_position(list_transform(col, lambda x: abs(x)), list_max(list_transform(col, lambda x: abs(x))))] AS top FROM p)
  SELECT series_key, round(sum(round(CASE WHEN top < 0 THEN -size ELSE size END, 6) * (k * 5 + 1)) + any_value(round(m[4], 6) * 4 + round(m[8], 6) * 8 + round(m[12], 6) * 12 + 16), 3) AS sum FROM g GROUP BY 1""",
)
_add("i11_orientation_error", lambda s, d: _affine(s, d).select("series_key", P.orientation_error(F.col("modality"), F.col("series_key") % 2 == 0, F.col("iop").isNotNull(), F.col("m")).alias("error")),
     FX + f", a AS (SELECT *, {_AFF} AS m FROM v) SELECT series_key, modality IN ('DX','DR','CR','RF') AND CASE WHEN series_key % 2 = 0 THEN iop IS NULL ELSE abs(m[2]) > abs(m[6]) END AS error FROM a")
_add("f21_window_given", lambda s, d: X.series(s, d).select("series_key", P.window_given(F.concat("echo_time", F.lit("\\40")), F.when(F.col("n_files") > 1, F.col("repetition_time")).otherwise("0")).alias("w")).select("series_key", "w.center", "w.width"),
     FX + ", w AS (SELECT series_key, try_cast(echo_time AS DOUBLE) AS c, CASE WHEN n_files > 1 THEN try_cast(repetition_time AS DOUBLE) ELSE 0 END AS w FROM fx) SELECT series_key, CASE WHEN w > 1e-6 AND c IS NOT NULL THEN c END AS center, CASE WHEN w > 1e-6 AND c IS NOT NULL THEN w END AS width FROM w")
_add("f29_quality_cell", lambda s, d: _judged(s, d).select("image_id", P.quality_cell(F.when(F.col("image_id") % 3 > 0, F.col("reasons")), F.col("image_id") % 2).alias("c")).select("image_id", "c.value", (F.length("c.reason") > 0).alias("told")),
     QC + " SELECT image_id, CASE WHEN image_id % 3 > 0 THEN (len(reasons) > 0)::INT ELSE (image_id % 2)::INT END AS value, image_id % 3 > 0 OR image_id % 2 = 0 AS told FROM qc")
_FLAT = "CASE WHEN len(o) = 6 THEN [-o[1]*0.7, -o[4]*0.5, -(o[2]*o[6]-o[3]*o[5]), -p[1], -o[2]*0.7, -o[5]*0.5, -(o[3]*o[4]-o[1]*o[6]), -p[2], o[3]*0.7, o[6]*0.5, o[1]*o[5]-o[2]*o[4], p[3], 0, 0, 0, 1] ELSE [0, 0.5, 0, 0, 0.7, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]::DOUBLE[] END"
_add("i04_flat_affine", lambda s, d: X.series(s, d).select("series_key", _hash(P.flat_affine(F.col("iop"), F.col("ipp"), F.lit(0.7), F.lit(0.5)))), FX + f" SELECT series_key, round(list_sum(list_transform({_FLAT}, lambda x, i: x * i)), 3) AS sum FROM v")


def _bytes(s, d):
    """The images stretched to 8 bits, every eighth value and all above 200 white."""
    white = lambda x: F.when((x > 200) | (x % 8 == 0), 255).otherwise(x)
    low, high = F.array_min("data"), F.array_max("data")
    return images(s, d).withColumn("data", F.transform("data", lambda x: white(F.floor((x - low) * 255 / (high - low)).cast("int"))))


def _regions(pixels: str, mask: str) -> str:
    """Number of 4-connected regions of pixels that ``mask`` picks, by growing each pixel's region to its smallest pixel."""
    return f"""mk AS (SELECT image_id, i FROM {pixels} WHERE {mask}),
  ed AS (SELECT a.image_id, a.i AS a, b.i AS b FROM mk a JOIN mk b ON a.image_id = b.image_id AND (abs(a.i - b.i) = 8 OR abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8)),
  rc(image_id, a, b) AS (SELECT image_id, i, i FROM mk UNION SELECT rc.image_id, rc.a, ed.b FROM rc JOIN ed ON rc.image_id = ed.image_id AND rc.b = ed.a),
  cc AS (SELECT image_id, count(*) FILTER (a = m) AS n FROM (SELECT image_id, a, min(b) AS m FROM rc GROUP BY 1, 2) GROUP BY 1)"""


_RANGE = "rg AS (SELECT image_id, min(x) AS lo, max(x) AS hi FROM px GROUP BY 1), pr AS (SELECT px.*, lo, hi FROM px JOIN rg USING (image_id))"
_MASKED = f"""{_RANGE}, br AS (SELECT image_id, any_value(modality) AS m, any_value(hi > lo) AS wide, avg((x > hi - 0.05 * (hi - lo))::INT) AS share FROM pr GROUP BY 1),
  {_regions("pr", "x > hi - 0.01 * (hi - lo)")},
  mq AS (SELECT image_id, coalesce(m <> 'US' AND wide AND share > 0.05 AND n <= 10, false) AS masked FROM br LEFT JOIN cc USING (image_id))"""
_RECURSIVE = PX.replace("WITH", "WITH RECURSIVE", 1)
_add(
    "a09_components",
    lambda s, d: I.with_components(images(s, d), share=0.3).select("image_id", "components"),
    f"{_RECURSIVE}, {_RANGE}, {_regions('pr', 'x > hi - 0.3 * (hi - lo)')} SELECT image_id, n::INT AS components FROM cc",
)
_add("i10_segmentation", lambda s, d: I.segmentation_mask(images(s, d)).select("image_id", "masked"), f"{_RECURSIVE}, {_MASKED} SELECT image_id, masked FROM mq")
_add(
    "i09_f30_quality_with_masks",
    lambda s, d: I.image_quality(images(s, d)).select("image_id", F.array_join("reasons", ",").alias("reasons"), "low"),
    f"""{_RECURSIVE}, qc AS (SELECT image_id, {_RULES} AS reasons FROM st JOIN tl USING (image_id) JOIN bd USING (image_id)), {_MASKED},
  al AS (SELECT image_id, CASE WHEN masked THEN list_append(reasons, 'segmentation_mask') ELSE reasons END AS r FROM qc JOIN mq USING (image_id))
  SELECT image_id, array_to_string(r, ',') AS reasons, len(r) > 0 AS low FROM al""",
)
_add(
    "i23_low_quality_png",
    lambda s, d: I.low_quality_png(_bytes(s, d)).select("image_id", "low"),
    f"""{_RECURSIVE}, {_RANGE}, b0 AS (SELECT image_id, i, floor((x - lo) * 255 / (hi - lo))::INT AS v FROM pr),
  b8 AS (SELECT image_id, i, CASE WHEN v > 200 OR v % 8 = 0 THEN 255 ELSE v END AS v FROM b0),
  w AS (SELECT image_id, avg((v > 250)::INT) AS share FROM b8 GROUP BY 1), {_regions("b8", "v = 255")}
  SELECT image_id, coalesce(share > 0.05 AND n <= 10, false) AS low FROM w LEFT JOIN cc USING (image_id)""",
)
