"""Queries of files, volumes and resampled images, made of the embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxelmill.functions import volume as V
from voxelmill.operators import flow as W
from voxelmill.operators import joins as J
from voxelmill.plans import fixtures as X
from voxelmill.plans.image_queries import PX, _hash, images
from voxelmill.session import read_table, shared_folder
from voxelmill.sources import formats

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _stored(rows, kind: str, **options):
    """Rows written as files of a format in the shared folder, and read back."""
    spark = rows.sparkSession
    formats.register(spark)
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.write.format(kind).mode("append").save(folder)
    reader = spark.read.format(kind)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def _number():
    """The image that a file's name gives."""
    return F.regexp_extract("path", r"(\d+)\.[a-z.]+$", 1).cast("long").alias("image_id")


def _slices(s, d):
    """Images as unsigned 16-bit slices with tags."""
    grey = F.transform("data", lambda x: F.floor(F.abs(x)).cast("double"))
    tags = {"Modality": F.col("modality"), "PatientID": F.concat(F.lit("P"), F.col("label").cast("string")), "InstanceNumber": F.col("image_id").cast("string"), "Rows": F.lit("8"), "Columns": F.lit("8"), "BitsAllocated": F.lit("16"), "PixelRepresentation": F.lit("0")}
    return images(s, d).select(F.concat(F.col("image_id").cast("string"), F.lit(".dcm")).alias("name"), F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]).alias("tags"), grey.alias("data"))


_add(
    "s09_k11_dicom_files",
    lambda s, d: _stored(_slices(s, d), "dicom", pixels="true").select(_number(), "n_rows", "n_cols", "status", _hash(F.col("data"))),
    PX + " SELECT image_id, 8 AS n_rows, 8 AS n_cols, 'ok' AS status, round(sum(floor(abs(x)) * (i + 1)), 3) AS sum FROM px GROUP BY 1",
)
_add(
    "s06_s08_dicom_headers",
    lambda s, d: _stored(_slices(s, d), "dicom", tags="Modality,PatientID").select(_number(), F.col("tags")["Modality"].alias("modality"), F.col("tags")["PatientID"].alias("patient"), "n_rows", "status"),
    PX + " SELECT image_id, modality, concat('P', label) AS patient, 8 AS n_rows, 'ok' AS status FROM im",
)


def _affines():
    """A matrix for each image: all orders of axes, all directions, oblique ones, and some that can't be decomposed."""
    order = "element_at(array(array(0,1,2), array(0,2,1), array(1,0,2), array(1,2,0), array(2,0,1), array(2,1,0)), cast(image_id % 6 + 1 as int))"
    sign = lambda c: f"(case when floor(image_id / {6 << c}) % 2 = 1 then -1.0 else 1.0 end)"
    cell = lambda r, c: f"(case when {order}[{c}] = {r} then {sign(c)} * {c + 1}.5 else 0.125 * ((image_id + {r} * 2 + {c}) % 3 - 1) end) * (case when image_id % 11 = 10 and {c} = 1 then 0 else 1 end)"
    rows = [",".join([cell(r, c) for c in range(3)] + [f"cast({r} * 10 as double)"]) for r in range(3)]
    return F.expr(f"transform(array({','.join(rows)},0,0,0,1), v -> cast(v as double))")


_SHAPE = "array(2, 4, 8)"
_ORDER = "[[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]][image_id % 6 + 1]"
#: The plan by the rule that made the matrices: axis c runs along world axis order[c]; one without an axis of its own is read straight along its voxel axes.
_CANON = (
    PX
    + f""", o AS (SELECT image_id, {_ORDER} AS ord, [(image_id // (6 * 2 ** c)::BIGINT) % 2 = 1 FOR c IN [0, 1, 2]] AS neg, image_id % 11 = 10 AS bad FROM im),
  b AS (SELECT image_id, bad, CASE WHEN bad THEN [0,1,2] ELSE [list_position(ord, 0) - 1, list_position(ord, 1) - 1, list_position(ord, 2) - 1] END AS ax,
    CASE WHEN bad THEN [neg[1], FALSE, neg[3]] ELSE neg END AS fl FROM o),
  v AS (SELECT image_id, ax, fl, x, [i % 2, i // 2 % 4, i // 8] AS p, [2, 4, 8] AS n FROM px JOIN b USING (image_id)),
  w AS (SELECT image_id, x, [n[a + 1] FOR a IN ax] AS m, [CASE WHEN fl[a + 1] THEN n[a + 1] - 1 - p[a + 1] ELSE p[a + 1] END FOR a IN ax] AS q FROM v)"""
)


def _canonical(s, d):
    return images(s, d).select("image_id", V.canonical(F.col("data"), F.expr(_SHAPE), _affines()).alias("v"))


_add(
    "i06_canonical",
    lambda s, d: _canonical(s, d).select("image_id", F.array_join("v.shape", "x").alias("shape"), _hash(F.col("v.data"))),
    _CANON + " SELECT image_id, array_to_string(any_value(m), 'x') AS shape, round(sum(x * (q[1] + m[1] * (q[2] + m[2] * q[3]) + 1)), 3) AS sum FROM w GROUP BY 1",
)
_add(
    "i24_i26_orthogonal",
    lambda s, d: _canonical(s, d).select("image_id", V.orthogonal_slices(F.col("v")).alias("o")).select("image_id", *[_hash(F.col(f"o.{n}")).alias(n) for n in ("axial", "sagittal", "coronal")]),
    _CANON
    + """ SELECT image_id, round(sum(x * (q[1] + m[1] * q[2] + 1)) FILTER (q[3] = m[3] // 2), 3) AS axial, round(sum(x * (q[2] + m[2] * q[3] + 1)) FILTER (q[1] = m[1] // 2), 3) AS sagittal,
    round(sum(x * (q[1] + m[1] * q[3] + 1)) FILTER (q[2] = m[2] // 2), 3) AS coronal FROM w GROUP BY 1""",
)


def _volumes(s, d, end: str):
    name = F.concat(F.col("image_id").cast("string"), F.lit(end)).alias("name")
    return images(s, d).select(name, F.expr(_SHAPE).alias("shape"), _affines().alias("affine"), "data")


def _float():
    return F.transform("data", lambda v: v.cast("double"))


_add(
    "s10_k03_nifti_files",
    lambda s, d: _stored(_volumes(s, d, ".nii.gz"), "nifti").select(_number(), F.array_join("shape", "x").alias("shape"), "status", F.round(F.get("affine", F.lit(0)), 3).alias("corner"), _hash(_float())),
    _CANON + ", c AS (SELECT image_id, CASE WHEN ord[1] = 0 THEN CASE WHEN neg[1] THEN -1.5 ELSE 1.5 END ELSE 0.125 * (image_id % 3 - 1) END AS corner FROM o) "
    "SELECT image_id, '2x4x8' AS shape, 'ok' AS status, any_value(corner)::DOUBLE AS corner, round(sum(x::FLOAT::DOUBLE * (i + 1)), 3) AS sum FROM px JOIN c USING (image_id) GROUP BY 1",
)
_add(
    "s11_k04_npz_files",
    lambda s, d: _stored(_volumes(s, d, ".npz"), "npz").select(_number(), F.array_join("shape", "x").alias("shape"), "status", _hash(_float())),
    PX + " SELECT image_id, '2x4x8' AS shape, 'ok' AS status, round(sum(x::FLOAT::DOUBLE * (i + 1)), 3) AS sum FROM px GROUP BY 1",
)


def _taps(name: str, size: str, target: str) -> str:
    """The weights of each target place, for every image of a table ``z`` with those sizes."""
    return f"""{name}0 AS (SELECT image_id, unnest(range({target})) AS t, {size}::DOUBLE / {target} AS k, {size} AS n FROM z),
  {name}1 AS (SELECT *, (t + 0.5) * k AS mid, greatest(k, 1.0) AS wide FROM {name}0),
  {name}2 AS (SELECT *, unnest(range(n)) AS u FROM {name}1),
  {name}3 AS (SELECT image_id, t, u, 1 - abs((u - mid + 0.5) / wide) AS w FROM {name}2 WHERE abs((u - mid + 0.5) / wide) < 1),
  {name} AS (SELECT image_id, t, u, w / sum(w) OVER (PARTITION BY image_id, t) AS w FROM {name}3)"""


def _sum(data):
    """As the others' sum, moved a little: weights of halves and quarters would leave sums on the very edge of rounding."""
    return F.round(F.aggregate(F.transform(data, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b) + 0.0002137, 3).alias("sum")


_RATIO = "(image_id % 23 - 1) / 8.0"
_add(
    "i17_by_aspect",
    lambda s, d: images(s, d).select("image_id", V.with_aspect(F.col("data"), F.col("n_cols"), F.col("n_rows"), F.expr(_RATIO)).alias("r")).select("image_id", "r.rows", _sum(F.col("r.data"))),
    PX + f""", z AS (SELECT image_id, CASE WHEN {_RATIO} > 0 THEN greatest(round_even(8 * {_RATIO}, 0)::INT, 1) ELSE 8 END AS h FROM im), {_taps("y", "8", "h")},
  r AS (SELECT image_id, t, i % 8 AS c, sum(w * x) AS v FROM px JOIN y USING (image_id) WHERE u = i // 8 GROUP BY ALL)
  SELECT image_id, any_value(h) AS rows, round(sum(v * (t * 8 + c + 1)) + 0.0002137, 3) AS sum FROM r JOIN z USING (image_id) GROUP BY 1""",
)
_SPACING = "1 + (image_id % 9 - 4) * 0.006"
_add(
    "i27_physical_height",
    lambda s, d: images(s, d).select("image_id", V.physical_height(F.col("data"), F.lit(4), F.lit(16), F.expr(f"({_SPACING}) * case when image_id % 2 = 1 then 2.0 else 1.0 end"), F.lit(1.0)).alias("r")).select("image_id", "r.rows", _sum(F.col("r.data"))),
    PX + f""", k AS (SELECT image_id, ({_SPACING}) * CASE WHEN image_id % 2 = 1 THEN 2.0 ELSE 1.0 END AS k FROM im),
  z AS (SELECT image_id, CASE WHEN abs(k - 1) < 0.02 THEN 16 ELSE greatest(round_even(16 * k, 0)::INT, 1) END AS h FROM k), {_taps("y", "16", "h")},
  r AS (SELECT image_id, t, i % 4 AS c, sum(w * x) AS v FROM px JOIN y USING (image_id) WHERE u = i // 4 GROUP BY ALL)
  SELECT image_id, any_value(h) AS rows, round(sum(v * (t * 4 + c + 1)) + 0.0002137, 3) AS sum FROM r JOIN z USING (image_id) GROUP BY 1""",
)
_add(
    "i18_letterbox",
    lambda s, d: images(s, d).select("image_id", V.letterboxed(F.col("data"), F.lit(4), F.lit(16), 11).alias("data")).select("image_id", F.size("data").alias("n"), _sum(F.col("data"))),
    PX + f""", z AS (SELECT image_id, 11 AS h, 3 AS w FROM im), {_taps("y", "16", "h")}, {_taps("v", "4", "w")},
  r AS (SELECT px.image_id, y.t AS r, v.t AS c, sum(y.w * v.w * x) AS x FROM px JOIN y ON px.image_id = y.image_id AND y.u = i // 4 JOIN v ON px.image_id = v.image_id AND v.u = i % 4 GROUP BY ALL)
  SELECT image_id, 121 AS n, round(sum(x * (r * 11 + c + 4 + 1)) + 0.0002137, 3) AS sum FROM r GROUP BY 1""",
)


def _names(s, d):
    """Tasks by customer; an item's name holds its task's identifier at its start, in its middle or not at all."""
    task = F.concat(F.lit("t"), F.lpad(F.col("o_custkey").cast("string"), 5, "0"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(task, F.lit("_out"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("zip-"), task, F.lit(".part"))).otherwise(F.concat(F.lit("cache"), F.col("o_orderkey").cast("string")))
    return read_table(s, d, "orders").select("o_orderkey", "o_orderstatus", task.alias("task"), name.alias("item"))


_add(
    "j11_not_named",
    lambda s, d: J.not_named(_names(s, d).select("item", "o_orderkey"), _names(s, d).where("o_orderstatus = 'O'").select("task"), "item", "task"),
    """WITH n AS (SELECT o_orderkey, o_orderstatus, concat('t', lpad(o_custkey::VARCHAR, 5, '0')) AS task FROM orders),
  m AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN concat(task, '_out') WHEN 1 THEN concat('zip-', task, '.part') ELSE concat('cache', o_orderkey) END AS item FROM n),
  a AS (SELECT DISTINCT task FROM m WHERE o_orderstatus = 'O')
  SELECT item, o_orderkey FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE contains(m.item, a.task))""",
)


def _damaged(s, d):
    """Images of which some have lost a value, hold none, or hold one that is no number."""
    data = F.when(F.col("image_id") % 17 == 3, F.slice("data", 1, 63)).when(F.col("image_id") % 17 == 5, F.transform("data", lambda v, i: F.when(i == 9, float("nan")).otherwise(v))).when(F.col("image_id") % 17 != 7, F.col("data"))
    return images(s, d).withColumn("data", data)


_add(
    "i14_fix_driver",
    lambda s, d: W.apply_fixes(_damaged(s, d), F.col("image_id") % 2 == 0, F.col("image_id") % 3 == 0).select("image_id", F.array_join("fixes", ",").alias("fixes"), F.array_join("errors", "; ").alias("errors"), F.when(~(F.col("image_id") % 17).isin(3, 5, 7), F.aggregate(F.transform("fixed", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)).alias("sum")).withColumn("sum", F.round("sum", 3)),
    PX + """, f AS (SELECT image_id, data, image_id % 2 = 0 AS o, image_id % 3 = 0 AS p, CASE image_id % 17 WHEN 3 THEN 'size differs from rows and columns' WHEN 5 THEN 'values that are no numbers' WHEN 7 THEN 'no pixels' END AS wrong FROM im),
  n AS (SELECT *, list_filter([CASE WHEN o THEN 'orientation_flip_x' END, CASE WHEN p THEN 'photometric_inversion' END], lambda v: v IS NOT NULL) AS asked FROM f),
  g AS (SELECT px.image_id, CASE WHEN image_id % 2 = 0 THEN i - i % 8 + 7 - i % 8 ELSE i END AS i, CASE WHEN image_id % 3 = 0 THEN max(x) OVER w - (x - min(x) OVER w) ELSE x END AS x FROM px WINDOW w AS (PARTITION BY image_id)),
  h AS (SELECT image_id, round(sum(x * (i + 1)), 3) AS sum FROM g GROUP BY 1)
  SELECT n.image_id, CASE WHEN wrong IS NULL THEN array_to_string(asked, ',') ELSE '' END AS fixes, CASE WHEN wrong IS NULL THEN '' ELSE array_to_string(list_transform(asked, lambda a: concat(a, ': ', wrong)), '; ') END AS errors,
    CASE WHEN wrong IS NULL THEN h.sum END AS sum FROM n JOIN h USING (image_id)""",
)


def _upload_flow(s, d):
    """Organize, convert and describe what was uploaded, in a folder of the query's own."""
    stages = [
        ("organize", lambda rows: rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("files"), F.min("l_shipdate").alias("begun"))),
        ("convert", lambda rows: rows.where("files > 1").withColumn("volume", F.concat_ws("-", "l_orderkey", "l_linenumber"))),
        ("metadata", lambda rows: rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("volumes"), F.sum("files").alias("files"), F.max("volume").alias("last"))),
    ]
    return W.run_stages(read_table(s, d, "lineitem"), stages, f"{shared_folder(s)}/flow-{uuid.uuid4().hex}")


_add(
    "t16_t22_upload_flow",
    _upload_flow,
    """WITH o AS (SELECT l_orderkey, l_linenumber, count(*) AS files FROM lineitem GROUP BY ALL HAVING count(*) > 1)
  SELECT l_linenumber, count(*) AS volumes, sum(files)::BIGINT AS files, max(concat_ws('-', l_orderkey, l_linenumber)) AS last FROM o GROUP BY 1""",
)


def _sheets(s, d):
    """Series by modality as sheets; then the MR sheet is replaced by the cleaned one."""
    folder = f"{shared_folder(s)}/sheets-{uuid.uuid4().hex}"
    rows = X.series(s, d).select("series_key", F.col("modality").alias("sheet"), F.col("protocol_name").alias("name"))
    W.replace_tables(rows, folder)
    W.replace_tables(rows.where("sheet = 'MR' and series_key % 10 < 4").withColumn("name", F.lower("name")), folder)
    return s.read.parquet(folder)


_add(
    "k02_replaced_sheet",
    _sheets,
    f"WITH fx AS ({X.duck(X.SERIES)}) SELECT series_key, modality AS sheet, CASE WHEN modality = 'MR' THEN lower(protocol_name) ELSE protocol_name END AS name FROM fx WHERE modality <> 'MR' OR series_key % 10 < 4",
)
