"""Input views of the registered queries, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelmill.session import read_table

SERIES = """
WITH g AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk,
         count(*) AS n_files, cast(sum(l_quantity) AS bigint) AS q
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber),
h AS (SELECT g.*, o_custkey AS ck, (ok + CASE WHEN ln <= 3 THEN 0 ELSE ln * 5 END) % 24 AS k
      FROM g JOIN {orders} ON ok = o_orderkey)
SELECT ok * 10 + ln AS series_key,
  concat('1.2.', cast(ok AS string)) AS study_uid,
  concat('A', cast(ok AS string)) AS accession,
  concat('P', cast(ck AS string)) AS patient_id,
  cast(ln AS bigint) AS series_number, n_files,
  CASE pk % 10 WHEN 0 THEN 'CT' WHEN 1 THEN 'DX' WHEN 2 THEN 'MG' ELSE 'MR' END AS modality,
  CASE k WHEN 0 THEN 'T1_TSE_TRA' WHEN 1 THEN 'T2_TSE_SAG_FS' WHEN 2 THEN 'T1_VIBE_DYN +C' WHEN 3 THEN 'ep2d_DWI_b1000'
    WHEN 4 THEN 'localizer' WHEN 5 THEN 'T2_HASTE_COR' WHEN 6 THEN 'T1_MAP' WHEN 7 THEN 'tse_dark_fluid' WHEN 8 THEN 'TOF_MRA'
    WHEN 9 THEN 'T2_BLADE_TRA' WHEN 10 THEN 'PD_TSE_FS_SAG' WHEN 11 THEN 'STIR_COR' WHEN 12 THEN 'T1_MPR_ISO'
    WHEN 13 THEN 'SWI' WHEN 14 THEN 'BOLD_fMRI' WHEN 15 THEN 'perf_dsc' WHEN 16 THEN 'T1_DIXON_W' WHEN 17 THEN 'DTI_32'
    WHEN 18 THEN 'svs_spectro' WHEN 19 THEN 'T2_star' WHEN 20 THEN 'T1_SE_SAG' WHEN 21 THEN 'subtract' WHEN 22 THEN 'ADC' ELSE 'misc' END AS protocol_name,
  CASE q % 6 WHEN 0 THEN 'Axial water' WHEN 1 THEN 'MPR recon' WHEN 2 THEN 'resp gate' WHEN 3 THEN 'MIP thin' ELSE 'routine' END AS series_desc,
  replace(CASE pk % 5 WHEN 0 THEN 'DERIVED/SECONDARY/MPR' WHEN 1 THEN 'ORIGINAL/SECONDARY' WHEN 2 THEN 'ORIGINAL/PRIMARY/W' ELSE 'ORIGINAL/PRIMARY/M' END, '/', chr(92)) AS image_type,
  replace(CASE k % 4 WHEN 0 THEN 'SE' WHEN 1 THEN 'SE/IR' WHEN 2 THEN 'GR' ELSE 'EP' END, '/', chr(92)) AS scanning_sequence,
  CASE k % 3 WHEN 0 THEN 'SP' WHEN 1 THEN 'SS' ELSE 'NONE' END AS sequence_variant,
  CASE k % 2 WHEN 0 THEN '3D' ELSE '2D' END AS mr_acquisition_type,
  CASE WHEN k % 7 = 6 THEN '' ELSE cast(300 + k * 170 AS string) END AS repetition_time,
  CASE WHEN k % 9 = 8 THEN 'n/a' ELSE cast(8 + k * 5 AS string) END AS echo_time,
  CASE WHEN k % 4 = 1 THEN cast(100 + (ok % 5) * 500 AS string) ELSE '' END AS inversion_time,
  CASE WHEN k % 8 = 3 THEN '1000' ELSE '' END AS b_value,
  CASE k % 5 WHEN 0 THEN '1' WHEN 1 THEN '15' WHEN 2 THEN '130' ELSE '' END AS echo_train_length,
  CASE ok % 5 WHEN 0 THEN '1.5' WHEN 1 THEN '2.99' WHEN 2 THEN '0.35' WHEN 3 THEN '7' ELSE '' END AS field_strength,
  CASE ok % 6 WHEN 0 THEN 'SIEMENS' WHEN 1 THEN 'Philips Medical' WHEN 2 THEN 'GE MEDICAL SYSTEMS' WHEN 3 THEN 'UIH' WHEN 4 THEN 'Canon' ELSE 'Acme' END AS manufacturer,
  CASE ok % 4 WHEN 0 THEN 'Gadovist' WHEN 1 THEN 'No' WHEN 2 THEN '' ELSE NULL END AS contrast_agent,
  CASE k % 5 WHEN 0 THEN '[1.0, 0.0, 0.0, 0.0, 1.0, 0.0]' WHEN 1 THEN '[0.0, 1.0, 0.0, 0.0, 0.0, 1.0]' WHEN 2 THEN '[1.0, 0.0, 0.0, 0.0, 0.0, 1.0]' WHEN 3 THEN '[0.8, 0.6, 0.0, 0.0, 0.6, 0.8]' ELSE NULL END AS iop,
  concat('[', cast(k AS string), '.0, -5.0, ', cast(ok % 40 AS string), '.25]') AS ipp,
  CASE WHEN ok % 11 = 0 THEN '' ELSE cast(80000 + (ln * 137 + sk * 11) % 9000 AS string) END AS series_time,
  CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE cast(1 + k % 5 AS string) END AS slice_thickness
FROM h
"""

STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' ELSE 'completed' END"
TASKS = f"SELECT event_id, user_id AS task_id, ts, {STATUS} AS status, value AS seconds FROM {{events}}"

QUALITY = """
SELECT d.source AS accession, concat('f', cast(d.doc_id % 7 AS string)) AS file, d.doc_id AS row_id,
  CASE WHEN l.quality IS NULL THEN CASE d.doc_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '0' WHEN 2 THEN 'POOR' WHEN 3 THEN '1.0' ELSE NULL END ELSE cast(1 - l.quality AS string) END AS low_raw,
  CASE WHEN l.toxic = 1 THEN 'contrast_low' WHEN d.doc_id % 3 = 0 THEN '' WHEN d.doc_id % 3 = 1 THEN 'dynamic_range_low' ELSE NULL END AS reason
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

FILES = "SELECT page_id, url AS path, md5(html) AS md5, cast(octet_length(html) AS bigint) AS length FROM {pages}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(text: str) -> str:
    """The view's SQL with plain table names."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {name: read_table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text}
    return spark.sql(text, **used)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SERIES)


def mr_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).where("upper(modality) = 'MR'")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TASKS)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, QUALITY)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FILES)
