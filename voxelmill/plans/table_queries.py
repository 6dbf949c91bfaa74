"""Queries of filters, joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelmill.functions import basic as B
from voxelmill.functions import text as T
from voxelmill.functions.templates import TEMPLATES
from voxelmill.operators import filters as P
from voxelmill.operators import joins as J
from voxelmill.operators import reports as R
from voxelmill.operators import tasks as K
from voxelmill.plans import fixtures as X
from voxelmill.session import read_table

QUERIES, ORACLE = {}, {}


def _add(name, query, sql):
    QUERIES[name], ORACLE[name] = query, sql


FX = f"WITH fx AS ({X.duck(X.SERIES)})"
TK = f"WITH t AS ({X.duck(X.TASKS)})"
QL = f"WITH q AS ({X.duck(X.QUALITY)})"
FL = "WITH fl AS (SELECT page_id, url AS path, md5(html) AS md5, octet_length(encode(html))::BIGINT AS length FROM pages)"
_DUCK_KW = "(" + " OR ".join(f"contains(upper(series_desc), '{k}')" for k in P.DERIVED_KEYWORDS) + ")"
_VOL = "upper(modality) IN ('CT','MR','MRI','PT','NM','US')"
_LOW = "coalesce(lower(trim(low_raw)) IN ('1','true','yes','y','低质量','poor','bad'), false) OR coalesce(floor(try_cast(low_raw AS DOUBLE)) = 1, false)"
QLL = QL + f", ql AS (SELECT *, ({_LOW}) AS low, coalesce(nullif(trim(reason), ''), '{R.NO_REASON}') AS why FROM q)"


def fx(s, d):
    return X.series(s, d)


def table(name):
    return lambda s, d: read_table(s, d, name)


orders, lineitem, events, docs = table("orders"), table("lineitem"), table("events"), table("documents")

# --- scans -------------------------------------------------------------------
_add("s01_study_query", lambda s, d: J.latest_by_key(lineitem(s, d).select(F.col("l_orderkey").alias("study"), "l_partkey", F.expr("l_partkey * 100000.0 + l_suppkey + l_extendedprice / 1000000").alias("o")), "study", "o").select("study", "l_partkey"),
     "SELECT l_orderkey AS study, arg_max(l_partkey, l_partkey * 100000.0::DOUBLE + l_suppkey + l_extendedprice / 1000000) AS l_partkey FROM lineitem GROUP BY l_orderkey")
_add("s02_j01_series_of_study", lambda s, d: orders(s, d).where("o_orderstatus = 'F'").select(F.expr("concat('1.2.', o_orderkey)").alias("study_uid"), "o_orderdate").join(fx(s, d).select("study_uid", "series_key", "modality"), "study_uid"),
     FX + " SELECT study_uid, o_orderdate, series_key, modality FROM fx JOIN (SELECT concat('1.2.', o_orderkey) AS study_uid, o_orderdate FROM orders WHERE o_orderstatus = 'F') USING (study_uid)")
_add("s03_j02_instance_counts", lambda s, d: fx(s, d).select("series_key").join(lineitem(s, d).groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("series_key")).agg(F.count("*").alias("n_instances")).where("n_instances > 1"), "series_key", "left").select("series_key", F.coalesce("n_instances", F.lit(0)).alias("n_instances")),
     FX + " SELECT series_key, CASE WHEN n_files > 1 THEN n_files ELSE 0 END AS n_instances FROM fx")
_add("s07_sniff", lambda s, d: X.files(s, d).select("page_id", P.F.rlike(F.lower("path"), F.lit(r"\.(txt|html|htm|json|xml|csv|zip|png|jpg|jpeg|pdf|log)$")).alias("other_format")),
     FL + r" SELECT page_id, regexp_matches(lower(path), '\.(txt|html|htm|json|xml|csv|zip|png|jpg|jpeg|pdf|log)$') AS other_format FROM fl")
_add("s12_json_cache", lambda s, d: events(s, d).select("event_id", F.expr("size(map_keys(from_json(props, 'map<string,string>')))").cast("long").alias("n_keys")), "SELECT event_id, len(json_keys(props))::BIGINT AS n_keys FROM events")
_add("s15_f38_env_scan", lambda s, d: fx(s, d).select("series_key", T.env_key(F.expr("concat('QC_', modality, '_STD_MIN')")).alias("k"), B.number(F.col("echo_time")).alias("value")).where("value is not null").select("series_key", "k.modality", "k.name", "value"),
     FX + " SELECT series_key, modality, 'std_min' AS name, try_cast(echo_time AS DOUBLE) AS value FROM fx WHERE try_cast(echo_time AS DOUBLE) IS NOT NULL")
_add("s19_sample_tags", lambda s, d: fx(s, d).groupBy("study_uid").agg(F.min_by("protocol_name", "series_key").alias("sample")), FX + " SELECT study_uid, arg_min(protocol_name, series_key) AS sample FROM fx GROUP BY study_uid")
_add("s20_sorted_listing", lambda s, d: X.files(s, d).where(F.lower("path").like("%.html")).select("path").orderBy("path"), FL + " SELECT path FROM fl WHERE lower(path) LIKE '%.html'")

# --- filters and projections ---------------------------------------------------
_add("p01_modality", lambda s, d: P.by_modality(fx(s, d), " ct, Mg").select("series_key", "modality"), FX + " SELECT series_key, modality FROM fx WHERE upper(modality) IN ('CT','MG')")
_add("p02_p03_derived", lambda s, d: fx(s, d).select("series_key", P.derived_by_type(F.col("image_type")).alias("by_type"), P.derived_by_description(F.col("series_desc")).alias("by_text")),
     FX + f" SELECT series_key, upper(trim(string_split(image_type, chr(92))[1])) = 'DERIVED' AS by_type, {_DUCK_KW} AS by_text FROM fx")
_add("p02_p03_without_derived", lambda s, d: P.without_derived(fx(s, d)).select("series_key"), FX + f" SELECT series_key FROM fx WHERE NOT starts_with(image_type, 'DERIVED') AND NOT {_DUCK_KW}")
_add("p04_thickness", lambda s, d: P.with_thickness(fx(s, d)).select("series_key"), FX + " SELECT series_key FROM fx WHERE coalesce(try_cast(slice_thickness AS DOUBLE) > 0, true)")
_add("p05_count_status", lambda s, d: fx(s, d).select("series_key", P.count_status(F.col("n_files") - 1, F.col("modality"), 2).alias("count_status")),
     FX + f" SELECT series_key, CASE WHEN NOT {_VOL} THEN 'not_checked' WHEN n_files - 1 >= 2 THEN 'enough' WHEN n_files = 1 THEN 'unknown' ELSE 'few' END AS count_status FROM fx")
_add("p06_least_files", lambda s, d: P.with_least_files(fx(s, d), 2).select("series_key"), FX + f" SELECT series_key FROM fx WHERE NOT {_VOL} OR n_files >= 2")
_add("p07_mr_only", lambda s, d: X.mr_series(s, d).select("series_key"), FX + " SELECT series_key FROM fx WHERE upper(modality) = 'MR'")
_TAGS = "map('Modality', modality, 'ProtocolName', protocol_name, 'InversionTime', nullif(inversion_time, ''))"
_add("p09_tag_projection", lambda s, d: P.project_tags(fx(s, d).select("series_key", F.expr(_TAGS).alias("tags")), ["Modality", "InversionTime", "KVP"]), FX + " SELECT series_key, modality AS \"Modality\", inversion_time AS \"InversionTime\", '' AS \"KVP\" FROM fx")
_add("s18_p09_mr_template", lambda s, d: P.project_tags(X.mr_series(s, d).select(F.col("series_key").alias("key"), F.expr("map('Modality', modality, 'EchoTime', echo_time)").alias("tags")), list(TEMPLATES["MR"])).select("key", "Modality", "EchoTime", "FlipAngle"), FX + " SELECT series_key AS key, modality AS \"Modality\", echo_time AS \"EchoTime\", '' AS \"FlipAngle\" FROM fx WHERE modality = 'MR'")
_add("p10_p25_template", lambda s, d: fx(s, d).select("series_key", P.template_of(F.col("modality")).alias("template"), P.is_flat(F.col("modality")).alias("flat")), FX + " SELECT series_key, modality AS template, modality IN ('DX','MG') AS flat FROM fx")
_add("p11_column_order", lambda s, d: (lambda x: x.select(*P.ordered_columns(x.columns, ["accession", "patient_id"], ["modality"])))(fx(s, d).select("series_key", "modality", "patient_id", "accession")), FX + " SELECT accession, patient_id, modality, series_key FROM fx")
_add("p12_p26_backfill", lambda s, d: fx(s, d).select("series_key", F.coalesce(F.nullif("repetition_time", F.lit("")), F.nullif("inversion_time", F.lit("")), F.lit("")).alias("filled")), FX + " SELECT series_key, coalesce(nullif(repetition_time,''), nullif(inversion_time,''), '') AS filled FROM fx")
_add("p15_extensions", lambda s, d: X.files(s, d).where(T.has_extension(F.col("path"), "html", "nii.gz")).select("page_id"), FL + r" SELECT page_id FROM fl WHERE regexp_matches(lower(path), '\.(html|nii\.gz)$')")
_add("p16_accepted_files", lambda s, d: P.accepted_files(X.files(s, d).select("page_id", "length", F.when(F.col("page_id") % 9 > 0, F.col("md5")).alias("sop_uid")), 2000).select("page_id", "reject_reason"),
     FL + " SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'no_instance_uid' WHEN length < 2000 THEN 'too_small' END AS reject_reason FROM fl")
_add("p17_response_status", lambda s, d: lineitem(s, d).select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", 65280).when(F.col("l_returnflag") == "N", 65281).otherwise(0).alias("code")).where(F.col("code").isin(65280, 65281)),
     "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 65280 ELSE 65281 END::INTEGER AS code FROM lineitem WHERE l_returnflag IN ('A','N')")
_add("p18_t13_expired", lambda s, d: (lambda t: P.expired(t.withColumnRenamed("ts", "end_time"), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id"))(X.tasks(s, d)), TK + " SELECT event_id FROM t WHERE ts < TIMESTAMP '2024-01-14 00:00:00'")
_add("p19_task_states", lambda s, d: X.tasks(s, d).where(F.col("status").isin("pending", "running")).select("event_id", "status"), TK + " SELECT event_id, status FROM t WHERE status IN ('pending','running')")
_add("p22_validation", lambda s, d: fx(s, d).select("series_key", P.validation_error(F.col("accession"), F.expr("cast(series_key % 70000 as string)"), F.col("protocol_name")).alias("error")),
     FX + " SELECT series_key, CASE WHEN series_key % 70000 NOT BETWEEN 1 AND 65535 THEN 'port' WHEN length(protocol_name) NOT BETWEEN 1 AND 16 THEN 'title' END AS error FROM fx")
_add("p23_u03_keywords", lambda s, d: fx(s, d).select("series_key", F.array_join(P.keywords_tidied(F.array(F.lit(" "), "modality", F.concat(F.lit(" "), F.lower("modality")), F.lit("mip "))), ",").alias("words")), FX + " SELECT series_key, concat(modality, ',MIP') AS words FROM fx")

# --- joins -----------------------------------------------------------------------
_add("j03_routed", lambda s, d: J.routed(lineitem(s, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("series_key"), "l_partkey", "l_suppkey"), fx(s, d).where("modality = 'MR'").select("series_key", F.concat(F.lit("d"), "series_key").alias("folder")), "inbox"),
     FX + " SELECT l.series_key, l_partkey, l_suppkey, CASE WHEN modality = 'MR' THEN concat('d', l.series_key) ELSE 'inbox' END AS folder FROM (SELECT l_orderkey * 10 + l_linenumber AS series_key, l_partkey, l_suppkey FROM lineitem) l JOIN fx ON fx.series_key = l.series_key")
_add("j04_by_position", lambda s, d: J.by_position(fx(s, d).select("study_uid", "series_key"), fx(s, d).where("n_files > 1").select("study_uid", F.col("series_key").alias("other"), F.lit(0).alias("quality")), "study_uid", "series_key", "other").select("series_key", F.coalesce("quality", F.lit(1)).alias("quality"), "other"),
     FX + ", l AS (SELECT *, row_number() OVER (PARTITION BY study_uid ORDER BY series_key) AS n FROM fx), r AS (SELECT study_uid, series_key AS other, row_number() OVER (PARTITION BY study_uid ORDER BY series_key) AS n FROM fx WHERE n_files > 1) SELECT series_key, CASE WHEN other IS NULL THEN 1 ELSE 0 END AS quality, other FROM l LEFT JOIN r USING (study_uid, n)")
_add("j05_u06_overlaid", lambda s, d: fx(s, d).select("series_key", F.array_join(F.transform(F.array_sort(F.map_entries(J.overlaid(F.expr("map('a', modality, 'b', accession)"), F.expr("map('b', patient_id, 'c', modality)")))), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("merged")),
     FX + " SELECT series_key, concat('a=', modality, ';b=', patient_id, ';c=', modality) AS merged FROM fx")
_add("j06_index_from_name", lambda s, d: fx(s, d).select("series_key", F.regexp_extract(F.expr("concat('vol_', lpad(cast(series_number as string), 4, '0'), '.nii.gz')"), r"_(\d{1,6})(?=\.)", 1).try_cast("long").alias("n")), FX + " SELECT series_key, series_number AS n FROM fx")
_add("j08_matched_stems", lambda s, d: J.matched_stems(fx(s, d).where("series_number <= 2").select("study_uid", F.col("protocol_name").alias("stem")).distinct(), fx(s, d).where("series_number > 2").select("study_uid", "series_key", F.when(F.col("series_number") % 2 == 1, F.concat("protocol_name", F.lit("_x"))).otherwise(F.col("protocol_name")).alias("stem")), "study_uid").select("series_key", "book"),
     FX + ", b AS (SELECT DISTINCT study_uid, protocol_name AS book FROM fx WHERE series_number <= 2), i AS (SELECT study_uid, series_key, CASE WHEN series_number % 2 = 1 THEN concat(protocol_name, '_x') ELSE protocol_name END AS stem FROM fx WHERE series_number > 2) SELECT series_key, coalesce(max(CASE WHEN book = stem THEN book END), min(CASE WHEN contains(book, stem) OR contains(stem, book) THEN book END)) AS book FROM i LEFT JOIN b USING (study_uid) GROUP BY series_key")
_add("j09_a25_checksums", lambda s, d: J.checked(X.files(s, d), X.files(s, d).where("page_id % 3 > 0").select("path", F.when(F.col("page_id") % 10 > 0, F.col("md5")).otherwise("x").alias("md5"))),
     FL + ", c AS (SELECT path, CASE WHEN page_id % 10 > 0 THEN md5 ELSE 'x' END AS m FROM fl WHERE page_id % 3 > 0), j AS (SELECT path, md5 = m AS same FROM fl JOIN c USING (path)) SELECT count(*) FILTER (same) AS verified, count(*) FILTER (NOT same) AS corrupted, array_to_string(list_sort(list(path) FILTER (NOT same))[1:5], ',') AS first_corrupted FROM j")
_done = lambda s, d: orders(s, d).where("o_orderstatus = 'F'").select("o_orderkey")
_add("j10_pending", lambda s, d: J.pending(orders(s, d).select("o_orderkey"), _done(s, d), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
_add("j10_u04_resumed", lambda s, d: J.resumed(orders(s, d).select("o_orderkey"), _done(s, d), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
_add("j11_not_in_use", lambda s, d: J.not_in_use(orders(s, d).select(F.concat_ws("_", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("item")), orders(s, d).where("o_orderstatus = 'O'").select("o_custkey"), "item", "o_custkey"),
     "SELECT concat_ws('_', o_custkey, o_orderkey) AS item FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
_add("j16_slice_records", lambda s, d: J.slice_rows(fx(s, d).groupBy("study_uid").agg((F.count("*") + 3).alias("n_slices")), fx(s, d).select("study_uid", "series_key"), "study_uid", "series_key").select("study_uid", F.col("z").cast("long").alias("z"), "series_key"),
     FX + ", r AS (SELECT study_uid, series_key, row_number() OVER (PARTITION BY study_uid ORDER BY series_key) - 1 AS n, count(*) OVER (PARTITION BY study_uid) AS c FROM fx), z AS (SELECT study_uid, c, unnest(generate_series(0, c + 2)) AS z FROM (SELECT DISTINCT study_uid, c FROM r)) SELECT study_uid, z, series_key FROM z JOIN r USING (study_uid) WHERE n = z % r.c")
_add("j17_after_latest", lambda s, d: (lambda x: x.join(x.where("n_files > 1").groupBy("study_uid").agg(F.max("t").alias("latest")), "study_uid").where("t > latest").select("series_key", "latest"))(fx(s, d).select("study_uid", "series_key", "n_files", B.number(F.col("series_time")).alias("t"))),
     FX + ", l AS (SELECT study_uid, max(try_cast(series_time AS DOUBLE)) AS latest FROM fx WHERE n_files > 1 GROUP BY study_uid) SELECT series_key, latest FROM fx JOIN l USING (study_uid) WHERE try_cast(series_time AS DOUBLE) > latest")
_add("j18_k06_manifest", lambda s, d: X.files(s, d).select("page_id", "path", F.split_part("path", F.lit("/"), F.lit(4)).alias("dir")).join(s.createDataFrame([("en",), ("fr",)], ["dir"]), "dir", "left_semi").select("page_id", "dir"), FL + " SELECT page_id, split_part(path, '/', 4) AS dir FROM fl WHERE split_part(path, '/', 4) IN ('en','fr')")

# --- aggregations ------------------------------------------------------------------
_add("a01_series_summary", lambda s, d: R.series_summary(fx(s, d), "study_uid", "series_key", ["modality", "series_desc", "contrast_agent"]), FX + " SELECT study_uid, count(*) AS file_count, arg_min(modality, series_key) AS modality, arg_min(series_desc, series_key) AS series_desc, arg_min(coalesce(contrast_agent,''), series_key) AS contrast_agent FROM fx GROUP BY study_uid")
_add("a02_flat_series", lambda s, d: fx(s, d).where(F.col("modality").isin("DR", "MG", "DX")).agg(F.countDistinct("series_key").alias("n")), FX + " SELECT count(DISTINCT series_key) AS n FROM fx WHERE modality IN ('DR','MG','DX')")
_add("a13_accession_quality", lambda s, d: R.accession_quality(X.quality(s, d)), QLL + " SELECT accession, file, count(*) AS total, count(*) FILTER (low) AS low FROM ql GROUP BY GROUPING SETS ((accession, file), (accession))")
_add("a13_reason_counts", lambda s, d: R.reason_counts(X.quality(s, d), ["accession", "file"]), QLL + " SELECT accession, file, why AS reason, count(*) AS n FROM ql WHERE low GROUP BY ALL")
_add("a14_global_report", lambda s, d: R.global_report(X.quality(s, d)), QLL + " SELECT count(*) AS total, count(*) FILTER (low) AS low, count(*) FILTER (NOT low) AS normal, round(100.0::DOUBLE * count(*) FILTER (low) / count(*), 1) AS low_percent FROM ql")
_add("a14_k10_reason_bars", lambda s, d: R.reason_bars(X.quality(s, d)), QLL + ", c AS (SELECT why AS reason, count(*) AS n FROM ql WHERE low GROUP BY ALL) SELECT reason, n, round(100.0::DOUBLE * n / max(n) OVER (), 1) AS bar FROM c")
_add("a14_o06_top_reason", lambda s, d: R.top_reason(X.quality(s, d)), QLL + ", c AS (SELECT accession, why AS reason, count(*) AS n FROM ql WHERE low GROUP BY ALL) SELECT accession, reason, n FROM c QUALIFY row_number() OVER (PARTITION BY accession ORDER BY n DESC, reason) = 1")
_add("a15_distribution", lambda s, d: R.batch_distribution(X.quality(s, d), F.col("row_id") % 11 == 0, ~T.is_truthy_low(F.col("low_raw")) & F.col("low_raw").isNotNull(), F.col("low_raw").isNotNull()),
     QLL + " SELECT CASE WHEN row_id % 11 = 0 THEN 'fixed' WHEN low_raw IS NULL THEN 'unknown' WHEN low THEN 'low' ELSE 'normal' END AS state, count(*) AS n FROM ql GROUP BY 1")
_add("a16_success_rate", lambda s, d: X.tasks(s, d).groupBy("task_id").agg(R.percent(F.count_if(F.col("status") == "completed"), F.count("*")).alias("rate")), TK + " SELECT task_id, round(100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*), 1) AS rate FROM t GROUP BY task_id")
_add("a17_transfers", lambda s, d: R.transfer_statistics(lineitem(s, d).select("l_suppkey", F.col("l_extendedprice").cast("long").alias("bytes"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_quantity")).otherwise(0.0).alias("seconds")), "l_suppkey").select("l_suppkey", F.round("mb", 6).alias("mb"), "seconds", F.round("mb_per_s", 8).alias("mb_per_s")),
     "WITH x AS (SELECT l_suppkey, sum(trunc(l_extendedprice)::BIGINT)::DOUBLE AS b, sum(CASE WHEN l_suppkey % 5 > 0 THEN l_quantity ELSE 0 END)::DOUBLE AS s FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(b / 1048576, 6) AS mb, s AS seconds, CASE WHEN s <> 0 THEN round(b / 1048576 / s, 8) END AS mb_per_s FROM x")
_add("a18_t07_failures", lambda s, d: R.failure_summary(X.tasks(s, d).where("status = 'failed'"), "task_id"), TK + ", c AS (SELECT task_id, count(*) AS n FROM t WHERE status = 'failed' GROUP BY 1) SELECT count(*) AS failed, count(*) FILTER (n < 2) AS retryable, count(*) FILTER (n >= 2) AS permanent FROM c")
_add("a19_folder_size", lambda s, d: X.files(s, d).agg(F.round(F.sum("length") / F.pow(F.lit(1024.0), F.lit(3)), 9).alias("gb")), FL + " SELECT round(sum(length)::DOUBLE / 1073741824, 9) AS gb FROM fl")
_add("a20_status_counts", lambda s, d: K.status_counts(X.tasks(s, d)), TK + " SELECT count(*) AS total, count(*) FILTER (status='pending') AS pending, count(*) FILTER (status='running') AS running, count(*) FILTER (status='completed') AS completed, count(*) FILTER (status='failed') AS failed, count(*) FILTER (status='cancelled') AS cancelled FROM t")
_add("a21_a30_queue_status", lambda s, d: K.queue_status(X.tasks(s, d)), TK + " SELECT count(*) FILTER (status='running') AS running, count(*) FILTER (status='pending') AS waiting, round(100.0::DOUBLE * count(*) FILTER (status='running') / 3, 1) AS utilisation FROM t")
_add("a22_eta", lambda s, d: X.tasks(s, d).agg(F.round(F.avg("seconds"), 6).alias("mean_s"), F.round(F.avg("seconds") * F.count_if(F.col("status") == "pending"), 3).alias("eta_s")), TK + " SELECT round(avg(seconds), 6) AS mean_s, round(avg(seconds) * count(*) FILTER (status='pending'), 3) AS eta_s FROM t")
_add("a23_plane", lambda s, d: fx(s, d).select("series_key", R.plane_of_counts(F.col("series_key") % 7, F.col("series_key") % 5, F.col("series_key") % 3).alias("plane")),
     FX + " SELECT series_key, CASE WHEN series_key % 7 <= least(series_key % 5, series_key % 3) THEN 'axial' WHEN series_key % 5 <= series_key % 3 THEN 'sagittal' ELSE 'coronal' END AS plane FROM fx")
_add("a24_k01_widths", lambda s, d: R.column_widths(fx(s, d).select("study_uid", "iop", "modality", "contrast_agent")),
     FX + " SELECT 'study_uid' AS column, least(greatest(max(length(study_uid)), 9) + 2, 50)::INTEGER AS width FROM fx UNION ALL SELECT 'iop', least(greatest(max(length(iop)), 3) + 2, 50)::INTEGER FROM fx UNION ALL SELECT 'modality', least(greatest(max(length(modality)), 8) + 2, 50)::INTEGER FROM fx UNION ALL SELECT 'contrast_agent', least(greatest(max(length(contrast_agent)), 14) + 2, 50)::INTEGER FROM fx")
_add("a26_duplicates", lambda s, d: orders(s, d).agg((F.count("*") - F.countDistinct("o_custkey")).alias("removed")), "SELECT count(*) - count(DISTINCT o_custkey) AS removed FROM orders")
_add("a28_k12_copy_statistics", lambda s, d: X.quality(s, d).agg(F.count("*").alias("total"), F.count_if(~T.is_truthy_low(F.col("low_raw"))).alias("copied"), F.count_if(T.is_truthy_low(F.col("low_raw"))).alias("skipped")), QLL + " SELECT count(*) AS total, count(*) FILTER (NOT low) AS copied, count(*) FILTER (low) AS skipped FROM ql")

# --- windows -----------------------------------------------------------------------
_add("w04_file_index", lambda s, d: fx(s, d).select("series_key", F.row_number().over(Window.partitionBy("study_uid").orderBy("series_key")).alias("file_index"), F.count("*").over(Window.partitionBy("study_uid")).alias("total")), FX + " SELECT series_key, row_number() OVER (PARTITION BY study_uid ORDER BY series_key)::INTEGER AS file_index, count(*) OVER (PARTITION BY study_uid) AS total FROM fx")
_q = lambda s, d: lineitem(s, d).select("l_suppkey", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("i"), F.count("*").over(Window.partitionBy("l_suppkey")).alias("n"))
_add("w05_p24_qc_sample", lambda s, d: _q(s, d).withColumn("i", F.col("i") - 1).where("n <= 200 or i between n div 2 - 3 and n div 2 + 3").select("l_suppkey", F.col("i").cast("long").alias("i")), "WITH q AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, i FROM q WHERE n <= 200 OR i BETWEEN n // 2 - 3 AND n // 2 + 3")
_add("w06_slice_spacing", lambda s, d: (lambda w: fx(s, d).withColumn("z", F.try_element_at(B.number_list(F.col("ipp")), F.lit(1))).select("study_uid", F.row_number().over(w).alias("rn"), F.abs(F.lead("z").over(w) - F.col("z")).alias("gap"), B.number(F.col("slice_thickness")).alias("th")).where("rn = 1").select("study_uid", F.coalesce("gap", "th", F.lit(1.0)).alias("spacing")))(Window.partitionBy("study_uid").orderBy("series_key")),
     FX + ", z AS (SELECT *, (try_cast(ipp AS DOUBLE[]))[1] AS z FROM fx), w AS (SELECT study_uid, row_number() OVER o AS rn, abs(lead(z) OVER o - z) AS gap, try_cast(slice_thickness AS DOUBLE) AS th FROM z WINDOW o AS (PARTITION BY study_uid ORDER BY series_key)) SELECT study_uid, coalesce(gap, th, 1.0) AS spacing FROM w WHERE rn = 1")
_add("w07_cleanup", lambda s, d: R.sheet_cleanup(X.tasks(s, d).select(F.col("event_id").alias("item"), F.col("ts").alias("atime"), F.floor("seconds").cast("double").alias("size")), "size", "atime", 4000.0, 5000.0).select("item"),
     TK + ", c AS (SELECT event_id AS item, ts, coalesce(sum(floor(seconds)) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(floor(seconds)) OVER () AS total FROM t) SELECT item FROM c WHERE total >= 5000 AND gone < total - 4000")
_add("w08_queue_position", lambda s, d: K.queue_positions(X.tasks(s, d), "task_id", ["ts", "event_id"]).select("event_id", "position"), TK + " SELECT event_id, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id)::INTEGER AS position FROM t WHERE status = 'pending'")
_add("w09_collision_names", lambda s, d: fx(s, d).select("series_key", F.col("protocol_name").alias("name"), (F.row_number().over(Window.partitionBy("study_uid", "protocol_name").orderBy("series_key")) - 1).alias("n")).select("series_key", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("n").cast("string"))).alias("file")),
     FX + ", n AS (SELECT series_key, protocol_name AS name, row_number() OVER (PARTITION BY study_uid, protocol_name ORDER BY series_key) - 1 AS n FROM fx) SELECT series_key, CASE WHEN n = 0 THEN name ELSE concat(name, '_', n) END AS file FROM n")
_add("w10_slice_order", lambda s, d: fx(s, d).select("series_key", F.row_number().over(Window.partitionBy("study_uid").orderBy(F.coalesce(F.try_element_at(B.number_list(F.col("ipp")), F.lit(3)), F.lit(0.0)), "series_key")).alias("place")), FX + " SELECT series_key, row_number() OVER (PARTITION BY study_uid ORDER BY coalesce((try_cast(ipp AS DOUBLE[]))[3], 0.0), series_key)::INTEGER AS place FROM fx")
_add("w13_progress", lambda s, d: _q(s, d).select("l_suppkey", "i", K.progress_percent(F.col("i"), F.col("n")).cast("long").alias("percent")), "WITH q AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, i::INTEGER AS i, (40 + floor(i::DOUBLE / n * 40))::BIGINT AS percent FROM q")

# --- sorts, limits, sets -------------------------------------------------------------
_add("o01_o02_history_page", lambda s, d: (lambda t: K.history_page(t, 3, 50, t.count(), [F.col("ts").desc(), F.col("event_id")]).select("event_id"))(X.tasks(s, d).where("status = 'completed'")), TK + " SELECT event_id FROM t WHERE status = 'completed' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
_add("o03_o05_recent", lambda s, d: X.tasks(s, d).where(F.col("status").isin(*K.FINISHED)).orderBy(F.col("ts").desc(), "event_id").limit(10).select("event_id", "status"), TK + " SELECT event_id, status FROM t WHERE status IN ('completed','failed','cancelled') ORDER BY ts DESC, event_id LIMIT 10")
_add("o04_last_logs", lambda s, d: K.last_per_key(X.tasks(s, d), "task_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id"), TK + " SELECT event_id FROM t QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) <= 5")
_add("o07_preferred_outputs", lambda s, d: fx(s, d).select("study_uid", "series_key", F.when(F.col("n_files") > 1, "npz").otherwise("nii.gz").alias("kind")).withColumn("r", F.rank().over(Window.partitionBy("study_uid").orderBy(F.when(F.col("kind") == "npz", 0).otherwise(1)))).where("r = 1").select("series_key", "kind"),
     FX + " SELECT series_key, CASE WHEN n_files > 1 THEN 'npz' ELSE 'nii.gz' END AS kind FROM fx QUALIFY rank() OVER (PARTITION BY study_uid ORDER BY CASE WHEN n_files > 1 THEN 0 ELSE 1 END) = 1")
_add("o09_middle", lambda s, d: fx(s, d).groupBy("study_uid").agg(F.array_sort(F.collect_list("series_key")).alias("k")).select("study_uid", F.expr("element_at(k, cast(size(k) div 2 + 1 as int))").alias("middle")), FX + " SELECT study_uid, list_sort(list(series_key))[len(list(series_key)) // 2 + 1] AS middle FROM fx GROUP BY study_uid")
_add("o10_u03_first_appearance", lambda s, d: orders(s, d).groupBy("o_custkey").agg(F.min("o_orderkey").alias("pos")).orderBy("pos"), "SELECT o_custkey, min(o_orderkey) AS pos FROM orders GROUP BY 1")
_add("u01_u02_merged_sheets", lambda s, d: R.merged_sheets({"CT": fx(s, d).where("modality = 'CT'").select("series_key", "accession"), "MG": fx(s, d).where("modality = 'MG'").select("series_key", "series_desc")}), FX + " SELECT series_key, modality AS accession, CASE WHEN modality = 'MG' THEN series_desc END AS series_desc FROM fx WHERE modality IN ('CT','MG')")
_add("u04_difference", lambda s, d: orders(s, d).select("o_custkey").subtract(orders(s, d).where("o_orderstatus = 'F'").select("o_custkey")), "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
_add("u05_completed_union", lambda s, d: orders(s, d).where("o_orderstatus = 'F'").select("o_custkey").union(orders(s, d).where("o_orderstatus = 'P'").select("o_custkey")).distinct(), "SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F','P') GROUP BY 1")

# --- functions ------------------------------------------------------------------------
_NAME = "concat(series_desc, '. ', protocol_name, ' [', modality, ']: ', image_type)"
_add("f22_folder_name", lambda s, d: fx(s, d).select("series_key", T.folder_name(F.expr(_NAME)).alias("folder")),
     FX + r", x AS (SELECT series_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _NAME + r", '[<>/\\|?*:\[\]]', '_', 'g'), '\.\s+', '_', 'g'), '\s+', '_', 'g'), '\.+', '.', 'g'), '_+', '_', 'g') AS n FROM fx) SELECT series_key, trim(substr(trim(n, '._ '), 1, 50), '.') AS folder FROM x")
_add("f23_series_folder", lambda s, d: fx(s, d).select("series_key", T.series_folder(F.col("series_key"), F.col("series_desc")).alias("folder")), FX + " SELECT series_key, concat(CASE WHEN series_key < 1000 THEN lpad(cast(series_key AS VARCHAR), 3, '0') ELSE cast(series_key AS VARCHAR) END, '_', replace(series_desc, ' ', '_')) AS folder FROM fx")
_add("f24_converted_name", lambda s, d: X.files(s, d).select("page_id", T.converted_name(F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("A"), "page_id")).otherwise(" "), F.col("path")).alias("name")), FL + " SELECT page_id, concat(CASE WHEN page_id % 4 > 0 THEN concat('A', page_id) ELSE 'Unknown' END, '/', string_split(path, '/')[-1]) AS name FROM fl")
_add("f25_f26_tag_text", lambda s, d: fx(s, d).select("series_key", B.tag_text(F.split("image_type", r"\\")).alias("image"), B.tag_text(F.array("modality")).alias("one")), FX + " SELECT series_key, concat('[', replace(image_type, chr(92), ', '), ']') AS image, modality AS one FROM fx")
_add("f27_md5", lambda s, d: read_table(s, d, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("md5")), "SELECT page_id, md5(html) AS md5 FROM pages")
_add("f32_truthy_low", lambda s, d: X.quality(s, d).select("row_id", T.is_truthy_low(F.col("low_raw")).alias("low")), QLL + " SELECT row_id, low FROM ql")
_add("f33_f34_stems", lambda s, d: fx(s, d).select("series_key", T.workbook_stem(F.concat(F.lit("x/DICOM_metadata_"), "accession", F.lit(".xlsx"))).alias("book"), T.image_stem(F.concat(F.lit("y/"), "accession", F.when(F.col("n_files") > 1, ".nii.gz").otherwise(".npz"))).alias("image")), FX + " SELECT series_key, accession AS book, accession AS image FROM fx")
_add("f36_t06_backoff", lambda s, d: fx(s, d).select("series_key", K.backoff(F.col("series_number")).alias("wait")), FX + " SELECT series_key, 2.0::DOUBLE * pow(2, series_number) AS wait FROM fx")
_add("f37_first_value", lambda s, d: fx(s, d).select("series_key", F.coalesce("contrast_agent", "iop", F.lit("none")).alias("v")), FX + " SELECT series_key, coalesce(contrast_agent, iop, 'none') AS v FROM fx")
_add("f39_sizes", lambda s, d: X.files(s, d).select("page_id", T.human_size(F.col("length") * 77).alias("size"), T.elapsed(F.col("length") / 10).alias("took")),
     FL + r", x AS (SELECT page_id, length * 77 AS b, floor(length / 10)::BIGINT AS s FROM fl), u AS (SELECT *, CASE WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS i FROM x) SELECT page_id, concat(regexp_replace(printf('%.2f', round(b / pow(1024, i), 2)), '\.?0+$', ''), ' ', ['Bytes','KB','MB'][i + 1]) AS size, CASE WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s // 3600, 'h ', s % 3600 // 60, 'm') END AS took FROM u")
_add("f40_html_escape", lambda s, d: read_table(s, d, "pages").select("page_id", F.md5(T.html_escaped(F.col("html")).cast("binary")).alias("h")), "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS h FROM pages")
_add("f41_renamed", lambda s, d: fx(s, d).select("series_key", T.renamed_output(F.concat("accession", F.when(F.col("n_files") > 1, ".nii.gz").otherwise(".NII")), ".npz").alias("path")), FX + " SELECT series_key, concat(accession, '.npz') AS path FROM fx")
_add("f42_spacing", lambda s, d: fx(s, d).select("series_key", F.get(B.number_list(F.col("ipp")), F.lit(2)).alias("z")), FX + " SELECT series_key, (try_cast(ipp AS DOUBLE[]))[3] AS z FROM fx")
_add("f43_aspect", lambda s, d: fx(s, d).select("series_key", (F.col("n_files") / F.greatest(F.col("series_key") % 3 * 0.5, F.lit(1e-6))).alias("aspect")), FX + " SELECT series_key, n_files / greatest(series_key % 3 * 0.5::DOUBLE, 1e-6::DOUBLE) AS aspect FROM fx")
_add("f44_f53_task_rows", lambda s, d: X.tasks(s, d).groupBy("task_id").agg(F.count("*").alias("entries"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds")), TK + " SELECT task_id, count(*) AS entries, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::BIGINT AS seconds FROM t GROUP BY task_id")
_add("f45_coerced", lambda s, d: fx(s, d).select("series_key", F.least(F.greatest(F.coalesce(F.col("echo_time").try_cast("int"), F.lit(20)), F.lit(1)), F.lit(200)).alias("size")), FX + " SELECT series_key, least(greatest(coalesce(try_cast(echo_time AS INTEGER), 20), 1), 200) AS size FROM fx")
_add("f48_k07_conversion_entry", lambda s, d: fx(s, d).select("series_key", F.to_json(F.map_filter(F.create_map(F.lit("Agent"), "contrast_agent", F.lit("Modality"), "modality"), lambda _, v: v.isNotNull())).alias("entry")),
     FX + " SELECT series_key, CASE WHEN contrast_agent IS NULL THEN concat('{\"Modality\":\"', modality, '\"}') ELSE concat('{\"Agent\":\"', contrast_agent, '\",\"Modality\":\"', modality, '\"}') END AS entry FROM fx")
_add("f50_final_state", lambda s, d: K.final_state(X.tasks(s, d).select("task_id", "event_id", "status"), "task_id", "event_id"),
     TK + ", o AS (SELECT task_id, event_id, status, max(CASE WHEN status = 'cancelled' THEN event_id END) OVER (PARTITION BY task_id ORDER BY event_id) AS c, max(CASE WHEN status = 'failed' THEN event_id END) OVER (PARTITION BY task_id ORDER BY event_id) AS f FROM t), l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY event_id DESC) AS r FROM o) SELECT task_id, CASE WHEN c IS NULL OR f > c THEN status ELSE 'cancelled' END AS state FROM l WHERE r = 1")
_add("f52_log_sampling", lambda s, d: _q(s, d).where("i % 3 = 0 or i = n").select("l_suppkey", "i"), "WITH q AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, i::INTEGER AS i FROM q WHERE i % 3 = 0 OR i = n")

# --- batch forms of the dataflow operators ----------------------------------------------
_add("t08_locks", lambda s, d: K.unlocked(X.tasks(s, d).select("task_id", "event_id", "ts"), "task_id", "ts", 3600).select("event_id", "locked"), TK + " SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY task_id ORDER BY ts)) < 3600000000, false) AS locked FROM t")
_add("t09_quiet_spells", lambda s, d: K.quiet_spells(X.tasks(s, d).select("task_id", "ts"), "task_id", "ts", 86400.0).select("task_id", "first", "changes"),
     TK + ", n AS (SELECT task_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY task_id ORDER BY ts)) > 86400000000, true)::INT AS new FROM t), s AS (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM n) SELECT task_id, min(ts) AS first, count(*) AS changes FROM s GROUP BY task_id, spell")
_add("t10_concurrency", lambda s, d: K.concurrency(X.tasks(s, d).select("task_id", "ts", F.expr("ts + make_dt_interval(0, 0, 0, seconds * 60)").alias("until")), "task_id", "ts", "until").select("task_id", F.col("most").alias("most")),
     TK + ", m AS (SELECT task_id, epoch_us(ts) AS moment, 1 AS step FROM t UNION ALL SELECT task_id, (epoch_us(ts) + round(seconds * 60, 6) * 1000000)::BIGINT, -1 FROM t), o AS (SELECT task_id, sum(step) OVER (PARTITION BY task_id ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT task_id, max(n)::BIGINT AS most FROM o GROUP BY 1")
_add("t21_submission", lambda s, d: fx(s, d).select("series_key", F.when(F.col("contrast_agent").isNull(), "rejected").otherwise("queued").alias("state")), FX + " SELECT series_key, CASE WHEN contrast_agent IS NULL THEN 'rejected' ELSE 'queued' END AS state FROM fx")

# --- sinks and what else the tables need ---------------------------------------------------
_add("p20_existing_outputs", lambda s, d: J.existing(X.files(s, d).select("page_id", "path"), X.files(s, d).where("page_id % 2 = 0")).select("page_id"), FL + " SELECT page_id FROM fl WHERE path IN (SELECT path FROM fl WHERE page_id % 2 = 0)")
_add("p27_sample_record", lambda s, d: fx(s, d).groupBy("study_uid").agg(F.min_by(F.struct("modality", "series_desc"), "series_key").alias("r"), F.count("*").alias("files")).select("study_uid", "r.modality", "r.series_desc", "files"), FX + " SELECT study_uid, arg_min(modality, series_key) AS modality, arg_min(series_desc, series_key) AS series_desc, count(*) AS files FROM fx GROUP BY 1")
_add("j07_cloned_entries", lambda s, d: J.cloned_entries(fx(s, d).select(F.concat("series_key", F.lit(".npz")).alias("file")), fx(s, d).where("series_key % 3 > 0").select(F.concat("series_key", F.when(F.col("n_files") > 1, ".nii").otherwise(".nii.gz")).alias("file"), F.col("modality").alias("entry"))), FX + " SELECT concat(series_key, '.npz') AS file, modality AS entry FROM fx WHERE series_key % 3 > 0")
_add("j15_storage_class", lambda s, d: fx(s, d).select("series_key", J.storage_class(F.col("modality")).alias("class")), FX + " SELECT series_key, CASE modality WHEN 'CT' THEN '1.2.840.10008.5.1.4.1.1.2' ELSE '1.2.840.10008.5.1.4.1.1.4' END AS class FROM fx")
_add("a29_merge_totals", lambda s, d: fx(s, d).groupBy("accession").count().agg(F.count("*").alias("accessions"), F.sum("count").alias("rows")), FX + " SELECT count(DISTINCT accession) AS accessions, count(*) AS rows FROM fx")
_add("a30_system_status", lambda s, d: X.files(s, d).agg(F.sum("length").alias("bytes"), (F.sum("length") >= 100000).alias("cleanup_needed")), FL + " SELECT sum(length)::BIGINT AS bytes, sum(length) >= 100000 AS cleanup_needed FROM fl")
_add("k05_preview_names", lambda s, d: fx(s, d).select("series_key", F.concat(T.folder_name(F.col("series_desc")), F.when(F.col("n_files") > 1, F.format_string("_%04d", F.col("series_number"))).otherwise(""), F.lit("_preview.png")).alias("name")), FX + " SELECT series_key, concat(replace(series_desc, ' ', '_'), CASE WHEN n_files > 1 THEN concat('_', lpad(cast(series_number AS VARCHAR), 4, '0')) ELSE '' END, '_preview.png') AS name FROM fx")
_add("k08_k09_ledger", lambda s, d: K.ledger(orders(s, d).select("o_orderkey"), lineitem(s, d).select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), "o_orderkey", "l_quantity"), "SELECT l_orderkey AS o_orderkey, round(sum(l_quantity), 6) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
_add("k12_k15_copy_routes", lambda s, d: X.quality(s, d).select("row_id", F.concat_ws("/", F.when(T.is_truthy_low(F.col("low_raw")), "low_quality"), "accession", "file").alias("target")), QLL + " SELECT row_id, CASE WHEN low THEN concat('low_quality/', accession, '/', file) ELSE concat(accession, '/', file) END AS target FROM ql")
_add("k14_result_choice", lambda s, d: fx(s, d).select("series_key", K.result_choice(F.when(F.col("series_number") == 1, "excel").when(F.col("series_number") == 2, "zip").otherwise("other"), F.col("contrast_agent"), F.col("iop"), F.when(F.col("n_files") > 1, "old.zip"), F.col("series_key") % 4).alias("c")).select("series_key", "c.path", "c.state"),
     FX + ", c AS (SELECT *, CASE series_number WHEN 1 THEN contrast_agent WHEN 2 THEN coalesce(iop, CASE WHEN n_files > 1 THEN 'old.zip' END) END AS path FROM fx) SELECT series_key, path, CASE WHEN series_number > 2 THEN 'unsupported' WHEN path IS NULL THEN 'missing' WHEN series_key % 4 = 0 THEN 'empty' ELSE 'ok' END AS state FROM c")
_add("o08_instance_order", lambda s, d: fx(s, d).groupBy("study_uid").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("series_number", "series_key"))), lambda e: e["series_key"].cast("string"))).alias("order")), FX + " SELECT study_uid, string_agg(series_key, ',' ORDER BY series_number, series_key) AS order FROM fx GROUP BY 1")
_add("f51_appended_logs", lambda s, d: X.tasks(s, d).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "status"))).alias("l")).select("task_id", F.size(F.array_append("l", F.struct(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("status")))).cast("long").alias("n")), TK + " SELECT task_id, count(*) + 1 AS n FROM t GROUP BY 1")
_add("c01_settings", lambda s, d: fx(s, d).select("series_key", F.coalesce(P.validation_error(F.lit("host"), F.col("series_key").cast("string"), F.lit("SCP")), F.lit("saved")).alias("state")), FX + " SELECT series_key, CASE WHEN series_key BETWEEN 1 AND 65535 THEN 'saved' ELSE 'port' END AS state FROM fx")
