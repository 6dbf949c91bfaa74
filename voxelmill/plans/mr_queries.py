"""Queries of the MR pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import basic as B
from voxelmill.functions import series as S
from voxelmill.operators import mr
from voxelmill.plans import fixtures as X

QUERIES, ORACLE = {}, {}


def _add(name, query, sql):
    QUERIES[name], ORACLE[name] = query, sql


def _features(spark, d):
    return mr.atomic_features(X.mr_series(spark, d))


def _classified(spark, d):
    return mr.classify(mr.hardware_features(_features(spark, d)))


_NUM = "CASE WHEN isnan(try_cast({0} AS DOUBLE)) THEN NULL ELSE try_cast({0} AS DOUBLE) END"


def _num(c):
    return _NUM.format(c)


def _any(col, *words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


FX = f"fx AS ({X.duck(X.SERIES)}), mr AS (SELECT * FROM fx WHERE upper(modality) = 'MR')"
_VEC = "try_cast(iop AS DOUBLE[])"
FEATURES = f"""{FX},
f0 AS (SELECT *, lower(coalesce(protocol_name, 'nan')) AS nm, lower(coalesce(image_type, 'nan')) AS it, {_num('repetition_time')} AS tr, {_num('echo_time')} AS te, {_num('inversion_time')} AS ti,
  {_num('b_value')} AS bv, {_num('echo_train_length')} AS etl, {_num('field_strength')} AS fs, {_num('series_time')} AS st, {_num('slice_thickness')} AS th, {_VEC} AS v FROM mr),
f1 AS (SELECT *, CASE WHEN len(v) = 6 THEN [abs(v[2]*v[6]-v[3]*v[5]), abs(v[3]*v[4]-v[1]*v[6]), abs(v[1]*v[5]-v[2]*v[4])] END AS n FROM f0),
f2 AS (SELECT *, greatest(n[1], n[2], n[3]) AS big FROM f1),
feat AS (SELECT *,
  CASE WHEN n IS NULL THEN CASE WHEN {_any('nm','ax','tra','trans')} THEN 'AX' WHEN {_any('nm','sag','sg')} THEN 'SAG' WHEN {_any('nm','cor','cr')} THEN 'COR' WHEN {_any('nm','obl','oblique')} THEN 'OBL' ELSE 'UNKNOWN' END
    WHEN big*big < 0.9::DOUBLE*(n[1]*n[1]+n[2]*n[2]+n[3]*n[3]) THEN 'OBL' WHEN n[1]=big THEN 'SAG' WHEN n[2]=big THEN 'COR' ELSE 'AX' END AS ori,
  (contains(upper(scanning_sequence),'IR') AND coalesce(ti BETWEEN 100 AND 250, false)) OR list_has_any(string_split(upper(image_type), chr(92)), ['W','WATER']) OR {_any('nm','fs','fatsat','spair','stir','fat sep','dixon')} AS fat,
  regexp_matches(nm, '\\+c|post|gd|enh|contrast|增强|dyn') AS enh, regexp_matches(nm, 'propeller|blade|radial|star') AS mc,
  CASE WHEN {_any('it','derived','secondary')} THEN 'DERIVED' WHEN contains(it,'localizer') OR {_any('nm','localizer','survey','scout')} THEN 'LOCALIZER' WHEN contains(it,'original') AND contains(it,'primary') THEN 'ORIGINAL' ELSE 'OTHER' END AS rit,
  CASE WHEN fs < 1 THEN 'Low-Field' WHEN fs < 2 THEN '1.5T' WHEN fs < 4 THEN '3.0T' WHEN fs IS NOT NULL THEN 'High-Field' ELSE 'nan' END AS sfs,
  CASE WHEN contains(lower(manufacturer),'siemens') THEN 'Siemens' WHEN contains(lower(manufacturer),'philips') THEN 'Philips' WHEN {_any('lower(manufacturer)','ge medical','ge healthcare')} THEN 'GE'
    WHEN {_any('lower(manufacturer)','uih','united imaging')} THEN 'UIH' WHEN contains(lower(manufacturer),'canon') THEN 'Canon' ELSE 'Other' END AS man,
  lower(concat(protocol_name, ' ', coalesce(series_desc, ''))) AS tx
  FROM f2)"""
_TSUF = f"CASE WHEN list_contains(string_split(upper(image_type), chr(92)),'WATER') OR contains(tx,'water') THEN '_WATER' WHEN list_contains(string_split(upper(image_type), chr(92)),'FAT') OR contains(tx,'fat') THEN '_FAT' WHEN {_any('tx','in_phase','inphase')} THEN '_INPHASE' WHEN {_any('tx','out_phase','outphase')} THEN '_OUTPHASE' WHEN contains(tx,'t2_star_echo') AND regexp_replace(string_split(tx,'echo')[-1], '[^0-9]', '', 'g') <> '' THEN concat('_ECHO', regexp_replace(string_split(tx,'echo')[-1], '[^0-9]', '', 'g')) ELSE '' END"
CLASSED = f"""{FEATURES},
lim(s, a, b, c, d, e, g, h) AS (VALUES ('3.0T',1800,40,2500,75,50,2000,300), ('1.5T',1200,40,2000,70,50,1800,250), ('Low-Field',1000,50,1800,80,60,1500,200), ('default',1500,40,2000,75,50,1800,250)),
c0 AS (SELECT feat.*, lim.* FROM feat JOIN lim ON s = CASE WHEN sfs IN ('3.0T','1.5T','Low-Field') THEN sfs ELSE 'default' END),
c1 AS (SELECT *, lower(scanning_sequence) AS sq, lower(sequence_variant) AS sv, lower(series_desc) AS sd,
  CASE WHEN contains(lower(scanning_sequence),'gr') THEN CASE WHEN contains(lower(sequence_variant),'ss') THEN 'GRE_STEADY_STATE' WHEN contains(lower(sequence_variant),'sp') THEN 'GRE_SPOILED' ELSE 'GRE' END
    WHEN contains(lower(scanning_sequence),'se') THEN CASE WHEN {_any('nm','haste','ssfse')} OR coalesce(etl > 128, false) THEN 'SE_SingleShot' WHEN etl > 1 THEN 'TSE' ELSE 'SE' END END AS fam FROM c0),
c2 AS (SELECT *, CASE
  WHEN {_any('nm','localizer','survey','scout')} OR rit = 'LOCALIZER' THEN 'LOCALIZER' WHEN {_any('nm','t1_map','t1map')} THEN 'T1_MAP' WHEN {_any('nm','t2_map','t2map')} THEN 'T2_MAP' WHEN contains(nm,'adc') THEN 'ADC' WHEN contains(nm,'fa_map') THEN 'FA_MAP'
  WHEN contains(nm,'sub') THEN 'SUBTRACTION' WHEN {_any('nm','mra','mrv','tof')} THEN 'MRA' WHEN {_any('nm','swi','swan')} THEN 'SWI' WHEN {_any('nm','pwi','perf','dsc')} THEN 'PWI' WHEN {_any('nm','mrs','svs','csi','spectro')} THEN 'MRS'
  WHEN contains(sd,'resp') THEN 'BREATH MOVEMENT' WHEN contains(sd,'mip') THEN 'MIP'
  WHEN bv > 50 THEN CASE WHEN contains(nm,'dti') THEN 'DTI' ELSE 'DWI' END WHEN contains(sq,'ep') AND {_any('nm','fmri','bold')} THEN 'fMRI_BOLD'
  WHEN ti >= g THEN 'T2_FLAIR' WHEN ti BETWEEN 100 AND h THEN 'T2_STIR'
  WHEN fam = 'SE_SingleShot' THEN 'T2_SE_SingleShot' WHEN fam IS NOT NULL AND te > d THEN 'T2_' || fam WHEN fam IS NOT NULL AND tr < a AND te < b THEN 'T1_' || fam WHEN fam IS NOT NULL AND tr > c AND te < e AND contains(nm,'pd') THEN 'PD_' || fam
  WHEN contains(nm,'tse_dark_fluid') THEN 'T2_FLAIR'
  WHEN contains(nm,'t1') THEN 'T1_' || coalesce(fam, CASE WHEN {_any('nm','tse','fse')} THEN 'TSE' WHEN contains(nm,'se') THEN 'SE' WHEN contains(nm,'mpr') AND contains(nm,'iso') AND mr_acquisition_type = '3D' THEN 'GRE_FLASH3D' ELSE 'NAME_BASED' END)
  WHEN contains(nm,'pd') THEN 'PD_' || coalesce(fam,'UNKNOWN') WHEN contains(nm,'flair') THEN 'T2_FLAIR' WHEN contains(nm,'stir') THEN 'T2_STIR' WHEN {_any('nm','dwi','diff')} THEN 'DWI'
  WHEN contains(nm,'t2') THEN 'T2_' || coalesce(fam, CASE WHEN {_any('nm','tse','fse')} THEN 'TSE' WHEN contains(nm,'se') THEN 'SE' ELSE 'NAME_BASED' END) END AS base FROM c1),
cls AS (SELECT *, CASE WHEN base IS NULL THEN 'UNKNOWN' ELSE base || {_TSUF} || CASE WHEN {_any('nm','blade','propeller')} OR mc THEN '_MC' ELSE '' END END AS sc FROM c2)"""


def _rl(c):
    return f"coalesce(cast(list_transform(try_cast({c} AS DOUBLE[]), lambda x: round_even(x, 2) + 0.0) AS VARCHAR), 'NA')"


def _ro(c):
    return f"coalesce(cast(round_even({c}, 1) + 0.0 AS VARCHAR), 'NA')"


_EXCL = "('DWI','DTI','ADC','FA','MRS','PWI','ASL','LOCALIZER','DERIVED','SUBTRACTION','MAP','fMRI_BOLD','SWI','T2')"
DYNAMIC = f"""{CLASSED},
d0 AS (SELECT *, CASE WHEN sc NOT IN {_EXCL} THEN concat_ws('_', {_rl('ipp')}, {_rl('iop')}, sc, {_ro('th')}, {_ro('tr')}, {_ro('te')}, 'NA') END AS fp FROM cls),
d1 AS (SELECT *, count(*) OVER w AS n_set, count(st) OVER w AS n_timed, min(series_key) OVER w AS first_key, row_number() OVER (PARTITION BY study_uid, fp ORDER BY st ASC NULLS LAST, series_key) AS rn FROM d0 WINDOW w AS (PARTITION BY study_uid, fp)),
dyn AS (SELECT *, fp IS NOT NULL AND n_set > 1 AND n_timed > 0 AS isdyn, CASE WHEN fp IS NOT NULL AND n_set > 1 AND n_timed > 0 THEN CASE WHEN rn = 1 THEN 'PRE' ELSE 'POST_' || cast(rn - 1 AS VARCHAR) END ELSE '' END AS phase FROM d1)"""

_GIVEN = "coalesce(NOT contains(lower(contrast_agent), 'no'), false)"
FINAL = f"""{DYNAMIC},
e0 AS (SELECT *, starts_with(nm, 't1') AND {_GIVEN} AS ce FROM dyn),
e1 AS (SELECT *, max(CASE WHEN ce THEN st END) OVER (PARTITION BY study_uid) AS latest FROM e0),
e2 AS (SELECT *, coalesce(phase = '' AND contains(sc, 'T1') AND st > latest, false) AS late FROM e1)"""

_add("f01_number", lambda s, d: X.series(s, d).select("series_key", B.number(F.col("echo_time")).alias("te"), B.number(F.col("repetition_time")).alias("tr")),
     f"WITH {FX} SELECT series_key, {_num('echo_time')} AS te, {_num('repetition_time')} AS tr FROM fx")
_add("f02_f03_orientation", lambda s, d: _features(s, d).select("series_key", F.col("standardOrientation").alias("orientation")), f"WITH {FEATURES} SELECT series_key, ori AS orientation FROM feat")
_add("f04_fat_suppression", lambda s, d: _features(s, d).select("series_key", F.col("isFatSuppressed").alias("fat")), f"WITH {FEATURES} SELECT series_key, fat FROM feat")
_add("f05_f06_flags", lambda s, d: _features(s, d).select("series_key", F.col("isContrastEnhanced").alias("contrast"), F.col("hasMotionCorrection").alias("motion")), f"WITH {FEATURES} SELECT series_key, enh AS contrast, mc AS motion FROM feat")
_add("f07_refined_image_type", lambda s, d: _features(s, d).select("series_key", F.col("refinedImageType").alias("refined")), f"WITH {FEATURES} SELECT series_key, rit AS refined FROM feat")
_add("f08_subtype_suffix", lambda s, d: _features(s, d).select("series_key", S.subtype_suffix(F.col("protocolName_lower"), F.col("series_desc"), F.col("image_type")).alias("suffix")), f"WITH {FEATURES} SELECT series_key, {_TSUF} AS suffix FROM feat")
_add("f09_sequence_class", lambda s, d: _classified(s, d).select("series_key", F.col("sequenceClass").alias("class")), f"WITH {CLASSED} SELECT series_key, sc AS class FROM cls")
_add("f10_f11_f12_hardware", lambda s, d: mr.hardware_features(X.mr_series(s, d)).select("series_key", F.col("standardFieldStrength").alias("strength"), F.col("standardManufacturer").alias("maker"), F.col("cleanedModelName").alias("model")),
     f"WITH {FEATURES} SELECT series_key, sfs AS strength, man AS maker, 'nan' AS model FROM feat")
_add("f13_rounded_lists", lambda s, d: X.mr_series(s, d).select("series_key", B.rounded_list(F.col("ipp")).alias("ipp"), B.rounded_list(F.col("iop")).alias("iop")), f"WITH {FX} SELECT series_key, {_rl('ipp')} AS ipp, {_rl('iop')} AS iop FROM mr")
_add("f14_fingerprint", lambda s, d: (lambda c: c.select("series_key", mr.fingerprint(c).alias("fingerprint")))(_classified(s, d)),
     f"WITH {CLASSED} SELECT series_key, concat_ws('_', {_rl('ipp')}, {_rl('iop')}, sc, {_ro('th')}, {_ro('tr')}, {_ro('te')}, 'NA') AS fingerprint FROM cls")
_add("f15a_enhanced_by_phase", lambda s, d: mr.dynamic_sets(_classified(s, d)).select("series_key", S.enhanced_by_phase(F.col("protocolName_lower"), F.col("contrast_agent"), mr.dynamic_phase(), F.col("sequenceClass")).alias("enhanced")),
     f"WITH {DYNAMIC} SELECT series_key, (starts_with(phase, 'POST') OR enh) AND {_GIVEN} AND NOT {_any('sc','DWI','T2','LOCALIZER')} AS enhanced FROM dyn")
_add("f15b_enhanced_by_agent", lambda s, d: _features(s, d).select("series_key", S.enhanced_by_agent(F.col("protocolName_lower"), F.col("contrast_agent")).alias("enhanced")), f"WITH {FEATURES} SELECT series_key, starts_with(nm, 't1') AND {_GIVEN} AS enhanced FROM feat")
_add("f16_f17_lowered", lambda s, d: _features(s, d).select("series_key", F.col("protocolName_lower").alias("name"), F.col("imageType_lower").alias("image"), F.col("standardDimension").alias("dimension")), f"WITH {FEATURES} SELECT series_key, nm AS name, it AS image, mr_acquisition_type AS dimension FROM feat")
_add("f18_preview_type", lambda s, d: X.mr_series(s, d).select("series_key", S.preview_type(F.col("protocol_name"), F.col("image_type"), B.number(F.col("repetition_time")), B.number(F.col("echo_time")), B.number(F.col("inversion_time"))).alias("kind")),
     f"""WITH {FEATURES} SELECT series_key, CASE WHEN {_any('nm','localizer','survey','scout')} THEN 'LOCALIZER' WHEN {_any('nm','flair','tse_dark_fluid')} THEN 'FLAIR' WHEN contains(nm,'stir') THEN 'STIR' WHEN {_any('nm','dwi','diff')} THEN 'DWI' WHEN contains(nm,'adc') OR contains(it,'adc') THEN 'ADC'
     WHEN ti >= 2000 THEN 'FLAIR' WHEN ti BETWEEN 100 AND 250 THEN 'STIR' WHEN tr IS NOT NULL AND te > 80 THEN 'T2' WHEN tr < 800 AND te < 30 THEN 'T1' WHEN tr > 2000 AND te < 30 THEN 'PD' WHEN contains(nm,'t1') THEN 'T1' WHEN contains(nm,'t2') THEN 'T2' WHEN contains(nm,'pd') THEN 'PD' ELSE 'UNKNOWN' END AS kind FROM feat""")  # fmt: skip
_LABEL = "CASE series_key % 6 WHEN 0 THEN 'OLB' WHEN 1 THEN 'sagittal' WHEN 2 THEN ' ax ' WHEN 3 THEN 'XYZ' WHEN 4 THEN NULL ELSE 'COR' END"
_add("f19_tidy_orientation", lambda s, d: X.mr_series(s, d).select("series_key", S.tidy_orientation(F.expr(_LABEL), F.col("iop"), F.col("protocol_name")).alias("plane")),
     f"""WITH {FEATURES}, l AS (SELECT *, CASE series_key % 6 WHEN 0 THEN 'OBL' WHEN 1 THEN 'SAG' WHEN 2 THEN 'AX' WHEN 3 THEN 'XYZ' WHEN 4 THEN 'UNKNOWN' ELSE 'COR' END AS lab FROM feat)
     SELECT series_key, CASE WHEN lab IN ('AX','SAG','COR') THEN lab WHEN lab IN ('OBL','UNKNOWN') AND n IS NOT NULL THEN CASE WHEN n[1]=big THEN 'SAG' WHEN n[2]=big THEN 'COR' ELSE 'AX' END
     WHEN {_any('nm','sag','sg')} THEN 'SAG' WHEN {_any('nm','cor','cr')} THEN 'COR' ELSE 'AX' END AS plane FROM l""")  # fmt: skip
_add("f20_orientation_from_tags", lambda s, d: X.mr_series(s, d).select("series_key", F.coalesce(S.plane_of(S.normal_of(F.col("iop"))), F.lit("UNKNOWN")).alias("plane")),
     f"WITH {FEATURES} SELECT series_key, CASE WHEN n IS NULL THEN 'UNKNOWN' ELSE ori END AS plane FROM feat")
_add("f35_slice_thickness", lambda s, d: X.series(s, d).select("series_key", S.slice_thickness(F.col("slice_thickness"), F.col("echo_time")).alias("thickness")), f"WITH {FX} SELECT series_key, coalesce({_num('slice_thickness')}, {_num('echo_time')}) AS thickness FROM fx")
_add("j12_thresholds", lambda s, d: mr.with_thresholds(mr.hardware_features(X.mr_series(s, d))).select("series_key", "limit.t1_tr_max", "limit.flair_ti_min", "limit.stir_ti_max"),
     f"WITH {CLASSED} SELECT series_key, a::DOUBLE AS t1_tr_max, g::DOUBLE AS flair_ti_min, h::DOUBLE AS stir_ti_max FROM c0")
_add("p08_dynamic_eligible", lambda s, d: _classified(s, d).where(~F.col("sequenceClass").isin(*S.RULES.not_dynamic)).select("series_key"), f"WITH {CLASSED} SELECT series_key FROM cls WHERE sc NOT IN {_EXCL}")
_add("a03_fingerprint_counts", lambda s, d: mr.with_fingerprint(_classified(s, d)).where("fingerprint is not null").groupBy("study_uid", "fingerprint").count().where("count > 1").select("study_uid", "fingerprint", F.col("count").alias("n")),
     f"WITH {DYNAMIC} SELECT study_uid, fp AS fingerprint, count(*) AS n FROM dyn WHERE fp IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
_add("w01_dynamic_phase", lambda s, d: mr.dynamic_sets(_classified(s, d)).select("series_key", mr.dynamic_phase().alias("phase")), f"WITH {DYNAMIC} SELECT series_key, phase FROM dyn")
_add("w02_dynamic_group", lambda s, d: mr.group_numbers(mr.with_fingerprint(_classified(s, d))),
     f"WITH {DYNAMIC}, g AS (SELECT study_uid, fp, any_value(n_set) AS n, any_value(first_key) AS k FROM dyn WHERE isdyn GROUP BY ALL) SELECT study_uid, fp AS fingerprint, row_number() OVER (ORDER BY study_uid, n DESC, k) AS \"dynamicGroup\" FROM g")
_add("w03_propagation", lambda s, d: mr.clean_series(X.mr_series(s, d), numbered=False).select("series_key", F.col("dynamicPhase").alias("phase"), F.col("isContrastEnhanced").alias("enhanced")),
     f"WITH {FINAL} SELECT series_key, CASE WHEN late THEN 'POST_PROPAGATED' ELSE phase END AS phase, ce OR late AS enhanced FROM e2")
_add("a04_latest_enhanced", lambda s, d: _features(s, d).where(S.enhanced_by_agent(F.col("protocolName_lower"), F.col("contrast_agent"))).groupBy("study_uid").agg(F.max(B.number(F.col("series_time"))).alias("latest")),
     f"WITH {FEATURES} SELECT study_uid, max(st) AS latest FROM feat WHERE starts_with(nm, 't1') AND {_GIVEN} GROUP BY study_uid")
_CLEAN = ["series_key", "standardOrientation", "sequenceClass", "standardFieldStrength", "standardManufacturer", "isFatSuppressed", "isContrastEnhanced", "dynamicPhase", "dynamicGroup"]
_add("mr_clean_series", lambda s, d: mr.clean_series(X.mr_series(s, d), columns=_CLEAN),
     f"""WITH {FINAL}, g AS (SELECT study_uid, fp, row_number() OVER (ORDER BY study_uid, any_value(n_set) DESC, any_value(first_key)) AS gid FROM dyn WHERE isdyn GROUP BY study_uid, fp)
     SELECT series_key, ori AS "standardOrientation", sc AS "sequenceClass", sfs AS "standardFieldStrength", man AS "standardManufacturer", fat AS "isFatSuppressed", ce OR late AS "isContrastEnhanced", CASE WHEN late THEN 'POST_PROPAGATED' ELSE phase END AS "dynamicPhase", gid AS "dynamicGroup"
     FROM e2 LEFT JOIN g USING (study_uid, fp)""")  # fmt: skip
