"""Scans, sinks, inventories and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.functions import scalar
from sensorloom.operators import channels, reconcile, timestamps
from sensorloom.operators.filtering import SOS_200_HZ, SOS_500_HZ
from sensorloom.operators.metrics import recording_results
from sensorloom.operators.rows import union_all
from sensorloom.plans.base import BASE, CELLS, KEY, LOCAL_RESULTS, STREAMS, local_predictions, local_results, query, r6, results_sql, streams
from sensorloom.session import shared_folder
from sensorloom.sources import catalogs, files, tables, text
from sensorloom.sources import testdata as td

CHANNELS = [f"{k}{c}" for k in "wf" for c in "xyz"]
_SAMPLES = """samples AS (SELECT 'E' AS dataset, 'e' || CAST(label AS VARCHAR) AS recording_id, vec_id, 1700000000000000000 + vec_id * 5000000 AS ts_ns,
  """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(("fx", "fy", "fz", "wx", "wy", "wz"))) + " FROM embeddings)"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/sensorloom-{name}-{uuid.uuid4().hex}"


def _clocked(spark, d) -> DataFrame:
    """Samples with a nanosecond counter too large for a double."""
    return td.samples(spark, d).withColumn("ts_ns", F.lit(1700000000000000000) + F.col("idx") * 5000000)


def asl_files(spark, d) -> str:
    """The samples as ASL-style CSV files; each file starts with the ASL header."""
    path = _folder(spark, "asl")
    named = _clocked(spark, d).select(
        F.col("ts_ns").alias("#timestamp [ns]"),
        *[F.col(f"w{c}").alias(f"w_RS_S_{c} [rad s^-1]") for c in "xyz"],
        *[F.col(f"f{c}").alias(f"a_RS_S_{c} [m s^-2]") for c in "xyz"],
        "recording_id",
    )
    # The writer would quote a leading '#', its comment mark; another mark keeps it plain.
    named.write.partitionBy("recording_id").option("header", True).option("comment", "~").csv(path)
    return path


def sensor_text_files(spark, d) -> str:
    """The samples as blank-separated text with a header row of names."""
    path = _folder(spark, "text")
    named = td.samples(spark, d).select(
        "idx", (F.col("idx") / F.lit(200.0)).alias("timestamp"), *[F.col(f"w{c}").alias(f"ang_vel_{c}") for c in "xyz"], *[F.col(f"f{c}").alias(f"lin_acc_{c}") for c in "xyz"], "recording_id"
    )
    named.write.partitionBy("recording_id").option("header", True).option("sep", " ").csv(path)
    return path


def _with_recording(df: DataFrame) -> DataFrame:
    return df.withColumns({"dataset": F.lit("E"), "recording_id": F.regexp_extract("path", r"recording_id=([^/]+)", 1)})


def _asl_mapped(scan: text.TextScan) -> DataFrame:
    return text.map_imu_header(scan.files).withColumns(text.header_units(F.col("header_line")))


@query("s1_asl_scan", f"WITH {_SAMPLES} SELECT {KEY}, ts_ns, {r6(*CHANNELS)} FROM samples")
def s1(spark, d):
    scan = text.scan_asl(spark, asl_files(spark, d))
    rows = _with_recording(text.imu_samples(scan.rows, _asl_mapped(scan)))
    return rows.select(*RECORDING, F.col("clock_int").alias("ts_ns"), *CHANNELS)


@query("s2_sensor_text_scan", f"WITH {_SAMPLES} SELECT {KEY}, round(vec_id / 200.0, 6) AS ts_s, {r6(*CHANNELS)} FROM samples")
def s2(spark, d):
    scan = text.scan_sensor_text(spark, sensor_text_files(spark, d))
    rows = _with_recording(text.imu_samples(scan.rows, text.map_imu_header(scan.files, text.TEXT_IMU_RULES, asl=False)))
    return rows.select(*RECORDING, F.col("clock").alias("ts_s"), *CHANNELS)


@query(
    "p5_p7_header_mapping",
    """SELECT DISTINCT 'E' AS dataset, 'e' || CAST(label AS VARCHAR) AS recording_id, 'HEADER_MAPPED' AS layout, 'timestamp [ns]' AS timestamp_field, 'w_RS_S_x [rad s^-1]' AS gyro_x_field,
    'a_RS_S_z [m s^-2]' AS accel_z_field, 'm/s^2' AS unit_acceleration, 'rad/s' AS unit_gyro, 'nanoseconds' AS unit_clock FROM embeddings""",
)
def p5(spark, d):
    m = _with_recording(_asl_mapped(text.scan_asl(spark, asl_files(spark, d))))
    at = lambda c: text.name_at(F.col("header"), F.col(f"places.{c}"))
    return m.select(
        *RECORDING, "layout", at("ts").alias("timestamp_field"), at("wx").alias("gyro_x_field"), at("fz").alias("accel_z_field"), "unit_acceleration", "unit_gyro", "unit_clock"
    ).distinct()


@query(
    "p6_pose_header_mapping",
    """SELECT DISTINCT 'E' AS dataset, 'e' || CAST(label AS VARCHAR) AS recording_id, 'timestamp' AS timestamp_field, 'p_RS_R_x [m],p_RS_R_y [m],p_RS_R_z [m]' AS position_fields,
    'q_RS_w [],q_RS_x [],q_RS_y [],q_RS_z []' AS orientation_fields, 'wxyz' AS quaternion_order, 'NO_DIRECT_GT_ACCELERATION' AS acceleration_fields,
    'v_RS_R_x [m s^-1],v_RS_R_y [m s^-1],v_RS_R_z [m s^-1]' AS velocity_fields, true AS bias_gyro_present, true AS bias_accel_present FROM embeddings""",
)
def p6(spark, d):
    names = ["#timestamp", *[f"p_RS_R_{c} [m]" for c in "xyz"], *[f"q_RS_{c} []" for c in "wxyz"], *[f"v_RS_R_{c} [m s^-1]" for c in "xyz"], "b_w_RS_S_x [rad s^-1]", "b_a_RS_S_x [m s^-2]"]
    cells = [F.col("vec_id")] + [F.col("embedding")[i].cast("double") for i in range(1, len(names))]
    path = _folder(spark, "pose")
    pose = td.table(spark, d, "embeddings").select(*[c.alias(n) for c, n in zip(cells, names)], F.format_string("e%d", "label").alias("recording_id"))
    pose.write.partitionBy("recording_id").option("header", True).option("comment", "~").csv(path)
    return text.map_pose_header(_with_recording(text.scan_asl(spark, path).files)).select(
        *RECORDING, "timestamp_field", "position_fields", "orientation_fields", "quaternion_order", "acceleration_fields", "velocity_fields", "bias_gyro_present", "bias_accel_present"
    ).distinct()


@query(
    "s5_native_streams",
    f"""WITH {_SAMPLES} SELECT {KEY}, round((ts_ns - min(ts_ns) OVER (PARTITION BY recording_id)) / 1e9, 6) AS rel_s, round(sqrt(fx*fx + fy*fy + fz*fz), 6) AS q_f, round(sqrt(wx*wx + wy*wy + wz*wz), 6) AS q_w FROM samples""",
)
def s5(spark, d):
    """Text to canonical native streams: header map, exact clock, magnitudes."""
    from sensorloom.operators.ordering import assign_idx

    scan = text.scan_asl(spark, asl_files(spark, d))
    rows = _with_recording(text.imu_samples(scan.rows, _asl_mapped(scan))).drop("idx").withColumnRenamed("clock_int", "ts_ns")
    ordered = assign_idx(rows, RECORDING, ["ts_ns"], td.bounded(spark, d))
    mag = lambda k: scalar.magnitude(*[F.col(f"{k}{c}") for c in "xyz"])
    return timestamps.relative_seconds(ordered).select(*RECORDING, "rel_s", mag("f").alias("q_f"), mag("w").alias("q_w"))


@query("s3_s4_s9_stream_store", f"WITH {STREAMS} SELECT {KEY}, dependency_group || '_x' AS dependency_group, idx, {r6('ts_s', 'q_f', 'q_w')}, idx AS native_index FROM streams")
def s9(spark, d):
    path = _folder(spark, "streams")
    tables.write_streams(streams(spark, d), path)
    groups = td.recordings(spark, d).select("recording_id", F.concat("dependency_group", F.lit("_x")).alias("dependency_group"))
    return tables.read_streams(spark, path, groups)


@query(
    "s6_s8_result_round_trip",
    f"""WITH {CELLS}, p AS ({results_sql('local_cells', 'model, dataset, recording_id')}) SELECT model, {KEY}, n_origins::BIGINT::VARCHAR AS n_origins_text, round(rmse_all_horizons, 6) AS rmse_all_horizons, round(mae_all_horizons, 6) AS mae_all_horizons, NULL::VARCHAR AS notes FROM p""",
)
def s8(spark, d):
    """Results to CSV with fixed columns and back; CSV keeps 10 digits."""
    path = _folder(spark, "results")
    scored = recording_results(local_predictions(spark, d), td.SPEC, BASE)
    columns = ["model", *RECORDING, "n_origins", "rmse_all_horizons", "mae_all_horizons", "notes"]
    tables.write_results(scored, path, columns, csv=True)
    back = tables.read_results(spark, path, columns)
    return tables.as_numbers(back, ["rmse_all_horizons", "mae_all_horizons"]).withColumnRenamed("n_origins", "n_origins_text")


@query(
    "s7_u1_context_union",
    f"""WITH {LOCAL_RESULTS} SELECT evaluation_context, model, {KEY}, 'Persistence' AS pub_model, round(rmse_all_horizons, 6) AS rmse_all_horizons FROM results WHERE model = 'B0_PERSISTENCE'""",
)
def s7(spark, d):
    results = local_results(spark, d).select("evaluation_context", "model", *RECORDING, "rmse_all_horizons")
    parts = {c: results.filter(F.col("evaluation_context") == c).drop("evaluation_context") for c in ("WITHIN_A", "WITHIN_B", "A_TO_B", "B_TO_A")}
    return reconcile.union_contexts(parts, {"B0_PERSISTENCE": "Persistence"})


_RUNLOG = "SELECT 'c' || CAST(o_custkey AS VARCHAR) AS job_id, o_orderkey AS appended_at, o_totalprice AS loss, o_orderpriority AS state FROM orders"


@query("s10_latest_runs", f"WITH log AS ({_RUNLOG}) SELECT job_id, max(appended_at) AS appended_at, round(arg_max(loss, appended_at), 6) AS loss, arg_max(state, appended_at) AS state FROM log GROUP BY ALL")
def s10(spark, d):
    path = _folder(spark, "runs")
    o = td.table(spark, d, "orders")
    log = o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("job_id"), F.col("o_orderkey").alias("appended_at"), F.col("o_totalprice").alias("loss"), F.col("o_orderpriority").alias("state"))
    log.write.mode("append").parquet(path)
    return tables.latest_runs(spark.read.parquet(path))


@query("j9_pending_jobs", "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS job_id, c_mktsegment AS scope FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j9(spark, d):
    jobs = td.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("job_id"), F.col("c_mktsegment").alias("scope"))
    log = td.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("job_id"))
    return tables.pending_jobs(jobs, log)


@query("s11_file_manifest")
def s11_files(spark, d):
    """Size and hash of written stream files (names differ from run to run)."""
    path = _folder(spark, "streams")
    tables.write_streams(streams(spark, d), path)
    m = files.file_manifest(spark, path, recursive=True)
    return m.filter(F.col("path").endswith(".parquet")).select("size_bytes", F.length("sha256").alias("digits"))


_DOC_HASH = "SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, lang, source FROM documents"


@query("s11_content_hashes", "SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents")
def s11(spark, d):
    return _hashes(spark, d).select("path", "size_bytes", "sha256")


def _hashes(spark, d) -> DataFrame:
    docs = td.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), "lang", "source", "text")


@query(
    "j1_hash_locks",
    f"""WITH h AS ({_DOC_HASH}) SELECT path, sha256 AS expected_hash, CASE WHEN source <> 'src3' THEN CASE WHEN lang = 'de' THEN sha256(sha256) ELSE sha256 END END AS observed_hash,
    CASE WHEN source = 'src3' THEN 'MISSING' WHEN lang = 'de' THEN 'FAIL' ELSE 'PASS' END AS status FROM h""",
)
def j1(spark, d):
    """Expected hashes against a store where one source is gone and one language changed."""
    h = _hashes(spark, d)
    seen = h.filter("source <> 'src3'").select("path", F.when(F.col("lang") == "de", F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return reconcile.verify_hashes(h, seen)


@query(
    "j2_changed_artifacts",
    f"""WITH h AS ({_DOC_HASH}) SELECT path, CASE WHEN source <> 'src1' THEN sha256 END AS before_hash, CASE WHEN source <> 'src3' THEN CASE WHEN lang = 'de' THEN sha256(sha256) ELSE sha256 END END AS after_hash,
    CASE WHEN source = 'src1' THEN 'ADDED' WHEN source = 'src3' THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM h WHERE source IN ('src1', 'src3') OR lang = 'de'""",
)
def j2(spark, d):
    h = _hashes(spark, d)
    after = h.filter("source <> 'src3'").select("path", F.when(F.col("lang") == "de", F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return reconcile.changed_artifacts(h.filter("source <> 'src1'"), after)


_NAMES = ("imu.csv", "groundtruth.txt", "cam0/0001.PNG", "leica/pos.txt", "sensor.yaml", "notes.txt", "kalibr/camchain.bin", "._imu.csv", "events.txt")
_PATHS = (
    "SELECT doc_id AS ord, source, source || '/' || lang || '/' || [" + ", ".join(f"'{n}'" for n in _NAMES) + f"][CAST(n_chars % {len(_NAMES)} AS INTEGER) + 1] AS path FROM documents"
)
_ROLE = """CASE WHEN regexp_matches(base, '\\.(png|jpg|jpeg|pgm|ppm|pnm)$') THEN NULL WHEN base LIKE '%imu%' AND (base LIKE '%.txt' OR base LIKE '%.csv') THEN 'imu'
  WHEN base LIKE '%groundtruth%' OR base LIKE 'gt.%' OR base LIKE '%ground_truth%' THEN 'gt' WHEN lower(path) LIKE '%leica%' THEN 'leica' WHEN base LIKE '%.yaml' OR base LIKE '%.yml' THEN 'yaml'
  WHEN base LIKE '%camchain%' OR lower(path) LIKE '%kalibr%' THEN 'calib' WHEN base LIKE '%.txt' AND base NOT LIKE '%image%' AND base NOT LIKE '%event%' THEN 'text' END"""


def _paths(spark, d) -> DataFrame:
    docs = td.table(spark, d, "documents")
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("n_chars") % len(_NAMES)).cast("int"))
    return docs.select(F.col("doc_id").alias("ord"), "source", F.concat_ws("/", "source", "lang", name).alias("path"))


@query("s12_file_roles", f"WITH p AS ({_PATHS}), b AS (SELECT *, lower(split_part(path, '/', -1)) AS base FROM p) SELECT ord, path, {_ROLE} AS role, (base LIKE '%.csv' OR base LIKE '%.yaml') AND base NOT LIKE '.\\_%' ESCAPE '\\' AS is_table FROM b")
def s12(spark, d):
    return _paths(spark, d).select("ord", "path", files.file_role(F.col("path")).alias("role"), files.is_table_member(F.col("path")).alias("is_table"))


@query(
    "s12_first_per_role",
    f"WITH p AS ({_PATHS}), b AS (SELECT *, lower(split_part(path, '/', -1)) AS base FROM p), r AS (SELECT *, {_ROLE} AS role FROM b) SELECT source, role, arg_min(path, ord) AS path, count(*) AS n_files FROM r WHERE role IS NOT NULL GROUP BY ALL",
)
def s12_first(spark, d):
    return files.first_per_role(_paths(spark, d), ["source"])


@query("s12_find_named", f"WITH p AS ({_PATHS}) SELECT source, arg_min(path, ord) AS path FROM p WHERE lower(path) LIKE '%en/%' AND lower(path) LIKE '%imu%' GROUP BY ALL")
def s12_named(spark, d):
    return files.find_named(_paths(spark, d), ["source"], ["en/", "IMU"])


_SPEED = "CASE WHEN speed <= 2.0 THEN 'low' WHEN speed <= 4.0 THEN 'medium' ELSE 'high' END"


@query(
    "s13_flight_catalog",
    f"""WITH f AS (SELECT DISTINCT p_brand, p_type, p_size / 10.0 AS speed FROM part) SELECT p_brand || '/yawForward/' || printf('maxSpeed%dp%d', CAST(floor(speed) AS BIGINT), CAST(round_even((speed - floor(speed)) * 10, 0) AS BIGINT)) AS recording_id,
    p_type AS trajectory_name, p_brand AS dependency_group, 'yawForward' AS yaw_condition, {_SPEED} AS speed_condition, round(speed, 6) AS nominal_max_speed FROM f""",
)
def s13(spark, d):
    p = td.table(spark, d, "part")
    families = p.groupBy(F.col("p_type").alias("family"), F.col("p_brand").alias("folder")).agg(F.collect_set(F.col("p_size") / F.lit(10.0)).alias("speeds"))
    return catalogs.expand_flights(families.withColumn("yaw", F.lit("yawForward")))


@query(
    "s13_sensor_catalog",
    """WITH s AS (SELECT lower(n_name) AS env, CASE WHEN n_regionkey IN (0, 2) THEN 'forward' ELSE '45' END AS cam, n_nationkey AS nr, CASE WHEN n_regionkey > 0 THEN n_nationkey * 1.0 END AS vmax, n_regionkey <> 4 AS pub FROM nation),
    f AS (SELECT *, env || '_' || cam AS dep, env || '_' || cam || '_' || CAST(nr AS VARCHAR) AS flight FROM s), x AS (SELECT * FROM f CROSS JOIN (VALUES ('snapdragon'), ('davis')) AS v(sensor))
    SELECT flight || '_' || sensor AS recording_id, flight, sensor, dep AS dependency_group, CASE WHEN vmax IS NULL THEN 'UNRESOLVED' WHEN vmax < 6 THEN 'low' WHEN vmax <= 12 THEN 'moderate' ELSE 'aggressive' END AS speed_condition,
    flight || '_' || sensor || CASE WHEN pub THEN '_with_gt.zip' ELSE '.zip' END AS archive, CASE WHEN pub THEN 'PUBLIC_GT' ELSE 'GROUND_TRUTH_WITHHELD' END AS gt_status FROM x""",
)
def s13_sensors(spark, d):
    n = td.table(spark, d, "nation")
    specs = n.select(
        F.lower("n_name").alias("env"), F.when(F.col("n_regionkey").isin(0, 2), "forward").otherwise("45_down").alias("cam"), F.col("n_nationkey").alias("nr"),
        F.when(F.col("n_regionkey") > 0, F.col("n_nationkey").cast("double")).alias("vmax"), (F.col("n_regionkey") != 4).alias("public_gt"),
    )
    return catalogs.expand_sensors(specs, ["snapdragon", "davis"])


_IDS = "SELECT s_suppkey, (['V1_', 'V2_', 'MH_', 'X_'])[CAST(s_nationkey % 4 AS INTEGER) + 1] || printf('%02d', s_nationkey) || CASE WHEN s_acctbal > 0 THEN '_easy' ELSE '_difficult' END AS recording_id FROM supplier"
_MEANING = """CASE WHEN recording_id LIKE 'V1%' OR recording_id LIKE 'V2%' THEN 'vicon' WHEN recording_id LIKE 'MH%' THEN 'machine_hall' ELSE 'UNRESOLVED' END AS environment,
  CASE WHEN recording_id LIKE 'V1%' THEN 'vicon_room1' WHEN recording_id LIKE 'V2%' THEN 'vicon_room2' WHEN recording_id LIKE 'MH%' THEN 'ETH_machine_hall' ELSE 'UNRESOLVED' END AS room,
  CASE WHEN recording_id LIKE 'X%' THEN 'UNRESOLVED' ELSE split_part(recording_id, '_', 3) END AS difficulty"""


def _ids(spark, d) -> DataFrame:
    s = td.table(spark, d, "supplier")
    prefix = F.get(F.array(*[F.lit(p) for p in ("V1_", "V2_", "MH_", "X_")]), (F.col("s_nationkey") % 4))
    return s.select("s_suppkey", "s_nationkey", F.concat(prefix, F.format_string("%02d", "s_nationkey"), F.when(F.col("s_acctbal") > 0, "_easy").otherwise("_difficult")).alias("recording_id"))


@query("p15_id_meaning", f"WITH i AS ({_IDS}) SELECT s_suppkey, recording_id, {_MEANING} FROM i")
def p15(spark, d):
    return catalogs.with_id_meaning(_ids(spark, d).drop("s_nationkey"))


@query(
    "s13_archive_catalog",
    f"""WITH i AS ({_IDS}), a AS (SELECT DISTINCT i.recording_id, CASE WHEN i.recording_id LIKE 'MH%' THEN 'machine_hall.zip' ELSE 'rooms.zip' END AS official_archive FROM i)
    SELECT official_archive, recording_id, CAST(length(official_archive) * 1000 AS BIGINT) AS size_bytes, CASE WHEN official_archive LIKE 'machine%' THEN 'YES_OPTIONAL' ELSE 'YES' END AS available, {_MEANING} FROM a""",
)
def s13_archives(spark, d):
    hall = F.col("recording_id").startswith("MH")
    ids = _ids(spark, d).withColumns({"name": F.when(hall, "machine_hall.zip").otherwise("rooms.zip"), "environment": F.when(hall, "machine_hall").otherwise("vicon")})
    archives = ids.select("name", "environment", F.array("recording_id").alias("recordings")).distinct()
    return catalogs.expand_archives(archives.withColumn("size_bytes", (F.length("name") * 1000).cast("bigint")))


_ALL_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query("s14_table_inventory", " UNION ALL ".join(f"SELECT '{t}' AS item, count(*) AS n_rows, CAST({_WIDTHS[t]} AS BIGINT) AS n_columns FROM {t}" for t in _ALL_TABLES))
def s14(spark, d):
    return files.table_inventory({t: td.table(spark, d, t) for t in _ALL_TABLES})


@query(
    "r5_package_check",
    """WITH inv AS (SELECT 'region' AS item, count(*) AS n, avg(r_regionkey) AS value FROM region UNION ALL SELECT 'nation', count(*), avg(n_nationkey) FROM nation UNION ALL SELECT 'orders', count(*), avg(o_totalprice) FROM orders),
    e AS (SELECT * FROM (VALUES ('region', 2.0), ('nation', NULL), ('orders', -1.0), ('absent', NULL)) AS v(item, expected))
    SELECT item, round(expected::DOUBLE, 6) AS expected, n AS n_rows, round(value, 6) AS value, CASE WHEN n > 0 THEN 'yes' ELSE 'no' END AS present,
    CASE WHEN n > 0 AND (expected IS NULL OR abs(value - expected) <= 1e-9) THEN 'PASS' ELSE 'FAIL' END AS status FROM e LEFT JOIN inv USING (item)""",
)
def r5(spark, d):
    means = {"region": "r_regionkey", "nation": "n_nationkey", "orders": "o_totalprice"}
    inv = union_all(*[td.table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(c).alias("value")).withColumn("item", F.lit(t)) for t, c in means.items()])
    want = spark.createDataFrame([("region", 2.0), ("nation", None), ("orders", -1.0), ("absent", None)], "item string, expected double")
    return reconcile.package_check(want, inv)


@query(
    "s15_manifest_audit_scan",
    """SELECT DISTINCT 'e' || CAST(label AS VARCHAR) AS sequence_id, count(*) OVER (PARTITION BY label) AS n_rows, 'idx,timestamp,ang_vel_x,ang_vel_y,ang_vel_z,lin_acc_x,lin_acc_y,lin_acc_z' AS columns FROM embeddings""",
)
def s15(spark, d):
    """All ready IMU files of a manifest, parsed in one scan."""
    path = sensor_text_files(spark, d)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path).select("path")
    manifest = found.select(
        F.lit("E").alias("dataset"), F.regexp_extract("path", r"recording_id=([^/]+)", 1).alias("sequence_id"), F.lit("IMU").alias("content_role"), F.col("path").alias("local_path"),
        F.lit("DOWNLOADED").alias("download_status"),
    )
    audited = files.audit_files(spark, manifest, "IMU")
    return audited.groupBy("sequence_id").agg(F.sum("n_rows").alias("n_rows"), F.array_join(F.first("columns"), ",").alias("columns"))


def _role_files(spark, d) -> DataFrame:
    """A manifest of IMU, ground truth and position files written from the vectors, and one that is not ready."""
    base = td.table(spark, d, "embeddings").select("vec_id", F.format_string("e%d", "label").alias("recording_id"), "embedding")
    value = lambda i: F.col("embedding")[i].cast("double")
    clock = (F.col("vec_id") / F.lit(200.0)).alias("timestamp")
    layouts = {
        "IMU": [clock, *[value(i).alias(f"ang_vel_{c}") for i, c in enumerate("xyz")], *[value(3 + i).alias(f"lin_acc_{c}") for i, c in enumerate("xyz")]],
        "GROUND_TRUTH": [clock, *[value(i).alias(f"t{c}") for i, c in enumerate("xyz")], *[value(4 + i).alias(f"q{c}") for i, c in enumerate("xyzw")]],
        "LEICA_POSITION": [clock, *[value(8 + i).alias(c) for i, c in enumerate("xyz")]],
    }
    manifests = []
    for role, cells in layouts.items():
        path = _folder(spark, f"role-{role.lower()}")
        base.select(*cells, "recording_id").write.partitionBy("recording_id").option("header", True).option("sep", " ").csv(path)
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)
        manifests.append(found.select(F.lit(role).alias("content_role"), F.col("path").alias("local_path"), F.lit("DOWNLOADED").alias("download_status")))
    manifests.append(manifests[0].withColumn("download_status", F.lit("MISSING")))
    return union_all(*manifests).withColumn("sequence_id", F.regexp_extract("local_path", r"recording_id=([^/]+)", 1))


_ROLE_COUNTS = "SELECT 'e' || CAST(label AS VARCHAR) AS sequence_id, count(*) AS n_rows FROM embeddings GROUP BY label"


@query(
    "s15_manifest_roles",
    f"""WITH n AS ({_ROLE_COUNTS}), roles AS (SELECT * FROM (VALUES
      ('IMU', 'imu', 'HEADER_MAPPED', 'ang_vel_x,ang_vel_y,ang_vel_z', NULL, NULL, NULL),
      ('GROUND_TRUTH', 'pose', NULL, NULL, 'tx,ty,tz', 'qx,qy,qz,qw', 'xyzw_from_header'),
      ('LEICA_POSITION', 'position', NULL, NULL, 'x,y,z', NULL, NULL)) AS v(content_role, kind, layout, gyro_fields, position_fields, orientation_fields, quaternion_order))
    SELECT sequence_id, roles.*, 'timestamp' AS timestamp_field, n_rows FROM n CROSS JOIN roles""",
)
def s15_roles(spark, d):
    """Every ready file of a manifest, interpreted by its content role."""
    found = files.scan_manifest(spark, _role_files(spark, d)).files
    return found.groupBy("sequence_id", "content_role", "kind").agg(
        F.sum("n_rows").alias("n_rows"), F.first(F.coalesce("imu.timestamp_field", "pose.timestamp_field", "position.timestamp_field")).alias("timestamp_field"),
        F.first("imu.layout").alias("layout"), F.first("imu.gyro_fields").alias("gyro_fields"), F.first(F.coalesce("pose.position_fields", "position.position_fields")).alias("position_fields"),
        F.first("pose.orientation_fields").alias("orientation_fields"), F.first("pose.quaternion_order").alias("quaternion_order"),
    )


@query(
    "s15_manifest_rows",
    "WITH e AS (SELECT 'e' || CAST(label AS VARCHAR) AS sequence_id, vec_id / 200.0 AS clock, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings) "
    + " UNION ALL ".join(
        f"SELECT sequence_id, '{kind}' AS kind, round(clock, 6) AS clock, " + ", ".join(f"{'NULL' if at is None else f'round(v[{at + 1}], 6)'} AS {c}" for c, at in cells.items()) + " FROM e"
        for kind, cells in {
            "imu": {"wx": 0, "fz": 5, "px": None, "pz": None, "qw": None, "qx": None},
            "pose": {"wx": None, "fz": None, "px": 0, "pz": 2, "qw": 7, "qx": 4},
            "position": {"wx": None, "fz": None, "px": 8, "pz": 10, "qw": None, "qx": None},
        }.items()
    ),
)
def s15_rows(spark, d):
    """The rows of all three kinds from one scan."""
    rows = files.scan_manifest(spark, _role_files(spark, d)).rows
    return rows.select(
        "sequence_id", "kind", F.coalesce("imu.clock", "pose.clock", "position.clock").alias("clock"), F.col("imu.wx").alias("wx"), F.col("imu.fz").alias("fz"),
        F.coalesce("pose.px", "position.px").alias("px"), F.coalesce("pose.pz", "position.pz").alias("pz"), F.col("pose.qw").alias("qw"), F.col("pose.qx").alias("qx"),
    )


@query(
    "s16_config_grid",
    """SELECT p_brand AS architecture, 'cfg' || CAST(p_partkey AS VARCHAR) AS config_id, CAST(p_size AS VARCHAR) || ',' || CAST(2 * p_size AS VARCHAR) AS channels, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END AS hidden_size FROM part""",
)
def s16(spark, d):
    size = F.col("p_size").cast("bigint")
    configs = td.table(spark, d, "part").select(
        F.col("p_brand").alias("architecture"), F.concat(F.lit("cfg"), "p_partkey").alias("config_id"), F.array(size, 2 * size).alias("channels"), F.when(size > 25, size).alias("hidden_size")
    )
    return tables.config_grid(configs)


@query(
    "s17_relabelled_baseline",
    f"""WITH {LOCAL_RESULTS} SELECT evaluation_context, 'BEST_LOCAL' AS model, {KEY}, 'B1_LINEAR' AS config_id, 'NA_BASELINE' AS seeds_mean, 'frozen baseline; not refit' AS notes, round(rmse_all_horizons, 6) AS rmse_all_horizons
    FROM results WHERE model = 'B1_LINEAR'""",
)
def s17(spark, d):
    rows = reconcile.relabel_baseline(local_results(spark, d), "B1_LINEAR", "BEST_LOCAL")
    return rows.select("evaluation_context", "model", *RECORDING, "config_id", "seeds_mean", "notes", "rmse_all_horizons")


# Two manifests with overlapping keys: cheap suppliers first, then all of them.
@query(
    "u2_merged_manifests",
    """WITH a AS (SELECT s_nationkey AS nation, s_suppkey % 7 AS slot, min(s_name) AS label FROM supplier WHERE s_acctbal < 3000 GROUP BY ALL), b AS (SELECT s_nationkey AS nation, s_suppkey % 7 AS slot, max(s_name) AS label FROM supplier GROUP BY ALL)
    SELECT CAST(nation AS BIGINT) AS nation, slot, coalesce(a.label, b.label) AS label FROM b LEFT JOIN a USING (nation, slot)""",
)
def u2(spark, d):
    s = td.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("slot"), "s_name", "s_acctbal")
    first = s.filter("s_acctbal < 3000").groupBy("nation", "slot").agg(F.min("s_name").alias("label"))
    return reconcile.merge_manifests([first, s.groupBy("nation", "slot").agg(F.max("s_name").alias("label"))], ["nation", "slot"])


@query("u3_common_groups", "WITH g AS (SELECT DISTINCT user_id % 14 < 6 AS a, user_id % 3 AS k, event_type FROM events) SELECT k, event_type FROM g WHERE a INTERSECT SELECT k, event_type FROM g WHERE NOT a")
def u3(spark, d):
    g = td.table(spark, d, "events").select((F.col("user_id") % 14 < 6).alias("a"), (F.col("user_id") % 3).alias("k"), "event_type")
    return g.filter("a").drop("a").intersect(g.filter(~F.col("a")).drop("a"))


@query("t4_first_seen_groups", "SELECT CASE WHEN user_id % 14 < 6 THEN 'A' ELSE 'B' END AS dataset, 'g' || CAST(user_id % 14 % 3 AS VARCHAR) AS held_group, min(user_id % 14) AS group_ord, count(DISTINCT user_id % 14) AS n_held FROM events GROUP BY ALL")
def t4(spark, d):
    from sensorloom.operators.splits import group_folds

    return group_folds(td.recordings(spark, d))


@query(
    "j4_left_joins",
    f"""WITH {STREAMS}, s AS (SELECT {KEY}, count(*) AS n FROM streams GROUP BY ALL), h AS (SELECT {KEY}, count(*) AS n_high FROM streams WHERE q_f > 200 GROUP BY ALL) SELECT {KEY}, n, n_high FROM s LEFT JOIN h USING (dataset, recording_id)""",
)
def j4(spark, d):
    rows = td.event_rows(spark, d)
    sizes = rows.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(rows.filter("q_f > 200").groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n_high")), list(RECORDING), "left")


@query(
    "p16_value_texts",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'YES' ELSE 'NO' END AS finished, printf('%.3f', o_totalprice) AS price_text, TRY_CAST(nullif(trim(substr(o_orderpriority, 1, 1)), '') AS DOUBLE) AS priority,
    CASE WHEN o_orderstatus = 'O' THEN 'DOWNLOADED' WHEN o_orderstatus = 'F' THEN 'HASH_VERIFIED' ELSE 'FAILED' END AS status FROM orders""",
)
def p16(spark, d):
    o = td.table(spark, d, "orders")
    raw = F.when(F.col("o_orderstatus") == "O", "DOWNLOADED").when(F.col("o_orderstatus") == "F", "ALREADY_PRESENT_HASH_VERIFIED").otherwise("FAILED")
    return o.select(
        "o_orderkey", scalar.yes_no(F.col("o_orderstatus") == "F").alias("finished"), scalar.fixed3(F.col("o_totalprice")).alias("price_text"),
        scalar.parse_number(F.substring("o_orderpriority", 1, 1)).alias("priority"), files.download_status(raw, F.lit("")).alias("status"),
    )


# A proper rotation from two data vectors (Gram-Schmidt) per embedding row.
_ROT = """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) b, CAST(embedding[3] AS DOUBLE) c, CAST(embedding[4] AS DOUBLE) d, CAST(embedding[5] AS DOUBLE) e, CAST(embedding[6] AS DOUBLE) f FROM embeddings),
u AS (SELECT vec_id, a / sqrt(a*a + b*b + c*c) AS u1, b / sqrt(a*a + b*b + c*c) AS u2, c / sqrt(a*a + b*b + c*c) AS u3, d, e, f FROM e),
v0 AS (SELECT *, d - (d*u1 + e*u2 + f*u3) * u1 AS d1, e - (d*u1 + e*u2 + f*u3) * u2 AS e1, f - (d*u1 + e*u2 + f*u3) * u3 AS f1 FROM u),
v AS (SELECT *, d1 / sqrt(d1*d1 + e1*e1 + f1*f1) AS v1, e1 / sqrt(d1*d1 + e1*e1 + f1*f1) AS v2, f1 / sqrt(d1*d1 + e1*e1 + f1*f1) AS v3 FROM v0),
r AS (SELECT vec_id, u1 AS m00, u2 AS m01, u3 AS m02, v1 AS m10, v2 AS m11, v3 AS m12, u2*v3 - u3*v2 AS m20, u3*v1 - u1*v3 AS m21, u1*v2 - u2*v1 AS m22 FROM v),
q AS (SELECT *, m00 + m11 + m22 AS t, sqrt(greatest(1 + m00 + m11 + m22, 0)) * 2 AS sw, sqrt(greatest(1 + m00 - m11 - m22, 0)) * 2 AS sx, sqrt(greatest(1 + m11 - m00 - m22, 0)) * 2 AS sy, sqrt(greatest(1 + m22 - m00 - m11, 0)) * 2 AS sz FROM r)"""


@query(
    "p17_quaternions",
    f"""{_ROT} SELECT vec_id,
    round(CASE WHEN t > 0 THEN 0.25 * sw WHEN m00 >= m11 AND m00 >= m22 THEN (m21 - m12) / sx WHEN m11 >= m22 THEN (m02 - m20) / sy ELSE (m10 - m01) / sz END, 6) AS w,
    round(CASE WHEN t > 0 THEN (m21 - m12) / sw WHEN m00 >= m11 AND m00 >= m22 THEN 0.25 * sx WHEN m11 >= m22 THEN (m01 + m10) / sy ELSE (m02 + m20) / sz END, 6) AS x,
    round(CASE WHEN t > 0 THEN (m02 - m20) / sw WHEN m00 >= m11 AND m00 >= m22 THEN (m01 + m10) / sx WHEN m11 >= m22 THEN 0.25 * sy ELSE (m12 + m21) / sz END, 6) AS y,
    round(CASE WHEN t > 0 THEN (m10 - m01) / sw WHEN m00 >= m11 AND m00 >= m22 THEN (m02 + m20) / sx WHEN m11 >= m22 THEN (m12 + m21) / sy ELSE 0.25 * sz END, 6) AS z,
    7.0::DOUBLE AS tz FROM q""",
)
def p17(spark, d):
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    rows = td.table(spark, d, "embeddings").select("vec_id", *[c.alias(f"e{i}") for i, c in enumerate(e)])
    a, b = [F.col(f"e{i}") for i in range(3)], [F.col(f"e{i}") for i in range(3, 6)]
    rows = rows.withColumns({f"u{i}": a[i] / norm(a) for i in range(3)})
    u = [F.col(f"u{i}") for i in range(3)]
    along = b[0] * u[0] + b[1] * u[1] + b[2] * u[2]
    rows = rows.withColumns({f"p{i}": b[i] - along * u[i] for i in range(3)})
    p = [F.col(f"p{i}") for i in range(3)]
    rows = rows.withColumns({f"v{i}": p[i] / norm(p) for i in range(3)})
    v = [F.col(f"v{i}") for i in range(3)]
    w = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    zero, shift = F.lit(0.0), F.lit(7.0)
    transform = F.array(*u, zero, *v, zero, *w, shift, zero, zero, zero, F.lit(1.0))
    rows = rows.withColumn("t", transform).select("vec_id", scalar.rotation_of(F.col("t")).alias("r"), scalar.translation_of(F.col("t")).alias("move"))
    rows = rows.withColumn("q", scalar.quaternion_wxyz(F.col("r")))
    return rows.select("vec_id", *[F.col("q")[i].alias(c) for i, c in enumerate("wxyz")], F.col("move")[2].alias("tz"))


@query(
    "p20_resampling_audit",
    f"""WITH {STREAMS}, st AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS dt FROM streams),
    c AS (SELECT {KEY}, count(*) AS n_native, count(*) AS n_processed, coalesce(bool_and(dt > 0), false) AS strictly_monotonic, 1 / (quantile_cont(dt, 0.5) FILTER (WHERE dt > 0)) AS hz FROM st GROUP BY ALL)
    SELECT dataset, recording_id, n_native, n_processed, round(CASE WHEN dataset = 'A' THEN 200.0 ELSE 500.0 END, 6)::DOUBLE AS native_rate_hz, CAST(CASE WHEN dataset = 'A' THEN 2 ELSE 5 END AS BIGINT) AS decimation_factor,
    strictly_monotonic, round(hz, 6) AS median_hz, round(abs(hz - 100), 6) AS max_abs_dev, CASE WHEN dataset = 'A' THEN 'ellip_sos_order5_fs200' ELSE 'ellip_sos_order6_fs500' END AS filter_name FROM c""",
)
def p20(spark, d):
    s = streams(spark, d)
    counts = s.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n_native"), F.count(F.lit(1)).alias("n_processed"))
    sos = spark.createDataFrame(
        [("A", 200.0, 2, [list(x) for x in SOS_200_HZ]), ("B", 500.0, 5, [list(x) for x in SOS_500_HZ])],
        "dataset string, native_rate_hz double, decimation_factor int, sos array<array<double>>",
    )
    return channels.resampling_audit(s, counts, sos, td.bounded(spark, d))


@query(
    "a37_dataset_rollup",
    f"""WITH {STREAMS}, st AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS dt FROM streams),
    r AS (SELECT {KEY}, dependency_group, count(*) AS n, 1 / (quantile_cont(dt, 0.5) FILTER (WHERE dt > 0)) AS hz FROM st GROUP BY ALL)
    SELECT dataset, count(*) AS n_recordings, count(DISTINCT dependency_group) AS n_groups, count(*) FILTER (WHERE n >= 700) AS n_usable, round(quantile_cont(hz, 0.5), 6) AS median_of_median_hz, CAST(sum(n * 24) AS BIGINT) AS consumed_bytes FROM r GROUP BY ALL""",
)
def a37(spark, d):
    s = streams(spark, d)
    rates = timestamps.rate_check(s, bounded=td.bounded(spark, d)).select(*RECORDING, "median_hz")
    per = s.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"), F.first("dependency_group").alias("g")).join(rates, list(RECORDING))
    return per.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_recordings"), F.count_distinct("g").alias("n_groups"), F.count_if(F.col("n") >= 700).alias("n_usable"),
        F.median("median_hz").alias("median_of_median_hz"), F.sum(F.col("n") * 24).alias("consumed_bytes"),
    )
