"""Rule-based verdicts over audited recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.operators import bundle, channels, classify, timestamps
from sensorloom.operators.ordering import assign_idx
from sensorloom.operators.rows import union_all
from sensorloom.plans.aggregates import _A1, _A7, _DESC, _GAPS, _HZ, _SPEC7, _timestamp_audit_sql
from sensorloom.plans.base import KEY, i64, query, r6, streams
from sensorloom.session import materialise
from sensorloom.sources import testdata as td

# Samples with a clock that stalls and steps back: lineitem rows as a 6-channel IMU.
_IMU = """imu AS (
  SELECT l_returnflag AS dataset, 's' || CAST(l_suppkey % 20 AS VARCHAR) AS recording_id,
    row_number() OVER (PARTITION BY l_returnflag, l_suppkey % 20 ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS idx, l_orderkey / 100.0 AS ts_s,
    l_quantity / 3.0 AS fx, l_discount AS fy, l_tax AS fz, l_linenumber / 1.0 AS wx, l_extendedprice AS wy, CASE WHEN l_suppkey % 20 = 3 THEN NULL ELSE l_tax END AS wz FROM lineitem)"""
_IMU_STEPS = _IMU + ", imu_steps AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS dt FROM imu)"


def imu(spark, d) -> DataFrame:
    li = td.table(spark, d, "lineitem")
    slot = F.col("l_suppkey") % 20
    rows = li.select(
        F.col("l_returnflag").alias("dataset"), F.concat(F.lit("s"), slot).alias("recording_id"), (F.col("l_orderkey") / F.lit(100.0)).alias("ts_s"),
        (F.col("l_quantity") / 3.0).alias("fx"), F.col("l_discount").alias("fy"), F.col("l_tax").alias("fz"), F.col("l_linenumber").cast("double").alias("wx"),
        F.col("l_extendedprice").alias("wy"), F.when(slot != 3, F.col("l_tax")).alias("wz"), "l_orderkey", "l_linenumber", "l_partkey",
    )
    return assign_idx(rows, RECORDING, ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_orderkey", "l_linenumber", "l_partkey")


_REST = f"""t AS (SELECT *, min(ts_s) OVER (PARTITION BY dataset, recording_id) AS t0, sqrt(fx*fx + fy*fy + fz*fz) AS norm FROM imu),
  hd AS (SELECT *, count(*) FILTER (WHERE ts_s <= t0 + 1.5) OVER (PARTITION BY dataset, recording_id) AS nh FROM t),
  rest AS (SELECT {KEY}, count(*) AS n_rest, quantile_cont(norm, 0.5) AS rest_median FROM hd WHERE CASE WHEN nh >= 10 THEN ts_s <= t0 + 1.5 ELSE idx < 200 END GROUP BY ALL),
  flags AS (SELECT *, CASE WHEN n_rest < 10 THEN 'UNRESOLVED' WHEN rest_median BETWEEN 8.5 AND 11 THEN 'YES_CONSISTENT_WITH_SPECIFIC_FORCE_AT_REST' WHEN rest_median < 1.5 THEN 'NO_OR_GRAVITY_REMOVED_CANDIDATE'
     ELSE printf('UNRESOLVED_rest_median_norm=%.3f', rest_median) END AS gravity_flag FROM rest)"""


@query("w13_gravity_flags", f"WITH {_IMU}, {_REST} SELECT {KEY}, n_rest, round(rest_median, 6) AS rest_median, gravity_flag FROM flags")
def w13(spark, d):
    return channels.gravity_flags(imu(spark, d))


_UNIT = "CASE WHEN dataset = 'A' THEN 'm/s^2' WHEN dataset = 'N' THEN 'DECLARED_IN_CALIB' ELSE 'UNRESOLVED' END"


def _units(rows: DataFrame) -> DataFrame:
    unit = F.when(F.col("dataset") == "A", "m/s^2").when(F.col("dataset") == "N", "DECLARED_IN_CALIB").otherwise("UNRESOLVED")
    return rows.select(*RECORDING).distinct().withColumn("unit_acceleration", unit)


_C10 = f"""q AS (SELECT {KEY}, {_UNIT} AS unit_acceleration, gravity_flag, CASE WHEN dataset = 'A' THEN 'SI_MPS2_VERIFIED' WHEN dataset = 'N' THEN 'CONVERTIBLE_TO_SI_WITH_DOCUMENTED_FORMULA' ELSE 'UNIT_UNRESOLVED' END AS unit_status,
    CASE WHEN dataset = 'A' AND gravity_flag LIKE 'YES%' THEN 'RAW_ACCELEROMETER_SPECIFIC_FORCE' ELSE 'UNRESOLVED' END AS quantity, CASE WHEN dataset = 'A' AND gravity_flag LIKE 'YES%' THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM flags)"""


@query("c10_measured_quantity", f"WITH {_IMU}, {_REST}, {_C10} SELECT * FROM q")
def c10(spark, d):
    rows = imu(spark, d)
    return channels.measured_quantity(_units(rows), channels.gravity_flags(rows))


# Evidence per recording: integrity, clock, overlap with the "reference" rows (discounted
# orders), documentation flags from the dataset.
_EVIDENCE = _IMU_STEPS + f""",
integ AS (SELECT {KEY}, count(*) AS n_samples, count(*) > 1 AND min(fx) = max(fx) AND min(fy) = max(fy) AND min(fz) = max(fz) AS accel_constant,
  count(*) FILTER (WHERE dt < 0) AS backward_count, arg_max(ts_s, idx) - arg_min(ts_s, idx) AS duration_s, arg_min(ts_s, idx) AS a0, arg_max(ts_s, idx) AS a1,
  (6 * count(*) - count(*) FILTER (WHERE wz IS NULL)) / (6.0 * count(*)) AS ff FROM imu_steps GROUP BY ALL),
ref AS (SELECT {KEY}, count(*) AS n_reference, arg_min(ts_s, idx) AS b0, arg_max(ts_s, idx) AS b1 FROM imu WHERE fy >= 0.09 AND recording_id <> 's5' GROUP BY ALL),
ev AS (SELECT i.*, n_reference, CASE WHEN b0 IS NOT NULL THEN greatest(least(a1, b1) - greatest(a0, b0), 0) END AS overlap_s, dataset <> 'R' AS has_calibration, CASE WHEN recording_id = 's7' THEN 'UNRESOLVED' ELSE 'HEADER_MAPPED' END AS layout,
  recording_id <> 's9' AS units_ok FROM integ i LEFT JOIN ref USING (dataset, recording_id))"""


def evidence(spark, d) -> DataFrame:
    rows = imu(spark, d)

    clock = timestamps.audit_timestamps(rows).select(*RECORDING, "backward_count", F.col("duration").alias("duration_s"))
    reference = rows.filter("fy >= 0.09 and recording_id <> 's5'")
    meets = timestamps.stream_overlap(rows, reference).select(*RECORDING, "overlap_s")
    sizes = reference.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n_reference"))
    return (
        channels.imu_integrity(rows)
        .join(clock, list(RECORDING))
        .join(meets, list(RECORDING), "left")
        .join(sizes, list(RECORDING), "left")
        .withColumns({
            "has_calibration": F.col("dataset") != "R",
            "layout": F.when(F.col("recording_id") == "s7", "UNRESOLVED").otherwise("HEADER_MAPPED"),
            "units_ok": F.col("recording_id") != "s9",
        })
    )


_CRITICAL = "(NOT has_calibration OR layout = 'UNRESOLVED' OR ff < 0.99 OR n_reference IS NULL)"
_VERDICT = f"""SELECT {KEY}, CASE WHEN {_CRITICAL} THEN 'EXCLUDE' WHEN NOT units_ok THEN 'QUESTIONABLE' WHEN duration_s < 20 OR coalesce(overlap_s, 0) < 20 THEN 'QUESTIONABLE' ELSE 'USABLE_PRIMARY' END AS usable_status,
    CASE WHEN {_CRITICAL} THEN 'CRITICAL integrity failure' WHEN NOT units_ok THEN 'incomplete IMU/units/frame/GT documentation' WHEN duration_s < 20 OR coalesce(overlap_s, 0) < 20 THEN 'duration or IMU-GT overlap < 20 s' ELSE '' END AS exclusion_reason FROM ev"""


@query("c2_audit_verdict", f"WITH {_EVIDENCE} {_VERDICT}")
def c2(spark, d):
    return classify.audit_verdict(evidence(spark, d))


_CHECKS = [
    ("CSV_READABLE", "imu", "true", "CRITICAL", "CRITICAL"),
    ("YAML_READABLE", "calibration", "has_calibration", "INFO", "CRITICAL"),
    ("REQUIRED_COLUMNS", "imu", "layout <> 'UNRESOLVED'", "CRITICAL", "CRITICAL"),
    ("NAN_INF", "imu", "ff >= 0.99", "INFO", "CRITICAL"),
    ("MONOTONIC_TS", "timestamps", "backward_count = 0", "INFO", "MAJOR"),
    ("CONSTANT_CHANNELS", "imu", "NOT accel_constant", "INFO", "MAJOR"),
    ("GT_READABLE", "ground_truth", "n_reference IS NOT NULL", "CRITICAL", "CRITICAL"),
    ("GT_OVERLAP", "ground_truth", "coalesce(overlap_s, 0) >= 20", "INFO", "MAJOR"),
]
_FINDINGS = " UNION ALL ".join(
    f"SELECT {KEY}, '{n}' AS check_id, '{c}' AS category, CASE WHEN {t} THEN '{ok}' ELSE '{bad}' END AS severity, CASE WHEN {t} THEN 'PASS' ELSE 'FAIL' END AS status FROM ev" for n, c, t, ok, bad in _CHECKS
)


@query("c2_audit_findings", f"WITH {_EVIDENCE} {_FINDINGS}")
def c2_findings(spark, d):
    return classify.audit_findings(evidence(spark, d))


@query("p19_major_failures", f"WITH {_EVIDENCE}, f AS ({_FINDINGS}) SELECT * FROM f WHERE severity = 'MAJOR' AND status = 'FAIL'")
def p19(spark, d):
    return classify.failing(classify.audit_findings(evidence(spark, d)))


_C1 = """SELECT dataset, recording_id, CASE WHEN NOT downloaded AND withheld THEN 'GT_WITHHELD' WHEN NOT downloaded THEN 'NOT_DOWNLOADED' WHEN layout = 'UNRESOLVED' OR n_reference IS NULL OR ff < 0.99 THEN 'EXCLUDE'
      WHEN coalesce(overlap_s, 0) < 20 OR NOT units_ok THEN 'QUESTIONABLE' WHEN NOT has_calibration THEN 'USABLE_SECONDARY' ELSE 'USABLE_PRIMARY' END AS usable_status,
    CASE WHEN NOT downloaded AND withheld THEN 'GROUND_TRUTH_WITHHELD' WHEN NOT downloaded THEN 'not downloaded' ELSE concat_ws('; ', CASE WHEN layout = 'UNRESOLVED' THEN 'IMU acceleration/angular velocity not available' END,
      CASE WHEN n_reference IS NULL THEN 'public ground-truth pose not available' END, CASE WHEN NOT units_ok THEN 'acceleration units not verified' END, CASE WHEN NOT has_calibration THEN 'sensor frame not sufficiently understood' END,
      CASE WHEN coalesce(overlap_s, 0) < 20 THEN 'IMU-GT overlap < 20 s' END, CASE WHEN ff < 0.99 THEN 'required IMU channels < 99% finite' END, CASE WHEN NOT has_calibration THEN 'calibration/frame relationship incompletely documented' END) END AS exclusion_reason
    FROM (SELECT *, recording_id <> 's11' AND recording_id <> 's12' AS downloaded, recording_id = 's12' AS withheld FROM ev)"""


def _usability(spark, d) -> DataFrame:
    name = F.col("recording_id")
    return classify.classify_usability(
        evidence(spark, d).withColumns({
            "downloaded": ~name.isin("s11", "s12"), "withheld": name == "s12", "public_gt": F.lit(True), "corrupt": F.lit(False), "imu_ok": F.col("layout") != "UNRESOLVED",
            "gt_ok": F.col("n_reference").isNotNull(), "frame_ok": F.col("has_calibration"), "calib_ok": F.col("has_calibration"), "min_overlap_s": F.lit(20.0),
            "finite_fraction": F.col("finite_fraction_required"),
        })
    )


@query("c1_usability", f"WITH {_EVIDENCE} {_C1}")
def c1(spark, d):
    return _usability(spark, d)


@query("c9_primary_set", f"WITH {_EVIDENCE}, c1 AS ({_C1}), c2 AS ({_VERDICT}) SELECT * FROM c1 WHERE usable_status = 'USABLE_PRIMARY' UNION ALL SELECT * FROM c2 WHERE usable_status = 'USABLE_PRIMARY'")
def c9(spark, d):
    return classify.primary_set([_usability(spark, d), classify.audit_verdict(evidence(spark, d))])


@query(
    "c3_acquisition_verdict",
    f"""WITH {_EVIDENCE}, v AS ({_VERDICT}), n AS (SELECT dataset, count(*) FILTER (WHERE usable_status = 'USABLE_PRIMARY') AS n FROM v GROUP BY ALL)
    SELECT min(n) AS least_primary, count(*) AS n_datasets, CASE WHEN min(n) >= 6 THEN 'CONDITIONAL_PASS' ELSE 'FAIL' END AS verdict FROM n""",
)
def c3_acquisition(spark, d):
    return classify.acquisition_verdict(classify.audit_verdict(evidence(spark, d)), {"source_verified": True}, True)


@query(
    "c3_stage_verdict",
    f"""{_A7}, f AS (SELECT 'MAJOR' AS severity, 'FAIL' AS status FROM integrity WHERE max_dt > 36000 UNION ALL SELECT 'CRITICAL', 'FAIL' FROM integrity WHERE status = 'FAIL'),
    ch AS (SELECT {KEY}, stddev_pop(q_f) AS sd, abs(avg(q_f)) AS m FROM streams GROUP BY ALL)
    SELECT bool_and(sd < 0.05) AS degenerate, bool_or(sd < 1e-9) AS near_constant, (SELECT bool_and(enough_rows = 'YES' AND near_nominal_rate = 'YES') FROM integrity) AS streams_ok,
    (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') > 0 FROM f) AS critical, (SELECT count(*) FILTER (WHERE severity = 'MAJOR') > 0 FROM f) AS major, true AS hashes_ok,
    CASE WHEN bool_and(sd < 0.05) THEN 'CONDITIONAL_PASS_REVIEW_REQUIRED' WHEN (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') > 0 FROM f) OR NOT (SELECT bool_and(enough_rows = 'YES' AND near_nominal_rate = 'YES') FROM integrity) THEN 'FAIL'
      WHEN bool_or(sd < 1e-9) OR (SELECT count(*) FILTER (WHERE severity = 'MAJOR') > 0 FROM f) THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS decision FROM ch""",
)
def c3(spark, d):
    s, b = streams(spark, d), td.bounded(spark, d)
    integrity = channels.processed_integrity(s, _SPEC7, _HZ, b)
    hashes = td.recordings(spark, d).select(F.lit("PASS").alias("status"))
    return classify.stage_verdict(integrity, channels.integrity_findings(integrity, 36000.0), hashes, channels.describe_channels(s, ["q_f", "q_w"], b))


@query(
    "c8_compatibility",
    f"""WITH {_IMU}, {_REST}, {_C10}, w AS (SELECT max(quantity) FILTER (WHERE dataset = 'A') AS aq, max(unit_acceleration) FILTER (WHERE dataset = 'A') AS au, max(quantity) FILTER (WHERE dataset = 'N') AS bq, max(unit_acceleration) FILTER (WHERE dataset = 'N') AS bu FROM q)
    SELECT aq AS a_quantity, au AS a_unit_acceleration, 'rad/s' AS a_unit_gyro, bq AS b_quantity, bu AS b_unit_acceleration, 'rad/s' AS b_unit_gyro, CASE WHEN aq = bq AND aq <> 'UNRESOLVED' THEN 'YES' ELSE 'NO' END AS same_quantity,
    CASE WHEN au = 'm/s^2' AND bu = 'm/s^2' THEN 'YES' ELSE 'NO' END AS units_ok, CASE WHEN aq = bq AND aq <> 'UNRESOLVED' AND au = 'm/s^2' AND bu = 'm/s^2' THEN 'COMPARABLE_AFTER_DOCUMENTED_FRAME_TRANSFORM' ELSE 'COMPARABLE_FOR_SELECTED_QUANTITIES_ONLY' END AS verdict FROM w""",
)
def c8(spark, d):
    rows = imu(spark, d)
    meta = channels.measured_quantity(_units(rows), channels.gravity_flags(rows)).withColumn("unit_gyro", F.lit("rad/s"))
    return classify.compatibility(meta, "A", "N")


@query(
    "a38_audit_bundle",
    f"""WITH {_IMU_STEPS}, k AS (SELECT *, 'imu' AS kind FROM imu_steps UNION ALL SELECT * EXCLUDE (rn), 'reference' FROM (
      SELECT dataset, recording_id, rn - 1 AS idx, ts_s, fx, fy, fz, wx, wy, wz, ts_s - lag(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY rn) AS dt, rn FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS rn FROM imu WHERE fy >= 0.09)))
    SELECT dataset || ':' || kind AS dataset, recording_id, count(*) AS sample_count, round(max(dt) FILTER (WHERE dt > 0), 6) AS maximum_gap, round(quantile_cont(dt, 0.5) FILTER (WHERE dt > 0), 6) AS median_dt, count(*) FILTER (WHERE dt = 0) AS duplicate_count FROM k GROUP BY ALL""",
)
def a38(spark, d):
    """Both stream kinds of every recording audited together, written once."""
    rows = imu(spark, d).select(*RECORDING, "idx", "ts_s", "fy")
    reference = assign_idx(rows.filter("fy >= 0.09").withColumnRenamed("idx", "native"), RECORDING, ["native"]).drop("native")
    tagged = union_all(rows.withColumn("kind", F.lit("imu")), reference.withColumn("kind", F.lit("reference")))
    both = tagged.withColumn("dataset", F.concat_ws(":", "dataset", "kind")).drop("kind")
    return timestamps.audit_timestamps(materialise(both, "kinds")).select(*RECORDING, "sample_count", "maximum_gap", "median_dt", "duplicate_count")


# --- the whole audit bundle ---------------------------------------------------------------

_AXES = ("fx", "fy", "fz", "wx", "wy", "wz")
_KINDS = _IMU + f""",
kinds AS (
  SELECT 'imu:' || dataset AS dataset, recording_id, idx, ts_s, {', '.join(_AXES)} FROM imu
  UNION ALL SELECT 'reference:' || dataset, recording_id, row_number() OVER (PARTITION BY dataset, recording_id ORDER BY idx) - 1, ts_s, {', '.join(_AXES)} FROM imu WHERE fy >= 0.09 AND recording_id <> 's5'),
kind_steps AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS dt FROM kinds),
{_timestamp_audit_sql('kind_steps')},
a AS (SELECT * EXCLUDE (dataset), split_part(dataset, ':', 2) AS dataset, split_part(dataset, ':', 1) AS kind FROM audit),
ov AS (SELECT i.dataset, i.recording_id, greatest(least(i.last_timestamp, r.last_timestamp) - greatest(i.first_timestamp, r.first_timestamp), 0) AS overlap_s,
  greatest(i.last_timestamp, r.last_timestamp) - least(i.first_timestamp, r.first_timestamp) AS span FROM a i JOIN a r USING (dataset, recording_id) WHERE i.kind = 'imu' AND r.kind = 'reference'),
axes AS ({' UNION ALL '.join(f"SELECT split_part(dataset, ':', 2) AS dataset, split_part(dataset, ':', 1) AS kind, recording_id, idx, '{c}' AS channel, {c} AS x FROM kinds" for c in _AXES)})"""


def _kinds(spark, d) -> DataFrame:
    rows = imu(spark, d)
    reference = rows.filter("fy >= 0.09 and recording_id <> 's5'").withColumnRenamed("idx", "native")
    return materialise(bundle.both_kinds(rows, assign_idx(reference, RECORDING, ["native"]).drop("native")), "kinds")


@query(
    "a38_stream_audits",
    f"""WITH {_KINDS} SELECT dataset, recording_id, kind, sample_count, {r6(*_A1)}, 'seconds' AS timestamp_unit, strictly_monotonic, backward_count, duplicate_count, {i64(*_GAPS)},
    CASE WHEN kind = 'imu' THEN round(overlap_s, 6) END AS overlap_s, CASE WHEN kind = 'imu' THEN round(CASE WHEN overlap_s = 0 THEN 0 ELSE overlap_s / span END, 6) END AS overlap_fraction
    FROM a LEFT JOIN ov USING (dataset, recording_id)""",
)
def a38_streams(spark, d):
    """Clock audit of both kinds and their overlap."""
    return bundle.stream_audits(_kinds(spark, d), td.bounded(spark, d))


@query(
    "a38_axis_audits",
    f"""WITH {_KINDS}, f AS (SELECT *, arg_min(x, idx) OVER (PARTITION BY dataset, recording_id, kind, channel) AS x0 FROM axes)
    SELECT dataset, recording_id, kind, channel, count(*) AS sample_count, count(*) - count(x) AS missing_count, count(*) - count(x) AS nonfinite_count, {_DESC},
    coalesce(round(avg(CASE WHEN x = x0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE x IS NOT NULL), 6), 1.0) AS constant_fraction FROM f GROUP BY ALL""",
)
def a38_axes(spark, d):
    """Inventory of all six axes of both kinds."""
    return bundle.axis_audits(_kinds(spark, d), _AXES, td.bounded(spark, d))


_MONOTONIC = "'timestamps' AS category, CASE WHEN strictly_monotonic THEN 'INFO' ELSE 'WARNING' END AS severity, CASE WHEN strictly_monotonic THEN 'PASS' ELSE 'FAIL' END AS status, printf('backward=%d dup=%d', backward_count, duplicate_count) AS observed, 'strictly increasing timestamps' AS expected_or_rule, 'Order of the native clock.' AS interpretation, CASE WHEN strictly_monotonic THEN 'none' ELSE 'report' END AS action_required FROM a"


@query(
    "a38_findings",
    f"""WITH {_KINDS}, fin AS (SELECT dataset, recording_id, least(count(x) FILTER (WHERE channel LIKE 'f%') / count(*) FILTER (WHERE channel LIKE 'f%'), count(x) FILTER (WHERE channel LIKE 'w%') / count(*) FILTER (WHERE channel LIKE 'w%')) AS finite FROM axes WHERE kind = 'imu' GROUP BY ALL),
    met AS (SELECT DISTINCT i.dataset, i.recording_id, coalesce(overlap_s, 0) AS s FROM imu i LEFT JOIN ov USING (dataset, recording_id))
    SELECT dataset, recording_id, 'MONOTONIC' AS check_id, {_MONOTONIC} WHERE kind = 'imu'
    UNION ALL SELECT dataset, recording_id, 'REFERENCE_MONOTONIC', {_MONOTONIC} WHERE kind = 'reference'
    UNION ALL SELECT dataset, recording_id, 'FINITE', 'nan_inf', CASE WHEN finite >= 0.99 THEN 'INFO' ELSE 'MAJOR' END, CASE WHEN finite >= 0.99 THEN 'PASS' ELSE 'FAIL' END, printf('finite_fraction=%.6f', finite), '>=0.99 finite samples', 'Finite share of the worse axis group.', CASE WHEN finite >= 0.99 THEN 'none' ELSE 'exclude' END FROM fin
    UNION ALL SELECT dataset, recording_id, 'OVERLAP', 'reference', CASE WHEN s >= 20 THEN 'INFO' ELSE 'MAJOR' END, CASE WHEN s >= 20 THEN 'PASS' ELSE 'FAIL' END, printf('overlap_s=%.6f', s), '>=20 s common time', 'Common time of both streams.', CASE WHEN s >= 20 THEN 'none' ELSE 'exclude' END FROM met""",
)
def a38_findings(spark, d):
    """Findings over clocks, axes and overlap of every recording."""
    both = _kinds(spark, d)
    audits, axes = bundle.stream_audits(both, td.bounded(spark, d)), bundle.axis_audits(both, _AXES, td.bounded(spark, d))
    return bundle.bundle_findings(audits, audits, axes)


_OBSERVED = {
    "CSV_READABLE": ("printf('n=%d', n_samples)", "table with a header", "EXCLUDE"),
    "YAML_READABLE": ("CASE WHEN has_calibration THEN 'present' ELSE 'missing' END", "calibration file", "review"),
    "REQUIRED_COLUMNS": ("layout", "timestamp + 3 gyro + 3 accel", "EXCLUDE"),
    "NAN_INF": ("printf('finite_fraction=%.6f', ff)", ">=99% finite required IMU samples", "EXCLUDE"),
    "MONOTONIC_TS": ("printf('backward=%d', backward_count)", "strictly increasing timestamps preferred", "review"),
    "CONSTANT_CHANNELS": ("printf('accel_constant=%s', accel_constant)", "non-constant IMU channels", "EXCLUDE"),
    "GT_READABLE": ("CASE WHEN n_reference IS NULL THEN 'missing' ELSE printf('n=%d', n_reference) END", "reference table readable", "EXCLUDE"),
    "GT_OVERLAP": ("printf('overlap_s=%.6f', coalesce(overlap_s, 0))", ">=20 s IMU-GT overlap", "downgrade usability"),
}
_ARCHIVE_BAD = "recording_id IN ('s11', 's13')"


@query(
    "c2_findings_detail",
    f"""WITH {_EVIDENCE} SELECT {KEY}, 'ZIP_VALID' AS check_id, 'archive' AS category, CASE WHEN {_ARCHIVE_BAD} THEN 'CRITICAL' ELSE 'INFO' END AS severity, CASE WHEN {_ARCHIVE_BAD} THEN 'FAIL' ELSE 'PASS' END AS status,
      CASE WHEN {_ARCHIVE_BAD} THEN 'data.csv' ELSE 'archive_ok' END AS observed, 'no damaged member' AS expected_or_rule, CASE WHEN {_ARCHIVE_BAD} THEN 'EXCLUDE' ELSE 'none' END AS action_required FROM ev
    UNION ALL {' UNION ALL '.join(
        f"SELECT {KEY}, '{n}', '{c}', CASE WHEN {t} THEN '{ok}' ELSE '{bad}' END, CASE WHEN {t} THEN 'PASS' ELSE 'FAIL' END, {_OBSERVED[n][0]}, '{_OBSERVED[n][1]}', CASE WHEN {t} THEN 'none' ELSE '{_OBSERVED[n][2]}' END FROM ev" for n, c, t, ok, bad in _CHECKS)}""",
)
def c2_detail(spark, d):
    """Findings with what was seen, the rule and the action; archives enter as the name of a damaged member."""
    damaged = F.when(F.expr(_ARCHIVE_BAD), "data.csv").otherwise("")
    return classify.detailed_findings(evidence(spark, d).withColumn("damaged_member", damaged)).drop("interpretation")


@query(
    "c2_verdict_with_archive",
    f"""WITH {_EVIDENCE}, v AS ({_VERDICT}) SELECT {KEY}, CASE WHEN {_ARCHIVE_BAD} THEN 'EXCLUDE' ELSE usable_status END AS usable_status,
    CASE WHEN {_ARCHIVE_BAD} THEN 'CRITICAL integrity failure' ELSE exclusion_reason END AS exclusion_reason, CASE WHEN {_ARCHIVE_BAD} THEN 'DAMAGED' ELSE 'OK' END AS archive_status FROM v""",
)
def c2_archive(spark, d):
    damaged = F.when(F.expr(_ARCHIVE_BAD), "data.csv").otherwise("")
    return classify.archive_verdict(evidence(spark, d).withColumn("damaged_member", damaged))
