"""Audit and error aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.config import RECORDING, WindowSpec
from sensorloom.functions.scalar import is_finite, magnitude, vector_magnitude
from sensorloom.operators import channels, timestamps, transfer
from sensorloom.operators.forecasts import PERSISTENCE
from sensorloom.operators.metrics import (
    equal_recording_mean, high_target_results, horizon_rows, normalised_mse, recording_results, seed_average, seed_variability,
)
from sensorloom.operators.sampling import thin_evenly
from sensorloom.operators.windows import high_thresholds
from sensorloom.plans.base import (
    BASE, CELLS, KEY, LOCAL_RESULTS, ORIGINS, RESULT_NUMBERS, STEPS, STREAMS, i64, local_predictions, local_results, query, r6,
    results_sql, streams, windows,
)
from sensorloom.sources import testdata as td

# --- timestamps -------------------------------------------------------------------

_A1 = ["first_timestamp", "last_timestamp", "duration", "median_dt", "mean_dt", "std_dt", "p01_dt", "p05_dt", "p95_dt", "p99_dt", "median_frequency", "maximum_gap"]
_POS = "FILTER (WHERE dt > 0)"


def _timestamp_audit_sql(source: str) -> str:
    return f"""
  base AS (
    SELECT dataset, recording_id, count(*) AS sample_count, arg_min(ts_s, idx) AS first_timestamp, arg_max(ts_s, idx) AS last_timestamp,
      coalesce(bool_and(dt > 0), false) AS strictly_monotonic, count(*) FILTER (WHERE dt < 0) AS backward_count, count(*) FILTER (WHERE dt = 0) AS duplicate_count,
      avg(dt) {_POS} AS mean_dt, stddev_pop(dt) {_POS} AS std_dt, max(dt) {_POS} AS maximum_gap,
      {', '.join(f'quantile_cont(dt, {p}) {_POS} AS {n}' for n, p in (('median_dt', 0.5), ('p01_dt', 0.01), ('p05_dt', 0.05), ('p95_dt', 0.95), ('p99_dt', 0.99)))}
    FROM {source} GROUP BY ALL),
  audit AS (
    SELECT b.*, last_timestamp - first_timestamp AS duration, 1.0 / median_dt AS median_frequency,
      {', '.join(f'(SELECT count(*) FROM {source} s WHERE s.dataset = b.dataset AND s.recording_id = b.recording_id AND s.dt > {k} * b.median_dt) AS number_gaps_gt_{k}x_median' for k in (2, 5, 10))}
    FROM base b)"""


_GAPS = [f"number_gaps_gt_{k}x_median" for k in (2, 5, 10)]


@query(
    "a1_timestamp_audit",
    f"""WITH {STEPS}, {_timestamp_audit_sql('steps')}
    SELECT {KEY}, sample_count, {r6(*_A1)}, 'seconds' AS timestamp_unit, strictly_monotonic, backward_count, duplicate_count, {i64(*_GAPS)} FROM audit""",
)
def a1(spark, d):
    return timestamps.audit_timestamps(streams(spark, d), td.bounded(spark, d))


# Events in event_id order: the clock of a user group then runs backwards at times.
_ID_STEPS = """
id_streams AS (
  SELECT CASE WHEN user_id % 14 < 6 THEN 'A' ELSE 'B' END AS dataset, printf('r%02d', user_id % 14) AS recording_id,
         row_number() OVER (PARTITION BY user_id % 14 ORDER BY value, event_id) - 1 AS idx, floor(epoch_us(ts) / 6e7) AS ts_s FROM events),
id_steps AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS dt FROM id_streams)"""


def _disordered(spark, d):
    """Rows in value order with a clock in whole minutes: steps back and duplicates."""
    from sensorloom.operators.ordering import assign_idx

    rows = td.event_rows(spark, d).withColumn("ts_s", F.floor(F.col("ts_us") / F.lit(6e7)).cast("double"))
    return assign_idx(rows, RECORDING, ["q_f", "event_id"], td.bounded(spark, d))


@query(
    "a1_timestamp_audit_disordered",
    f"""WITH {_ID_STEPS}, {_timestamp_audit_sql('id_steps')}
    SELECT {KEY}, sample_count, {r6(*_A1)}, 'seconds' AS timestamp_unit, strictly_monotonic, backward_count, duplicate_count, {i64(*_GAPS)} FROM audit""",
)
def a1_disordered(spark, d):
    return timestamps.audit_timestamps(_disordered(spark, d), td.bounded(spark, d))


@query(
    "a2_step_rates",
    f"""WITH {STEPS} SELECT {KEY}, round(min(dt), 6) AS min_dt, round(max(dt), 6) AS max_dt, round(quantile_cont(1 / dt, 0.05), 6) AS measured_p05_rate_hz,
    round(quantile_cont(1 / dt, 0.5), 6) AS measured_median_rate_hz, round(quantile_cont(1 / dt, 0.95), 6) AS measured_p95_rate_hz FROM steps WHERE dt > 0 GROUP BY ALL""",
)
def a2(spark, d):
    return timestamps.step_rate_stats(streams(spark, d), td.bounded(spark, d))


@query(
    "a3_rate_check",
    f"""WITH {STEPS} SELECT {KEY}, round(max(dt) {_POS}, 6) AS max_dt, coalesce(bool_and(dt > 0), false) AS strictly_monotonic, round(quantile_cont(dt, 0.5) {_POS}, 6) AS median_dt,
    round(1 / quantile_cont(dt, 0.5) {_POS}, 6) AS median_hz, round(abs(1 / quantile_cont(dt, 0.5) {_POS} - 100), 6) AS max_abs_dev FROM steps GROUP BY ALL""".replace(
        f"1 / quantile_cont(dt, 0.5) {_POS}", f"1 / (quantile_cont(dt, 0.5) {_POS})"
    ),
)
def a3(spark, d):
    return timestamps.rate_check(streams(spark, d), bounded=td.bounded(spark, d))


@query(
    "p18_frequency_triple",
    f"""WITH {STEPS} SELECT {KEY}, round(1 / (quantile_cont(dt, 0.5) {_POS}), 6) AS median_hz, round(1 / (quantile_cont(dt, 0.95) {_POS}), 6) AS p05_hz,
    round(1 / (quantile_cont(dt, 0.05) {_POS}), 6) AS p95_hz FROM steps GROUP BY ALL""",
)
def p18(spark, d):
    audit = timestamps.audit_timestamps(streams(spark, d), td.bounded(spark, d))
    return timestamps.frequency_triple(audit).select(*RECORDING, "median_hz", "p05_hz", "p95_hz")


@query(
    "p2_relative_seconds",
    f"WITH {STREAMS} SELECT {KEY}, idx, round((ts_us * 1000 - first_value(ts_us * 1000) OVER (PARTITION BY dataset, recording_id ORDER BY idx)) / 1e9, 6) AS rel_s FROM streams",
)
def p2(spark, d):
    return timestamps.relative_seconds(streams(spark, d)).select(*RECORDING, "idx", "rel_s")


def _units_sql(clock: str) -> str:
    return f"""WITH {STREAMS}, c AS (SELECT dataset, recording_id, idx, {clock} AS clock FROM streams),
    s AS (SELECT *, abs(clock - lag(clock) OVER (PARTITION BY dataset, recording_id ORDER BY idx)) AS step,
                 clock - lag(clock) OVER (PARTITION BY dataset, recording_id ORDER BY clock, idx) AS sorted_step FROM c),
    m AS (SELECT dataset, recording_id, count(*) AS n, max(clock) - min(clock) AS span, quantile_cont(CAST(step AS DOUBLE), 0.5) AS step, quantile_cont(CAST(sorted_step AS DOUBLE), 0.5) AS sorted_step FROM s GROUP BY ALL)
    SELECT {KEY}, round(step, 6) AS median_step,
      CASE WHEN step IS NULL OR step <= 0 THEN 'UNRESOLVED' WHEN step > 1e5 THEN 'nanoseconds' WHEN step > 50 THEN 'microseconds' ELSE 'seconds' END AS text_unit,
      CASE WHEN floor(step) > 1000 THEN 'nanoseconds' WHEN step > 50 THEN 'microseconds' ELSE 'seconds' END AS asl_unit,
      CASE WHEN sorted_step <= 0 THEN 'UNRESOLVED' WHEN sorted_step BETWEEN 1e6 AND 1e10 THEN 'nanoseconds_candidate' WHEN sorted_step BETWEEN 1e3 AND 1e6 THEN 'microseconds_candidate'
           WHEN sorted_step BETWEEN 1e-4 AND 1.0 THEN 'seconds_candidate' WHEN span > 1e12 THEN 'nanoseconds_candidate' ELSE 'UNRESOLVED' END AS sorted_label
    FROM m"""


@query("p3_p4_clock_units_us", _units_sql("ts_us"))
def p3_us(spark, d):
    s = streams(spark, d).withColumn("clock", F.expr("ts_ns div 1000"))
    return timestamps.clock_units(s, "clock", bounded=td.bounded(spark, d))


@query("p3_p4_clock_units_index", _units_sql("idx / 100.0"))
def p3_s(spark, d):
    s = streams(spark, d).withColumn("clock", F.col("idx") / F.lit(100.0))
    return timestamps.clock_units(s, "clock", bounded=td.bounded(spark, d))


# Two streams per recording: clicks against errors.
_OVERLAP = f"""WITH {STREAMS}, a AS (SELECT dataset, recording_id, min(ts_s) AS a0, max(ts_s) AS a1 FROM streams WHERE event_type = 'click' GROUP BY ALL),
    b AS (SELECT dataset, recording_id, min(ts_s) AS b0, max(ts_s) AS b1 FROM streams WHERE event_type = 'error' AND q_f > 60 GROUP BY ALL)
    SELECT {KEY}, round(a0, 6) AS a_first, round(a1, 6) AS a_last, round(b0, 6) AS b_first, round(b1, 6) AS b_last,
      CASE WHEN least(a1, b1) > greatest(a0, b0) THEN round(greatest(a0, b0), 6) END AS overlap_start,
      CASE WHEN least(a1, b1) > greatest(a0, b0) THEN round(least(a1, b1), 6) END AS overlap_end,
      CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN round(greatest(least(a1, b1) - greatest(a0, b0), 0.0), 6) END AS overlap_s,
      CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN round(greatest(least(a1, b1) - greatest(a0, b0), 0.0) / (greatest(a1, b1) - least(a0, b0)), 6) END AS overlap_fraction
    FROM a FULL JOIN b USING (dataset, recording_id)"""


@query("j7_stream_overlap", _OVERLAP)
def j7(spark, d):
    rows = td.event_rows(spark, d).select(*RECORDING, "event_type", "q_f", (F.col("ts_us") / F.lit(1e6)).alias("ts_s"), F.col("ts_us").alias("idx"))
    return timestamps.stream_overlap(rows.filter("event_type = 'click'"), rows.filter("event_type = 'error' and q_f > 60"))


# --- channels ---------------------------------------------------------------------

_SAMPLES = """samples AS (SELECT 'E' AS dataset, 'e' || CAST(label AS VARCHAR) AS recording_id, vec_id AS idx,
  """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(("fx", "fy", "fz", "wx", "wy", "wz"))) + " FROM embeddings)"


@query("p1_magnitudes", f"WITH {_SAMPLES} SELECT idx, round(sqrt(fx*fx + fy*fy + fz*fz), 6) AS q_f, round(sqrt(wx*wx + wy*wy + wz*wz), 6) AS q_w FROM samples")
def p1(spark, d):
    s = td.samples(spark, d)
    return s.select("idx", magnitude(*[F.col(c) for c in ("fx", "fy", "fz")]).alias("q_f"), magnitude(*[F.col(c) for c in ("wx", "wy", "wz")]).alias("q_w"))


@query("p1_vector_magnitude", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))), 6) AS norm FROM embeddings")
def p1_vector(spark, d):
    return td.table(spark, d, "embeddings").select("vec_id", vector_magnitude(F.col("embedding")).alias("norm"))


@query(
    "p1_lineitem_magnitude",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) AS q FROM lineitem",
)
def p1_lineitem(spark, d):
    v = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    return td.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", magnitude(*v).alias("q"))


_LONG = f"WITH {STREAMS}, long AS (SELECT {KEY}, idx, 'q_f' AS channel, q_f AS x FROM streams UNION ALL SELECT {KEY}, idx, 'q_w', q_w FROM streams)"
_DESC = "round(min(x), 6) AS min, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(max(x), 6) AS max, round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.99), 6) AS p99"


@query("a4_channel_description", f"{_LONG} SELECT {KEY}, channel, {_DESC}, count(x) / count(*) AS finite_fraction, stddev_pop(x) < 1e-9 AS near_constant FROM long GROUP BY ALL")
def a4(spark, d):
    return channels.describe_channels(streams(spark, d), ["q_f", "q_w"], td.bounded(spark, d))


@query(
    "a5_channel_inventory",
    f"""{_LONG}, f AS (SELECT *, first_value(x) OVER (PARTITION BY dataset, recording_id, channel ORDER BY idx) AS x0 FROM long)
    SELECT {KEY}, channel, count(*) AS sample_count, count(*) - count(x) AS missing_count, count(*) - count(x) AS nonfinite_count, {_DESC},
    round(avg(CASE WHEN x = x0 THEN 1.0 ELSE 0.0 END), 6) AS constant_fraction FROM f GROUP BY ALL""",
)
def a5(spark, d):
    return channels.channel_inventory(streams(spark, d), ["q_f", "q_w"], td.bounded(spark, d))


@query(
    "a6_imu_integrity",
    f"""WITH {_SAMPLES} SELECT {KEY}, count(*) AS n_samples, CAST(0 AS BIGINT) AS accel_nan, CAST(0 AS BIGINT) AS accel_inf, CAST(0 AS BIGINT) AS gyro_nan, CAST(0 AS BIGINT) AS gyro_inf,
    count(*) > 1 AND min(fx) = max(fx) AND min(fy) = max(fy) AND min(fz) = max(fz) AS accel_constant, count(*) > 1 AND min(wx) = max(wx) AND min(wy) = max(wy) AND min(wz) = max(wz) AS gyro_constant,
    1.0::DOUBLE AS finite_fraction_required FROM samples GROUP BY ALL""",
)
def a6(spark, d):
    return channels.imu_integrity(td.samples(spark, d))


# NaN and infinities derived from the data: log and inverse of centred values.
_BAD = f"""WITH {_SAMPLES}, bad AS (SELECT {KEY}, idx, CASE WHEN fx < 0 THEN 'NaN'::DOUBLE ELSE fx END AS fx, CASE WHEN fy > 0.1 THEN 'inf'::DOUBLE ELSE fy END AS fy, 1.0 AS fz,
    CASE WHEN wx < -0.1 THEN '-inf'::DOUBLE ELSE wx END AS wx, CASE WHEN wy > 0 THEN NULL ELSE wy END AS wy, wz FROM samples)"""


@query(
    "a6_imu_integrity_defects",
    f"""{_BAD} SELECT {KEY}, count(*) AS n_samples, count(*) FILTER (WHERE isnan(fx)) AS accel_nan, count(*) FILTER (WHERE isinf(fy)) AS accel_inf, count(*) FILTER (WHERE wy IS NULL) AS gyro_nan,
    count(*) FILTER (WHERE isinf(wx)) AS gyro_inf, false AS accel_constant, false AS gyro_constant,
    round((6 * count(*) - count(*) FILTER (WHERE isnan(fx)) - count(*) FILTER (WHERE isinf(fy)) - count(*) FILTER (WHERE wy IS NULL) - count(*) FILTER (WHERE isinf(wx))) / (6.0 * count(*)), 6) AS finite_fraction_required
    FROM bad GROUP BY ALL""",
)
def a6_defects(spark, d):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    s = td.samples(spark, d)
    bad = s.withColumns({
        "fx": F.when(F.col("fx") < 0, nan).otherwise(F.col("fx")),
        "fy": F.when(F.col("fy") > 0.1, inf).otherwise(F.col("fy")),
        "fz": F.lit(1.0),
        "wx": F.when(F.col("wx") < -0.1, -inf).otherwise(F.col("wx")),
        "wy": F.when(~(F.col("wy") > 0), F.col("wy")),
    })
    return channels.imu_integrity(bad)


@query(
    "p10_finite_fraction",
    f"{_BAD} SELECT {KEY}, round(avg(CASE WHEN isnan(fx) THEN 0.0 ELSE 1.0 END), 6) AS fx_finite, round(avg(CASE WHEN isinf(fy) THEN 0.0 ELSE 1.0 END), 6) AS fy_finite FROM bad GROUP BY ALL",
)
def p10(spark, d):
    s = td.samples(spark, d).withColumns({
        "fx": F.when(F.col("fx") < 0, F.lit(float("nan"))).otherwise(F.col("fx")),
        "fy": F.when(F.col("fy") > 0.1, F.lit(float("inf"))).otherwise(F.col("fy")),
    })
    return s.groupBy(*RECORDING).agg(*[F.avg(is_finite(F.col(c)).cast("double")).alias(f"{c}_finite") for c in ("fx", "fy")])


_SPEC7 = WindowSpec(lookback=600, horizon=100, stride=2)
_HZ = 1 / 3600.0
_A7 = f"""WITH {STEPS}, a AS (
    SELECT {KEY}, count(*) AS n_rows, arg_max(ts_s, idx) - arg_min(ts_s, idx) AS duration_s, max(dt) {_POS} AS max_dt, 1 / (quantile_cont(dt, 0.5) {_POS}) AS hz,
      coalesce(bool_and(dt > 0), false) AS mono, stddev_pop(q_f) AS sf, stddev_pop(q_w) AS sw FROM steps GROUP BY ALL),
    v AS (SELECT *, n_rows >= 700 AND duration_s >= 699 / {_HZ!r} AS enough, abs(hz - {_HZ!r}) <= 2 AS near FROM a),
    integrity AS (SELECT {KEY}, n_rows, round(duration_s, 6) AS duration_s, round(hz, 6) AS effective_rate_hz, round(max_dt, 6) AS max_dt, 'YES' AS all_finite,
      CASE WHEN mono THEN 'YES' ELSE 'NO' END AS strictly_monotonic, CASE WHEN near THEN 'YES' ELSE 'NO' END AS near_nominal_rate, CASE WHEN enough THEN 'YES' ELSE 'NO' END AS enough_rows,
      CASE WHEN sf > 0 THEN 'YES' ELSE 'NO' END AS nonzero_qf_var, CASE WHEN sw > 0 THEN 'YES' ELSE 'NO' END AS nonzero_qw_var,
      CASE WHEN mono AND near AND enough THEN 'PASS' ELSE 'FAIL' END AS status FROM v)"""


def _integrity(spark, d):
    return channels.processed_integrity(streams(spark, d), _SPEC7, _HZ, td.bounded(spark, d))


@query("a7_processed_integrity", f"{_A7} SELECT * FROM integrity")
def a7(spark, d):
    return _integrity(spark, d)


@query(
    "a7_integrity_findings",
    f"""{_A7} SELECT {KEY}, 'TIMESTAMP_GAP' AS check_id, 'MAJOR' AS severity, 'integrity' AS category, 'FAIL' AS status FROM integrity WHERE max_dt > 36000
    UNION ALL SELECT {KEY}, 'PROCESSED_INTEGRITY', 'CRITICAL', 'integrity', 'FAIL' FROM integrity WHERE status = 'FAIL'""",
)
def a7_findings(spark, d):
    return channels.integrity_findings(_integrity(spark, d), 36000.0)


@query(
    "a29_gravity_dominance",
    f"""WITH {STREAMS} SELECT {KEY}, count(*) AS n_samples, round(avg(q_f), 6) AS mean_qf, round(stddev_samp(q_f), 6) AS sd_qf,
    {', '.join(f"round(avg(CASE WHEN abs(q_f - 9.81) <= {w} THEN 1.0 ELSE 0.0 END), 6) AS frac_within_{n}" for w, n in ((0.5, '0p5'), (1.0, '1p0'), (2.0, '2p0')))},
    {', '.join(f'round(quantile_cont(q_f, {p}), 6) AS {n}' for n, p in (('median_qf', 0.5), ('p01', 0.01), ('p05', 0.05), ('p95', 0.95), ('p99', 0.99)))},
    round(quantile_cont(q_f, 0.75) - quantile_cont(q_f, 0.25), 6) AS iqr_qf FROM streams GROUP BY ALL""",
)
def a29(spark, d):
    return channels.gravity_dominance(streams(spark, d), td.bounded(spark, d))


_SHIFT_NAMES = ["mean", "sd", "p01", "p05", "median", "p95", "p99", "iqr"]
_SHIFT = f"""WITH {STREAMS}, q AS (SELECT dataset, 'q_f' AS quantity, q_f AS x FROM streams UNION ALL SELECT dataset, 'q_w', q_w FROM streams),
    st AS (SELECT dataset, quantity, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS median,
           quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM q GROUP BY ALL),
    v AS (SELECT quantity, x, count(*) FILTER (WHERE dataset = 'A') AS a, count(*) FILTER (WHERE dataset = 'B') AS b FROM q GROUP BY ALL),
    c AS (SELECT quantity, x, sum(a) OVER w / sum(a) OVER (PARTITION BY quantity) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY quantity) AS fb, lead(x) OVER w - x AS dx
          FROM v WINDOW w AS (PARTITION BY quantity ORDER BY x)),
    w1 AS (SELECT quantity, sum(abs(fa - fb) * dx) AS wasserstein FROM c GROUP BY ALL)"""


@query(
    "a30_domain_shift",
    f"""{_SHIFT} SELECT a.quantity, {', '.join(f'round({s}.{n}, 6) AS {s}_{n}' for s in 'ab' for n in _SHIFT_NAMES)}, round(wasserstein, 6) AS wasserstein
    FROM st a JOIN st b ON a.quantity = b.quantity AND a.dataset = 'A' AND b.dataset = 'B' JOIN w1 ON w1.quantity = a.quantity""",
)
def a30(spark, d):
    return transfer.domain_shift(streams(spark, d), "A", "B", td.bounded(spark, d))


# --- forecast errors ----------------------------------------------------------------


@query(
    "a8_a10_recording_results",
    f"WITH {LOCAL_RESULTS} SELECT evaluation_context, model, {KEY}, {i64('n_origins', 'ord')}, {r6(*RESULT_NUMBERS)}, round(skill, 6) AS skill FROM results",
)
def a10(spark, d):
    return local_results(spark, d)


@query(
    "a9_horizon_rows",
    f"""WITH {CELLS} SELECT model, {KEY}, CAST(h AS BIGINT) AS horizon_index, CAST(10 * h AS BIGINT) AS horizon_ms, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse
    FROM local_cells GROUP BY model, dataset, recording_id, h""",
)
def a9(spark, d):
    scored = recording_results(local_predictions(spark, d), td.SPEC, BASE)
    return horizon_rows(scored, td.SPEC, ["model"])


@query(
    "a11_equal_recording_mean",
    f"""WITH {CELLS}, p AS ({results_sql('local_cells', 'model, dataset, recording_id')})
    SELECT dataset, model, count(*) AS n_recordings, round(avg(rmse_all_horizons), 6) AS mean_rmse_all_horizons, round(avg(mae_all_horizons), 6) AS mean_mae_all_horizons FROM p GROUP BY ALL""",
)
def a11(spark, d):
    scored = recording_results(local_predictions(spark, d), td.SPEC, BASE)
    return equal_recording_mean(scored, ["dataset", "model"])


@query(
    "a12_high_target_rmse",
    f"""WITH {CELLS}, t AS (SELECT dataset, recording_id, quantile_cont(q_f, 0.95) AS p95 FROM streams GROUP BY ALL)
    SELECT model, {KEY}, round(p95, 6) AS p95_threshold, count(*) FILTER (WHERE y > p95) AS n_high_cells, round(sqrt(avg((yhat - y) * (yhat - y)) FILTER (WHERE y > p95)), 6) AS rmse_high_p95_targets
    FROM local_cells JOIN t USING (dataset, recording_id) GROUP BY ALL""",
)
def a12(spark, d):
    t = high_thresholds(streams(spark, d), bounded=td.bounded(spark, d))
    return high_target_results(local_predictions(spark, d), t)


# Seeds: three lines of different length stand for three trained versions of one model.
_SEEDS = ORIGINS + """,
seed_cells AS (
  SELECT dataset, recording_id, origin, h, future_qf[h] AS y, k AS seed,
         list_avg(hist_qf[11 - k:10]) AS yhat
  FROM windows CROSS JOIN generate_series(1, 4) AS g(h) CROSS JOIN (VALUES (2), (4), (8)) AS v(k)),
seed_results AS (""" + results_sql("seed_cells", "seed, dataset, recording_id") + ")"


def _seed_results(spark, d):
    w = windows(spark, d)
    means = F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("seed"), F.array_repeat(F.aggregate(F.slice("hist_qf", 11 - k, k), F.lit(0.0), lambda a, v: a + v) / k, 4).alias("yhat"))
        for k in (2, 4, 8)
    ])
    rows = w.select(*RECORDING, F.col("future_qf").alias("y"), F.inline(means)).withColumn("model", F.lit("TAIL_MEAN"))
    return recording_results(rows, td.SPEC, BASE, ["model", "seed"])


@query(
    "a22_seed_average",
    f"""WITH {_SEEDS} SELECT 'TAIL_MEAN' AS model, {KEY}, CAST(max(n_origins) AS BIGINT) AS n_origins, count(DISTINCT seed) AS n_seeds,
    {', '.join(f'round(avg({c}), 6) AS {c}' for c in RESULT_NUMBERS)} FROM seed_results GROUP BY ALL""",
)
def a22(spark, d):
    return seed_average(_seed_results(spark, d), td.SPEC, BASE, ["model"])


@query(
    "a23_seed_variability",
    f"""WITH {_SEEDS}, m AS (SELECT dataset, seed, avg(rmse_all_horizons) AS m FROM seed_results GROUP BY ALL)
    SELECT dataset, 'TAIL_MEAN' AS model, count(*) AS n_seeds, round(avg(m), 6) AS mean_across_seeds, round(stddev_samp(m), 6) AS sd_across_seeds, round(min(m), 6) AS min_seed,
    round(max(m), 6) AS max_seed, round(max(m) - min(m), 6) AS range FROM m GROUP BY ALL""",
)
def a23(spark, d):
    return seed_variability(_seed_results(spark, d), ["dataset", "model"])


@query(
    "a36_normalised_mse_all",
    f"""WITH {CELLS}, p AS (SELECT dataset, recording_id, avg((yhat - y) / 25.0 * ((yhat - y) / 25.0)) AS mse, count(*) // 4 AS nw FROM local_cells WHERE model = 'B0_PERSISTENCE' GROUP BY ALL)
    SELECT 'B0_PERSISTENCE' AS model, dataset, round(avg(mse), 6) AS norm_mse, CAST(sum(nw) AS BIGINT) AS n_windows FROM p GROUP BY ALL""",
)
def a36_all(spark, d):
    """Every window, without thinning."""
    return normalised_mse(local_predictions(spark, d).filter(F.col("model") == PERSISTENCE), F.lit(25.0), ["model", "dataset"])


@query(
    "a36_normalised_mse",
    f"""WITH {CELLS}, w AS (SELECT *, row_number() OVER (PARTITION BY dataset, recording_id, h ORDER BY origin) - 1 AS r, count(*) OVER (PARTITION BY dataset, recording_id, h) AS n
      FROM local_cells WHERE model = 'B0_PERSISTENCE'),
    keep AS (SELECT * FROM w WHERE n <= 96 OR list_contains(list_transform(range(96), lambda j: CAST(floor(j * ((n - 1) / 95.0)) AS BIGINT)), r)),
    p AS (SELECT dataset, recording_id, avg((yhat - y) / 25.0 * ((yhat - y) / 25.0)) AS mse, count(*) // 4 AS nw FROM keep GROUP BY ALL)
    SELECT 'B0_PERSISTENCE' AS model, dataset, round(avg(mse), 6) AS norm_mse, CAST(sum(nw) AS BIGINT) AS n_windows FROM p GROUP BY ALL""",
)
def a36(spark, d):
    from sensorloom.operators.forecasts import predict

    thin = thin_evenly(windows(spark, d), 96, td.bounded(spark, d))
    return normalised_mse(predict(thin, td.SPEC, BASE, (PERSISTENCE,)), F.lit(25.0), ["model", "dataset"])
