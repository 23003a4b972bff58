"""Ordered queries: steps, origins, windows, local forecasts, filters (W, P8-P14)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.functions.arrays import channel_last, features, lag_slice
from sensorloom.operators import filtering
from sensorloom.operators.channels import autocorrelation, predictability, extreme_values, rest_norm
from sensorloom.operators.forecasts import LINEAR, PERSISTENCE, predict
from sensorloom.operators.metrics import recording_results
from sensorloom.operators.timestamps import native_steps, stream_spans
from sensorloom.operators.windows import build_windows, classify_origins, high_thresholds, window_counts
from sensorloom.plans.base import BASE, CELLS, KEY, ORACLES, ORIGINS, STEPS, STREAMS, i64, query, r6, streams, windows
from sensorloom.session import shared_folder
from sensorloom.sources import testdata as td
from sensorloom.sources.tables import write_blocks


@query("w1_native_steps", f"WITH {STEPS} SELECT {KEY}, idx, round(dt, 6) AS dt, CAST(dt < 0 AS BIGINT) AS backward, CAST(dt = 0 AS BIGINT) AS duplicate FROM steps")
def w1(spark, d):
    s = native_steps(streams(spark, d))
    return s.select(*RECORDING, "idx", "dt", (F.col("dt") < 0).cast("bigint").alias("backward"), (F.col("dt") == 0).cast("bigint").alias("duplicate"))


@query("w2_classified_origins", f"WITH {ORIGINS} SELECT {KEY}, origin, status FROM origins")
def w2(spark, d):
    return classify_origins(streams(spark, d), td.SPEC, td.bounded(spark, d))


_COUNTS = ["candidate_origins", "valid_origins", "excluded_due_to_start", "excluded_due_to_end", "excluded_due_to_gap", "excluded_other"]


@query(
    "w2_window_counts",
    f"""WITH {ORIGINS} SELECT {KEY}, CAST(max(n) AS BIGINT) AS processed_samples, count(*) AS candidate_origins,
    {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {c}" for s, c in zip(('valid', 'start', 'end', 'gap', 'other'), _COUNTS[1:]))},
    CAST(10 AS BIGINT) AS lookback_samples, CAST(4 AS BIGINT) AS horizon_samples, CAST(2 AS BIGINT) AS stride_samples
    FROM origins GROUP BY ALL""",
)
def w2_counts(spark, d):
    return window_counts(streams(spark, d), td.SPEC, td.bounded(spark, d))


@query(
    "w3_windows",
    f"""WITH {ORIGINS} SELECT {KEY}, dependency_group, origin, list_aggregate(hist_qf, 'string_agg', ',') AS hist_qf,
    list_aggregate(hist_qw, 'string_agg', ',') AS hist_qw, list_aggregate(future_qf, 'string_agg', ',') AS future_qf FROM windows""",
)
def w3(spark, d):
    return _window_text(windows(spark, d))


def _window_text(w):
    return w.withColumns({c: F.array_join(c, ",") for c in ("hist_qf", "hist_qw", "future_qf")})


@query("w4_high_thresholds", f"WITH {STREAMS} SELECT {KEY}, round(quantile_cont(q_f, 0.95), 6) AS p95_qf FROM streams GROUP BY ALL")
def w4(spark, d):
    return high_thresholds(streams(spark, d), bounded=td.bounded(spark, d))


@query("w5_persistence_forecast", f"WITH {CELLS} SELECT {KEY}, origin, h, round(yhat, 6) AS yhat, round(y, 6) AS y FROM local_cells WHERE model = 'B0_PERSISTENCE'")
def w5(spark, d):
    return _long(predict(windows(spark, d), td.SPEC, BASE, (PERSISTENCE,)))


@query("w6_linear_forecast", f"WITH {CELLS} SELECT {KEY}, origin, h, round(yhat, 6) AS yhat, round(y, 6) AS y FROM local_cells WHERE model = 'B1_LINEAR'")
def w6(spark, d):
    return _long(predict(windows(spark, d), td.SPEC, BASE, (LINEAR,)))


def _long(predictions):
    cells = predictions.select(*RECORDING, "origin", F.posexplode(F.arrays_zip("yhat", "y")).alias("h", "c"))
    return cells.select(*RECORDING, "origin", (F.col("h") + 1).cast("bigint").alias("h"), "c.yhat", "c.y")


# Sequential twin of the cascade: one recursion step per row, all recordings at once.
def _filter_sql(sos, tail: str) -> str:
    step, prev_in = [], "s.q_f"
    for k, (b0, b1, b2, _a0, a1, a2) in enumerate(sos):
        y = f"({b0!r} * {prev_in} + f.u{k})"
        step += [f"{b1!r} * {prev_in} - ({a1!r}) * {y} + f.v{k} AS u{k}", f"{b2!r} * {prev_in} - ({a2!r}) * {y} AS v{k}"]
        prev_in = y
    first, prev_in = [], "q_f"
    for k, (b0, b1, b2, _a0, a1, a2) in enumerate(sos):
        y = f"({b0!r} * {prev_in})"
        first += [f"{b1!r} * {prev_in} - ({a1!r}) * {y} AS u{k}", f"{b2!r} * {prev_in} - ({a2!r}) * {y} AS v{k}"]
        prev_in = y
    out = "s.q_f"
    for k, (b0, *_rest) in enumerate(sos):
        out = f"({b0!r} * {out} + f.u{k})"
    start = "q_f"
    for b0, *_rest in sos:
        start = f"({b0!r} * {start})"
    states = ", ".join(f"u{k}, v{k}" for k in range(len(sos)))
    body = STREAMS.strip()
    return f"""WITH RECURSIVE {body},
filtered AS (
  SELECT dataset, recording_id, idx, ts_s, {start} AS y, {states} FROM (SELECT *, {', '.join(first)} FROM streams WHERE idx = 0)
  UNION ALL
  SELECT s.dataset, s.recording_id, s.idx, s.ts_s, {out} AS y, {', '.join(step)}
  FROM filtered f JOIN streams s ON s.dataset = f.dataset AND s.recording_id = f.recording_id AND s.idx = f.idx + 1)
{tail}"""


@query("w7_causal_filter", _filter_sql(filtering.SOS_200_HZ, f"SELECT {KEY}, idx, round(y, 6) AS q_f FROM filtered"))
def w7(spark, d):
    out = filtering.causal_filter(streams(spark, d).select(*RECORDING, "idx", "ts_s", "q_f"), filtering.SOS_200_HZ, ["q_f"])
    return out.select(*RECORDING, "idx", "q_f")


# The same operators over the stored block layout: their big input is not shuffled again.


def _stored(spark, d):
    path = f"{shared_folder(spark)}/sensorloom-blocks-{uuid.uuid4().hex}"
    halo = max(td.SPEC.lookback, filtering.memory_rows(filtering.SOS_200_HZ))
    return write_blocks(streams(spark, d), f"stream_blocks_{uuid.uuid4().hex}", halo, td.SPEC.horizon, path=path)


@query("s4_blocks_steps", ORACLES["w1_native_steps"])
def w1_stored(spark, d):
    s = native_steps(_stored(spark, d))
    return s.select(*RECORDING, "idx", "dt", (F.col("dt") < 0).cast("bigint").alias("backward"), (F.col("dt") == 0).cast("bigint").alias("duplicate"))


@query("s4_blocks_window_counts", ORACLES["w2_window_counts"])
def w2_stored(spark, d):
    return window_counts(_stored(spark, d), td.SPEC, td.bounded(spark, d))


@query("s4_blocks_windows", ORACLES["w3_windows"])
def w3_stored(spark, d):
    return _window_text(build_windows(_stored(spark, d), td.SPEC, td.bounded(spark, d)))


@query("s4_blocks_filter", ORACLES["w7_causal_filter"])
def w7_stored(spark, d):
    stored = _stored(spark, d).select(*RECORDING, "idx", "ts_s", "q_f", "block", "own")
    return filtering.causal_filter(stored, filtering.SOS_200_HZ, ["q_f"]).select(*RECORDING, "idx", "q_f")


_HOUR = 3600.0


@query(
    "w8_processed_streams",
    _filter_sql(
        filtering.SOS_200_HZ,
        f"""SELECT {KEY}, row_number() OVER (PARTITION BY dataset, recording_id ORDER BY idx) - 1 AS idx, idx AS native_index, round(y, 6) AS q_f
        FROM (SELECT *, first_value(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS t0 FROM filtered)
        WHERE idx % 2 = 0 AND ts_s - t0 >= {_HOUR}""",
    ),
)
def w8(spark, d):
    out = filtering.process_streams(streams(spark, d).drop("native_index"), filtering.SOS_200_HZ, 2, _HOUR, td.bounded(spark, d))
    return out.select(*RECORDING, "idx", "native_index", "q_f")


@query(
    "w8_stage_counts",
    f"""WITH {STREAMS} SELECT {KEY}, count(*) AS n_native, count(*) FILTER (WHERE idx % 2 = 0) AS n_decimated,
    count(*) FILTER (WHERE idx % 2 = 0 AND ts_s - t0 >= {_HOUR}) AS n_processed
    FROM (SELECT *, first_value(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS t0 FROM streams) GROUP BY ALL""",
)
def w8_counts(spark, d):
    s = streams(spark, d).drop("native_index")
    starts = s.groupBy(*RECORDING).agg(F.min_by("ts_s", "idx").alias("t0"))
    kept = filtering.drop_warmup(filtering.decimate(s, 2), starts, _HOUR, td.bounded(spark, d))
    return filtering.stage_counts(s, kept, 2)


@query("p8_decimated", f"WITH {STREAMS} SELECT {KEY}, CAST(idx // 5 AS BIGINT) AS idx, idx AS native_index, {r6('q_f', 'q_w')} FROM streams WHERE idx % 5 = 0")
def p8(spark, d):
    return filtering.decimate(streams(spark, d), 5).select(*RECORDING, "idx", "native_index", "q_f", "q_w")


@query(
    "p11_p12_features",
    f"""WITH {ORIGINS} SELECT {KEY}, origin, list_aggregate(hist_qf[8:10], 'string_agg', ',') AS lagged,
    list_aggregate(list_concat(hist_qf[8:10], hist_qw[8:10]), 'string_agg', ',') AS features,
    list_aggregate([hist_qf[9], hist_qw[9], hist_qf[10], hist_qw[10]], 'string_agg', ',') AS channel_last FROM windows""",
)
def p12(spark, d):
    w = windows(spark, d)
    pairs = F.flatten(F.transform(channel_last(2, 10), lambda p: F.array(p["q_f"], p["q_w"])))
    return w.select(
        *RECORDING, "origin",
        F.array_join(lag_slice(F.col("hist_qf"), 3, 10), ",").alias("lagged"),
        F.array_join(features(3, 10), ",").alias("features"),
        F.array_join(pairs, ",").alias("channel_last"),
    )


@query(
    "p14_high_target_cells",
    f"""WITH {ORIGINS}, t AS (SELECT dataset, recording_id, quantile_cont(q_f, 0.95) AS p95 FROM streams GROUP BY ALL)
    SELECT {KEY}, CAST(sum(len(list_filter(future_qf, lambda y: y > p95))) AS BIGINT) AS n_high, CAST(4 * count(*) AS BIGINT) AS n_cells
    FROM windows JOIN t USING (dataset, recording_id) GROUP BY ALL""",
)
def p14(spark, d):
    w = windows(spark, d).join(high_thresholds(streams(spark, d), bounded=td.bounded(spark, d)), list(RECORDING))
    high = F.size(F.filter("future_qf", lambda y: y > F.col("p95_qf"))).cast("bigint")
    return w.groupBy(*RECORDING).agg(F.sum(high).alias("n_high"), F.sum(F.size("future_qf").cast("bigint")).alias("n_cells"))


_ACF = "sum(c * lead_{k}) / sum(c * c) AS acf_{k}"


@query(
    "w12_autocorrelation",
    f"""WITH {STREAMS}, c AS (SELECT dataset, recording_id, idx, q_f - avg(q_f) OVER (PARTITION BY dataset, recording_id) AS c FROM streams),
    l AS (SELECT *, {', '.join(f'lead(c, {k}) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS lead_{k}' for k in (1, 5, 10, 20))} FROM c)
    SELECT {KEY}, {', '.join(f'round(sum(c * lead_{k}) / sum(c * c), 6) AS acf_{k}' for k in (1, 5, 10, 20))} FROM l GROUP BY ALL""",
)
def w12(spark, d):
    return autocorrelation(streams(spark, d), (1, 5, 10, 20))


_EXTREME = f"""WITH {STEPS}, peak AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, recording_id ORDER BY q_f DESC, idx) AS rn FROM steps) WHERE rn = 1),
around AS (
  SELECT p.dataset, p.recording_id, quantile_cont(s.q_f, 0.5) AS neighbour_median FROM peak p JOIN streams s
  ON s.dataset = p.dataset AND s.recording_id = p.recording_id AND abs(s.idx - p.idx) <= 5 AND s.idx <> p.idx GROUP BY ALL),
agg AS (
  SELECT s.dataset, s.recording_id, min(s.q_f) AS q_f_min, quantile_cont(s.q_f, 0.001) AS q_f_p001, quantile_cont(s.q_f, 0.01) AS q_f_p01,
         quantile_cont(s.q_f, 0.99) AS q_f_p99, quantile_cont(s.q_f, 0.999) AS q_f_p999, quantile_cont(s.dt, 0.5) AS step,
         count(*) FILTER (WHERE s.q_f > 30) AS a30, count(*) FILTER (WHERE s.q_f > 50) AS a50, count(*) FILTER (WHERE s.q_f > 100) AS a100,
         count(*) FILTER (WHERE abs(s.q_f - p.q_f) <= 1e-9) AS n_samples_at_max
  FROM steps s JOIN peak p USING (dataset, recording_id) GROUP BY ALL),
j AS (
  SELECT g.*, p.q_f AS q_f_max, p.ts_s AS timestamp_of_max, p.q_w AS q_w_at_qf_max, p.q_f / neighbour_median AS ratio, a30 * step AS d30, a50 * step AS d50, a100 * step AS d100
  FROM agg g JOIN peak p USING (dataset, recording_id) JOIN around USING (dataset, recording_id)),
k AS (SELECT *, CASE WHEN ratio < 3 THEN 'YES' WHEN ratio < 8 THEN 'PARTIAL' ELSE 'NO' END AS cons FROM j)
SELECT {KEY}, {r6('q_f_min', 'q_f_p001', 'q_f_p01', 'q_f_p99', 'q_f_p999', 'q_f_max', 'timestamp_of_max', 'q_w_at_qf_max')},
  round(d30, 6) AS duration_above_30, round(d50, 6) AS duration_above_50, round(d100, 6) AS duration_above_100,
  cons AS neighbors_consistent, round(ratio, 6) AS neighbor_median_ratio, n_samples_at_max,
  CASE WHEN q_f_max >= 150 AND n_samples_at_max >= 3 THEN 'YES' ELSE 'NO' END AS possible_saturation,
  CASE WHEN cons = 'NO' AND d100 < 0.05 THEN 'YES' ELSE 'NO' END AS possible_spike,
  round(q_f_max, 6) AS native_q_f_max, 'YES' AS raw_source_consistent, 'KEEP' AS action FROM k"""


@query("a31_extreme_values", _EXTREME)
def a31(spark, d):
    s = streams(spark, d)
    return extreme_values(s, td.event_rows(spark, d), bounded=td.bounded(spark, d))


@query(
    "w9_peak_rows",
    f"""WITH {STREAMS} SELECT {KEY}, idx, {r6('q_f', 'ts_s', 'q_w')} FROM
    (SELECT *, row_number() OVER (PARTITION BY dataset, recording_id ORDER BY q_f DESC, idx) AS rn FROM streams) WHERE rn = 1""",
)
def w9(spark, d):
    peak = F.max(F.struct("q_f", (-F.col("idx")).alias("neg"), "ts_s", "q_w")).alias("p")
    return streams(spark, d).groupBy(*RECORDING).agg(peak).select(*RECORDING, (-F.col("p.neg")).alias("idx"), "p.q_f", "p.ts_s", "p.q_w")


@query(
    "w13_rest_norm",
    """SELECT 'E' AS dataset, 'e' || CAST(label AS VARCHAR) AS recording_id, round(quantile_cont(sqrt(x * x + y * y + z * z), 0.5), 6) AS rest_norm_median
    FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
                 row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 400 GROUP BY label""",
)
def w13(spark, d):
    from sensorloom.operators.ordering import assign_idx

    s = td.samples(spark, d).withColumnRenamed("idx", "vec_id")
    return rest_norm(assign_idx(s, RECORDING, ["vec_id"], td.bounded(spark, d)))


@query("w14_stream_spans", f"WITH {STREAMS} SELECT {KEY}, round(arg_min(ts_s, idx), 6) AS first_s, round(arg_max(ts_s, idx), 6) AS last_s, count(*) AS n FROM streams GROUP BY ALL")
def w14(spark, d):
    return stream_spans(streams(spark, d))


@query(
    "a24_predictability",
    f"""WITH {CELLS}, p AS (SELECT dataset, recording_id, count(*) // 4 AS n_origins, sqrt(avg((yhat - y) * (yhat - y))) AS persistence_rmse
      FROM local_cells WHERE model = 'B0_PERSISTENCE' GROUP BY ALL),
    c AS (SELECT dataset, recording_id, idx, q_f - avg(q_f) OVER (PARTITION BY dataset, recording_id) AS c FROM streams),
    l AS (SELECT *, {', '.join(f'lead(c, {k}) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS lead_{k}' for k in (1, 5, 10, 20))} FROM c),
    a AS (SELECT dataset, recording_id, {', '.join(_ACF.format(k=k) for k in (1, 5, 10, 20))} FROM l GROUP BY ALL),
    s AS (SELECT dataset, recording_id, count(*) AS n_processed, stddev_pop(q_f) AS sd_qf, quantile_cont(q_f, 0.95) AS p95_qf FROM streams GROUP BY ALL)
    SELECT {KEY}, n_processed, {i64('n_origins')}, {r6('sd_qf', 'persistence_rmse', 'p95_qf', 'acf_1', 'acf_5', 'acf_10', 'acf_20')},
    round(persistence_rmse / sd_qf, 6) AS persistence_rmse_over_sd
    FROM s JOIN p USING (dataset, recording_id) JOIN a USING (dataset, recording_id)""",
)
def a24(spark, d):
    b = td.bounded(spark, d)
    s = streams(spark, d)
    w = build_windows(s, td.SPEC, b)
    scored = recording_results(predict(w, td.SPEC, BASE, (PERSISTENCE,)), td.SPEC, BASE)
    return predictability(s, scored, high_thresholds(s, bounded=b), (1, 5, 10, 20))


