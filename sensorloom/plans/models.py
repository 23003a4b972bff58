"""Splits, ridge models, selection and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.operators import linear, sampling, selection, splits, stats
from sensorloom.operators.forecasts import LINEAR, PERSISTENCE, RIDGE_QF_QW, predict, score_with
from sensorloom.operators.metrics import high_target_results, recording_results, with_skill
from sensorloom.operators.rows import union_all
from sensorloom.operators.windows import high_thresholds
from sensorloom.plans.base import (
    BASE, BOOT, CELLS, KEY, LAG1, ORIGINS, PAIRS, RESULT_NUMBERS, full_grid, i64, query, r6, results_sql, streams, windows, written_windows,
)
from sensorloom.session import materialise
from sensorloom.sources import testdata as td

_RECS = """recs AS (
  SELECT CASE WHEN r < 6 THEN 'A' ELSE 'B' END AS dataset, printf('r%02d', r) AS recording_id, 'g' || CAST(r % 3 AS VARCHAR) AS dependency_group, r AS ord,
         row_number() OVER (PARTITION BY r < 6 ORDER BY r) AS number FROM (SELECT DISTINCT user_id % 14 AS r FROM events))"""

# --- folds --------------------------------------------------------------------------


@query(
    "k1_leave_one_recording_out",
    f"""WITH {_RECS} SELECT printf('%s_LORO_%02d_%s', h.dataset, h.number, h.recording_id) AS fold_id, 'WITHIN_' || h.dataset AS evaluation_class, h.dataset AS source_or_domain,
    CASE WHEN t.recording_id = h.recording_id THEN 'test' ELSE 'train' END AS split_role, t.dataset, t.recording_id AS sequence_id, t.dependency_group,
    'leave-one-recording-out; windows of held-out sequence never train' AS notes FROM recs h JOIN recs t USING (dataset)""",
)
def k1(spark, d):
    return splits.leave_one_recording_out(td.recordings(spark, d))


_LGO = f"""{_RECS}, grp AS (SELECT dataset, dependency_group AS held, count(*) AS n FROM recs GROUP BY ALL)"""


@query(
    "k2_leave_group_out",
    f"""WITH {_LGO} SELECT r.dataset || '_LGO_' || held AS fold_id, 'SOURCE_SELECTION' AS evaluation_class, r.dataset AS source_or_domain,
    CASE WHEN dependency_group = held THEN 'source_validation' ELSE 'source_train' END AS split_role, r.dataset, recording_id AS sequence_id, dependency_group,
    'leave-trajectory-group-out source validation' || CASE WHEN n = 1 THEN '; SMALL_GROUP_SINGLE_RECORDING' ELSE '' END AS notes FROM recs r JOIN grp USING (dataset)""",
)
def k2(spark, d):
    return splits.leave_group_out(td.recordings(spark, d))


_TRANSFER = f"""WITH {_RECS}, route AS (SELECT * FROM (VALUES ('A', 'B'), ('B', 'A')) AS v(s, t))
    SELECT 'TRANSFER_' || s || '_TO_' || t AS fold_id, 'ZERO_SHOT_TRANSFER' AS evaluation_class, s AS source_or_domain,
    CASE WHEN dataset = s THEN 'source_train' ELSE 'target_eval' END AS split_role, dataset, recording_id AS sequence_id, dependency_group,
    CASE WHEN dataset = s THEN 'source-only fitting; no ' || t || ' parameters' ELSE 'frozen source system; no target-domain fitting' END AS notes
    FROM recs JOIN route ON dataset = s OR dataset = t"""


@query("k3_transfer_manifests", _TRANSFER)
def k3(spark, d):
    return splits.transfer_manifests(td.recordings(spark, d), PAIRS)


@query("k4_overlapping_roles", "SELECT 'x' AS fold_id, 'x' AS dataset, 'x' AS sequence_id WHERE false")
def k4(spark, d):
    r = td.recordings(spark, d)
    return splits.overlapping_roles(union_all(splits.leave_one_recording_out(r), splits.leave_group_out(r), splits.transfer_manifests(r, PAIRS)))


# Every recording in group g1 also trains in its own test fold.
@query(
    "k4_overlapping_roles_leaky",
    f"WITH {_RECS} SELECT printf('%s_LORO_%02d_%s', dataset, number, recording_id) AS fold_id, dataset, recording_id AS sequence_id FROM recs WHERE dependency_group = 'g1'",
)
def k4_leaky(spark, d):
    folds = splits.leave_one_recording_out(td.recordings(spark, d))
    leak = folds.filter("split_role = 'test' and dependency_group = 'g1'").withColumn("split_role", F.lit("train"))
    return splits.overlapping_roles(folds.unionByName(leak))


# In the fold B to A, recordings of group g1 of the target also train.
@query(
    "k5_transfer_separation",
    f"""WITH {_RECS}, route AS (SELECT * FROM (VALUES ('A', 'B'), ('B', 'A')) AS v(s, t)),
    m AS (SELECT 'TRANSFER_' || s || '_TO_' || t AS fold_id, s, t, dataset, dataset = s OR (s = 'B' AND dependency_group = 'g1') AS trains, dataset = t AS target FROM recs JOIN route ON dataset = s OR dataset = t),
    sides AS (SELECT fold_id, min(s) AS s, string_agg(DISTINCT dataset, ',' ORDER BY dataset) FILTER (WHERE trains) AS train_datasets, string_agg(DISTINCT dataset, ',' ORDER BY dataset) FILTER (WHERE target) AS target_datasets FROM m GROUP BY fold_id)
    SELECT fold_id, train_datasets, target_datasets, CASE WHEN train_datasets = s AND target_datasets <> s AND target_datasets NOT LIKE '%,%' THEN 'PASS' ELSE 'FAIL' END AS status FROM sides""",
)
def k5(spark, d):
    folds = splits.transfer_manifests(td.recordings(spark, d), PAIRS)
    leak = folds.filter("fold_id = 'TRANSFER_B_TO_A' and split_role = 'target_eval' and dependency_group = 'g1'").withColumn("split_role", F.lit("source_train"))
    return splits.transfer_separation(folds.unionByName(leak))


def _fit_log(spark, d) -> DataFrame:
    """Source fits of both datasets; the one for B also used recordings of A."""
    r = td.recordings(spark, d)
    fits = r.groupBy("dataset").agg(F.array_sort(F.collect_set("recording_id")).alias("fit_recordings"))
    own = fits.select(F.concat_ws("_TO_", "dataset", F.when(F.col("dataset") == "A", "B").otherwise("A")).alias("evaluation_context"), F.lit("B3").alias("fit_object"), F.col("dataset").alias("fit_dataset"), "fit_recordings")
    wrong = r.filter("dependency_group = 'g0'").agg(F.array_sort(F.collect_set("recording_id")).alias("fit_recordings")).select(
        F.lit("B_TO_A").alias("evaluation_context"), F.lit("B3_MIXED").alias("fit_object"), F.lit("B").alias("fit_dataset"), "fit_recordings"
    )
    return own.unionByName(wrong)


@query(
    "k6_leak_audit",
    f"""WITH {_RECS} SELECT 'B_TO_A' AS evaluation_context, 'B3_MIXED' AS fit_object, 'B' AS fit_dataset, 'FORBIDDEN_RECORDING' AS leak,
    (SELECT string_agg(recording_id, ',' ORDER BY recording_id) FROM recs WHERE dataset = 'A' AND dependency_group = 'g0') AS recordings""",
)
def k6(spark, d):
    r = td.recordings(spark, d)
    targets = r.groupBy("dataset").agg(F.array_sort(F.collect_set("recording_id")).alias("forbidden_recordings"))
    source = F.when(F.col("dataset") == "A", "B").otherwise("A")
    allowed = targets.select(F.concat_ws("_TO_", source, "dataset").alias("evaluation_context"), source.alias("source_dataset"), "forbidden_recordings")
    return splits.leak_audit(_fit_log(spark, d), allowed)


CONFIGS = (("TCN", "TCN01"), ("TCN", "TCN02"), ("GRU", "GRU01"))
SEEDS = (11, 12, 13)
_GRID = "grid AS (SELECT * FROM (VALUES ('TCN', 'TCN01'), ('TCN', 'TCN02'), ('GRU', 'GRU01')) AS c(architecture, config_id) CROSS JOIN (VALUES (11), (12), (13)) AS s(seed))"


@query(
    "j11_job_grid",
    f"""WITH {_LGO}, {_GRID}, tot AS (SELECT dataset, count(*) AS n_all FROM recs GROUP BY ALL)
    SELECT 'SOURCE_LGO|' || dataset || '_ALL|' || architecture || '|' || config_id || '|seed' || seed || '|valgrp' || held || '|qw1' AS job_id, 'SOURCE_LGO' AS purpose, dataset || '_ALL' AS scope,
    architecture, config_id, CAST(seed AS BIGINT) AS seed, dataset, held AS val_group, n_all - n AS n_train, n AS n_val FROM grp JOIN tot USING (dataset) CROSS JOIN grid""",
)
def j11(spark, d):
    return splits.job_grid(td.recordings(spark, d), CONFIGS, SEEDS)


_NESTED = f"""{_LGO}, {_GRID}, tot AS (SELECT dataset, count(*) AS n_all FROM recs GROUP BY ALL),
    inn AS (SELECT h.dataset, h.recording_id AS held_recording, held AS val_group, n - CASE WHEN h.dependency_group = held THEN 1 ELSE 0 END AS n_val, n_all FROM recs h JOIN grp USING (dataset) JOIN tot USING (dataset))"""


@query(
    "j11_nested_job_grid",
    f"""WITH {_NESTED} SELECT 'NESTED_LORO|' || dataset || '_HOLD_' || held_recording || '|' || architecture || '|' || config_id || '|seed' || seed || '|valgrp' || val_group || '|qw1' AS job_id,
    'NESTED_LORO' AS purpose, dataset || '_HOLD_' || held_recording AS scope, architecture, config_id, CAST(seed AS BIGINT) AS seed, dataset, held_recording, val_group,
    n_all - 1 - n_val AS n_train, n_val FROM inn CROSS JOIN grid WHERE n_val > 0 AND n_all - 1 - n_val > 0""",
)
def j11_nested(spark, d):
    return splits.nested_job_grid(td.recordings(spark, d), CONFIGS, SEEDS)


@query(
    "j10_forbidden_fits",
    f"""WITH {_RECS} SELECT 'job_' || h.recording_id AS job_id, h.recording_id AS scope, h.recording_id AS recording_id FROM recs h WHERE dependency_group = 'g2'""",
)
def j10(spark, d):
    """Jobs that hold a recording out, but those of group g2 trained on everything."""
    r = td.recordings(spark, d)
    everyone = r.groupBy("dataset").agg(F.collect_set("recording_id").alias("all_ids"))
    train = F.when(F.col("dependency_group") == "g2", F.col("all_ids")).otherwise(F.array_remove("all_ids", F.col("recording_id")))
    jobs = r.join(everyone, "dataset").select(F.concat(F.lit("job_"), "recording_id").alias("job_id"), F.col("recording_id").alias("scope"), train.alias("train_ids"))
    return splits.forbidden_fits(jobs, r.select(F.col("recording_id").alias("scope"), "recording_id"))


# --- weights and scalers ---------------------------------------------------------------


@query(
    "a13_window_weights",
    f"""WITH {ORIGINS}, c AS (SELECT dataset, recording_id, count(*) AS n_windows FROM windows GROUP BY ALL), f AS (SELECT dataset, count(*) AS n_rec FROM c GROUP BY ALL)
    SELECT {KEY}, n_windows, n_rec, round(1.0 / (n_windows * n_rec), 6) AS weight, round(1.0 / n_rec, 6) AS weight_sum FROM c JOIN f USING (dataset)""",
)
def a13(spark, d):
    return linear.window_weights(windows(spark, d), ["dataset"])


_SCALER = """c AS (SELECT dataset, recording_id, count(*) AS n FROM windows GROUP BY ALL), nr AS (SELECT dataset, count(*) AS n_rec FROM c GROUP BY ALL),
  w AS (SELECT windows.*, 1.0 / (c.n * nr.n_rec) AS wt FROM windows JOIN c USING (dataset, recording_id) JOIN nr USING (dataset)),
  m AS (SELECT dataset, count(*) AS n_windows, sum(wt * list_avg(hist_qf)) AS mf, sum(wt * list_avg(hist_qw)) AS mw, sum(wt * list_avg(future_qf)) AS my FROM w GROUP BY ALL)"""


@query(
    "a15_channel_scaler",
    f"""WITH {ORIGINS}, {_SCALER} SELECT dataset, any_value(n_windows) AS n_windows, round(any_value(mf), 6) AS feature_qf_mean, round(any_value(my), 6) AS target_mean, round(any_value(mw), 6) AS feature_qw_mean,
    round(sqrt(sum(wt * list_avg(list_transform(hist_qf, lambda v: (v - mf) * (v - mf))))), 6) AS feature_qf_std,
    round(sqrt(sum(wt * list_avg(list_transform(future_qf, lambda v: (v - my) * (v - my))))), 6) AS target_std,
    round(sqrt(sum(wt * list_avg(list_transform(hist_qw, lambda v: (v - mw) * (v - mw))))), 6) AS feature_qw_std FROM w JOIN m USING (dataset) GROUP BY dataset""",
)
def a15(spark, d):
    return linear.channel_scaler(windows(spark, d))


def moments(spark, d, w=None):
    """Moments of every recording, written once: all folds and grids read this table. `w`: windows that are written already."""
    shift = linear.channel_shift(td.event_rows(spark, d))
    return materialise(linear.recording_moments(windows(spark, d) if w is None else w, td.SPEC, shift), "moments"), shift


@query(
    "a14_recording_moments",
    f"""WITH {ORIGINS}, m AS (SELECT {KEY}, count(*) AS n_windows, {', '.join(f'avg(hist_qf[{i}]) AS f{i}, avg(hist_qw[{i}]) AS w{i}' for i in (1, 5, 10))}, avg(future_qf[4]) AS y4,
      avg(hist_qf[10] * future_qf[1]) AS f10y1, avg(hist_qw[10] * hist_qf[10]) AS w10f10 FROM windows GROUP BY ALL)
    SELECT {KEY}, n_windows, {r6('f1', 'f5', 'f10', 'w1', 'w5', 'w10', 'y4', 'f10y1', 'w10f10')} FROM m""",
)
def a14(spark, d):
    m = linear.recording_moments(windows(spark, d), td.SPEC)
    width = 25
    at = lambda i, j: F.col("moments")[i * width + j]
    return m.select(
        *RECORDING, "n_windows", *[at(0, i).alias(f"f{i}") for i in (1, 5, 10)], *[at(0, 10 + i).alias(f"w{i}") for i in (1, 5, 10)], at(0, 24).alias("y4"),
        at(10, 21).alias("f10y1"), at(20, 10).alias("w10f10"),
    )


# --- ridge with one lag: the whole protocol in SQL --------------------------------------
# Two inputs (last q_f, last q_w) give a closed form, so nested selection, refits and
# transfer scoring all have an exact twin.

_H = (1, 2, 3, 4)
_LAG1 = ORIGINS + f""",
{_RECS},
z AS (SELECT dataset, recording_id, dependency_group, origin, hist_qf[10] AS x1, hist_qw[10] AS x2, {', '.join(f'future_qf[{h}] AS y{h}' for h in _H)} FROM windows),
mom AS (SELECT dataset, recording_id, dependency_group, count(*) AS nw, avg(x1) AS e1, avg(x2) AS e2, avg(x1 * x1) AS e11, avg(x2 * x2) AS e22, avg(x1 * x2) AS e12,
        {', '.join(f'avg(y{h}) AS ey{h}, avg(x1 * y{h}) AS e1y{h}, avg(x2 * y{h}) AS e2y{h}' for h in _H)} FROM z GROUP BY ALL),
folds AS (
  SELECT printf('%s_LORO_%02d_%s', dataset, number, recording_id) AS fold_id, dataset, recording_id AS held_recording FROM recs
  UNION ALL SELECT DISTINCT dataset || '_SOURCE', dataset, NULL FROM recs),
grps AS (SELECT DISTINCT dataset, dependency_group AS val_group FROM recs),
alphas AS (SELECT * FROM (VALUES (1e-4), (1e-2), (1.0), (100.0)) AS v(alpha)),
models AS (SELECT * FROM (VALUES ('B2_RIDGE_QF'), ('B3_RIDGE_QF_QW')) AS v(model))"""


def _fit_sql(train: str, keys: str) -> str:
    """Closed-form ridge from averaged train moments; `train` yields keys + moments."""
    sums = ", ".join(f"avg({c}) AS {c}" for c in ["e1", "e2", "e11", "e22", "e12"] + [f"{p}{h}" for h in _H for p in ("ey", "e1y", "e2y")])
    slopes = []
    for h in _H:
        c1, c2 = f"((e1y{h} - e1 * ey{h}) / s1)", f"((e2y{h} - e2 * ey{h}) / s2)"
        slopes.append(f"CASE WHEN model = 'B2_RIDGE_QF' THEN {c1} / (1 + alpha) ELSE ((1 + alpha) * {c1} - rho * {c2}) / ((1 + alpha) * (1 + alpha) - rho * rho) END AS b1_{h}")
        slopes.append(f"CASE WHEN model = 'B2_RIDGE_QF' THEN 0.0 ELSE ((1 + alpha) * {c2} - rho * {c1}) / ((1 + alpha) * (1 + alpha) - rho * rho) END AS b2_{h}")
    return f"""SELECT * FROM (SELECT *, {', '.join(slopes)} FROM (
      SELECT *, sqrt(e11 - e1 * e1) AS s1, sqrt(e22 - e2 * e2) AS s2, (e12 - e1 * e2) / sqrt((e11 - e1 * e1) * (e22 - e2 * e2)) AS rho
      FROM (SELECT {keys}, count(*) AS n_rec, sum(nw) AS n_windows, {sums} FROM {train} GROUP BY {keys})))"""


def _yhat(h: int) -> str:
    return f"(ey{h} + b1_{h} * (x1 - e1) / s1 + b2_{h} * (x2 - e2) / s2)"


_SELECT1 = _LAG1 + f""",
inner_rows AS (
  SELECT f.fold_id, f.dataset, f.held_recording, g.val_group, model, alpha, m.* EXCLUDE (dataset) FROM folds f JOIN grps g USING (dataset) JOIN mom m USING (dataset)
  CROSS JOIN models CROSS JOIN alphas WHERE m.recording_id IS DISTINCT FROM f.held_recording AND m.dependency_group <> g.val_group),
inner_fits AS ({_fit_sql('inner_rows', 'fold_id, dataset, held_recording, val_group, model, alpha')}),
val AS (
  SELECT i.fold_id, i.dataset, i.model, i.alpha, z.recording_id, sqrt(avg(({' + '.join(f'(y{h} - {_yhat(h)}) * (y{h} - {_yhat(h)})' for h in _H)}) / 4)) AS rmse
  FROM inner_fits i JOIN z ON z.dataset = i.dataset AND z.dependency_group = i.val_group AND z.recording_id IS DISTINCT FROM i.held_recording GROUP BY ALL),
scores AS (SELECT fold_id, dataset, model, alpha, avg(rmse) AS score, count(*) AS n_val FROM val GROUP BY ALL),
tied AS (SELECT *, min(score) OVER k AS best_score FROM scores WINDOW k AS (PARTITION BY fold_id, model)),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY fold_id, model ORDER BY alpha DESC) AS rn, count(*) OVER (PARTITION BY fold_id, model) AS n_tied
  FROM tied WHERE score <= best_score * 1.01),
selected AS (SELECT * FROM chosen WHERE rn = 1)"""

_FITS1 = _SELECT1 + f""",
outer_rows AS (
  SELECT f.fold_id, f.dataset, f.held_recording, s.model, s.alpha, m.* EXCLUDE (dataset) FROM folds f JOIN selected s USING (fold_id) JOIN mom m ON m.dataset = f.dataset
  WHERE m.recording_id IS DISTINCT FROM f.held_recording),
fits AS ({_fit_sql('outer_rows', 'fold_id, dataset, held_recording, model, alpha')})"""


def _selection(spark, d, baseline):
    m, shift = moments(spark, d)
    return m, shift, selection.select_ridge(m, td.recordings(spark, d), td.SPEC, baseline)


def _fits(spark, d, baseline):
    m, shift, chosen = _selection(spark, d, baseline)
    return selection.refit(m, td.recordings(spark, d), chosen, td.SPEC, shift)


@query(
    "k7_nested_selection_lag1",
    f"WITH {_SELECT1} SELECT fold_id, dataset, model, CAST(1 AS BIGINT) AS lag, round(alpha, 6) AS alpha, round(score, 6) AS score, n_tied, round(best_score, 6) AS best_score FROM selected",
)
def k7_lag1(spark, d):
    return _selection(spark, d, LAG1)[2]


@full_grid("k7_validation_scores")
@query(
    "k7_validation_scores_lag1",
    f"WITH {_SELECT1} SELECT fold_id, dataset, recording_id, model, CAST(1 AS BIGINT) AS lag, round(alpha, 6) AS alpha, round(rmse, 6) AS rmse FROM val",
)
def k7_scores(spark, d, baseline=LAG1):
    m, _ = moments(spark, d)
    grid = [(n, lag, a) for n in linear.RIDGE_MODELS for lag in baseline.lags for a in baseline.alphas]
    return selection.validation_scores(m, td.recordings(spark, d), td.SPEC, grid)


@query(
    "a16_ridge_fit_lag1",
    f"""WITH {_FITS1} SELECT fold_id, dataset, held_recording, model, CAST(1 AS BIGINT) AS lag, round(alpha, 6) AS alpha, CAST(n_windows AS BIGINT) AS n_windows,
    round(e1, 6) AS mean_qf, round(s1, 6) AS std_qf, CASE WHEN model <> 'B2_RIDGE_QF' THEN round(e2, 6) END AS mean_qw, CASE WHEN model <> 'B2_RIDGE_QF' THEN round(s2, 6) END AS std_qw,
    round(b1_1, 6) AS coef_qf_h1, round(b1_4, 6) AS coef_qf_h4, CASE WHEN model <> 'B2_RIDGE_QF' THEN round(b2_1, 6) END AS coef_qw_h1, round(ey1, 6) AS intercept_h1, round(ey4, 6) AS intercept_h4 FROM fits""",
)
def a16(spark, d):
    fits = _fits(spark, d, LAG1)
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    return fits.select(
        "fold_id", "dataset", "held_recording", "model", "lag", "alpha", "n_windows",
        at("scaler_mean", 0).alias("mean_qf"), at("scaler_std", 0).alias("std_qf"), at("scaler_mean", 1).alias("mean_qw"), at("scaler_std", 1).alias("std_qw"),
        F.get(at("coef", 0), F.lit(0)).alias("coef_qf_h1"), F.get(at("coef", 3), F.lit(0)).alias("coef_qf_h4"), F.get(at("coef", 0), F.lit(1)).alias("coef_qw_h1"),
        at("intercept", 0).alias("intercept_h1"), at("intercept", 3).alias("intercept_h4"),
    )


@query("a16_ridge_fit")
def a16_full(spark, d):
    """Selected and refitted models of every fold, with whole scalers, coefficients and intercepts."""
    return _fits(spark, d, BASE)


@full_grid("a18_coefficient_audit")
@query(
    "a18_coefficient_audit_lag1",
    f"""WITH {_FITS1} SELECT fold_id, dataset, model, CAST(1 AS BIGINT) AS lag, round(alpha, 6) AS alpha, CAST(CASE WHEN model = 'B2_RIDGE_QF' THEN 1 ELSE 2 END AS BIGINT) AS n_features, CAST(4 AS BIGINT) AS n_outputs,
    CAST(CASE WHEN model = 'B2_RIDGE_QF' THEN 4 ELSE 8 END AS BIGINT) AS n_coefficients, round(sqrt({' + '.join(f'b1_{h} * b1_{h} + b2_{h} * b2_{h}' for h in _H)}), 6) AS coef_norm,
    round(sqrt({' + '.join(f'ey{h} * ey{h}' for h in _H)}), 6) AS intercept_norm, round(sqrt(e1 * e1 + CASE WHEN model = 'B2_RIDGE_QF' THEN 0 ELSE e2 * e2 END), 6) AS mean_l2,
    round(sqrt(s1 * s1 + CASE WHEN model = 'B2_RIDGE_QF' THEN 0 ELSE s2 * s2 END), 6) AS std_l2, CAST(n_windows AS BIGINT) AS n_windows FROM fits""",
)
def a18(spark, d, baseline=LAG1):
    return linear.coefficient_audit(_fits(spark, d, baseline), ["fold_id", "dataset"])


ALL_CELLS1 = CELLS + "," + _FITS1[len(ORIGINS) + 1 :] + f""",
assigned AS (
  SELECT 'WITHIN_' || dataset AS evaluation_context, dataset, held_recording AS recording_id, f.* EXCLUDE (dataset, held_recording) FROM fits f WHERE held_recording IS NOT NULL
  UNION ALL
  SELECT f.dataset || '_TO_' || r.dataset, r.dataset, r.recording_id, f.* EXCLUDE (dataset, held_recording) FROM fits f JOIN recs r ON r.dataset <> f.dataset WHERE held_recording IS NULL),
ridge_cells AS ({' UNION ALL '.join(f"SELECT evaluation_context, fold_id, a.model, z.dataset, z.recording_id, z.origin, {h} AS h, y{h} AS y, {_yhat(h)} AS yhat FROM assigned a JOIN z USING (dataset, recording_id)" for h in _H)}),
context_cells AS (
  SELECT evaluation_context, model, c.dataset, recording_id, origin, h, y, yhat FROM local_cells c JOIN (VALUES ('A', 'WITHIN_A'), ('B', 'WITHIN_B'), ('B', 'A_TO_B'), ('A', 'B_TO_A')) AS v(dataset, evaluation_context) USING (dataset)
  UNION ALL SELECT evaluation_context, model, dataset, recording_id, origin, h, y, yhat FROM ridge_cells),
per_model AS ({results_sql('context_cells', 'evaluation_context, model, dataset, recording_id')}),
results AS (
  SELECT l.*, b.rmse_all_horizons AS base, CASE WHEN l.model <> 'B0_PERSISTENCE' THEN 1 - l.rmse_all_horizons / b.rmse_all_horizons END AS skill
  FROM per_model l JOIN (SELECT * FROM per_model WHERE model = 'B0_PERSISTENCE') b USING (evaluation_context, dataset, recording_id))"""


def ridge_models(spark, d, baseline=LAG1, lags=None, kept=None):
    """Selected and refitted models with the recordings they score."""
    m, shift = kept or moments(spark, d)
    r = td.recordings(spark, d)
    chosen = selection.select_ridge(m, r, td.SPEC, baseline, lags)
    return selection.assign_models(selection.refit(m, r, chosen, td.SPEC, shift), r, PAIRS)


def all_predictions(spark, d, baseline=LAG1):
    """Local and ridge forecasts in every context."""
    w = written_windows(spark, d)
    ridge = linear.ridge_predict(w, ridge_models(spark, d, baseline, kept=moments(spark, d, w)), td.SPEC).drop("fold_id")
    local = predict(w, td.SPEC, baseline, (PERSISTENCE, LINEAR))
    contexts = selection.local_assignments(td.recordings(spark, d), PAIRS).drop("ord")
    return local.join(contexts, list(RECORDING)).unionByName(ridge)


def all_results(spark, d, baseline=LAG1):
    scored = recording_results(all_predictions(spark, d, baseline), td.SPEC, baseline, ["evaluation_context", "model"])
    return with_skill(scored, ["evaluation_context"])


@full_grid("a17_ridge_predictions")
@query(
    "a17_ridge_predictions_lag1",
    f"WITH {ALL_CELLS1} SELECT evaluation_context, fold_id, model, {KEY}, origin, CAST(h AS BIGINT) AS h, round(yhat, 6) AS yhat FROM ridge_cells",
)
def a17(spark, d, baseline=LAG1):
    w = written_windows(spark, d)
    p = linear.ridge_predict(w, ridge_models(spark, d, baseline, kept=moments(spark, d, w)), td.SPEC)
    cells = p.select("evaluation_context", "fold_id", "model", *RECORDING, "origin", F.posexplode("yhat").alias("h", "yhat"))
    return cells.withColumn("h", F.col("h") + 1)


@query(
    "k8_j12_all_results_lag1",
    f"WITH {ALL_CELLS1} SELECT evaluation_context, model, {KEY}, {i64('n_origins')}, {r6(*RESULT_NUMBERS)}, round(skill, 6) AS skill FROM results",
)
def k8(spark, d):
    return all_results(spark, d)


@query(
    "j6_fold_windows",
    f"""WITH {ORIGINS}, {_RECS} SELECT printf('%s_LORO_%02d_%s', h.dataset, h.number, h.recording_id) AS fold_id, CASE WHEN w.recording_id = h.recording_id THEN 'test' ELSE 'train' END AS split_role,
    count(*) AS n_windows, count(DISTINCT w.recording_id) AS n_recordings FROM windows w JOIN recs h USING (dataset) GROUP BY ALL""",
)
def j6(spark, d):
    """Windows per fold side. Counts are joined to folds, not the windows themselves."""
    counts = windows(spark, d).groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"))
    folds = splits.leave_one_recording_out(td.recordings(spark, d)).withColumnRenamed("sequence_id", "recording_id")
    return folds.join(counts, list(RECORDING)).groupBy("fold_id", "split_role").agg(F.sum("n").alias("n_windows"), F.count(F.lit(1)).alias("n_recordings"))


@query("k7_nested_selection")
def k7(spark, d):
    """Full grid of lags and penalties, nested in every fold."""
    m, _ = moments(spark, d)
    return selection.select_ridge(m, td.recordings(spark, d), td.SPEC, BASE)


@query("k8_all_results")
def k8_full(spark, d):
    """Whole protocol with the full grid."""
    return all_results(spark, d, BASE)


@query("k9_fixed_lag_sensitivity")
def k9(spark, d):
    """Lag pinned to the look-back, penalty selected, against the free selection. One pass of validation
    scores serves both; both are scored by one pass over the windows."""
    w = written_windows(spark, d)
    (m, shift), r = moments(spark, d, w), td.recordings(spark, d)
    scores = materialise(selection.validation_means(m, r, td.SPEC, BASE), "validation-means")
    settings = {"primary": scores, "fixed": scores.filter(F.col("lag") == td.SPEC.lookback)}
    models = [
        selection.assign_models(selection.refit(m, r, selection.best_of_grid(s, BASE).filter(F.col("model") == RIDGE_QF_QW), td.SPEC, shift), r, PAIRS)
        .withColumn("evaluation_context", F.concat_ws("|", F.lit(name), "evaluation_context"))
        for name, s in settings.items()
    ]
    scored = recording_results(linear.ridge_predict(w, union_all(*models), td.SPEC), td.SPEC, BASE, ["evaluation_context", "model"])
    split = F.split("evaluation_context", "\\|")
    tagged = scored.withColumns({"setting": split[0], "evaluation_context": split[1]}).join(r.select(*RECORDING, "ord"), list(RECORDING))
    return stats.setting_comparison(materialise(tagged, "lag-settings"), BASE, "ord", BOOT, "primary", "fixed", td.bounded(spark, d))


@full_grid("a32_high_target_results")
@query(
    "a32_high_target_results_lag1",
    f"""WITH {ALL_CELLS1}, t AS (SELECT dataset, recording_id, quantile_cont(q_f, 0.95) AS p95 FROM streams GROUP BY ALL)
    SELECT evaluation_context, model, {KEY}, round(p95, 6) AS p95_threshold, count(*) FILTER (WHERE y > p95) AS n_high_cells, round(sqrt(avg((yhat - y) * (yhat - y)) FILTER (WHERE y > p95)), 6) AS rmse_high_p95_targets
    FROM context_cells JOIN t USING (dataset, recording_id) GROUP BY ALL""",
)
def a32(spark, d, baseline=LAG1):
    t = high_thresholds(streams(spark, d), bounded=td.bounded(spark, d))
    return high_target_results(all_predictions(spark, d, baseline), t, ["evaluation_context", "model"])


# --- selection on logs --------------------------------------------------------------------

_RUNS = """runs AS (
  SELECT event_type AS config_id, user_id % 3 AS seed, user_id % 14 AS rec, avg(value) AS rmse, count(*) AS best_epoch FROM events GROUP BY ALL),
sizes AS (SELECT event_type AS config_id, count(DISTINCT user_id) AS n_params FROM events GROUP BY ALL)"""


def _runs(spark, d):
    """Run records: per (config, seed, recording) an error and a best epoch."""
    e = td.table(spark, d, "events").select(F.col("event_type").alias("config_id"), (F.col("user_id") % 3).alias("seed"), (F.col("user_id") % 14).alias("rec"), "value")
    runs = e.groupBy("config_id", "seed", "rec").agg(F.avg("value").alias("rmse"), F.count(F.lit(1)).alias("best_epoch"))
    return runs.select("config_id", "seed", "best_epoch", F.create_map(F.col("rec").cast("string"), "rmse").alias("rmse_by_seq"), F.lit("S").alias("source"))


@query(
    "t2_config_choice",
    f"""WITH {_RUNS}, s AS (SELECT config_id, avg(m) AS score, count(*) AS n_seeds FROM (SELECT config_id, seed, avg(rmse) AS m FROM runs GROUP BY ALL) GROUP BY ALL),
    e AS (SELECT config_id, count(*) AS n_records, round_even(median(best_epoch), 0) AS ep FROM runs GROUP BY ALL)
    SELECT 'S' AS source, config_id, round(score, 6) AS score, n_params, n_records, n_seeds, CAST(greatest(ep, 1) AS BIGINT) AS selected_epochs
    FROM s JOIN e USING (config_id) JOIN sizes USING (config_id) ORDER BY score, n_params, config_id LIMIT 1""",
)
def t2(spark, d):
    sizes = td.table(spark, d, "events").groupBy(F.col("event_type").alias("config_id")).agg(F.count_distinct("user_id").alias("n_params"))
    return selection.select_config(_runs(spark, d), sizes, ["source"])


@query(
    "t1_tied_argmin",
    """WITH s AS (SELECT l_returnflag AS k, CAST(l_quantity AS BIGINT) AS lag, l_discount AS alpha, avg(l_extendedprice / l_quantity) AS score FROM lineitem GROUP BY ALL),
    t AS (SELECT *, min(score) OVER (PARTITION BY k) AS best_score FROM s), c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lag, alpha DESC) AS rn, count(*) OVER (PARTITION BY k) AS n_tied FROM t WHERE score <= best_score * 1.05)
    SELECT k, lag, round(alpha, 6) AS alpha, round(score, 6) AS score, n_tied, round(best_score, 6) AS best_score FROM c WHERE rn = 1""",
)
def t1(spark, d):
    li = td.table(spark, d, "lineitem")
    scores = li.groupBy(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("bigint").alias("lag"), F.col("l_discount").alias("alpha")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("score"))
    return selection.tied_argmin(scores, ["k"], 0.05)


@full_grid("t3_best_model")
@query(
    "t3_best_model_lag1",
    f"""WITH {ALL_CELLS1}, m AS (SELECT evaluation_context, model, avg(rmse_all_horizons) AS v FROM results GROUP BY ALL)
    SELECT evaluation_context, arg_min(model, v) AS best_model, round(min(v), 6) AS best_value FROM m GROUP BY ALL""",
)
def t3(spark, d, baseline=LAG1):
    means = all_results(spark, d, baseline).groupBy("evaluation_context", "model").agg(F.avg("rmse_all_horizons").alias("mean_rmse"))
    return selection.best_model(means, ["evaluation_context"])


# --- samples ---------------------------------------------------------------------------------

_U = "(CAST(concat('0x', substr(md5('7:{l}:' || CAST(draw AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


@query(
    "i1_equal_recording_sample",
    f"""WITH {ORIGINS}, c AS (SELECT {KEY}, count(*) AS nw, row_number() OVER (ORDER BY dataset, recording_id) - 1 AS rec_no FROM windows GROUP BY dataset, recording_id),
    dr AS (SELECT range AS draw FROM range(512)), p AS (SELECT draw, CAST(floor({_U.format(l='r')} * (SELECT count(*) FROM c)) AS BIGINT) AS rec_no FROM dr),
    q AS (SELECT draw, dataset, recording_id, CAST(floor({_U.format(l='w')} * nw) AS BIGINT) AS w FROM p JOIN c USING (rec_no)),
    n AS (SELECT {KEY}, origin, row_number() OVER (PARTITION BY dataset, recording_id ORDER BY origin) - 1 AS w FROM windows)
    SELECT draw, {KEY}, w, origin FROM q JOIN n USING (dataset, recording_id, w)""",
)
def i1(spark, d):
    s = sampling.equal_recording_sample(windows(spark, d), 512, 7, td.bounded(spark, d))
    return s.select("draw", *RECORDING, "w", "origin")


@query(
    "i2_even_thinning",
    f"""WITH {ORIGINS}, w AS (SELECT {KEY}, origin, row_number() OVER (PARTITION BY dataset, recording_id ORDER BY origin) - 1 AS r, count(*) OVER (PARTITION BY dataset, recording_id) AS n FROM windows)
    SELECT {KEY}, origin FROM w WHERE n <= 96 OR list_contains(list_transform(range(96), lambda j: CAST(floor(j * ((n - 1) / 95.0)) AS BIGINT)), r)""",
)
def i2(spark, d):
    return sampling.thin_evenly(windows(spark, d), 96, td.bounded(spark, d)).select(*RECORDING, "origin")


@query(
    "v2_frozen_model",
    f"""WITH {ORIGINS} SELECT 'EXTERNAL' AS model, {KEY}, origin, CAST(h AS BIGINT) AS h,
    round(CAST(CAST((hist_qf[10] - 25.0) / 10.0 AS FLOAT) AS DOUBLE) * 10.0 + 25.0, 6) AS yhat FROM windows CROSS JOIN generate_series(1, 4) AS g(h)""",
)
def v2(spark, d):
    """A frozen external scorer that repeats the last scaled q_f."""

    def last_value(blob, x: np.ndarray) -> np.ndarray:
        return np.repeat(x[:, -1, :1], blob["horizon"], axis=1)

    p = score_with(windows(spark, d), "EXTERNAL", {"horizon": 4}, last_value, [25.0, 50.0], [10.0, 30.0], 25.0, 10.0)
    cells = p.select("model", *RECORDING, "origin", F.posexplode("yhat").alias("h", "yhat"))
    return cells.withColumn("h", F.col("h") + 1)
