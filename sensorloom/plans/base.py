"""Registry of runnable queries and their SQL twins, and shared fixture pieces."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.config import BaselineSpec, BootstrapSpec
from sensorloom.operators.forecasts import LINEAR, PERSISTENCE, predict
from sensorloom.operators.metrics import recording_results, with_skill
from sensorloom.operators.selection import local_assignments
from sensorloom.operators.windows import build_windows
from sensorloom.session import materialise, ship_package
from sensorloom.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PAIRS = (("A", "B"), ("B", "A"))
BASE = BaselineSpec(linear_k=5, lags=(1, 2, 5, 10), alphas=(1e-6, 1e-4, 1e-2, 1.0, 100.0), report_horizons=(1, 2, 4))
LAG1 = BaselineSpec(linear_k=5, lags=(1,), alphas=(1e-4, 1e-2, 1.0, 100.0), report_horizons=(1, 2, 4))
BOOT = BootstrapSpec(reps=10_000, seed=20260912, draws="hash")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return tidy(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def full_grid(name: str) -> Callable[[Query], Query]:
    """Register a query of the ridge protocol with every lag and penalty. It has no twin: the SQL solves one lag only."""

    def add(fn: Query) -> Query:
        query(name)(partial(fn, baseline=BASE))
        return fn

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, whole numbers to BIGINT: the forms both engines share."""
    cells = []
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cells.append(F.round(f.name, 6).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cells.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cells.append(F.col(f.name))
    return df.select(*cells)


def r6(*columns: str) -> str:
    """SQL list of columns rounded to 6 decimals under their own names."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def i64(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


KEY = "dataset, recording_id"

# --- SQL twins of the fixture views ------------------------------------------

STREAMS = """
streams AS (
  SELECT CASE WHEN r < 6 THEN 'A' ELSE 'B' END AS dataset, printf('r%02d', r) AS recording_id,
         'g' || CAST(r % 3 AS VARCHAR) AS dependency_group, r AS ord,
         row_number() OVER (PARTITION BY r ORDER BY ts_us, event_id) - 1 AS idx,
         ts_us, ts_us / 1e6 AS ts_s, q_f, q_w, event_type
  FROM (SELECT user_id % 14 AS r, epoch_us(ts) AS ts_us, event_id, event_type, value AS q_f,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS q_w FROM events))"""

STEPS = STREAMS + """,
steps AS (
  SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS dt FROM streams)"""

ORIGINS = STEPS + """,
limits AS (
  SELECT dataset, recording_id, count(*) AS n, quantile_cont(dt, 0.5) FILTER (WHERE dt > 0) AS median_dt
  FROM steps GROUP BY ALL),
framed AS (
  SELECT s.*, n, median_dt,
         min(dt) OVER inner_steps AS least_dt, max(dt) OVER inner_steps AS most_dt,
         list(q_f) OVER past AS hist_qf, list(q_w) OVER past AS hist_qw, list(q_f) OVER ahead AS future_qf
  FROM steps s JOIN limits USING (dataset, recording_id)
  WINDOW inner_steps AS (PARTITION BY dataset, recording_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 4 FOLLOWING),
         past AS (PARTITION BY dataset, recording_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY dataset, recording_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
origins AS (
  SELECT *, idx AS origin, CASE WHEN idx < 9 THEN 'start' WHEN idx + 4 >= n THEN 'end' WHEN least_dt <= 0 THEN 'other'
              WHEN most_dt > 8.0 * median_dt THEN 'gap' ELSE 'valid' END AS status
  FROM framed WHERE idx % 2 = 0),
windows AS (SELECT * FROM origins WHERE status = 'valid')"""

# One row per (window, model, horizon step) of the two local forecasters.
CELLS = ORIGINS + """,
lines AS (
  SELECT w.*, l.m, l.s FROM windows w JOIN (
    SELECT dataset, recording_id, idx, avg(q_f) OVER k AS m, regr_slope(q_f, idx) OVER k AS s FROM streams
    WINDOW k AS (PARTITION BY dataset, recording_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) l
  USING (dataset, recording_id, idx)),
local_cells AS (
  SELECT dataset, recording_id, dependency_group, ord, origin, hist_qf, hist_qw, h, future_qf[h] AS y, 'B0_PERSISTENCE' AS model, hist_qf[10] AS yhat
  FROM lines CROSS JOIN generate_series(1, 4) AS g(h)
  UNION ALL
  SELECT dataset, recording_id, dependency_group, ord, origin, hist_qf, hist_qw, h, future_qf[h], 'B1_LINEAR', m + s * (h + 2)
  FROM lines CROSS JOIN generate_series(1, 4) AS g(h))"""


def results_sql(cells: str, by: str) -> str:
    """Per-recording results from cells with y and yhat."""
    return f"""
  SELECT {by}, count(*) // 4 AS n_origins, sqrt(avg((yhat - y) * (yhat - y))) AS rmse_all_horizons,
         avg(abs(yhat - y)) AS mae_all_horizons,
         {', '.join(f'sqrt(avg((yhat - y) * (yhat - y)) FILTER (WHERE h = {h})) AS rmse_at_{h}' for h in (1, 2, 4))},
         {', '.join(f'sqrt(avg((yhat - y) * (yhat - y)) FILTER (WHERE h = {h})) AS rmse_h{h:02d}' for h in (1, 2, 3, 4))}
  FROM {cells} GROUP BY {by}"""


RESULT_NUMBERS = ["rmse_all_horizons", "mae_all_horizons", "rmse_at_1", "rmse_at_2", "rmse_at_4", "rmse_h01", "rmse_h02", "rmse_h03", "rmse_h04"]

LOCAL_RESULTS = CELLS + f""",
per_model AS ({results_sql('local_cells', 'model, dataset, recording_id, ord')}),
local_results AS (
  SELECT evaluation_context, p.* FROM per_model p JOIN (VALUES
    ('A', 'WITHIN_A'), ('B', 'WITHIN_B'), ('B', 'A_TO_B'), ('A', 'B_TO_A')) AS c(dataset, evaluation_context) USING (dataset)),
results AS (
  SELECT l.*, b.rmse_all_horizons AS base,
         CASE WHEN l.model <> 'B0_PERSISTENCE' THEN CASE WHEN b.rmse_all_horizons = 0 THEN CASE WHEN l.rmse_all_horizons = 0 THEN 1.0 END
              ELSE 1 - l.rmse_all_horizons / b.rmse_all_horizons END END AS skill
  FROM local_results l JOIN (SELECT * FROM local_results WHERE model = 'B0_PERSISTENCE') b
  USING (evaluation_context, dataset, recording_id))"""


# --- Spark side -----------------------------------------------------------------


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.streams(spark, sf_dir)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_windows(streams(spark, sf_dir), td.SPEC, td.bounded(spark, sf_dir))


def written_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows as a written table, for queries that read them more than once."""
    return materialise(windows(spark, sf_dir), "windows")


def local_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(windows(spark, sf_dir), td.SPEC, BASE, (PERSISTENCE, LINEAR))


def local_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-recording results of the local forecasters in every context, with skill; written once, statistics read them several times."""
    scored = recording_results(local_predictions(spark, sf_dir), td.SPEC, BASE)
    contexts = local_assignments(td.recordings(spark, sf_dir), PAIRS)
    return materialise(with_skill(scored.join(contexts, ["dataset", "recording_id"]), ["evaluation_context"]), "local-results")
