"""Replays of the fixture streams through the live operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.operators.filtering import SOS_200_HZ
from sensorloom.operators.forecasts import LINEAR, PERSISTENCE, predict
from sensorloom.operators.ordering import join_facts
from sensorloom.operators.windows import build_windows
from sensorloom.plans.base import BASE, KEY, STEPS, STREAMS, query, r6, streams
from sensorloom.plans.models import moments, ridge_models
from sensorloom.plans.ordered import _filter_sql
from sensorloom.session import materialise, shared_folder
from sensorloom.sources import testdata as td
from sensorloom.streaming import live

MAX_STEP_S = 36000.0


def _replay(spark, d, written: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The streams (`written`: a table of them) as a readStream over ordered slices, and a fresh folder."""
    folder = f"{shared_folder(spark)}/sensorloom-live-{uuid.uuid4().hex}"
    rows = (streams(spark, d) if written is None else written).select(*RECORDING, "dependency_group", "idx", "ts_s", "q_f", "q_w")
    live.replay_table(rows, f"{folder}/in", live.slice_rows(td.largest_recording(spark, d)))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    return source, folder


def _finish(spark, result: DataFrame, folder: str) -> DataFrame:
    live.run_to_end(result, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


def _by_slices(spark, rows: DataFrame, width: int, along: str, operator, mark_s: int | None = None) -> DataFrame:
    """Result of a live operator whose micro-batches are the slices of a replay.

    A watermark moves between micro-batches only, so no row of a slice is behind one that another file of the slice has
    moved, however wide slices are. With `mark_s` a marker row so long after the end comes last.
    """
    folder = f"{shared_folder(spark)}/sensorloom-live-{uuid.uuid4().hex}"
    run = lambda: _finish(spark, operator(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder)
    for _ in live.replay_slices(rows, f"{folder}/in", width, along):
        out = run()
    if mark_s:
        _mark_end(spark, rows, folder, mark_s)
        out = run()
    return out


def _by_days(spark, d, operator, mark_s: int) -> DataFrame:
    """The same for the streams along event time: as few slices of a long span as of a short one, more only for more rows."""
    rows = streams(spark, d).select(*RECORDING, "dependency_group", "idx", "ts_s", "q_f", "q_w")
    count, span_s = td.extent(spark, d)
    return _by_slices(spark, rows, live.slice_seconds(span_s, count), "ts_s", operator, mark_s)


@query(
    "x1_live_filter",
    _filter_sql(
        SOS_200_HZ,
        f"""SELECT {KEY}, idx, round(ts_s, 6) AS ts_s, round(y, 6) AS q_f, CAST(0 AS BIGINT) AS late_rows
        FROM (SELECT *, first_value(ts_s) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS t0 FROM filtered) WHERE idx % 2 = 0 AND ts_s - t0 >= 3600""",
    ),
)
def x1(spark, d):
    source, folder = _replay(spark, d)
    return _finish(spark, live.live_filter(source, SOS_200_HZ, 2, 3600.0), folder).drop("q_w")


@query(
    "x2_live_windows",
    f"""WITH {STEPS}, f AS (SELECT *, count(*) OVER (PARTITION BY dataset, recording_id) AS n, min(dt) OVER inner_steps AS lo, max(dt) OVER inner_steps AS hi, regr_slope(q_f, idx) OVER k AS s, avg(q_f) OVER k AS m,
      lead(q_f, 4) OVER (PARTITION BY dataset, recording_id ORDER BY idx) AS y4 FROM steps
      WINDOW inner_steps AS (PARTITION BY dataset, recording_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 4 FOLLOWING), k AS (PARTITION BY dataset, recording_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT {KEY}, idx AS origin, model, round(CASE WHEN model = 'B1_LINEAR' THEN m + s * 6 ELSE q_f END, 6) AS yhat_last, round(y4, 6) AS y_last FROM f CROSS JOIN (VALUES ('B0_PERSISTENCE'), ('B1_LINEAR')) AS v(model) WHERE idx % 2 = 0 AND idx >= 9 AND idx + 4 < n AND lo > 0 AND hi <= {MAX_STEP_S}""",
)
def x2(spark, d):
    source, folder = _replay(spark, d)
    forecasts = predict(live.live_windows(source, td.SPEC, MAX_STEP_S), td.SPEC, BASE, (PERSISTENCE, LINEAR))
    out = _finish(spark, forecasts, folder)
    return out.select(*RECORDING, "origin", "model", F.element_at("yhat", -1).alias("yhat_last"), F.element_at("y", -1).alias("y_last"))


@query("x2_live_ridge")
def x2_ridge(spark, d):
    """Selected ridge models, frozen as a table, score the windows as they come; rows as those of `ridge_predict`."""
    rows = materialise(streams(spark, d), "streams")  # read by the replay and twice by the windows of the models
    source, folder = _replay(spark, d, rows)
    kept = moments(spark, d, build_windows(rows, td.SPEC, td.bounded(spark, d)))
    live.freeze_models(ridge_models(spark, d, BASE, kept=kept), f"{folder}/models")
    windows = live.live_windows(source, td.SPEC, MAX_STEP_S)
    live.run_ridge(windows, f"{folder}/models", td.SPEC, f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    return out.select("evaluation_context", "fold_id", "model", *RECORDING, "origin", F.element_at("yhat", -1).alias("yhat_last"), F.element_at("y", -1).alias("y_last"), "model_version")


# Every 97th row arrives a slice later: it is late, and no window may reach over the hole it leaves. A slice is a whole
# number of LATE_SLICE rows, so each late row has rows behind it in the slice that it misses.
LATE_SLICE = 256


@query(
    "x2_live_windows_late",
    f"""WITH {STREAMS}, kept AS (SELECT * FROM (SELECT *, max(idx) OVER (PARTITION BY dataset, recording_id) AS top FROM streams)
      WHERE NOT (idx % 97 = 5 AND idx % {LATE_SLICE} < {LATE_SLICE - 20} AND idx < top - 20)),
    steps AS (SELECT *, ts_s - lag(ts_s) OVER r AS dt FROM kept WINDOW r AS (PARTITION BY dataset, recording_id ORDER BY idx)),
    f AS (SELECT *, lag(idx, 9) OVER r AS first, lead(idx, 4) OVER r AS final, lag(q_f, 9) OVER r AS oldest, lead(q_f, 4) OVER r AS y_last,
      min(dt) OVER inner_steps AS lo, max(dt) OVER inner_steps AS hi FROM steps
      WINDOW r AS (PARTITION BY dataset, recording_id ORDER BY idx), inner_steps AS (PARTITION BY dataset, recording_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 4 FOLLOWING))
    SELECT {KEY}, idx AS origin, round(oldest, 6) AS oldest, round(q_f, 6) AS newest, round(y_last, 6) AS y_last FROM f
    WHERE idx % 2 = 0 AND final - first = 13 AND lo > 0 AND hi <= {MAX_STEP_S}""",
)
def x2_late(spark, d):
    rows = streams(spark, d).select(*RECORDING, "dependency_group", "idx", "ts_s", "q_f", "q_w")
    width = -(-live.slice_rows(td.largest_recording(spark, d), least=LATE_SLICE) // LATE_SLICE) * LATE_SLICE
    ends = rows.groupBy(*RECORDING).agg(F.max("idx").alias("top"))
    late = (F.col("idx") % 97 == 5) & (F.col("idx") % LATE_SLICE < LATE_SLICE - 20) & (F.col("idx") < F.col("top") - 20)
    shown = join_facts(rows, ends, RECORDING, "idx").withColumn("arrival", F.col("idx") + F.when(late, width).otherwise(0)).drop("top")
    out = _by_slices(spark, shown, width, "arrival", lambda source: live.live_windows(source, td.SPEC, MAX_STEP_S))
    return out.select(*RECORDING, "origin", F.element_at("hist_qf", 1).alias("oldest"), F.element_at("hist_qf", -1).alias("newest"), F.element_at("future_qf", -1).alias("y_last"))


@query(
    "x3_live_health",
    f"""WITH {STEPS} SELECT {KEY}, count(*) AS sample_count, count(*) FILTER (WHERE dt < 0) AS backward_count, count(*) FILTER (WHERE dt = 0) AS duplicate_count, round(max(dt) FILTER (WHERE dt > 0), 6) AS maximum_gap, CAST(0 AS BIGINT) AS late_rows
    FROM steps GROUP BY ALL""",
)
def x3(spark, d):
    source, folder = _replay(spark, d)
    live.run_updates(live.live_health(source), f"{folder}/out", f"{folder}/state")
    updates = spark.read.parquet(f"{folder}/out")
    names = [c for c in updates.columns if c not in (*RECORDING, "batch")]
    return updates.groupBy(*RECORDING).agg(F.max_by(F.struct(*names), "batch").alias("u")).select(*RECORDING, "u.*")


@query(
    "x3_live_ends",
    f"""WITH {STEPS} SELECT {KEY}, count(*) AS sample_count, count(*) FILTER (WHERE dt < 0) AS backward_count, count(*) FILTER (WHERE dt = 0) AS duplicate_count, round(max(dt) FILTER (WHERE dt > 0), 6) AS maximum_gap, CAST(0 AS BIGINT) AS late_rows
    FROM steps GROUP BY ALL""",
)
def x3_ends(spark, d):
    """Counters told once per recording, when its timer expires: a marker row far behind the end moves the watermark there."""
    out = _by_days(spark, d, lambda source: live.live_ends(source, idle="300 days", delay="7 days"), 400 * 86400)
    return out.filter("recording_id is not null")


def _mark_end(spark, rows: DataFrame, folder: str, after_s: int) -> None:
    """A row without a recording, so long after the last one."""
    whole = spark.read.schema(rows.schema).parquet(f"{folder}/in")
    ends = {"ts_s": F.max("ts_s") + after_s, "idx": F.lit(0).cast("bigint")}
    whole.agg(*[ends.get(f.name, F.max(F.lit(None).cast(f.dataType))).alias(f.name) for f in rows.schema]).write.mode("append").parquet(f"{folder}/in")


@query(
    "x3_live_counts",
    f"""WITH {STREAMS}, b AS (SELECT {KEY}, CAST(floor(ts_s / 86400) AS BIGINT) AS day, q_f FROM streams)
    SELECT {KEY}, day, count(*) AS n, {r6('min(q_f)', 'max(q_f)').replace('AS min(q_f)', 'AS min_qf').replace('AS max(q_f)', 'AS max_qf')} FROM b GROUP BY ALL""",
)
def x3_counts(spark, d):
    """All days: a marker row two days after the end moves the watermark past the last of them."""
    counted = lambda source: live.live_counts(source.withColumn("ts", F.timestamp_seconds("ts_s")), "ts", "10 minutes", "1 day")
    out = _by_days(spark, d, counted, 2 * 86400).filter("recording_id is not null")
    return out.select(*RECORDING, F.floor(F.unix_seconds("window_start") / 86400).alias("day"), "n", "min_qf", "max_qf")
