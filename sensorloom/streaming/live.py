"""Causal operators on live streams.

Every operator is a stateful processor that keeps a small typed state per recording and takes its rows one
Arrow batch at a time. Rows leave in the order of `idx`: a row that follows the last one goes on at once, one that comes too early
waits for the rows before it until the micro-batch ends, HOLD rows in memory and the others in files of the task. A row whose
idx is not beyond the last one gone on is late, is counted, and changes nothing. It leaves a hole, and no window reaches over a hole.

With `idle` (an interval such as "1 hour") the state of a recording ends when the watermark, `delay` behind the newest
timestamp of the stream, has passed its last row by so much. The timers run on event time, so this also holds in
available-now runs, and `live_ends` tells the final counters of each ended recording. A stream with `idle` has
one clock: rows behind its watermark (at first: at or before 1970) are dropped before they reach a recording.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorloom.config import RECORDING, WindowSpec
from sensorloom.operators.filtering import Sos, filter_block
from sensorloom.operators.linear import ridge_predict

#: Rows of a recording that wait in memory for earlier ones within a micro-batch; more wait in files.
HOLD = 50_000


def seconds(interval: str) -> float:
    """Length of an interval like `90 seconds` or `1 hour`."""
    return pd.Timedelta(interval).total_seconds()


class Waiting:
    """Rows of one recording that wait for earlier ones, in files of HOLD idx each."""

    def __init__(self) -> None:
        self.folder = tempfile.TemporaryDirectory(prefix="spark-")
        self.parts: dict[int, list[Path]] = {}

    def add(self, rows: pd.DataFrame) -> None:
        for number, part in rows.groupby(rows["idx"] // HOLD):
            files = self.parts.setdefault(int(number), [])
            files.append(Path(self.folder.name) / f"{number}-{len(files)}")
            part.to_pickle(files[-1])

    def drain(self) -> Iterator[pd.DataFrame]:
        """All rows, a file's worth of idx at a time, ascending; the folder goes at the end."""
        with self.folder:
            for number in sorted(self.parts):
                yield pd.concat([pd.read_pickle(f) for f in self.parts[number]])


class InOrder(StatefulProcessor):
    """Orders the rows of a recording and keeps its place; subclasses say what a run of rows in order does."""

    def __init__(self, idle: str | None = None):
        self.idle_ms = round(1000 * seconds(idle)) if idle else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last_idx bigint, late bigint, last_ts double")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare the subclass's own state."""

    def load(self) -> None:
        """Read the subclass's own state before the first run of a micro-batch."""

    def store(self) -> None:
        """Write it back after the last one."""

    def forget(self) -> None:
        """Clear it."""

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Result of the next rows, in order."""
        return iter(())

    def batch_end(self, key: tuple, late: int) -> Iterator[pd.DataFrame]:
        """Result once per micro-batch."""
        return iter(())

    def ended(self, key: tuple, late: int) -> Iterator[pd.DataFrame]:
        """Result when the recording ends."""
        return iter(())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, self.late, last_ts = self.place.get() if self.place.exists() else (-1, 0, None)
        self.load()
        waiting: pd.DataFrame | None = None
        filed: Waiting | None = None

        def ordered(queue: pd.DataFrame) -> pd.DataFrame:
            """The rows that are not late, ascending; the others are counted."""
            count, queue = len(queue), queue.sort_values("idx", kind="stable")
            queue = queue[(queue["idx"] > last) & ~queue["idx"].duplicated()]
            self.late += count - len(queue)
            return queue

        for frame in rows:
            queue = ordered(frame if waiting is None else pd.concat([waiting, frame]))
            idx = queue["idx"].to_numpy(np.int64)
            go = int((idx == last + 1 + np.arange(len(idx))).argmin()) if len(idx) and idx[-1] != last + len(idx) else len(idx)
            waiting = queue.iloc[go:] if go < len(queue) else None
            if go:
                last, last_ts = int(idx[go - 1]), float(queue["ts_s"].iloc[go - 1])
                yield from self.take(key, queue.iloc[:go])
            if waiting is not None and len(waiting) > HOLD:
                filed = filed or Waiting()
                filed.add(waiting)
                waiting = None
        if filed is not None and waiting is not None:
            filed.add(waiting)
        for queue in filed.drain() if filed is not None else [waiting] if waiting is not None else []:
            queue = ordered(queue)
            if len(queue):
                last, last_ts = int(queue["idx"].iloc[-1]), float(queue["ts_s"].iloc[-1])
                yield from self.take(key, queue)
        self.place.update((last, self.late, last_ts))
        self.store()
        if self.idle_ms and last_ts is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(1000 * last_ts) + self.idle_ms)
        yield from self.batch_end(key, self.late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, late, _ = self.place.get()
        yield from self.ended(key, late)
        self.place.clear()
        self.forget()

    def close(self) -> None:
        pass


def _processed(stream: DataFrame, columns: tuple[str, ...], processor: InOrder, schema: str, mode: str, idle: str | None, delay: str) -> DataFrame:
    rows = stream.select(*RECORDING, *columns)
    if idle:
        rows = rows.withColumn("at", F.timestamp_seconds("ts_s")).withWatermark("at", delay)
    return rows.groupBy(*RECORDING).transformWithStateInPandas(processor, schema, mode, "EventTime" if idle else "None")


class FilterProcessor(InOrder):
    """State: two numbers per filter section and channel, and the first timestamp."""

    def __init__(self, sos: Sos, factor: int, warmup_s: float, idle: str | None):
        super().__init__(idle)
        self.sos, self.factor, self.warmup_s = sos, factor, warmup_s

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "zf array<double>, zw array<double>, t0 double")

    def load(self) -> None:
        zero = [0.0] * (2 * len(self.sos))
        zf, zw, self.t0 = self.memory.get() if self.memory.exists() else (zero, zero, None)
        self.zf, self.zw = np.asarray(zf, float), np.asarray(zw, float)

    def store(self) -> None:
        self.memory.update((self.zf.tolist(), self.zw.tolist(), self.t0))

    def forget(self) -> None:
        self.memory.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        self.t0 = float(rows["ts_s"].iloc[0]) if self.t0 is None else self.t0
        qf, self.zf = filter_block(self.sos, rows["q_f"].to_numpy(float), self.zf)
        qw, self.zw = filter_block(self.sos, rows["q_w"].to_numpy(float), self.zw)
        out = rows.assign(q_f=qf, q_w=qw, late_rows=self.late)
        keep = (out["idx"] % self.factor == 0) & (out["ts_s"] - self.t0 >= self.warmup_s - 1e-15)
        if keep.any():
            yield out.loc[keep, [*RECORDING, "idx", "ts_s", "q_f", "q_w", "late_rows"]]


def live_filter(stream: DataFrame, sos: Sos, factor: int = 1, warmup_s: float = 0.0, idle: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Filter, decimate and drop the warm-up as rows arrive."""
    schema = "dataset string, recording_id string, idx bigint, ts_s double, q_f double, q_w double, late_rows bigint"
    return _processed(stream, ("idx", "ts_s", "q_f", "q_w"), FilterProcessor(sos, factor, warmup_s, idle), schema, "append", idle, delay)


class WindowProcessor(InOrder):
    """State: the last look-back + horizon - 1 rows, as a list."""

    def __init__(self, spec: WindowSpec, max_step_s: float, idle: str | None):
        super().__init__(idle)
        self.spec, self.max_step_s = spec, max_step_s

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "idx bigint, ts double, qf double, qw double")

    def load(self) -> None:
        held = list(self.tail.get())
        i, t, f, w = zip(*held) if held else ((), (), (), ())
        self.held = (np.asarray(i, np.int64), *(np.asarray(x, float) for x in (t, f, w)))

    def store(self) -> None:
        i, t, f, w = (x.tolist() for x in self.held)
        self.tail.put(list(zip(i, t, f, w)))

    def forget(self) -> None:
        self.tail.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        L, H, S = self.spec.lookback, self.spec.horizon, self.spec.stride
        held = len(self.held[0])
        new = (rows["idx"].to_numpy(np.int64), *(rows[c].to_numpy(float) for c in ("ts_s", "q_f", "q_w")))
        i, t, f, w = (np.concatenate(pair) for pair in zip(self.held, new))
        steps = np.diff(t)
        bad = np.concatenate([[0], np.cumsum((steps <= 0) | (steps > self.max_step_s))])
        # Places of origins whose last horizon row is new and whose rows follow each other without a hole.
        at = np.arange(max(held - H, L - 1), len(t) - H)
        at = at[(i[at] % S == 0) & (i[at + H] - i[at - L + 1] == L + H - 1) & (bad[at + H] == bad[at - L + 1])]
        self.held = tuple(x[-(L + H - 1) :] for x in (i, t, f, w))
        if len(at):
            cut = lambda x, lo, hi: list(x[at[:, None] + np.arange(lo, hi)])
            yield pd.DataFrame({
                "dataset": key[0], "recording_id": key[1], "dependency_group": rows["dependency_group"].iloc[0], "origin": i[at],
                "hist_qf": cut(f, 1 - L, 1), "hist_qw": cut(w, 1 - L, 1), "future_qf": cut(f, 1, H + 1),
            })


def live_windows(stream: DataFrame, spec: WindowSpec, max_step_s: float, idle: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Windows as soon as their horizon has arrived; feed them to any forecaster.

    A live stream has no median step yet, so the gap limit is given in seconds.
    """
    schema = "dataset string, recording_id string, dependency_group string, origin bigint, hist_qf array<double>, hist_qw array<double>, future_qf array<double>"
    return _processed(stream, ("dependency_group", "idx", "ts_s", "q_f", "q_w"), WindowProcessor(spec, max_step_s, idle), schema, "append", idle, delay)


class HealthProcessor(InOrder):
    """State: the counters and the last timestamp. `final`: tell them at the recording's end only."""

    def __init__(self, idle: str | None, final: bool):
        super().__init__(idle)
        self.final = final

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "n bigint, back bigint, same bigint, gap double, last_ts double")

    def load(self) -> None:
        self.now = self.counters.get() if self.counters.exists() else (0, 0, 0, None, None)

    def store(self) -> None:
        self.counters.update(self.now)

    def forget(self) -> None:
        self.counters.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        count, back, same, gap, last_ts = self.now
        t = rows["ts_s"].to_numpy(float)
        steps = np.diff(t if last_ts is None else np.concatenate([[last_ts], t]))
        if (steps > 0).any():
            gap = max(gap or 0.0, float(steps[steps > 0].max()))
        self.now = (count + len(t), back + int((steps < 0).sum()), same + int((steps == 0).sum()), gap, float(t[-1]))
        return iter(())

    def row(self, key: tuple, late: int) -> pd.DataFrame:
        count, back, same, gap, _ = self.now
        return pd.DataFrame({
            "dataset": [key[0]], "recording_id": [key[1]], "sample_count": [count], "backward_count": [back], "duplicate_count": [same], "maximum_gap": [gap], "late_rows": [late],
        })

    def batch_end(self, key: tuple, late: int) -> Iterator[pd.DataFrame]:
        if not self.final:
            yield self.row(key, late)

    def ended(self, key: tuple, late: int) -> Iterator[pd.DataFrame]:
        if self.final:
            self.load()
            yield self.row(key, late)


HEALTH = "dataset string, recording_id string, sample_count bigint, backward_count bigint, duplicate_count bigint, maximum_gap double, late_rows bigint"


def live_health(stream: DataFrame, idle: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Running clock counters per recording after each micro-batch (update mode)."""
    return _processed(stream, ("idx", "ts_s"), HealthProcessor(idle, False), HEALTH, "update", idle, delay)


def live_ends(stream: DataFrame, idle: str, delay: str = "10 minutes") -> DataFrame:
    """The final clock counters of each recording, once, when it has been silent for `idle` (append mode)."""
    return _processed(stream, ("idx", "ts_s"), HealthProcessor(idle, True), HEALTH, "append", idle, delay)


# --- frozen models ------------------------------------------------------------------


def freeze_models(models: DataFrame, path: str) -> int:
    """Write a model table as the next version of the store at `path`; running queries take it up with their next micro-batch."""
    version = (latest_version(models.sparkSession, path) or 0) + 1
    models.write.mode("errorifexists").parquet(f"{path}/version={version:08d}")
    return version


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest complete version; None without any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    done = [s.getPath().getParent().getName() for s in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []]
    return max((int(name.split("=")[1]) for name in done), default=None)


def run_ridge(live: DataFrame, models_path: str, spec: WindowSpec, path: str, checkpoint: str) -> None:
    """Forecasts of live windows by the frozen models, which are read anew for every micro-batch.

    A micro-batch is scored like a finished table (`ridge_predict`: small model tables go to the tasks, large ones are
    joined) and replaces its own folder, so one that runs again after a failure adds no row.
    """

    def score(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = latest_version(spark, models_path)
        if version is None:
            raise RuntimeError(f"no models at {models_path}")
        models = spark.read.parquet(f"{models_path}/version={version:08d}")
        scored = ridge_predict(batch, models, spec).withColumn("model_version", F.lit(version).cast("bigint"))
        scored.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _start(live.writeStream.foreachBatch(score), live.sparkSession, checkpoint, "append")


def live_counts(stream: DataFrame, event_time: str, delay: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Rows and value range per recording and event-time window, with a watermark."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, every), *RECORDING)
        .agg(F.count(F.lit(1)).alias("n"), F.min("q_f").alias("min_qf"), F.max("q_f").alias("max_qf"))
        .select(*RECORDING, F.col("window.start").alias("window_start"), "n", "min_qf", "max_qf")
    )


def replay_slices(rows: DataFrame, path: str, width: int, along: str = "idx", files: int | None = None) -> Iterator[int]:
    """Write a finished table so that it can be replayed in order, and tell the number of each slice once it lies there.

    Slices of `width` along a column are appended one after the other, and within a
    slice a recording lies in one file, in the order of idx. Sliced along idx, a micro-batch never sees a
    recording out of order and holds at most `width` rows of it per file. Sliced along
    event time, no row arrives behind a watermark moved by another recording. The source is
    read once: the slices are partitions of one written table, and each append reads its own.
    `files` fixes the files per slice.
    """
    spark, cut = rows.sparkSession, f"{path}-slices"
    sliced = rows.withColumn("slice", F.floor(F.col(along) / width))
    (sliced.repartition("slice", *RECORDING) if files is None else sliced.repartition("slice")).write.partitionBy("slice").parquet(cut)
    written = spark.read.schema(sliced.schema).parquet(cut)
    low, high = written.agg(F.min("slice"), F.max("slice")).first()
    for number in range(low, high + 1) if low is not None else ():
        part = written.filter(F.col("slice") == number).drop("slice")
        part = part.repartition(*RECORDING) if files is None else part.repartition(files)
        part.sortWithinPartitions(*RECORDING, "idx").write.mode("append").parquet(path)
        yield number


def replay_table(rows: DataFrame, path: str, width: int, along: str = "idx", files: int | None = None) -> None:
    """All slices of `replay_slices`."""
    for _ in replay_slices(rows, path, width, along, files):
        pass


def slice_rows(longest: int, slices: int = 4, least: int = 512, most: int = 1_000_000) -> int:
    """Slice length for a replay: a few slices for short recordings, a bounded one for long."""
    return min(most, max(least, -(-longest // slices)))


def slice_seconds(span_s: float, rows: int, slices: int = 4, most: int = 4_000_000) -> int:
    """The same along event time: `slices` of them, or as many as hold `most` rows on average."""
    return max(1, math.ceil(span_s / max(slices, -(-rows // most))))


def _start(writer, spark: SparkSession, checkpoint: str, mode: str) -> None:
    """Process everything available and stop. The processors' state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_to_end(result: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into parquet files and stop."""
    _start(result.writeStream.format("parquet").option("path", path), result.sparkSession, checkpoint, "append")


def run_updates(result: DataFrame, path: str, checkpoint: str) -> None:
    """The same for an update-mode result: each micro-batch writes its updates under its
    number, so that the last one per key can be picked; one that runs again replaces its own."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _start(result.writeStream.foreachBatch(keep), result.sparkSession, checkpoint, "update")
