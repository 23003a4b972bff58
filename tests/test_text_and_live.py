"""Text scans, file hashes, run logs, and live operators over several micro-batches."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.config import WindowSpec
from sensorloom.operators import filtering, linear, timestamps, windows
from sensorloom.sources import files, tables, text
from sensorloom.streaming import live

ASL = "#timestamp [ns],w_RS_S_x [rad s^-1],w_RS_S_y [rad s^-1],w_RS_S_z [rad s^-1],a_RS_S_x [m s^-2],a_RS_S_y [m s^-2],a_RS_S_z [m s^-2]\n"


def test_asl_table(spark, tmp_path):
    body = "1403638128145099776,1,2,3,4,5,6\n# note\n\nbad,1,2,3,4,5,6\n1403638128150099776,1.5,nan,3,4,5\n"
    (tmp_path / "a.csv").write_text(ASL + body)
    table = text.read_asl_table(spark, str(tmp_path / "a.csv"))
    heads = table.groupBy("path").agg(F.first("header").alias("header"), F.first("header_line").alias("header_line"))
    mapped = text.map_imu_header(heads).withColumns(text.header_units(F.col("header_line")))
    m = mapped.first()
    assert m.layout == "HEADER_MAPPED" and m.places.asDict() == {"ts": 0, "wx": 1, "wy": 2, "wz": 3, "fx": 4, "fy": 5, "fz": 6}
    assert (m.unit_acceleration, m.unit_gyro, m.unit_clock) == ("m/s^2", "rad/s", "nanoseconds")
    a, b = text.imu_samples(table, mapped).orderBy("idx").collect()
    assert (a.idx, b.idx, a.clock_int, b.clock_int - a.clock_int) == (0, 1, 1403638128145099776, 5_000_000)
    assert (b.wx, b.wy, b.fy, b.fz) == (1.5, None, 5.0, None)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = text.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 6000
    assert all(int(r.line[1:]) == r.line_no for r in rows)


@pytest.mark.parametrize("body, unit", [
    ("# index timestamp ang_vel_x ang_vel_y ang_vel_z lin_acc_x lin_acc_y lin_acc_z\n0 1.0 1 2 3 4 5 6\n1 1.1 1 2 3 4 5 6\n", "UNRESOLVED"),
    ("timestamp,wx,wy,wz,ax,ay,az\n0,1,2,3,4,5,6\n", "UNRESOLVED"),
])
def test_sensor_text(spark, tmp_path, body, unit):
    (tmp_path / "imu.txt").write_text(body)
    table = text.read_sensor_text(spark, str(tmp_path / "imu.txt"))
    heads = table.groupBy("path").agg(F.first("header").alias("header"), F.first("has_accel_unit").alias("u"))
    m = text.map_imu_header(heads, text.TEXT_IMU_RULES, asl=False)
    row = m.first()
    assert not row.u
    sample = text.imu_samples(table, m).orderBy("idx").first()
    assert (sample.wx, sample.wz, sample.fx, sample.fz) == (1.0, 3.0, 4.0, 6.0)
    assert row.layout == ("HEADER_MAPPED" if "lin_acc" in body else "ASSUMED_7COL_T_WXWYWZ_AXAYAZ_UNCONFIRMED_BY_HEADER")


def test_pose_header(spark):
    names = ["timestamp", "p_RS_R_x [m]", "p_RS_R_y [m]", "p_RS_R_z [m]", "q_RS_w []", "q_RS_x []", "q_RS_y []", "q_RS_z []", "b_a_RS_S_x [m s^-2]"]
    r = text.map_pose_header(spark.createDataFrame([(names,)], "header array<string>")).first()
    assert (r.quaternion_order, r.acceleration_fields, r.bias_accel_present, r.velocity_fields) == ("wxyz", "NO_DIRECT_GT_ACCELERATION", True, "NOT_PRESENT")


def test_stream_text(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# dataset=A\n# sequence_id=r1\ntimestamp_s,q_f,q_w\n0.0,9.8,0.1\n0.01,9.9,0.2\n")
    rows = tables.read_stream_csv(spark, str(tmp_path / "s.csv")).orderBy("idx").collect()
    assert [(r.dataset, r.recording_id, r.idx, r.q_f, r.native_index) for r in rows] == [("A", "r1", 0, 9.8, -1), ("A", "r1", 1, 9.9, -1)]


def test_file_hash(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc" * 1000)
    row = files.file_manifest(spark, str(tmp_path / "x.bin")).first()
    assert (row.sha256, row.size_bytes) == (hashlib.sha256(b"abc" * 1000).hexdigest(), 3000)


def test_result_cells(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 0.00001234, 1234567.891, None, [1, 2])], "a double, b double, c double, d double, e array<int>")
    tables.write_results(df, str(tmp_path / "r"), ["a", "b", "c", "d", "e", "missing"], csv=True)
    row = tables.read_results(spark, str(tmp_path / "r")).first()
    assert (row.a, float(row.b), row.c, row.d, row.e) == ("1.5", 0.00001234, "1234567.891", None, "[1,2]")


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for loss in (2.0, 1.0):
        tables.append_runs(spark.createDataFrame([("j1", loss), (f"j{loss}", 0.0)], "job_id string, loss double"), path)
    log = spark.read.parquet(path)
    assert {r.job_id: r.loss for r in tables.latest_runs(log).collect()}["j1"] == 1.0
    jobs = spark.createDataFrame([("j1",), ("j9",)], "job_id string")
    assert [r.job_id for r in tables.pending_jobs(jobs, log).collect()] == ["j9"]


def test_grid_rejects_repeated_ids(spark):
    df = spark.createDataFrame([("T", "c1", [1, 2]), ("T", "c1", [3])], "architecture string, config_id string, channels array<int>")
    with pytest.raises(Exception, match="duplicate config_id"):
        tables.config_grid(df).collect()


@pytest.fixture(scope="module")
def replayed(spark, stream, tmp_path_factory):
    """A stream in slices of 60 rows, one file per trigger; the last slice comes again."""
    rng = np.random.default_rng(6)
    t = np.cumsum(np.where(rng.random(300) < 0.03, 0.09, 0.01))
    t[120] = t[119]
    s = stream({"r": list(zip(t, 9.8 + rng.normal(size=300), rng.random(300))), "s": [(i * 0.01, i % 5, 1) for i in range(150)]}).cache()
    folder = tmp_path_factory.mktemp("live")
    live.replay_table(s, f"{folder}/in", 60)
    s.filter("idx >= 290").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return s, spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


def test_live_filter(spark, replayed):
    s, source, folder = replayed
    live.run_to_end(live.live_filter(source, filtering.SOS_200_HZ, 2, 0.2), f"{folder}/f", f"{folder}/fs")
    got = spark.read.parquet(f"{folder}/f").orderBy("recording_id", "idx").collect()
    want = filtering.process_streams(s.drop("native_index"), filtering.SOS_200_HZ, 2, 0.2, True).orderBy("recording_id", "idx").collect()
    assert [(r.recording_id, r.idx) for r in got] == [(r.recording_id, r.native_index) for r in want]
    assert np.abs(np.array([r.q_f for r in got]) - [r.q_f for r in want]).max() < 1e-10


def test_live_windows(spark, replayed):
    s, source, folder = replayed
    spec = WindowSpec(20, 5, 5, 5.0)  # the median step is 0.01, so the limit is 0.05 s
    live.run_to_end(live.live_windows(source, spec, 0.05), f"{folder}/w", f"{folder}/ws")
    order = ["recording_id", "origin"]
    got = [tuple(r) for r in spark.read.parquet(f"{folder}/w").select(*order, "hist_qf", "hist_qw", "future_qf").orderBy(*order).collect()]
    want = [tuple(r) for r in windows.build_windows(s, spec, True).select(*order, "hist_qf", "hist_qw", "future_qf").orderBy(*order).collect()]
    assert got == want and len(got) > 30


def test_live_health(spark, replayed):
    s, source, folder = replayed
    live.run_updates(live.live_health(source), f"{folder}/h", f"{folder}/hs")
    last = spark.read.parquet(f"{folder}/h").groupBy("recording_id").agg(F.max_by(F.struct("*"), "batch").alias("u")).select("u.*")
    got = {r.recording_id: r for r in last.collect()}
    for a in timestamps.audit_timestamps(s, True).collect():
        r = got[a.recording_id]
        assert (r.sample_count, r.backward_count, r.duplicate_count) == (a.sample_count, a.backward_count, a.duplicate_count)
        assert r.maximum_gap == pytest.approx(a.maximum_gap)
    assert got["r"].late_rows == 10


def test_no_live_window_reaches_over_a_late_row(spark, stream, tmp_path):
    """Row 6 arrives behind row 7: it is dropped, and the windows that need it do not come out."""
    s = stream({"r": [(i * 0.01, float(i), 1) for i in range(14)]}).withColumn("arrival", F.when(F.col("idx") == 6, 10).otherwise(F.col("idx")))
    live.replay_table(s, f"{tmp_path}/in", 5, "arrival", files=1)
    source = spark.readStream.schema(s.withColumn("arrival", F.col("arrival").cast("bigint")).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.run_to_end(live.live_windows(source, WindowSpec(3, 2, 1, 5.0), 0.05), f"{tmp_path}/w", f"{tmp_path}/ws")
    got = sorted((r.origin, [*r.hist_qf, *r.future_qf]) for r in spark.read.parquet(f"{tmp_path}/w").collect())
    assert got == [(o, [float(o + k) for k in range(-2, 3)]) for o in (2, 3, 9, 10, 11)]


def test_rows_wait_for_earlier_ones_of_their_batch(spark, stream, tmp_path, monkeypatch):
    """Files of one micro-batch in any order, in small Arrow batches: nothing is late, windows are whole."""
    s = stream({"r": [(i * 0.01, float(i), 1) for i in range(40)], "q": [(i * 0.01, float(-i), 1) for i in range(25)]})
    for low in (20, 30, 0, 10):
        s.filter((F.col("idx") >= low) & (F.col("idx") < low + 10)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        live.run_to_end(live.live_windows(source, WindowSpec(3, 2, 1, 5.0), 0.05), f"{tmp_path}/w", f"{tmp_path}/ws")
        live.run_updates(live.live_health(source), f"{tmp_path}/h", f"{tmp_path}/hs")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.parquet(f"{tmp_path}/w").groupBy("recording_id").count().collect()
    assert {r["recording_id"]: r["count"] for r in got} == {"r": 36, "q": 21}
    assert {(r.recording_id, r.sample_count, r.late_rows) for r in spark.read.parquet(f"{tmp_path}/h").collect()} == {("r", 40, 0), ("q", 25, 0)}


def test_silent_recordings_end_in_an_available_now_run(spark, stream, tmp_path):
    """The timer tells the counters once and clears the state: rows that come later start anew."""
    s = stream({"r": [(1000 + i, 1, 1) for i in range(10)], "late": [(1100 + i, 1, 1) for i in range(5)], "mark": [(1900, 1, 1)], "r2": [(1950, 1, 1)]})
    for names in (["r"], ["late"], ["mark"], ["r2"]):
        s.filter(F.col("recording_id").isin(names)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.run_to_end(live.live_ends(source, idle="200 seconds", delay="10 seconds"), f"{tmp_path}/e", f"{tmp_path}/es")
    ended = {r.recording_id: r.sample_count for r in spark.read.parquet(f"{tmp_path}/e").collect()}
    assert ended == {"r": 10, "late": 5}  # the last ones are not silent for so long yet
    again = s.filter("recording_id = 'r'").withColumns({"idx": F.col("idx"), "ts_s": F.col("ts_s") + 2000})
    again.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.run_to_end(live.live_ends(source, idle="200 seconds", delay="10 seconds"), f"{tmp_path}/e", f"{tmp_path}/es")
    ended = sorted((r.recording_id, r.sample_count) for r in spark.read.parquet(f"{tmp_path}/e").collect())
    assert ended == [("late", 5), ("mark", 1), ("r", 10), ("r2", 1)]


def test_live_ridge_is_ridge_predict(spark, stream, tmp_path):
    """Every micro-batch reads the newest models; its rows are those of the batch operator; one run again adds none."""
    rng = np.random.default_rng(9)
    s = stream({n: [(i * 0.01, 9.8 + rng.normal(), rng.random()) for i in range(120)] for n in ("r", "q")})
    spec = WindowSpec(6, 3, 2, 5.0)
    columns = "dataset string, recording_id string, evaluation_context string, fold_id string, model string, lag int, scaler_mean array<double>, scaler_std array<double>, coef array<array<double>>, intercept array<double>"

    def models(scale):
        make = lambda name, lag, both: ("A", name, "WITHIN_A", f"f{name}", "B3_RIDGE_QF_QW" if both else "B2_RIDGE_QF", lag, *[rng.random(lag * (1 + both)).tolist() for _ in range(2)], (scale * rng.normal(size=(3, lag * (1 + both)))).tolist(), [1.0, 2.0, 3.0])
        return spark.createDataFrame([make("r", 2, False), make("r", 6, True), make("q", 4, True)], columns).cache()

    live.replay_table(s, f"{tmp_path}/in", 60)
    source = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in")
    first, second = models(1.0), models(2.0)
    assert live.latest_version(spark, f"{tmp_path}/m") is None
    order = ["recording_id", "fold_id", "model", "origin"]
    rows = lambda df: [(*(r[c] for c in order), [round(v, 9) for v in r["yhat"]], r["y"]) for r in df.orderBy(*order).collect()]
    want = windows.build_windows(s, spec, True)
    for version, table in ((1, first), (2, second)):
        assert live.freeze_models(table, f"{tmp_path}/m") == version
        live.run_ridge(live.live_windows(source, spec, 0.05), f"{tmp_path}/m", spec, f"{tmp_path}/p{version}", f"{tmp_path}/ps{version}")
        got = spark.read.parquet(f"{tmp_path}/p{version}")
        assert rows(got) == rows(linear.ridge_predict(want, table, spec)) and {r[0] for r in got.select("model_version").distinct().collect()} == {version}
    assert rows(spark.read.parquet(f"{tmp_path}/p1")) != rows(spark.read.parquet(f"{tmp_path}/p2"))
