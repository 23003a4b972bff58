"""Small inputs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from sensorloom.config import BaselineSpec, WindowSpec
from sensorloom.functions.arrays import lag_slice, linear_extrapolation, persistence
from sensorloom.functions.scalar import filter_order, magnitude, quaternion_wxyz, skill_score
from sensorloom.operators import filtering, timestamps
from sensorloom.operators.linear import window_weights
from sensorloom.operators.metrics import equal_recording_mean, recording_results
from sensorloom.operators.windows import build_windows, window_counts


def ticks(times):
    return [(t, 1.0, 1.0) for t in times]


def test_duplicate_and_backward_steps(stream):
    row = timestamps.audit_timestamps(stream({"r": ticks([0.0, 0.1, 0.1, 0.05, 0.3])}), True).first()
    assert (row.sample_count, row.duplicate_count, row.backward_count, row.strictly_monotonic) == (5, 1, 1, False)


def test_gaps_count_from_the_median(stream):
    row = timestamps.audit_timestamps(stream({"r": ticks([0, 1, 2, 3, 14])}), True).first()
    assert row.median_dt == 1.0
    assert (row.number_gaps_gt_2x_median, row.number_gaps_gt_5x_median, row.number_gaps_gt_10x_median) == (1, 1, 1)
    row = timestamps.audit_timestamps(stream({"r": ticks([0, 0.01, 0.02, 0.03, 0.5])}), True).first()
    assert row.maximum_gap == pytest.approx(0.47)


def test_only_finite_timestamps_count(stream):
    row = timestamps.audit_timestamps(stream({"r": ticks([0.0, math.nan, 0.2, math.inf, 0.4])}), True).first()
    assert row.sample_count == 3


def test_single_row_has_no_steps(stream):
    row = timestamps.audit_timestamps(stream({"r": ticks([7.0])}), True).first()
    assert (row.sample_count, row.strictly_monotonic, row.median_dt, row.number_gaps_gt_2x_median) == (1, False, None, 0)


def test_overlap(stream):
    left = stream({"r": ticks([0, 10]), "s": ticks([0, 10, 30, 40]), "t": ticks([0, 1])})
    right = stream({"r": ticks([5, 20]), "s": ticks([5, 15, 25, 35]), "t": ticks([3, 4]), "u": ticks([0, 1])})
    rows = {r.recording_id: r for r in timestamps.stream_overlap(left, right).collect()}
    assert rows["r"].overlap_s == 5.0 and rows["r"].overlap_fraction == 0.25
    assert rows["s"].overlap_s == 30.0
    assert rows["t"].overlap_s == 0.0 and rows["t"].overlap_fraction == 0.0
    assert rows["u"].overlap_s is None


def test_nanoseconds_keep_their_spacing(spark):
    clock = [1403638128145099776 + i * 5_000_000 for i in range(3)]
    df = spark.createDataFrame([("A", "r", i, c) for i, c in enumerate(clock)], "dataset string, recording_id string, idx bigint, ts_ns bigint")
    assert [r.rel_s for r in timestamps.relative_seconds(df).orderBy("idx").collect()] == [0.0, 0.005, 0.01]
    units = timestamps.clock_units(df, "ts_ns", bounded=True).first()
    assert (units.text_unit, units.asl_unit, units.sorted_label) == ("nanoseconds", "nanoseconds", "nanoseconds_candidate")


def test_window_counts_closed_form(stream):
    row = window_counts(stream({"r": ticks([i * 0.01 for i in range(1000)])}), WindowSpec(), True).first()
    assert (row.candidate_origins, row.excluded_due_to_start, row.valid_origins, row.excluded_due_to_gap) == (200, 20, 176, 0)


def test_window_gap_excludes(stream):
    times = [i * 0.01 + (1.0 if i >= 200 else 0.0) for i in range(400)]
    row = window_counts(stream({"r": ticks(times)}), WindowSpec(), True).first()
    # The jump sits between rows 199 and 200: origins 180..295 have it inside.
    assert row.excluded_due_to_gap == len(range(180, 299, 5))
    assert row.valid_origins + row.excluded_due_to_gap == len(range(100, 380, 5))


def test_window_stuck_clock_is_other(stream):
    times = [i * 0.01 for i in range(400)]
    times[250] = times[249]
    row = window_counts(stream({"r": ticks(times)}), WindowSpec(), True).first()
    assert row.excluded_other > 0


def test_windows_hold_the_right_rows(stream):
    s = stream({"r": [(i * 0.01, i, -i) for i in range(60)]})
    rows = build_windows(s, WindowSpec(10, 4, 5), True).orderBy("origin").collect()
    assert [r.origin for r in rows] == list(range(10, 56, 5))
    for r in rows:
        assert r.hist_qf == [float(i) for i in range(r.origin - 9, r.origin + 1)]
        assert r.hist_qw == [-float(i) for i in range(r.origin - 9, r.origin + 1)]
        assert r.future_qf == [float(i) for i in range(r.origin + 1, r.origin + 5)]


def test_local_forecasts(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.5],), ([0.0, 0.0, 9.0],)], "h array<double>")
    assert [r[0] for r in df.select(persistence(F.col("h"), 2)).collect()] == [[3.5, 3.5], [9.0, 9.0]]
    line = spark.createDataFrame([([2 + 3 * (i - 9) * 0.01 for i in range(10)],)], "h array<double>")
    got = line.select(linear_extrapolation(F.col("h"), 10, 10, 4, 0.01)).first()[0]
    assert got == pytest.approx([2.03, 2.06, 2.09, 2.12], abs=1e-12)
    with pytest.raises(ValueError):
        lag_slice(F.col("h"), 11, 10)


def test_errors_and_means(spark):
    df = spark.createDataFrame([("A", "r", "m", [1.0, 1.0], [1.0, 3.0]), ("A", "r", "m", [3.0, 5.0], [3.0, 5.0]), ("A", "s", "m", [0.0, 0.0], [3.0, 3.0])], "dataset string, recording_id string, model string, yhat array<double>, y array<double>")
    spec, base = WindowSpec(1, 2, 1), BaselineSpec(report_horizons=(1, 2))
    out = recording_results(df, spec, base)
    r = out.filter("recording_id = 'r'").first()
    assert (r.rmse_all_horizons, r.mae_all_horizons, r.n_origins) == (1.0, 0.5, 2)
    assert r.rmse_h02 == pytest.approx(math.sqrt(2))
    assert equal_recording_mean(out, ["model"]).first().mean_rmse_all_horizons == 2.0
    with pytest.raises(ValueError):
        recording_results(df, spec, BaselineSpec())


def test_skill_and_magnitude(spark):
    row = spark.range(1).select(
        skill_score(F.lit(1.0), F.lit(2.0)), skill_score(F.lit(0.0), F.lit(0.0)), skill_score(F.lit(1.0), F.lit(0.0)), magnitude(F.lit(3.0), F.lit(4.0), F.lit(12.0))
    ).first()
    assert tuple(row) == (0.5, 1.0, None, 13.0)


def test_weights_sum_to_one(spark):
    rows = [("A", "a", i) for i in range(2)] + [("A", "b", i) for i in range(8)]
    w = window_weights(spark.createDataFrame(rows, "dataset string, recording_id string, origin bigint"), ["dataset"]).collect()
    assert {r.recording_id: r.weight_sum for r in w} == {"a": 0.5, "b": 0.5}


def test_filter_order_and_decimation(spark, stream):
    df = spark.createDataFrame([([list(s) for s in filtering.SOS_200_HZ],), ([list(s) for s in filtering.SOS_500_HZ],)], "sos array<array<double>>")
    assert [r[0] for r in df.select(filter_order(F.col("sos"))).collect()] == [5, 6]
    kept = filtering.decimate(stream({"r": ticks(range(10))}), 2).orderBy("idx").collect()
    assert [(r.idx, r.native_index) for r in kept] == [(0, 0), (1, 2), (2, 4), (3, 6), (4, 8)]


def test_quaternion_of_half_turns(spark):
    turns = [([1, 0, 0, 0, 1, 0, 0, 0, 1], [1, 0, 0, 0]), ([1, 0, 0, 0, -1, 0, 0, 0, -1], [0, 1, 0, 0]), ([-1, 0, 0, 0, 1, 0, 0, 0, -1], [0, 0, 1, 0]), ([-1, 0, 0, 0, -1, 0, 0, 0, 1], [0, 0, 0, 1])]
    df = spark.createDataFrame([([float(x) for x in r],) for r, _ in turns], "r array<double>")
    assert [r[0] for r in df.select(quaternion_wxyz(F.col("r"))).collect()] == [q for _, q in turns]
