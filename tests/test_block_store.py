"""Ordered operators over the stored block layout: same rows, no shuffle of the stream."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.operators import filtering, ordering
from sensorloom.operators.timestamps import audit_timestamps, native_steps
from sensorloom.operators.windows import build_windows, classify_origins, high_thresholds, window_counts
from sensorloom.sources import testdata as td
from sensorloom.sources.tables import write_blocks

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    return td.streams(spark, D).select(*RECORDING, "dependency_group", "idx", "ts_s", "q_f", "q_w", F.col("idx").alias("native_index")).cache()


def store(plain, tmp, before, after, rows=32):
    return write_blocks(plain, f"t_{uuid.uuid4().hex}", before, after, rows, 4, f"{tmp}/{uuid.uuid4().hex}")


def rows(df):
    return sorted(map(str, df.collect()))


def stream_exchanges(df):
    """Exchanges by block or by recording and salt in the first plan: what moves a whole stream."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(.*(block|salt)", line)]


def test_windows_steps_and_audit_start_without_a_shuffle(spark, plain, tmp_path):
    stored = store(plain, tmp_path, 12, 6)
    assert ordering.stored_halo(stored) == {"before": 12, "after": 6, "rows": 32} and stored.filter("not own").count() > 0
    assert rows(ordering.own_rows(stored).select(plain.columns)) == rows(plain)
    pairs = [
        (native_steps(stored).select(*RECORDING, "idx", "dt"), native_steps(plain).select(*RECORDING, "idx", "dt")),
        (classify_origins(stored, td.SPEC, True), classify_origins(plain, td.SPEC, True)),
        (build_windows(stored, td.SPEC, True), build_windows(plain, td.SPEC, True)),
    ]
    for got, want in pairs:
        assert not stream_exchanges(got) and stream_exchanges(want)
        assert rows(got) == rows(want)
    assert rows(window_counts(stored, td.SPEC, True)) == rows(window_counts(plain, td.SPEC, True))
    assert rows(high_thresholds(stored, bounded=True)) == rows(high_thresholds(plain, bounded=True))
    counts = ["sample_count", "backward_count", "duplicate_count", "maximum_gap", "median_dt", "number_gaps_gt_5x_median"]
    assert rows(audit_timestamps(stored, True).select(*RECORDING, *counts)) == rows(audit_timestamps(plain, True).select(*RECORDING, *counts))


def test_filter_starts_on_the_stored_blocks(plain, tmp_path):
    sos = filtering.SOS_200_HZ
    columns = [*RECORDING, "idx", "q_f"]
    stored = store(plain, tmp_path, filtering.memory_rows(sos), 0, 64)
    got = filtering.causal_filter(stored.select(*columns, "block", "own"), sos, ["q_f"])
    assert got.columns == columns and not stream_exchanges(got)
    want = {(r.dataset, r.recording_id, r.idx): r.q_f for r in filtering.causal_filter(plain.select(*columns), sos, ["q_f"]).collect()}
    found = {(r.dataset, r.recording_id, r.idx): r.q_f for r in got.collect()}
    assert found.keys() == want.keys()
    assert max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_narrow_halo_is_cut_anew(plain, tmp_path):
    """A frame wider than the stored halo is right too; it costs the shuffle of a plain table."""
    stored = store(plain, tmp_path, 2, 1)
    got = build_windows(stored, td.SPEC, True)
    assert stream_exchanges(got) and rows(got) == rows(build_windows(plain, td.SPEC, True))


def test_many_facts_are_joined(plain, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_FACTS", 3)
    stored = store(plain, tmp_path, 12, 6)
    assert rows(build_windows(stored, td.SPEC, True)) == rows(build_windows(plain, td.SPEC, True))


def test_empty_streams(plain, tmp_path):
    stored = store(plain.limit(0), tmp_path, 12, 6)
    assert native_steps(stored).count() == 0 and build_windows(stored, td.SPEC, True).count() == 0
