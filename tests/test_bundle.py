"""Audit bundle on hand-made recordings: missing signals, missing references, bad clocks and cells."""

import pytest

from sensorloom.operators import bundle, classify

NAN = float("nan")


@pytest.fixture(scope="module")
def tables(spark):
    schema = "dataset string, recording_id string, idx bigint, ts_s double, fx double, fy double, fz double, wx double, wy double, wz double"
    row = lambda d, r, i, t, wz=0.5: (d, r, i, float(t), 1.0 * i, 2.0, 3.0, 4.0, 5.0, wz)
    signal = [row("a:b", "good", i, i) for i in range(40)]
    signal += [row("a:b", "bad", i, [0, 1, 1, 0.5, 2][i], NAN if i == 2 else 0.5) for i in range(5)]
    reference = [row("a:b", "good", i, 10 + i) for i in range(50)] + [row("a:b", "lost", i, i) for i in range(3)]
    both = bundle.both_kinds(spark.createDataFrame(signal, schema), spark.createDataFrame(reference, schema))
    audits, axes = bundle.stream_audits(both, True), bundle.axis_audits(both, bounded=True)
    return audits, axes


def test_audits_and_overlap(tables):
    audits = {(r.recording_id, r.kind): r for r in tables[0].collect()}
    assert set(audits) == {("good", "imu"), ("good", "reference"), ("bad", "imu"), ("lost", "reference")}
    assert all(r.dataset == "a:b" for r in audits.values()), "a dataset may hold the separator"
    good = audits["good", "imu"]
    assert (good.overlap_s, good.sample_count, good.strictly_monotonic) == (29.0, 40, True) and good.overlap_fraction == pytest.approx(29 / 59)
    assert audits["good", "reference"].overlap_s is None and audits["bad", "imu"].overlap_s is None
    assert (audits["bad", "imu"].backward_count, audits["bad", "imu"].duplicate_count) == (1, 1)


def test_axes(tables):
    axes = {(r.recording_id, r.kind, r.channel): r for r in tables[1].collect()}
    assert len(axes) == 4 * 6
    assert axes["bad", "imu", "wz"].nonfinite_count == 1 and axes["bad", "imu", "fy"].constant_fraction == 1.0


def test_findings(spark, tables):
    audits, axes = tables
    recordings = audits.select("dataset", "recording_id").union(spark.createDataFrame([("a:b", "gone")], "dataset string, recording_id string"))
    found = {(r.recording_id, r.check_id): r for r in bundle.bundle_findings(recordings, audits, axes).collect()}
    assert {k[1] for k in found if k[0] == "good"} == {"MONOTONIC", "REFERENCE_MONOTONIC", "FINITE", "OVERLAP"}
    assert all(found["good", c].status == "PASS" and found["good", c].severity == "INFO" for c in ("MONOTONIC", "REFERENCE_MONOTONIC", "FINITE", "OVERLAP"))
    assert {k[1] for k in found if k[0] == "bad"} == {"MONOTONIC", "FINITE", "OVERLAP"}
    assert found["bad", "MONOTONIC"].observed == "backward=1 dup=1" and found["bad", "MONOTONIC"].severity == "WARNING"
    assert found["bad", "FINITE"].observed == "finite_fraction=0.933333" and found["bad", "FINITE"].action_required == "exclude"
    assert found["bad", "OVERLAP"].observed == "overlap_s=0.000000"
    assert {k[1] for k in found if k[0] == "lost"} == {k[1] for k in found if k[0] == "gone"} == {"SIGNAL_MISSING"}
    assert found["gone", "SIGNAL_MISSING"].severity == "CRITICAL"


def test_detailed_findings_without_archives(spark):
    row = ("a", "r", 5, True, "HEADER_MAPPED", 1.0, 0, False, None, None)
    names = "dataset string, recording_id string, n_samples bigint, has_calibration boolean, layout string, finite_fraction_required double, backward_count bigint, accel_constant boolean, n_reference bigint, overlap_s double"
    found = {r.check_id: r for r in classify.detailed_findings(spark.createDataFrame([row], names)).collect()}
    assert set(found) == {c for c, _, _ in classify.AUDIT_CHECKS}
    assert (found["GT_READABLE"].observed, found["GT_READABLE"].action_required) == ("missing", "EXCLUDE")
    plain = {r.check_id: (r.severity, r.status) for r in classify.audit_findings(spark.createDataFrame([row], names)).collect()}
    assert {k: (r.severity, r.status) for k, r in found.items()} == plain
