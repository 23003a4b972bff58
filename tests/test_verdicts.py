"""Verdict rules on hand-made tables: gain labels and key findings."""

import re

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import classify
from sensorloom.sources import files, tables

FLAGS = "evaluation_context string, model string, mean_delta double, wins bigint, losses bigint, practical_gain boolean, gain_over_seeds boolean"
MEANS = "evaluation_context string, model string, mean_rmse double"
CONTEXTS = ("WA", "WB", "AB", "BA")


def label(spark, rows, errors):
    flags = spark.createDataFrame([(c, "M", -0.1 if w > x else 0.1, w, x, g, s) for c, (w, x, g, s) in zip(CONTEXTS, rows)], FLAGS)
    means = [(c, m, v) for c in CONTEXTS for m, v in (("P", 1.0), ("R", 1.0))] + [(c, "M", e) for c, e in zip(CONTEXTS, errors)]
    r = classify.gain_classification(flags, spark.createDataFrame(means, MEANS), ("WA", "WB"), ("AB", "BA"), "P", "R").first()
    return r.label, r.decision


GAIN, WEAK, NONE = (5, 1, True, True), (5, 1, True, False), (1, 5, False, False)


@pytest.mark.parametrize(
    ("rows", "errors", "want"),
    [
        ([GAIN, GAIN, GAIN, NONE], [0.9] * 4, ("ADVANCED_MODEL_CLEAR_GAIN", "PASS")),
        ([GAIN, NONE, NONE, NONE], [0.9] * 4, ("ADVANCED_MODEL_DOMAIN_SPECIFIC_GAIN", "PASS")),
        ([WEAK, NONE, NONE, NONE], [0.9] * 4, ("ADVANCED_MODELS_UNSTABLE", "PASS")),
        ([NONE, NONE, NONE, NONE], [1.1] * 4, ("RIDGE_REMAINS_COMPETITIVE", "PASS")),
        ([GAIN, NONE, NONE, NONE], [0.9, 1.0, 2.0, 1.0], ("ADVANCED_MODEL_DOMAIN_SPECIFIC_GAIN", "PASS")),
        ([WEAK, NONE, GAIN, NONE], [0.9, 1.0, 0.9, 2.0], ("ADVANCED_MODELS_UNSTABLE", "CONDITIONAL_PASS")),
        ([NONE, NONE, NONE, NONE], [1.0, 1.0, 1.6, 1.0], ("RIDGE_REMAINS_COMPETITIVE", "PASS")),
    ],
)
def test_gain_labels(spark, rows, errors, want):
    assert label(spark, rows, errors) == want


def test_key_findings(spark):
    errors = {"WA": (1.0, 1.01, 1.02, 1.0), "WB": (1.0, 0.9, 0.95, 0.8), "AB": (1.0, 1.01, 1.1, 1.2), "BA": (1.0, 0.95, 0.9, 1.0)}
    means = [(c, m, v) for c, vs in errors.items() for m, v in zip(("R", "CONV", "RECUR", "ATTN"), vs)]
    paired = [("WA", m, -0.005, 4, 4, 0.1) for m in ("CONV", "RECUR", "ATTN")]
    paired += [("WB", "ATTN", -0.2, 7, 1, -0.05), ("AB", "ATTN", 0.2, 1, 7, 0.3), ("BA", "RECUR", -0.1, 5, 3, 0.02)]
    p = spark.createDataFrame(paired, "evaluation_context string, model string, mean_delta double, wins bigint, losses bigint, ci_high double")
    found = classify.key_findings(spark.createDataFrame(means, MEANS), p, "WA", "WB", "AB", "BA", "R", ["CONV", "RECUR", "ATTN"], "CONV", "RECUR", "ATTN")
    assert {r.finding: r.status for r in found.collect()} == dict.fromkeys("ABCDE", "SUPPORTED")
    weak = p.withColumn("ci_high", F.lit(-0.01))
    found = classify.key_findings(spark.createDataFrame(means, MEANS), weak, "WA", "WB", "AB", "BA", "R", ["CONV", "RECUR", "ATTN"], "CONV", "RECUR", "ATTN")
    assert {r.finding: r.status for r in found.collect()}["D"] == "PARTIALLY_SUPPORTED"


def test_calibration_token_and_run_stamp(spark, tmp_path):
    roles = spark.createDataFrame([("a/imu.yaml.bak",), ("a/imu.yaml",), ("a/imu0.csv",)], "path string").select(files.file_role(F.col("path")).alias("r"))
    assert [r.r for r in roles.collect()] == ["calib", "yaml", "imu"]
    tables.append_runs(spark.createDataFrame([("j", 1.0)], "job_id string, loss double"), f"{tmp_path}/log")
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", spark.read.parquet(f"{tmp_path}/log").first().finished_utc)


def test_evidence_class_is_that_of_the_published_decimals(spark, monkeypatch):
    """Before, an interval that ends 3e-7 above zero, published as 0, made another class than its row shows."""
    from sensorloom.plans import statistics

    columns = "model string, n_recordings bigint, wins bigint, losses bigint, mean_delta double, ci_low double, ci_high double, relative_improvement_pct double"
    rows = [("gain", 6, 5, 1, -2e-6, -3e-6, 3e-7, 3e-6), ("none", 6, 2, 4, 4e-7, 3e-7, 5e-7, -1e-6), ("clear", 6, 6, 0, -2.0, -3.0, -1.0, 4.0)]
    monkeypatch.setattr(statistics, "_all", lambda *_: None)
    monkeypatch.setattr(statistics.stats, "paired_comparison", lambda *_, **__: spark.createDataFrame(rows, columns))
    got = {r.model: r.evidence_class[0] for r in statistics.c4(spark, "/root/testdata/sf0.001").collect()}
    assert got == {"gain": "A", "none": "C", "clear": "A"}
