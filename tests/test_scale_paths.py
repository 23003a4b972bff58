"""The routes for groups too large for one task give the same rows as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.config import WindowSpec
from sensorloom.operators import channels, filtering, ordering, windows
from sensorloom.operators.channels import describe_channels
from sensorloom.operators.transfer import domain_shift


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", int(i), float(round(rng.normal(), 1))) for i in rng.permutation(3000)]
    return spark.createDataFrame(rows, "k string, o bigint, v double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_assign_idx(numbers):
    a, b = (ordering.assign_idx(numbers, ["k"], ["v", "o"], bounded=x).select("k", "o", "idx") for x in (True, False))
    assert rows(a, "k", "o") == rows(b, "k", "o")


def test_prefix_sums_and_next(numbers):
    a, b = (ordering.prefix_sums(numbers, ["k"], ["o"], {"s": "o"}, {"n": "v"}, bounded=x).select("k", "o", "s", "n") for x in (True, False))
    assert rows(a, "k", "o") == rows(b, "k", "o")


def test_quantiles_match_numpy(numbers):
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.333, "e": 1.0}
    a, b = (rows(ordering.exact_quantiles(numbers, ["k"], "v", probs, bounded=x), "k") for x in (True, False))
    assert [r[0] for r in a] == [r[0] for r in b]
    local = numbers.toPandas().groupby("k").v
    for x, y in zip(a, b):
        want = np.quantile(local.get_group(x[0]), list(probs.values()))
        assert x[1:] == pytest.approx(want, abs=1e-12) and y[1:] == pytest.approx(want, abs=1e-12)


def test_group_size_probe(numbers):
    assert ordering.groups_are_bounded(numbers, ["k"], 2000)
    assert not ordering.groups_are_bounded(numbers, ["k"], 1999)


@pytest.fixture(scope="module")
def walk(stream):
    rng = np.random.default_rng(2)
    t = np.cumsum(np.where(rng.random(700) < 0.02, 0.05, 0.01))
    t[300] = t[299]
    return stream({"r": list(zip(t, 9.8 + np.cumsum(rng.normal(size=700)) / 10, rng.random(700))), "s": [(i * 0.01, i % 7, 1) for i in range(90)]})


def test_small_blocks_change_nothing(walk, monkeypatch):
    spec = WindowSpec(20, 5, 5)
    big = rows(windows.build_windows(walk, spec, True), "recording_id", "origin")
    status = rows(windows.classify_origins(walk, spec, True), "recording_id", "origin")
    assert {r[-1] for r in status} == set(windows.STATUSES)
    monkeypatch.setattr("sensorloom.config.BLOCK_ROWS", 40)
    assert spec.block_rows == 40
    assert rows(windows.build_windows(walk, spec, False), "recording_id", "origin") == big
    assert rows(windows.classify_origins(walk, spec, False), "recording_id", "origin") == status


def test_filter_blocks_match_one_pass(walk):
    one = rows(filtering.causal_filter(walk.select("dataset", "recording_id", "idx", "q_f", "q_w"), filtering.SOS_200_HZ, block_rows=1 << 20), "recording_id", "idx")
    x = np.array([r[3] for r in one if r[1] == "r"])
    raw = np.array([r.q_f for r in walk.filter("recording_id = 'r'").orderBy("idx").collect()])
    z, y = np.zeros((3, 2)), np.zeros(len(raw))
    for i, v in enumerate(raw):
        for k, (b0, b1, b2, _, a1, a2) in enumerate(filtering.SOS_200_HZ):
            out = b0 * v + z[k, 0]
            z[k] = [b1 * v - a1 * out + z[k, 1], b2 * v - a2 * out]
            v = out
        y[i] = v
    assert np.abs(x - y).max() < 1e-11


def test_filter_halo_forgets(spark):
    memory = filtering.memory_rows(filtering.SOS_200_HZ)
    n = 3 * memory
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("A", "r", i, float(v)) for i, v in enumerate(rng.normal(size=n))], "dataset string, recording_id string, idx bigint, q_f double")
    short = filtering.causal_filter(df, filtering.SOS_200_HZ, ["q_f"], block_rows=1)
    whole = filtering.causal_filter(df, filtering.SOS_200_HZ, ["q_f"], block_rows=1 << 20)
    a, b = (np.array([r.q_f for r in x.orderBy("idx").collect()]) for x in (short, whole))
    assert np.abs(a - b).max() < 1e-12
    with pytest.raises(ValueError):
        filtering.memory_rows([(1.0, 0.0, 0.0, 1.0, -2.0, 1.0)])


def test_distributed_statistics(walk):
    a, b = (rows(describe_channels(walk, ["q_f", "q_w"], x).select("recording_id", "channel", "p01", "median", "p99"), "recording_id", "channel") for x in (True, False))
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-12)


def test_distributed_wasserstein(walk, stream):
    both = walk.unionByName(stream({"z": [(i * 0.01, 8 + i % 4, i % 2) for i in range(120)]}, "B"))
    a, b = (domain_shift(both, "A", "B", x).select("quantity", "wasserstein").orderBy("quantity").collect() for x in (True, False))
    assert [r.wasserstein for r in a] == pytest.approx([r.wasserstein for r in b], abs=1e-12)


def test_wasserstein_of_known_samples(stream):
    both = stream({"a": [(0, v, 1) for v in (0, 1, 3)]}).unionByName(stream({"b": [(0, v, 1) for v in (5, 6, 8)]}, "B"))
    got = {r.quantity: r.wasserstein for r in domain_shift(both, "A", "B", True).collect()}
    assert got["q_f"] == pytest.approx(5.0)


def test_blocks_are_partitioned_by_block(walk):
    plan = windows.build_windows(walk.repartition("dataset", "recording_id"), WindowSpec(20, 5, 5), True)._jdf.queryExecution().toString()
    assert "hashpartitioning(dataset" in plan and "block" in plan.split("hashpartitioning(dataset", 1)[1].split(")")[0]


def test_frames_reach_over_block_ends(walk):
    frame = {"back": F.lag("ts_s").over(ordering.block_window()), "ahead": F.lead("q_f", 3).over(ordering.block_window())}
    small, large = (
        rows(ordering.with_block_columns(walk, frame, 1, 3, block_rows=n).select("recording_id", "idx", "back", "ahead"), "recording_id", "idx")
        for n in (7, 1 << 20)
    )
    assert small == large and len(small) == 790


@pytest.mark.parametrize("build", [lambda s: windows.build_windows(s, WindowSpec(20, 5, 5, 5.0), True), lambda s: channels.autocorrelation(s, (1, 5))])
def test_no_recording_meets_its_facts_in_one_task(spark, stream, build):
    """Without broadcasts, joins of the stream to per-recording facts are salted."""
    s = stream({"r": [(i * 0.01, i % 7, 1) for i in range(200)]})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = build(s)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert any("salt" in line for line in joins)
    assert all(line.count("salt") >= 2 or "idx" in line for line in joins if "Inner" in line)
