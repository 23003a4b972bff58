"""Centroid clustering and whitening against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import centroids, whitening
from sensorloom.llm.base import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, cluster int, distance string, n string, near string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "i", "x", 5, "d", "n", "q") for i, v in rows], SCHEMA)


def odd_rows(dims, seed=4):
    """Clusters, repeated rows, ties and vectors that are left out."""
    rng = random.Random(seed)
    good = [(i, [rng.gauss(i % 3, 0.5) for _ in range(dims)]) for i in range(60)]
    good += [good[0], good[0], (None, good[5][1]), (70, [0.0] * dims), (71, [-0.0] * dims), (72, [1e-9] * dims), (73, [-1e-9] * dims)]
    bad = [(80, None), (81, []), (82, [1.0] * (dims - 1)), (83, [1.0] * (dims - 1) + [None]), (84, [float("nan")] * dims), (85, [1.0] * (dims - 1) + [float("-inf")])]
    return good, bad


def floors(v):
    return [math.floor(float(np.float32(a)) * 256) for a in v]


def plain_clusters(rows, k, rounds, seed):
    xs = [(i, floors(v)) for i, v in rows]
    order = sorted(xs, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centre = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        members = {}
        for _, x in xs:
            members.setdefault(near(x)[1], []).append(x)
        centre = [[sum(c) // len(members[n]) for c in zip(*members[n])] if n in members else centre[n] for n in range(len(centre))]
    found = [(i, *near(x)[::-1]) for i, x in xs]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, n, d in found)


@pytest.mark.parametrize(("k", "rounds"), [(7, 5), (7, 1), (500, 2), (1, 3)])
def test_clusters_are_the_plain_ones(spark, k, rounds):
    good, bad = odd_rows(6)
    got = centroids.cluster(frame(spark, good + bad), "vec_id", "embedding", 6, k, rounds).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(good, k, rounds, 2)


def test_cluster_query_on_the_tables(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op11_centroid_clusters"](spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows, 40, 5, 2)


def test_vectors_at_the_bound_and_empty_tables(spark):
    far = [(1, [3e38] * 4), (2, [-3e38] * 4), (3, [0.0] * 4)]
    got = {r["id"]: r for r in centroids.cluster(frame(spark, far), "vec_id", "embedding", 4, 1, 1).collect()}
    assert got[1]["distance"] == 4 * (centroids.LIMIT - 0) ** 2 == got[2]["distance"] and got[3]["distance"] == 0
    for rows in ([], odd_rows(6)[1]):
        out = centroids.cluster(frame(spark, rows), "vec_id", "embedding", 6)
        assert out.collect() == [] and out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_rounds_are_plain_expressions(spark):
    vectors = centroids.integer_vectors(frame(spark, odd_rows(6)[0]), "vec_id", "embedding", 6)
    plan = centroids.assign(vectors, [[1] * 6, [2] * 6])._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Exchange", "Join"))


# --- whitening ---------------------------------------------------------------------


def plain_whitening(rows, k):
    """Every figure from the covariance of the distinct vectors; components up to sign."""
    xs = [(i, floors(v)) for i, v in rows]
    once = sorted({tuple(x) for _, x in xs})
    a = np.array(once, float)
    n, sums = len(once), [sum(c) for c in zip(*once)]
    centred = a - a.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = {x: sum((n * p - s) ** 2 for p, s in zip(x, sums)) for x in once}
    white = {x: [(np.array(x) - a.mean(0)) @ v[:, j] / math.sqrt(e[j]) for j in range(k)] for x in once}
    return n, deviation, white, e[:k] / e.sum(), [(i, tuple(x)) for i, x in xs]


def test_whitening_is_the_eigenvector_form(spark):
    good, bad = odd_rows(6)
    got = whitening.whiten(frame(spark, good + bad), "vec_id", "embedding", 4).collect()
    n, deviation, white, explained, xs = plain_whitening(good, 4)
    assert Counter((r["id"], r["deviation"]) for r in got if r["component"] == 1) == Counter((i, deviation[x]) for i, x in xs)
    assert len(got) == 4 * len(xs) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    for c in range(1, 5):
        mine = sorted((deviation_, w) for deviation_, w in ((r["deviation"], r["whitened"]) for r in got if r["component"] == c))
        theirs = sorted((deviation[x], white[x][c - 1]) for _, x in xs)
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(mine, theirs)))
        assert np.allclose([a[1] for a in mine], [sign * b[1] for b in theirs], atol=1e-9)
        assert {round(r["explained"], 12) for r in got if r["component"] == c} == {round(explained[c - 1], 12)}


def test_small_directions_keep_their_precision(spark):
    """Spread over eight orders of magnitude in one direction; the fourth eigenvalue is 1e-13 of the first."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    x = np.rint((rng.normal(size=(400, 5)) * [3e8, 1e6, 1e4, 100, 10]) @ basis.T).astype(int)
    df = spark.createDataFrame([(i, [float(v) / 256 for v in r]) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, "vec_id", "embedding", 4).collect()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    for c in range(4):
        value = next(r["explained"] for r in got if r["component"] == c + 1)
        assert abs(value / (s[c] ** 2 / (s**2).sum()) - 1) < 1e-6
    assert got[0]["identity_error"] < 1e-4
    assert all(r["deviation"] is None or r["deviation"] < 1 << 63 for r in got)


def test_vectors_without_spread_have_no_components(spark):
    flat = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]  # one direction only
    got = whitening.whiten(frame(spark, flat), "vec_id", "embedding", 4).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10 and abs(got[0]["explained"] - 1) < 1e-12
    for rows in ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], [], [(1, None), (2, [])]):
        out = whitening.whiten(frame(spark, rows), "vec_id", "embedding", 4)
        assert out.collect() == [] and out.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    mixed = whitening.whiten(frame(spark, [*flat, (90, [1.0])]), "vec_id", "embedding", 4)
    assert mixed.where(F.col("id") == 90).count() == 0


def test_whitening_query_on_the_tables(spark, sf):
    got = QUERIES["op12_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    assert len(rows) == 4 * spark.read.parquet(f"{sf}/embeddings.parquet").count() and rows[0]["identity_error"] < 1e-10


def test_large_counts_give_exact_deviations():
    x, sums, n = np.array([[1 << 35, -3], [5, 7]]), [123456789, -77], 10**6
    assert whitening.deviations(x, n, sums) == [None, (n * 5 - sums[0]) ** 2 + (n * 7 + 77) ** 2]
    small = np.array([[3, 4]])
    assert whitening.deviations(small, 10, [1, 2]) == [29**2 + 38**2]
