"""Pairwise quality ranking: held-out accuracy, the threshold against a sort, odd tables."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sensorloom.llm import quality
from sensorloom.llm.base import QUERIES

SF = "/root/testdata/sf0.01"


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 9)))
    good = lambda: ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(rng.randint(1, 9)))
    bad = lambda: " | ".join(word().upper() + rng.choice(["!!", "###", "$$$"]) for _ in range(rng.randint(5, 60)))
    return [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]


def test_held_out_documents_of_the_tables(spark, sf):
    """Judged on the fold that trains nothing; the query's own fold rule, columns and range."""
    got = QUERIES["op13_quality_ranking"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held)


def test_ranking_and_threshold(spark):
    data = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    model = quality.fit(docs, labels, per_class=60)
    strengths = quality.with_strength(docs, model)
    cut = quality.threshold(strengths, labels)
    known = sorted(r["strength"] for r in strengths.collect())
    bad = sum(1 for _, _, q in data if q == 0)
    assert known[bad - 1] - quality.STEP <= cut <= known[bad] + quality.STEP  # the quantile of a plain sort
    model.threshold = cut
    out = {r["doc_id"]: r for r in quality.classify(strengths, model).collect()}
    assert all(out[i]["predicted"] == q for i, _, q in data)
    again = quality.fit(docs.repartition(7), labels, per_class=60)
    assert np.array_equal(again.weight, model.weight)


def test_pairs_and_gradient_are_the_written_loss():
    up, down = quality.preferences(np.arange(3), np.arange(3, 8), 4, 1)
    assert len(up) == len(down) == 20 and set(up) == {0, 1, 2} and set(down) == {3, 4, 5, 6, 7}
    texts, y = ["aa bb", "cc dd", "### $$", "!!"], np.array([1, 1, 0, 0])
    model = quality.train(texts, y, 3, 0.05, 60)
    s = quality.strength(texts, model)
    assert min(s[:2]) > max(s[2:])


def test_whole_texts_count(spark):
    r, c, v = quality.features(["ab" * 300_000 + "Z"])
    plain = quality.features(["ab" * 300_000])
    assert len(set(c) - set(plain[1])) >= 1 and np.isclose((v[c < 1 << quality.BITS] ** 2).sum(), len(quality.SIZES), rtol=1e-3)


def test_odd_documents(spark, odd_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, 1, 0), (7, 1, None), (8, 0, 0), (10, None, 0), (4, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels)
    strengths = quality.with_strength(odd_docs.withColumn("strength", F.lit("old")), model)
    model.threshold = quality.threshold(strengths, labels)
    rows = quality.classify(strengths.drop("score"), model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert quality.fit(odd_docs, labels.where("quality = 1")) is None and quality.fit(odd_docs.where("false"), labels) is None
    assert {(r["score"], r["predicted"]) for r in quality.classify(odd_docs.drop("score").withColumn("strength", F.lit(0.0)), None).collect()} == {(0.5, 1)}


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["op13_quality_ranking"](spark, str(tmp_path)).count() == 0
