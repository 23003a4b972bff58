"""Python workers hold bounded pieces of their input."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sensorloom.llm import language
from sensorloom.llm.base import blocks, prepare


def test_batches_of_wide_rows_stay_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)], "mb": [batch.nbytes / 2**20]})

    prepare(spark)
    wide = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("word "), 800).alias("text"))
    rows = wide.mapInArrow(sizes, "n long, mb double").collect()
    assert sum(r["n"] for r in rows) == 6000 and max(r["mb"] for r in rows) < 6


def test_vectors_of_short_texts_are_made_in_parts():
    texts = [f"a{'bcdefgh'[k % 7]}" for k in range(10_000)]
    model = language.Model(["x"], np.ones(language.DIMS, np.float32), np.ones((1, language.DIMS), np.float32) / 64, np.zeros(1, np.int64), np.zeros((1, len(language.LENGTHS) + 1)))
    language.classify(texts[:1], model)
    tracemalloc.start()
    told, score, rejected = language.classify(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and told == ["x"] * 10_000 and len(score) == len(rejected) == 10_000
    one = [language.classify([t], model)[1][0] for t in texts[:7]]
    assert np.allclose(score, np.resize(one, 10_000), atol=1e-6)


def test_blocks_hold_every_text_once():
    texts = ["", "ab", "c" * 50, "", "d"] * 40
    for most in (None, 1, 7):
        cuts = list(blocks(texts, 60, most))
        assert [i for a, b in cuts for i in range(a, b)] == list(range(200)) and max(b - a for a, b in cuts) <= (most or 200)
