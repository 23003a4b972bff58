"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features: hashed n-grams of 3 to 8 characters of the lower-cased text, where non-letters are
blanks, valued log2(1 + occurrences). Each value is scaled by the log-count ratio
r = log((p + 1) / |p| : (q + 1) / |q|) of toxic and clean training texts, and a logistic regression
with L2 penalty is fitted on those n-grams whose ratio differs from 0 by `least_z` standard errors. Both are learned from a bounded sample of labelled documents
(`positives`, `negatives`, parameters), chosen by hash of doc_id; the intercept is corrected for the
share of toxic documents among all labelled ones. Scoring reads whole texts.

Defined cases: null or empty text -> the score of a text without features; a null label is no training
row, and of several labels for one document the largest counts; without both classes the score is 0 for
every text; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import blocks, codes, fold, letters, query, table, texts_of, unit_hash

BITS = 18
SIZES = (3, 4, 5, 6, 7, 8)


@dataclass
class Model:
    weight: np.ndarray  # one per hashed n-gram; most are 0
    bias: float


def grams(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram number, value), sorted; only n-grams flagged in `wanted` if given."""
    c, starts = codes([t.lower() for t in texts], SIZES[-1] - 1)
    c = np.where(letters()[c], c, np.where(c == 0, 0, 32)).astype(np.uint32)
    first, last = starts[0], starts[-1]
    body = c[first:last]
    inside = body != 0
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, np.diff(starts))
    h, found = body.copy(), []
    for n in range(2, SIZES[-1] + 1):
        h = h * np.uint32(0x01000193) + c[first + 1 - n : last + 1 - n]
        if n < SIZES[0]:
            continue
        at = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - BITS)
        keep = inside if wanted is None else inside & wanted[at]
        found.append(row[keep] | at[keep])
    pairs, tf = np.unique(np.concatenate(found), return_counts=True)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), np.log2(1.0 + tf).astype(np.float32)


def train(texts: list[str], toxic: np.ndarray, prior: float, least_df: int, least_z: float, penalty: float, rounds: int) -> Model:
    """Fit on the sample. `prior`: share of toxic documents among all labelled ones."""
    p, q, df = np.ones(1 << BITS), np.ones(1 << BITS), np.zeros(1 << BITS)
    for a, b in blocks(texts, 500_000):  # first the ratios, then only the chosen features are kept
        row, col, value = grams(texts[a:b])
        bad = toxic[row + a] == 1
        p += np.bincount(col[bad], value[bad], 1 << BITS)
        q += np.bincount(col[~bad], value[~bad], 1 << BITS)
        df += np.bincount(col, minlength=1 << BITS)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    chosen = (df >= least_df) & (np.abs(ratio) / np.sqrt(1 / p + 1 / q) >= least_z)
    rows, cols, values = [], [], []
    for a, b in blocks(texts, 500_000):
        row, col, value = grams(texts[a:b], chosen)
        rows.append((row + a).astype(np.int32))
        cols.append(col.astype(np.int32))
        values.append(value)
    row, col = np.concatenate(rows), np.concatenate(cols)
    x = np.concatenate(values) * ratio[col].astype(np.float32)
    n, y = len(texts), toxic.astype(np.float64)
    w, b = np.zeros(1 << BITS), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    m1, m2, c1, c2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):  # Adam on the whole sample
        margin = np.bincount(row, x * w[col], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        g, gb = np.bincount(col, x * error[row], minlength=1 << BITS) + penalty * w / n, error.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        fix1, fix2, rate = 1 - 0.9**step, 1 - 0.99**step, 0.02
        w -= rate * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-8)
        b -= rate * (c1 / fix1) / (np.sqrt(c2 / fix2) + 1e-8)
    share = y.mean()
    b += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    weight = (w * ratio).astype(np.float32)
    weight[np.abs(weight) < 0.01 * np.abs(weight).max()] = 0  # too small to matter; spares their look-up
    return Model(weight, float(b))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 2500, negatives: int = 5000, least_df: int = 4, least_z: float = 4.0, penalty: float = 1.0, rounds: int = 80) -> Model | None:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic).

    At most about `positives` + `negatives` labelled documents are read into the one fitting task.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return None
    share = F.when(F.col("toxic") == 1, positives / n[1]).otherwise(negatives / n[0])
    drawn = known.where(F.col("toxic").isin(0, 1) & (unit_hash("doc_id", seed=3) < share))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    prior = n[1] / (n[0] + n[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += texts_of(batch)
            toxic += batch.column(1).to_pylist()
        if len(set(toxic)) == 2:
            m = train(texts, np.array(toxic), prior, least_df, least_z, penalty, rounds)
            yield pa.RecordBatch.from_pydict({"weight": [m.weight.tobytes()], "bias": [m.bias]})

    made = rows.repartition(1).mapInArrow(run, "weight binary, bias double").collect()
    return Model(np.frombuffer(made[0]["weight"], np.float32), made[0]["bias"]) if made else None


def score(texts: list[str], model: Model | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    out, wanted = [np.zeros(0)], model.weight != 0
    for a, b in blocks(texts, 500_000):
        row, col, value = grams(texts[a:b], wanted)
        margin = np.bincount(row, model.weight[col] * value, minlength=b - a) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(margin, -500, 500))))
    return np.concatenate(out)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs` with score and predicted appended (older ones of those names go)."""
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(texts_of(batch), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return classify(rows, model).select("doc_id", "held_out", "score", "predicted")
