"""Quality by Bradley-Terry pairwise ranking.

Each document has a strength, linear in its features; a good document is preferred to a bad one with
probability 1 / (1 + exp(bad - good)). The weights are learned by logistic loss on feature differences of
preference pairs: `rounds_of_pairs` times, every sampled bad document meets a sampled good one, and every good one a bad
one, drawn by a seeded permutation. A document is then judged by its strength against a threshold, the quantile of the
strengths of all labelled training documents (not only the sample) below which as large a share lies as is labelled
bad; score = 1 / (1 + exp(threshold - strength)), the probability of being preferred to a document at the threshold.

Features of a whole text: shares of hashed character n-grams of 1 to 4 (letters by case class within longer n-grams kept as
they are), as square roots so that frequent ones do not drown the rest, and the SHAPES: shares of letters, capitals, digits,
marks, blanks and lines, length of words, share of repeated lines and words.

Learned from at most about `per_class` documents of each label (a parameter), chosen by hash of doc_id. The threshold is
read from a histogram of STEP-wide strengths over every labelled training row.

Defined cases: null or empty text -> the score of a text without features; a null label is no training row, and of
several labels for one document the largest counts; without both classes every score is 0.5 (predicted 1); repeated rows are scored
alike; a null doc_id is scored and has no label; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import blocks, codes, fold, letters, query, table, texts_of, unit_hash
from sensorloom.session import materialise

BITS = 16
SIZES = (1, 2, 3, 4)
#: Share of capitals, digits, marks, blanks, line ends, other letters; mean word length; repeated lines; repeated words; log length.
SHAPES = 10
WIDTH = (1 << BITS) + SHAPES
STEP = 1 / 64


@dataclass
class Model:
    weight: np.ndarray
    threshold: float = 0.0


def shapes(text: str) -> list[float]:
    """Figures of one whole text."""
    n = len(text)
    if not n:
        return [0.0] * SHAPES
    capitals, digits, blank = sum(map(str.isupper, text)), sum(map(str.isdigit, text)), sum(map(str.isspace, text))
    alpha, ends, words, lines = sum(map(str.isalpha, text)), text.count("\n"), text.split(), [x for x in text.split("\n") if x.strip()]
    return [
        capitals / n, digits / n, (n - alpha - digits - blank) / n, blank / n, ends / n, (alpha - capitals) / n,
        min(2.0, (n - blank) / max(1, len(words)) / 10), 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / max(1, len(words)), np.log1p(n) / 20,
    ]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature number, value), n-grams first."""
    c, starts = codes(texts, SIZES[-1] - 1)
    first, last = starts[0], starts[-1]
    body = c[first:last]
    inside = body != 0
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, np.diff(starts))
    length = np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))
    h, found = np.zeros(len(body), np.uint32), []
    for n in SIZES:
        h = h * np.uint32(0x01000193) + c[first + 1 - n : last + 1 - n]
        at = ((h ^ (h >> np.uint32(13))) * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - BITS)
        found.append(row[inside] | at[inside])
    pairs, count = np.unique(np.concatenate(found), return_counts=True)
    r, col = pairs >> BITS, pairs & ((1 << BITS) - 1)
    value = np.sqrt(count / length[r])
    figures = np.array([shapes(t) for t in texts]).reshape(len(texts), SHAPES)
    at = np.repeat(np.arange(len(texts)), SHAPES)
    return np.concatenate([r, at]), np.concatenate([col, np.tile(np.arange(1 << BITS, WIDTH), len(texts))]), np.concatenate([value, figures.ravel()]).astype(np.float32)


def preferences(good: np.ndarray, bad: np.ndarray, times: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other) document numbers: each document meets one of the other class in every round."""
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad))
    deal = lambda x: np.concatenate([rng.permutation(x) for _ in range(-(-n // len(x)))])[:n]
    drawn = [(deal(good), deal(bad)) for _ in range(times)]
    return np.concatenate([a for a, _ in drawn]), np.concatenate([b for _, b in drawn])


def train(texts: list[str], quality: np.ndarray, times: int, penalty: float, steps: int, seed: int = 13) -> Model:
    """Weights that rank the sample's good documents above its bad ones."""
    parts = []
    for a, b in blocks(texts, 500_000):
        r, c, v = features(texts[a:b])
        parts.append(((r + a).astype(np.int32), c.astype(np.int32), v))
    row, col, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = len(texts)
    up, down = preferences(np.flatnonzero(quality == 1), np.flatnonzero(quality == 0), times, seed)
    w, m1, m2 = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for step in range(1, steps + 1):  # Adam over all pairs
        s = np.bincount(row, value * w[col], minlength=n)
        lost = 1 / (1 + np.exp(np.clip(s[up] - s[down], -30, 30))) / len(up)  # slope of log(1 + exp(-difference))
        pull = np.bincount(down, lost, minlength=n) - np.bincount(up, lost, minlength=n)
        g = np.bincount(col, value * pull[row], minlength=WIDTH) + penalty * w / n
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(w.astype(np.float32))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and quality (0 or 1), one row per document."""
    return labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, times: int = 8, penalty: float = 0.05, steps: int = 120) -> Model | None:
    """Weights from documents (doc_id, text) and labels (doc_id, quality), without a threshold.

    At most about 2 * `per_class` labelled documents are read into the one fitting task.
    """
    known = labelled(labels)
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return None
    share = F.when(F.col("quality") == 1, per_class / n[1]).otherwise(per_class / n[0])
    drawn = known.where(unit_hash("doc_id", seed=13) < share)  # bounded by per_class, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, quality = [], []
        for batch in batches:
            texts += texts_of(batch)
            quality += batch.column(2).to_pylist()
        if len(set(quality)) == 2:
            order = sorted(range(len(texts)), key=lambda i: (texts[i], quality[i]))  # whatever order the shuffle gave
            m = train([texts[i] for i in order], np.array([quality[i] for i in order]), times, penalty, steps)
            yield pa.RecordBatch.from_pydict({"weight": [m.weight.tobytes()]})

    made = rows.repartition(1).mapInArrow(run, "weight binary").collect()
    return Model(np.frombuffer(made[0]["weight"], np.float32)) if made else None


def strength(texts: list[str], model: Model) -> np.ndarray:
    out = [np.zeros(0)]
    for a, b in blocks(texts, 500_000):
        r, c, v = features(texts[a:b])
        out.append(np.bincount(r, model.weight[c] * v, minlength=b - a))
    return np.concatenate(out)


def with_strength(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with strength appended (an older one of that name goes)."""
    docs = docs.drop("strength")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strength(texts_of(batch), held.value))], [*batch.schema.names, "strength"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, strength double")


def threshold(strengths: DataFrame, labels: DataFrame) -> float:
    """Quantile of the labelled documents' strengths (doc_id, strength) at the share of bad labels.

    It lies in the middle of the STEP in which that share is reached, or of the empty stretch behind it.
    """
    steps = strengths.join(labelled(labels), "doc_id").groupBy(F.floor(F.col("strength") / STEP).alias("at")).agg(F.count("*").alias("n"), F.sum(1 - F.col("quality")).alias("bad"))
    rows = sorted((r["at"], r["n"], r["bad"]) for r in steps.collect())  # as many rows as steps between the least and the largest strength
    if not rows:
        return 0.0
    wanted, seen = sum(r[2] for r in rows), 0
    for k, (at, n, _) in enumerate(rows):
        seen += n
        if seen >= wanted:
            end = rows[k + 1][0] if seen == wanted and k + 1 < len(rows) else at + 1
            start = at + 1 if seen == wanted else at
            return (start + end) / 2 * STEP
    return 0.0


def classify(strengths: DataFrame, model: Model | None) -> DataFrame:
    """score and predicted from strength."""
    score = 1 / (1 + F.exp(F.lit(model.threshold) - F.col("strength"))) if model else F.lit(0.5)
    return strengths.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op13_quality_ranking")
def op13_quality_ranking(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    taught = labels.where(fold(F.col("doc_id"), 3) != 1)
    model = fit(docs, taught)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    if model is None:
        return classify(rows.drop("text"), None)
    strengths = materialise(with_strength(rows, model).drop("text"), "quality-strength")
    model.threshold = threshold(strengths, taught)
    return classify(strengths, model).select("doc_id", "held_out", "score", "predicted", "strength")
