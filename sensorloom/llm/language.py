"""Language identification by nearest centroid over TF-IDF character n-grams.

Vectors: letters lower-cased, all else one blank, n-grams of 1 to 3 characters hashed to DIMS
counters, (1 + log tf) * idf, scaled to length 1. Document frequencies come from every training
document. Each language gets a few centroids by spherical k-means over a bounded hash sample of
its documents (`sample`, a parameter). A text takes the language of the centroid with the largest
cosine. Rejection by distance: the cosine is below the low `quantile` of the cosines that all training
texts of the same language and length class have to their own language, read from histograms of BINS
steps; a sampled text is held against its centroid without itself. Where a class has too few texts to
show that quantile, the limit is the lower of its lowest cosine and the normal quantile of its mean and
deviation, and a class of under FEW texts takes that of all languages. A text without a letter is `und`.

Defined cases: null or letterless text -> lang_pred 'und', score 0, rejected; a null language is no
training row; with no training rows at all everything is 'und'; repeated rows are scored alike;
other columns are ignored; ties between centroids go to the language first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import blocks, codes, fold, letters, query, table, texts_of, unit_hash

DIMS = 1 << 12
#: Vectors are made of so many code points and so many texts at a time: a vector takes DIMS numbers, however short its text.
VECTOR_CHARS, VECTOR_TEXTS = 500_000, 512
SALTS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: Upper ends of the length classes (letters) whose distances are judged apart.
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Steps of the cosine histograms, from 0 to 1.
BINS = 1000
#: A length class of a language with fewer training texts says nothing about its own tail.
FEW = 20


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per cluster
    owner: np.ndarray  # language number of each cluster
    least: np.ndarray  # languages x length classes


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x DIMS) and the number of letters of each text."""
    lowered = [t.lower() for t in texts]
    c, starts = codes(lowered, 2)
    is_letter = letters()[c]
    c = np.where(is_letter, c, np.where(c == 0, 0, 32)).astype(np.uint32)
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMS, sizes)
    body = slice(starts[0], starts[-1])
    total = np.zeros(len(texts) * DIMS, np.int64)
    h = c[body].copy()
    for n, salt in enumerate(SALTS, 1):
        if n > 1:
            h = h * np.uint32(0x01000193) + c[starts[0] + 1 - n : starts[-1] + 1 - n]
        keep = c[body] != 0
        at = ((h * np.uint32(salt)) ^ (h >> np.uint32(7))) * np.uint32(0x2545F491) >> np.uint32(20)
        total += np.bincount(row[keep] + at[keep], minlength=len(total))
    letter_counts = np.add.reduceat(is_letter[body].astype(np.int64), starts[:-1] - starts[0]) if len(texts) else np.zeros(0, np.int64)
    return total.reshape(len(texts), DIMS), letter_counts


def vectors(count_rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count_rows.astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def length_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, n, side="left")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        texts = texts_of(batch)
        for a, b in blocks(texts, VECTOR_CHARS, VECTOR_TEXTS):
            seen += (counts(texts[a:b])[0] > 0).sum(0)
            n += b - a
    yield pa.RecordBatch.from_pydict({"dim": np.arange(-1, DIMS), "df": np.concatenate(([n], seen))})


def clusters(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from rows spread by farthest-first choice, so it is repeatable."""
    chosen = [int(np.argmax(v @ v.mean(0)))]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[chosen[-1]])
    centre = v[chosen]
    for _ in range(rounds):
        to = np.argmax(v @ centre.T, 1)
        sums = np.stack([v[to == j].sum(0) if (to == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return centre


def own_cosines(v: np.ndarray, centre: np.ndarray, weight: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Largest cosine of each row to the centroids; a sampled row is first taken out of its nearest one (`weight`: length of its sum)."""
    cosine = v @ centre.T
    at, i = cosine.argmax(1), np.arange(len(v))
    s, c = weight[at], cosine[i, at]
    rest = np.sqrt(np.maximum(s * s - 2 * s * c + 1, 0))
    without = np.where(rest > 1e-3, (s * c - 1) / np.maximum(rest, 1e-3), 0)
    cosine[i, at] = np.where(sampled, without, c)
    return np.clip(cosine.max(1), 0, 1)


def limits(histogram: np.ndarray, quantile: float) -> np.ndarray:
    """Lowest accepted cosine (languages x length classes) from counts (languages x length classes x BINS)."""
    edge, z = np.arange(BINS) / BINS, NormalDist().inv_cdf(quantile)

    def limit(h: np.ndarray) -> float:
        n = h.sum()
        low = edge[np.searchsorted(np.cumsum(h), max(1.0, quantile * n))]
        if n * quantile >= 1:
            return low
        mean = (h * edge).sum() / n
        return max(0.0, min(low, mean + z * np.sqrt((h * (edge - mean) ** 2).sum() / (n - 1))))

    pooled = histogram.sum(0)
    out = np.full(histogram.shape[:2], np.nan)
    for i, j in np.ndindex(out.shape):
        own = histogram[i, j] if histogram[i, j].sum() >= FEW else pooled[j]
        if own.sum() >= FEW:
            out[i, j] = limit(own)
    for j in range(out.shape[1] - 2, -1, -1):  # too few in all languages: as the next longer class, and at the long end as the next shorter
        out[:, j] = np.where(np.isnan(out[:, j]), out[:, j + 1], out[:, j])
    for j in range(1, out.shape[1]):
        out[:, j] = np.where(np.isnan(out[:, j]), out[:, j - 1], out[:, j])
    out = np.nan_to_num(out)
    return np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1]  # a shorter text may lie as far off as a longer one


def fit(train: DataFrame, k: int = 4, sample: int = 600, rounds: int = 8, quantile: float = 0.001) -> Model | None:
    """Learn from (doc_id, text, lang) rows; `sample` bounds the documents per language that shape the centroids.

    All rows set the limits. Collected: one row per language, DIMS document counts and BINS counts per language and length class.
    """
    known = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rows = known.select("text").mapInArrow(_frequencies, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIMS + 1)
    for r in rows:
        df[r["dim"] + 1] = r["df"]
    idf = np.log((1 + df[0]) / (1 + df[1:])).astype(np.float32) + np.float32(0.1)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    sampled = unit_hash("doc_id", seed=8) < share[F.col("lang")]

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [counts(list(pdf["text"][a:b])) for a, b in blocks(list(pdf["text"]), VECTOR_CHARS, VECTOR_TEXTS)]
        n = np.concatenate([p[1] for p in parts])
        v = vectors(np.concatenate([p[0] for p in parts]), idf)[n > 0]
        if not len(v):
            return pd.DataFrame({"lang": [], "at": [], "weight": [], "value": []})
        centre = clusters(v, k, rounds)
        to = (v @ centre.T).argmax(1)
        weight = [float(np.linalg.norm(v[to == j].sum(0))) for j in range(len(centre))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "at": range(len(centre)), "weight": weight, "value": [c.astype(np.float32).tobytes() for c in centre]})

    made = known.where(sampled).select("lang", "text").groupBy("lang").applyInPandas(shape, "lang string, at int, weight double, value binary").collect()
    languages = sorted({r["lang"] for r in made})
    if not languages:
        return None
    centre = sorted((languages.index(r["lang"]), r["at"], r["value"], r["weight"]) for r in made)
    centroids, owner, weight = np.stack([np.frombuffer(c[2], np.float32) for c in centre]), np.array([c[0] for c in centre]), np.array([c[3] for c in centre])
    shape_ = (len(languages), len(LENGTHS) + 1, BINS)
    held = train.sparkSession.sparkContext.broadcast((languages, idf, centroids, owner, weight))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, idf, centroids, owner, weight = held.value
        total = np.zeros(shape_, np.int64)
        for batch in batches:
            texts, langs = texts_of(batch), np.array(batch.column(1).to_pylist(), object)
            own = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in blocks(texts, VECTOR_CHARS, VECTOR_TEXTS):
                c, n = counts(texts[a:b])
                v, of = vectors(c, idf), length_class(n)
                for i, lang in enumerate(languages):
                    rows = np.flatnonzero((langs[a:b] == lang) & (n > 0))
                    best = own_cosines(v[rows], centroids[owner == i], weight[owner == i], own[a:b][rows])
                    np.add.at(total, (i, of[rows], np.minimum((best * BINS).astype(int), BINS - 1)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int64), "n": total.ravel()[at]})

    histogram = np.zeros(np.prod(shape_))
    seen = known.select("text", "lang", F.coalesce(sampled, F.lit(False)).alias("sampled"))
    for r in seen.mapInArrow(distances, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        histogram[r["at"]] = r["n"]
    return Model(languages, idf, centroids, owner, limits(histogram.reshape(shape_), quantile))


def classify(texts: list[str], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text."""
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    language, score, rejected = [], [], []
    for a, b in blocks(texts, VECTOR_CHARS, VECTOR_TEXTS):
        c, n = counts(texts[a:b])
        cosine = vectors(c, model.idf) @ model.centroids.T
        at = cosine.argmax(1)
        best = np.clip(cosine[np.arange(len(at)), at].astype(float), 0, 1)
        who = model.owner[at]
        language += ["und" if k == 0 else model.languages[w] for w, k in zip(who, n)]
        score.append(np.where(n > 0, best, 0.0))
        rejected.append((n == 0) | (best < model.least[who, length_class(n)]))
    none = np.zeros(0)
    return language, np.concatenate([none, *score]), np.concatenate([none.astype(bool), *rejected])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs` with lang_pred, score and rejected appended (older ones of those names go)."""
    docs = docs.drop("lang_pred", "score", "rejected")
    held = model and docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, score, rejected = classify(texts_of(batch), held and held.value)
            columns = [*batch.columns, pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def training(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang")


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(training(docs))
    held = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return identify(held, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
