"""Whitening of vectors by shifted Cholesky QR.

A component c becomes the integer x = floor(SCALE * c). The fit list holds each distinct x once: n vectors A with sums S.
Its centred rows x - S / n are orthogonalised by repeated Gram passes: a pass solves each row against the
triangular factors found so far, adds up the Gram matrix G of the solved rows map-side, and the driver factors
G + shift into the next upper triangle R. Shifts keep the factorisation alive where A is nearly rank deficient (each
pass lifts small directions towards 1); the passes end when the rows are orthonormal in every direction that
carries anything, and the composed triangle, closed with the square root of the last Gram matrix, has A's
singular values and right vectors: its SVD gives eigenvalues e = s^2 / n and the components. No covariance is
ever squared first, so small components keep double precision.

Only d sums and d x d Gram entries (d: length of a vector) reach the driver. The fit list is a written table in the
shared folder, read by every pass. `identity_error` comes from one more pass over the whitened fit list.

Defined cases: vectors that are null, empty, or hold a null or non-finite entry are left out; all vectors must have
one length, so those whose length is not the most frequent one (ties: the larger) are left out too; components whose
eigenvalue is zero to double precision do not exist, so equal or single vectors give no rows; |x| beyond LIMIT counts
as LIMIT; `deviation` is exact, and null where it does not fit in 64 bits; repeated rows are whitened each; a null id stays;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table
from sensorloom.llm.centroids import finite, integers
from sensorloom.session import materialise

LIMIT = 1 << 40
PASSES = 8
UNIT = float(np.finfo(float).eps)


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """Rows x d array of a list column of equal lengths."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def integer_rows(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, x) of the rows that take part."""
    v = F.col(vector)
    usable = rows.where(v.isNotNull() & (F.size(v) > 0) & finite(v))
    lengths = usable.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    usable = usable.where(F.size(v) == (best["d"] if best else 0))
    return usable.select(F.col(id_column).alias("id"), integers(v, limit=LIMIT).alias("x"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            s = matrix(batch).sum(0)
            yield pa.RecordBatch.from_pydict({"j": np.arange(-1, len(s)), "s": np.concatenate(([len(batch)], s))})


def totals(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    parts = fit_list.mapInArrow(_totals, "j long, s long").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["j"]: int(r["s"]) for r in parts.collect()}
    return found.get(-1, 0), [found[j] for j in range(len(found) - 1)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off in integers first."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def solved(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows q R^-1, by substitution over the columns of the upper triangle R."""
    out = np.empty_like(q)
    for j in range(len(r)):
        out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(fit_list: DataFrame, n: int, sums: list[int], factors: list[np.ndarray], project: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows, solved against each factor in turn or projected."""
    d = len(sums) if project is None else project.shape[1]
    upper = np.triu_indices(d)
    held = fit_list.sparkSession.sparkContext.broadcast((n, sums, factors, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, factors, project = held.value
        total, carry = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            if not len(batch):
                continue
            q = centred(matrix(batch), n, sums)
            for r in factors:
                q = solved(q, r)
            if project is not None:
                q = q @ project
            part = q.T @ q - carry  # compensated over batches
            grown = total + part
            carry, total = (grown - total) - part, grown
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(upper[0])), "v": total[upper]})

    out = np.zeros((d, d))
    for r in fit_list.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        out[i, j] = out[j, i] = r["v"]
    return out


def shifted_cholesky(g: np.ndarray) -> np.ndarray:
    """Upper R with R^T R = g + shift: the smallest shift of its row that succeeds."""
    d = len(g)
    shift = 11 * d * (d + 1) * UNIT * max(float(np.linalg.norm(g, 2)), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 100


def orthonormal(g: np.ndarray) -> bool:
    """Is each direction of the solved rows of length 1, or empty?"""
    e = np.linalg.eigvalsh(g)
    return bool(np.all((np.abs(e - 1) < 1e-8) | (np.abs(e) < 1e-8)))


class Whitening:
    """n, sums, eigenvalues (falling), components (columns) and trace of the covariance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.components, self.trace = n, sums, values, components, trace


def fit(fit_list: DataFrame, k: int) -> Whitening | None:
    """Components of a table of distinct x."""
    n, sums = totals(fit_list)
    if not n:
        return None
    g = gram(fit_list, n, sums, [])
    trace = float(np.trace(g)) / n
    factors: list[np.ndarray] = []
    composed = np.eye(len(sums))
    for _ in range(PASSES if trace > 0 else 0):
        r = shifted_cholesky(g)
        factors.append(r)
        composed = r @ composed
        g = gram(fit_list, n, sums, factors)
        if orthonormal(g):
            break
    e, w = np.linalg.eigh(g)
    closing = np.sqrt(np.clip(e, 0, None))[:, None] * w.T  # A^T A = composed^T g composed
    _, s, vt = np.linalg.svd(closing @ composed)
    rank = int((s > s[0] * len(s) * UNIT).sum()) if s[0] > 0 else 0
    rank = min(k, rank)
    return Whitening(n, sums, (s * s / n)[:rank], vt[:rank].T, trace)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly."""
    most = max(int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0), 1)
    if len(sums) * most * most < 1 << 63:
        z = x * n - np.array(sums, np.int64)
        return (z * z).sum(1).tolist()
    out = []
    for row in x.tolist():
        v = sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        out.append(v if v < 1 << 63 else None)
    return out


def whiten(rows: DataFrame, id_column: str, vector: str, k: int = 4) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error: a row per vector and component up to k."""
    own = integer_rows(rows, id_column, vector)
    kind = own.schema["id"].dataType.simpleString()
    fit_list = materialise(own.select("x").distinct(), "whitening-fit")
    model = fit(fit_list, k)
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return own.where("false").select("id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")[1:]])
    project = model.components / np.sqrt(model.values)
    covariance = gram(fit_list, model.n, model.sums, [], project) / model.n
    error = float(np.abs(covariance - np.eye(len(covariance))).max())
    held = rows.sparkSession.sparkContext.broadcast((model, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, project = held.value
        m = len(model.values)
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch)
            at = np.repeat(np.arange(len(x)), m)
            deviation = pa.array(deviations(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.n)), deviation.take(pa.array(at)),
                    pa.array((centred(x, model.n, model.sums) @ project).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(at), error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(run, schema)


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")
