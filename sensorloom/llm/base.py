"""Shared pieces of the corpus operators: inputs, folds, text blocks and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space of every word contract: space and the five control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: Texts are handed to numpy in blocks of about so many code points (one long text may exceed it).
BLOCK_CHARS = 2_000_000

#: Arrow batches to Python workers are cut at this size, so long texts cannot fill a worker. A worker holds a batch several
#: times over (as Arrow, as strings, as results) and keeps that memory for its next task, also while later stages need none.
BATCH_BYTES = 4 << 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session end at BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def prepare(spark: SparkSession) -> None:
    """Workers can import the package, and their batches are bounded."""
    ship_package(spark)
    bounded_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo `parts`; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def unit_hash(*columns: Column, seed: int = 0) -> Column:
    """Uniform in (0, 1), a function of the values alone, so reruns and other partitionings agree."""
    h = F.xxhash64(*columns, F.lit(seed))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def blocks(texts: list[str], limit: int = BLOCK_CHARS, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about `limit` code points together, and of `most` texts where a row has its price whatever the text."""
    first = size = 0
    for i, t in enumerate(texts):
        if (size and size + len(t) > limit) or i - first == most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between runs of `pad` zeros, and where each text starts.

    A window no longer than pad + 1 never sees two texts. A NUL inside a text counts as a space.
    """
    zeros = "\0" * pad
    whole = zeros + zeros.join(t.replace("\0", " ") if "\0" in t else t for t in texts) + zeros
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = pad + np.concatenate(([0], np.cumsum(lengths + pad)))
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), starts


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Letter flag of every code point (built once per worker)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ranked_sample(rows: DataFrame, size: int) -> list:
    """About `size` rows of smallest `rank` (uniform to 1 where `hit`, to 2 elsewhere), sorted by rank.

    The cut comes from a count over all rows, so only the sample itself reaches the driver.
    """
    n = rows.agg(F.sum(F.when(F.col("hit"), 1.0).otherwise(0.5))).first()[0] or 0.0
    drawn = rows.where(F.col("rank") < size / n) if n > size else rows
    return sorted(drawn.drop("hit").collect(), key=lambda r: (r["rank"], str(r)))
