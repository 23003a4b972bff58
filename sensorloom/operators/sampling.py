"""Samples the protocol itself draws: windows by recording, and even thinning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.operators.ordering import assign_idx


def ordinal_windows(windows: DataFrame, by: Sequence[str] = RECORDING, bounded: bool | None = None) -> DataFrame:
    """0-based window number `w` within each recording."""
    return assign_idx(windows, by, ["origin"], bounded).withColumnRenamed("idx", "w")


def _uniform(seed: int, draw, label: str):
    """Portable uniform number in [0, 1): 32 bits of md5('seed:label:draw')."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(label), draw.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def equal_recording_sample(windows: DataFrame, n_draws: int, seed: int, bounded: bool | None = None) -> DataFrame:
    """Draws with replacement: a uniform recording, then a uniform window of it.

    Draws are rows from `range`, joined to the ranked recordings and then to window
    numbers, so any number of draws is spread over the cluster.
    """
    numbered = ordinal_windows(windows, bounded=bounded)
    counts = windows.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n_windows")).withColumn("all", F.lit(1))
    pool = assign_idx(counts, ["all"], list(RECORDING), bounded).withColumnRenamed("idx", "rec_no")
    n_rec = counts.agg(F.count(F.lit(1))).scalar()
    draws = windows.sparkSession.range(n_draws).withColumnRenamed("id", "draw")
    picked = draws.select("draw", F.floor(_uniform(seed, F.col("draw"), "r") * n_rec).alias("rec_no"))
    located = picked.join(pool, "rec_no").select(
        "draw", *RECORDING, F.floor(_uniform(seed, F.col("draw"), "w") * F.col("n_windows")).alias("w")
    )
    return located.join(numbered, [*RECORDING, "w"])


def thin_evenly(windows: DataFrame, most: int, bounded: bool | None = None) -> DataFrame:
    """At most `most` windows per recording at evenly spaced, truncated positions.

    Row r of n is kept iff r = floor(j(n-1)/(most-1)) for some j, which only needs the
    smallest j that reaches r.
    """
    if most < 2:
        raise ValueError("thinning needs at least two windows")
    sizes = windows.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"))
    rows = ordinal_windows(windows, bounded=bounded).join(sizes, list(RECORDING))
    step = (F.col("n") - 1) / F.lit(float(most - 1))
    # Around the candidate j, compare the truncated positions exactly.
    near = F.floor(F.col("w") / step)
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        j = near + d
        hit = hit | ((j >= 0) & (j <= most - 1) & (F.floor(j * step) == F.col("w")))
    return rows.filter((F.col("n") <= most) | hit).drop("n", "w")
