"""Distribution shift between two datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordering import grouped_stats, prefix_sums

SHIFT_QUANTILES = {"p01": 0.01, "p05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95, "p99": 0.99}


def quantity_rows(streams: DataFrame, quantities: Sequence[str] = ("q_f", "q_w")) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(q).alias("x")) for q in quantities])
    return streams.select("dataset", F.inline(pairs)).filter("x is not null")


def dataset_distributions(streams: DataFrame, quantities: Sequence[str] = ("q_f", "q_w"), bounded: bool | None = None) -> DataFrame:
    """Distribution of each quantity over all rows of a dataset."""
    stats = grouped_stats(
        quantity_rows(streams, quantities),
        ["quantity", "dataset"],
        [F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")],
        {"x": SHIFT_QUANTILES},
        bounded,
    )
    return stats.withColumn("iqr", F.col("q75") - F.col("q25")).drop("q25", "q75")


def wasserstein(streams: DataFrame, a: str, b: str, quantities: Sequence[str] = ("q_f", "q_w"), bounded: bool | None = None) -> DataFrame:
    """1-Wasserstein distance: area between the two empirical distribution functions.

    Equal values collapse to counts before the ordered running sums.
    """
    rows = quantity_rows(streams, quantities).filter(F.col("dataset").isin(a, b))
    side = lambda d: F.count(F.when(F.col("dataset") == d, 1))
    counts = rows.groupBy("quantity", "x").agg(side(a).alias("in_a"), side(b).alias("in_b"))
    sizes = rows.groupBy("quantity").agg(side(a).alias("n_a"), side(b).alias("n_b"))
    steps = prefix_sums(counts, ["quantity"], ["x"], {"upto_a": "in_a", "upto_b": "in_b"}, {"next_x": "x"}, bounded)
    height = F.abs(F.col("upto_a") / F.col("n_a") - F.col("upto_b") / F.col("n_b"))
    return (
        steps.join(sizes, "quantity")
        .groupBy("quantity")
        .agg(F.sum(height * (F.col("next_x") - F.col("x"))).alias("wasserstein"))
    )


def domain_shift(streams: DataFrame, a: str, b: str, bounded: bool | None = None) -> DataFrame:
    """Both distributions side by side, with their distance."""
    stats = dataset_distributions(streams, bounded=bounded)
    names = [c for c in stats.columns if c not in ("quantity", "dataset")]
    wide = stats.groupBy("quantity").agg(
        *[F.max(F.when(F.col("dataset") == d, F.col(c))).alias(f"{side}_{c}") for side, d in (("a", a), ("b", b)) for c in names]
    )
    return wide.join(wasserstein(streams, a, b, bounded=bounded), "quantity")
