"""Candidate origins, their validity, and the history/future arrays around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.config import RECORDING, WindowSpec
from sensorloom.operators.ordering import block_tags, block_window, exact_quantiles, facts_beside, grouped_stats, halo_rows, own_rows
from sensorloom.operators.timestamps import native_steps

STATUSES = ("start", "end", "other", "gap", "valid")


def step_limits(streams: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Per recording: row count and the median of the positive time steps."""
    steps = native_steps(streams).withColumn("pdt", F.when(F.col("dt") > 0, F.col("dt")))
    return grouped_stats(steps, RECORDING, [F.count(F.lit(1)).alias("n")], {"pdt": {"median_dt": 0.5}}, bounded)


def _classified_rows(streams: DataFrame, spec: WindowSpec, bounded: bool | None, columns: list[str]) -> DataFrame:
    """Halo rows with `status` on candidate origins (NULL elsewhere and in the halo).

    A window is broken iff the latest breaking step up to its last row lies inside it,
    so a running maximum of the breaking positions is enough: linear work per block.
    """
    size, (L, H, S) = spec.block_rows, (spec.lookback, spec.horizon, spec.stride)
    rows = facts_beside(streams.select(*RECORDING, "idx", "ts_s", *columns, *block_tags(streams)), step_limits(streams, bounded), RECORDING, "idx")
    k = F.col("idx")
    in_order = block_window()
    up_to_end = in_order.rowsBetween(Window.unboundedPreceding, H)
    latest = lambda broken: F.max(F.when(broken, k)).over(up_to_end)
    inside = lambda at: F.coalesce(F.col(at) > k - (L - 1), F.lit(False))
    status = (
        F.when(k < L - 1, "start")
        .when(k + H >= F.col("n"), "end")
        .when(inside("stuck_at"), "other")
        .when(inside("jump_at"), "gap")
        .otherwise("valid")
    )
    return (
        halo_rows(rows, L - 1, H, size)
        .withColumn("dt", F.col("ts_s") - F.lag("ts_s").over(in_order))
        .withColumns({"stuck_at": latest(F.col("dt") <= 0), "jump_at": latest(F.col("dt") > spec.gap_factor * F.col("median_dt"))})
        .withColumn("status", F.when(F.col("own") & (k % S == 0), status))
    )


def classify_origins(streams: DataFrame, spec: WindowSpec, bounded: bool | None = None) -> DataFrame:
    """Every candidate origin with its status; the first broken rule wins."""
    rows = _classified_rows(streams, spec, bounded, []).filter("status is not null")
    return rows.select(*RECORDING, F.col("idx").alias("origin"), "status")


def window_counts(streams: DataFrame, spec: WindowSpec, bounded: bool | None = None) -> DataFrame:
    """Window audit per recording."""
    is_status = lambda s: F.sum((F.col("status") == s).cast("bigint"))
    counts = (
        classify_origins(streams, spec, bounded)
        .groupBy(*RECORDING)
        .agg(
            F.count(F.lit(1)).alias("candidate_origins"),
            is_status("valid").alias("valid_origins"),
            is_status("start").alias("excluded_due_to_start"),
            is_status("end").alias("excluded_due_to_end"),
            is_status("gap").alias("excluded_due_to_gap"),
            is_status("other").alias("excluded_other"),
        )
    )
    sizes = own_rows(streams).groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("processed_samples"))
    return sizes.join(counts, list(RECORDING), "left").withColumns(
        {
            "lookback_samples": F.lit(spec.lookback).cast("bigint"),
            "horizon_samples": F.lit(spec.horizon).cast("bigint"),
            "stride_samples": F.lit(spec.stride).cast("bigint"),
        }
    )


def build_windows(streams: DataFrame, spec: WindowSpec, bounded: bool | None = None) -> DataFrame:
    """One row per valid origin with its history and future arrays.

    Rows k-L+1..k are the history, k+1..k+H the future. The rows of a block, already
    together for the classification, become arrays, and only valid origins read their
    slices from them.
    """
    L, H = spec.lookback, spec.horizon
    packed = (
        _classified_rows(streams, spec, bounded, ["q_f", "q_w", "dependency_group"])
        .groupBy(*RECORDING, "block")
        .agg(
            F.first("dependency_group").alias("dependency_group"),
            F.array_sort(F.collect_list(F.struct("idx", "q_f", "q_w", (F.col("status") == "valid").alias("valid")))).alias("rows"),
        )
    )
    origins = F.transform(F.filter("rows", lambda r: r["valid"]), lambda r: r["idx"])
    # The generator fixes the arrays as columns. Left as expressions, they would be
    # evaluated again for every origin that reads from them.
    arrays = packed.select(
        *RECORDING,
        "dependency_group",
        F.inline(F.array(F.struct(F.col("rows")[0]["idx"].alias("first"), F.col("rows.q_f").alias("f"), F.col("rows.q_w").alias("w"), origins.alias("origins")))),
    )

    def read(values: str, low: Column, n: int) -> Column:
        places = F.sequence(low, low + (n - 1))
        return F.transform(places, lambda i: F.get(F.col(values), i.cast("int")))

    def cut(k: Column) -> Column:
        at = k - F.col("first")
        return F.struct(
            k.alias("origin"), read("f", at - (L - 1), L).alias("hist_qf"), read("w", at - (L - 1), L).alias("hist_qw"), read("f", at + 1, H).alias("future_qf")
        )

    return arrays.select(*RECORDING, "dependency_group", F.inline(F.transform("origins", cut)))


def high_thresholds(streams: DataFrame, percentile: float = 0.95, bounded: bool | None = None) -> DataFrame:
    """Per-recording upper-tail threshold of q_f."""
    return exact_quantiles(own_rows(streams), RECORDING, "q_f", {"p95_qf": percentile}, bounded)
