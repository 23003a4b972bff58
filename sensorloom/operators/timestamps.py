"""Clock handling and timestamp audits. Native row order is never repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.functions.scalar import inverse, is_finite, overlap_fraction, overlap_seconds
from sensorloom.operators.ordering import block_window, exact_quantiles, grouped_stats, join_facts, prefix_sums, with_block_columns

DT_QUANTILES = {"median_dt": 0.5, "p01_dt": 0.01, "p05_dt": 0.05, "p95_dt": 0.95, "p99_dt": 0.99}


def native_steps(df: DataFrame, ts: str = "ts_s", keys: Sequence[str] = RECORDING) -> DataFrame:
    """Adds `dt`, the step from the previous native row (NULL on the first)."""
    step = F.col(ts) - F.lag(ts).over(block_window(keys))
    return with_block_columns(df, {"dt": step}, 1, 0, keys)


def relative_seconds(df: DataFrame, origin: Column | None = None, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Seconds since the recording's first clock tick (or `origin`), subtracted as
    integers so nanosecond counters keep their spacing."""
    if origin is None:
        first = df.groupBy(*keys).agg(F.min_by("ts_ns", "idx").alias("origin_ns"))
        df, origin = join_facts(df, first, keys, "idx"), F.col("origin_ns")
    return df.withColumn("rel_s", (F.col("ts_ns") - origin) / F.lit(1e9)).drop("origin_ns")


def clock_units(df: DataFrame, clock: str, declared: Column | None = None, bounded: bool | None = None) -> DataFrame:
    """Unit of each recording's clock from the median absolute native step.

    `text_unit` follows the rule for plain sensor text, `asl_unit` the rule for
    tables whose header may declare a unit, `sorted_label` is the reporting-only
    label on sorted values.
    """
    steps = native_steps(df, clock).withColumn("size_of_step", F.abs("dt"))
    median = exact_quantiles(steps, RECORDING, "size_of_step", {"step": 0.5}, bounded)
    ends = df.groupBy(*RECORDING).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(clock)).alias("largest"),
        (F.max(clock) - F.min(clock)).alias("span"),
        *([F.max(declared).alias("declared")] if declared is not None else [F.max(F.lit(None).cast("string")).alias("declared")]),
    )
    ordered = sorted_step_median(df, clock, bounded)
    joined = ends.join(median, list(RECORDING), "left").join(ordered, list(RECORDING), "left")
    step, sorted_step = F.col("step"), F.col("sorted_step")
    text_unit = (
        F.when(F.col("n") == 1, F.when(F.col("largest") > 1e16, "nanoseconds").otherwise("seconds_or_single_sample"))
        .when(step.isNull() | (step <= 0), "UNRESOLVED")
        .when(step > 1e5, "nanoseconds")
        .when(step > 50, "microseconds")
        .otherwise("seconds")
    )
    asl_unit = (
        F.when(F.col("declared") == "nanoseconds", "nanoseconds")
        .when(F.col("n") < 2, F.coalesce("declared", F.lit("UNRESOLVED")))
        .when(F.floor(step) > 1000, "nanoseconds")
        .when(step > 50, "microseconds")
        .otherwise("seconds")
    )
    label = (
        F.when((F.col("n") < 2) | (sorted_step <= 0), "UNRESOLVED")
        .when(sorted_step.between(1e6, 1e10), "nanoseconds_candidate")
        .when(sorted_step.between(1e3, 1e6), "microseconds_candidate")
        .when(sorted_step.between(1e-4, 1.0), "seconds_candidate")
        .when(F.col("span") > 1e12, "nanoseconds_candidate")
        .otherwise("UNRESOLVED")
    )
    return joined.select(
        *RECORDING,
        F.col("step").cast("double").alias("median_step"),
        text_unit.alias("text_unit"),
        asl_unit.alias("asl_unit"),
        label.alias("sorted_label"),
    )


def sorted_step_median(df: DataFrame, clock: str, bounded: bool | None = None) -> DataFrame:
    """Median step between consecutive values in clock order."""
    data = df.select(*RECORDING, "idx", F.col(clock).alias("v"), F.lit(1).cast("bigint").alias("one")).filter("v is not null")
    following = prefix_sums(data, RECORDING, ["v", "idx"], {"rank": "one"}, {"next_v": "v"}, bounded)
    steps = following.withColumn("d", F.col("next_v") - F.col("v"))
    return exact_quantiles(steps, RECORDING, "d", {"sorted_step": 0.5}, bounded)


def to_seconds(df: DataFrame, clock: str, unit: Column) -> DataFrame:
    """Clock in seconds for a unit column."""
    scale = F.when(unit == "nanoseconds", 1e9).when(unit == "microseconds", 1e6).otherwise(1.0)
    return df.withColumn("seconds", F.col(clock) / scale)


def audit_timestamps(streams: DataFrame, bounded: bool | None = None, unit: str = "seconds") -> DataFrame:
    """Timestamp audit per recording: order checks on all steps, statistics on the
    positive ones. Gap counts need the median, hence the second aggregation."""
    steps = native_steps(streams.filter(is_finite(F.col("ts_s"))))
    positive = F.when(F.col("dt") > 0, F.col("dt"))
    steps = steps.withColumn("pdt", positive)
    base = grouped_stats(
        steps,
        RECORDING,
        [
            F.count(F.lit(1)).alias("sample_count"),
            F.min_by("ts_s", "idx").alias("first_timestamp"),
            F.max_by("ts_s", "idx").alias("last_timestamp"),
            (F.coalesce(F.bool_and(F.col("dt") > 0), F.lit(False))).alias("strictly_monotonic"),
            F.sum((F.coalesce(F.col("dt"), F.lit(1.0)) < 0).cast("bigint")).alias("backward_count"),
            F.sum((F.coalesce(F.col("dt"), F.lit(1.0)) == 0).cast("bigint")).alias("duplicate_count"),
            F.avg("pdt").alias("mean_dt"),
            F.stddev_pop("pdt").alias("std_dt"),
            F.max("pdt").alias("maximum_gap"),
        ],
        {"pdt": DT_QUANTILES},
        bounded,
    )
    over = lambda k: F.sum((F.col("pdt") > k * F.col("median_dt")).cast("bigint"))
    gaps = (
        join_facts(steps.select(*RECORDING, "pdt", "idx"), base.select(*RECORDING, "median_dt"), RECORDING, "idx")
        .groupBy(*RECORDING)
        .agg(*[F.coalesce(over(k), F.lit(0)).alias(f"number_gaps_gt_{k}x_median") for k in (2, 5, 10)])
    )
    return base.join(gaps, list(RECORDING)).withColumns(
        {
            "duration": F.col("last_timestamp") - F.col("first_timestamp"),
            "timestamp_unit": F.lit(unit),
            "median_frequency": inverse(F.col("median_dt")),
        }
    )


def step_rate_stats(streams: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Extreme steps and the distribution of instantaneous rates 1/dt."""
    steps = native_steps(streams.filter(is_finite(F.col("ts_s")))).filter("dt > 0").withColumn("rate", 1 / F.col("dt"))
    rates = {"measured_p05_rate_hz": 0.05, "measured_median_rate_hz": 0.5, "measured_p95_rate_hz": 0.95}
    return grouped_stats(steps, RECORDING, [F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt")], {"rate": rates}, bounded)


def rate_check(streams: DataFrame, nominal_hz: float = 100.0, bounded: bool | None = None) -> DataFrame:
    """Median rate, its distance from nominal, largest step, strict order."""
    steps = native_steps(streams).withColumn("pdt", F.when(F.col("dt") > 0, F.col("dt")))
    base = grouped_stats(
        steps,
        RECORDING,
        [
            F.max("pdt").alias("max_dt"),
            (F.coalesce(F.bool_and(F.col("dt") > 0), F.lit(False)) & F.max("pdt").isNotNull()).alias("strictly_monotonic"),
        ],
        {"pdt": {"median_dt": 0.5}},
        bounded,
    )
    hz = inverse(F.col("median_dt"))
    return base.withColumns({"median_hz": hz, "max_abs_dev": F.abs(hz - nominal_hz)})


def stream_spans(streams: DataFrame) -> DataFrame:
    """First and last timestamp in native order."""
    return streams.groupBy(*RECORDING).agg(
        F.min_by("ts_s", "idx").alias("first_s"), F.max_by("ts_s", "idx").alias("last_s"), F.count(F.lit(1)).alias("n")
    )


def stream_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlap of two streams of each recording. A stream missing on one side gives
    NULL; intervals that do not meet give 0."""
    a = stream_spans(left).select(*RECORDING, F.col("first_s").alias("a_first"), F.col("last_s").alias("a_last"))
    b = stream_spans(right).select(*RECORDING, F.col("first_s").alias("b_first"), F.col("last_s").alias("b_last"))
    ends = [F.col(c) for c in ("a_first", "a_last", "b_first", "b_last")]
    joined = a.join(b, list(RECORDING), "full")
    seconds = overlap_seconds(*ends)
    return joined.withColumns(
        {
            "overlap_start": F.when(seconds > 0, F.greatest("a_first", "b_first")),
            "overlap_end": F.when(seconds > 0, F.least("a_last", "b_last")),
            "overlap_s": seconds,
            "overlap_fraction": overlap_fraction(*ends),
        }
    )


def frequency_triple(audit: DataFrame) -> DataFrame:
    """Median, low and high rate from step percentiles: a long step is a low rate."""
    return audit.withColumns(
        {
            "median_hz": inverse(F.col("median_dt")),
            "p05_hz": inverse(F.col("p95_dt")),
            "p95_hz": inverse(F.col("p05_dt")),
        }
    )
