"""Channel statistics and integrity verdicts per recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING, WindowSpec
from sensorloom.functions.scalar import filter_name, is_finite, magnitude, yes_no
from sensorloom.operators.ordering import block_window, exact_quantiles, grouped_stats, join_facts, with_block_columns
from sensorloom.operators.timestamps import native_steps, rate_check

G = 9.81
ACCEL, GYRO = ("fx", "fy", "fz"), ("wx", "wy", "wz")
DESCRIBED = {"p01": 0.01, "median": 0.5, "p99": 0.99}
CHANNEL = (*RECORDING, "channel")


def long_channels(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per (row, channel); `x` is NULL where the value is not finite."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("raw")) for c in channels])
    rows = df.select(*RECORDING, "idx", F.inline(pairs))
    return rows.withColumn("x", F.when(is_finite(F.col("raw")), F.col("raw")))


def describe_channels(df: DataFrame, channels: Sequence[str], bounded: bool | None = None) -> DataFrame:
    """Distribution of finite values, finite share and the near-constant flag."""
    stats = grouped_stats(
        long_channels(df, channels),
        CHANNEL,
        [
            F.min("x").alias("min"),
            F.avg("x").alias("mean"),
            F.stddev_pop("x").alias("std"),
            F.max("x").alias("max"),
            (F.count("x") / F.count(F.lit(1))).alias("finite_fraction"),
        ],
        {"x": DESCRIBED},
        bounded,
    )
    flat = (F.col("std") < 1e-9) | (F.try_divide(F.col("std"), F.abs("mean")) < 1e-8)
    return stats.withColumn("near_constant", F.col("std").isNull() | F.coalesce(flat, F.lit(False)))


def channel_inventory(df: DataFrame, channels: Sequence[str], bounded: bool | None = None) -> DataFrame:
    """Counts, distribution and the share of values equal to the first finite one."""
    rows = long_channels(df, channels)
    finite = F.col("x").isNotNull()
    stats = grouped_stats(
        rows,
        CHANNEL,
        [
            F.count(F.lit(1)).alias("sample_count"),
            F.count(F.when(~finite, 1)).alias("missing_count"),
            F.count(F.when(~finite, 1)).alias("nonfinite_count"),
            F.min("x").alias("min"),
            F.avg("x").alias("mean"),
            F.stddev_pop("x").alias("std"),
            F.max("x").alias("max"),
            F.min_by("x", F.when(finite, F.col("idx"))).alias("first_x"),
        ],
        {"x": DESCRIBED},
        bounded,
    )
    same = (
        join_facts(rows.filter(finite), stats.select(*CHANNEL, "first_x"), CHANNEL, "idx")
        .groupBy(*CHANNEL)
        .agg(F.avg((F.col("x") == F.col("first_x")).cast("double")).alias("constant_fraction"))
    )
    return (
        stats.drop("first_x").join(same, list(CHANNEL), "left")
        # A channel without finite values counts as constant.
        .withColumn("constant_fraction", F.coalesce("constant_fraction", F.lit(1.0)))
    )


def imu_integrity(samples: DataFrame) -> DataFrame:
    """NaN and infinity counts, all-axes-constant flags, finite share of all cells."""

    def count_if(channels: Sequence[str], test) -> Column:
        return F.sum(sum((test(F.col(c)).cast("bigint") for c in channels), F.lit(0)).cast("bigint"))

    is_nan = lambda c: F.coalesce(F.isnan(c), F.lit(False)) | c.isNull()
    is_inf = lambda c: F.coalesce(F.abs(c) == float("inf"), F.lit(False))

    def constant(channels: Sequence[str]) -> Column:
        clean = [F.when(~is_nan(F.col(c)), F.col(c)) for c in channels]
        flat = [F.coalesce(F.min(c) == F.max(c), F.lit(False)) for c in clean]
        return (flat[0] & flat[1] & flat[2]) & (F.count(F.lit(1)) > 1)

    both = (*ACCEL, *GYRO)
    return samples.groupBy(*RECORDING).agg(
        F.count(F.lit(1)).alias("n_samples"),
        count_if(ACCEL, is_nan).alias("accel_nan"),
        count_if(ACCEL, is_inf).alias("accel_inf"),
        count_if(GYRO, is_nan).alias("gyro_nan"),
        count_if(GYRO, is_inf).alias("gyro_inf"),
        constant(ACCEL).alias("accel_constant"),
        constant(GYRO).alias("gyro_constant"),
        (count_if(both, is_finite) / (F.count(F.lit(1)) * 6)).alias("finite_fraction_required"),
    )


def rest_norm(samples: DataFrame, head_rows: int = 400) -> DataFrame:
    """Median specific-force magnitude of the first rows of each recording."""
    head = samples.filter(F.col("idx") < head_rows).withColumn("norm", magnitude(*[F.col(c) for c in ACCEL]))
    head = head.filter(is_finite(F.col("norm")))
    return head.groupBy(*RECORDING).agg(F.median("norm").alias("rest_norm_median"))


def gravity_flags(samples: DataFrame, head_s: float = 1.5, bounded: bool | None = None) -> DataFrame:
    """Is gravity still in the stream while the vehicle rests at the start?

    The rest interval is the first 1.5 s, or the first 200 rows when that holds
    fewer than 10; below 10 finite magnitudes nothing is claimed.
    """
    rows = samples.withColumn("norm", magnitude(*[F.col(c) for c in ACCEL]))
    start = rows.groupBy(*RECORDING).agg(F.min("ts_s").alias("t0"))
    timed = join_facts(rows, start, RECORDING, "idx").withColumn("in_head", F.col("ts_s") <= F.col("t0") + head_s)
    sizes = timed.filter("in_head").groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n_head"))
    rest = (
        join_facts(timed, sizes, RECORDING, "idx", "left")
        .filter(F.when(F.col("n_head") >= 10, F.col("in_head")).otherwise(F.col("idx") < 200))
        .filter(is_finite(F.col("norm")))
    )
    median = grouped_stats(rest, RECORDING, [F.count(F.lit(1)).alias("n_rest")], {"norm": {"rest_median": 0.5}}, bounded)
    m = F.col("rest_median")
    flag = (
        F.when(F.coalesce("n_rest", F.lit(0)) < 10, "UNRESOLVED")
        .when(m.between(8.5, 11.0), "YES_CONSISTENT_WITH_SPECIFIC_FORCE_AT_REST")
        .when(m < 1.5, "NO_OR_GRAVITY_REMOVED_CANDIDATE")
        .otherwise(F.format_string("UNRESOLVED_rest_median_norm=%.3f", m))
    )
    return start.select(*RECORDING).join(median, list(RECORDING), "left").withColumn("gravity_flag", flag)


def measured_quantity(units: DataFrame, flags: DataFrame) -> DataFrame:
    """What the accelerometer reports, from header units and the rest interval.

    `units` has unit_acceleration ('m/s^2', a calibration-derived text, or
    'UNRESOLVED') per recording.
    """
    unit = F.col("unit_acceleration")
    status = (
        F.when(unit == "m/s^2", "SI_MPS2_VERIFIED")
        .when(unit.contains("CALIB"), "CONVERTIBLE_TO_SI_WITH_DOCUMENTED_FORMULA")
        .otherwise("UNIT_UNRESOLVED")
    )
    rested = (unit == "m/s^2") & F.col("gravity_flag").startswith("YES")
    return units.join(flags.select(*RECORDING, "gravity_flag"), list(RECORDING), "left").withColumns(
        {
            "unit_status": status,
            "quantity": F.when(rested, "RAW_ACCELEROMETER_SPECIFIC_FORCE").otherwise("UNRESOLVED"),
            "confidence": F.when(rested, "MEDIUM").otherwise("LOW"),
        }
    )


def gravity_dominance(streams: DataFrame, bounded: bool | None = None) -> DataFrame:
    """How much of each stream sits near 1 g."""
    near = lambda d: F.avg((F.abs(F.col("q_f") - G) <= d).cast("double"))
    stats = grouped_stats(
        streams,
        RECORDING,
        [
            F.count(F.lit(1)).alias("n_samples"),
            F.avg("q_f").alias("mean_qf"),
            F.stddev_samp("q_f").alias("sd_qf"),
            near(0.5).alias("frac_within_0p5"),
            near(1.0).alias("frac_within_1p0"),
            near(2.0).alias("frac_within_2p0"),
        ],
        {"q_f": {"median_qf": 0.5, "q25": 0.25, "q75": 0.75, "p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}},
        bounded,
    )
    return stats.withColumn("iqr_qf", F.col("q75") - F.col("q25")).drop("q25", "q75")


def processed_integrity(
    streams: DataFrame, spec: WindowSpec = WindowSpec(), nominal_hz: float = 100.0, bounded: bool | None = None
) -> DataFrame:
    """Verdict per processed stream: finite, ordered, near the nominal rate, long enough."""
    rates = rate_check(streams, nominal_hz, bounded)
    shape = streams.groupBy(*RECORDING).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.max_by("ts_s", "idx") - F.min_by("ts_s", "idx")).alias("duration_s"),
        F.bool_and(is_finite(F.col("q_f")) & is_finite(F.col("q_w")) & is_finite(F.col("ts_s"))).alias("finite"),
        F.stddev_pop("q_f").alias("sd_f"),
        F.stddev_pop("q_w").alias("sd_w"),
    )
    span = spec.lookback + spec.horizon
    joined = shape.join(rates, list(RECORDING)).withColumns(
        {
            "enough": (F.col("n_rows") >= span) & (F.col("duration_s") >= (span - 1) / nominal_hz),
            "near_rate": F.coalesce(F.col("max_abs_dev") <= 2.0, F.lit(False)),
        }
    )
    passed = F.col("finite") & F.col("strictly_monotonic") & F.col("near_rate") & F.col("enough")
    return joined.select(
        *RECORDING,
        "n_rows",
        "duration_s",
        F.col("median_hz").alias("effective_rate_hz"),
        "max_dt",
        yes_no(F.col("finite")).alias("all_finite"),
        yes_no(F.col("strictly_monotonic")).alias("strictly_monotonic"),
        yes_no(F.col("near_rate")).alias("near_nominal_rate"),
        yes_no(F.col("enough")).alias("enough_rows"),
        yes_no(F.col("sd_f") > 0).alias("nonzero_qf_var"),
        yes_no(F.col("sd_w") > 0).alias("nonzero_qw_var"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
    )


def integrity_findings(integrity: DataFrame, max_gap_s: float = 0.03) -> DataFrame:
    """Finding rows of failed checks."""
    gap = F.when(
        F.col("max_dt") > max_gap_s,
        F.struct(F.lit("TIMESTAMP_GAP").alias("check_id"), F.lit("MAJOR").alias("severity")),
    )
    fail = F.when(
        F.col("status") == "FAIL",
        F.struct(F.lit("PROCESSED_INTEGRITY").alias("check_id"), F.lit("CRITICAL").alias("severity")),
    )
    found = F.filter(F.array(gap, fail), lambda f: f.isNotNull())
    return integrity.select(*RECORDING, F.inline(found), F.lit("integrity").alias("category"), F.lit("FAIL").alias("status"))


def resampling_audit(streams: DataFrame, counts: DataFrame, sos_table: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Filter name, sample counts and effective rate of each processed stream.

    `counts` comes from the filter stage (n_native, n_processed); `sos_table` has one
    row per dataset: native_rate_hz, decimation_factor, sos.
    """
    rates = rate_check(streams, bounded=bounded).select(*RECORDING, "strictly_monotonic", "median_hz", "max_abs_dev")
    return (
        counts.join(sos_table, "dataset")
        .join(rates, list(RECORDING), "left")
        .withColumn("filter_name", filter_name(F.col("sos"), F.col("native_rate_hz")))
        .drop("sos")
    )


def autocorrelation(streams: DataFrame, lags: Sequence[int], column: str = "q_f") -> DataFrame:
    """Autocorrelation around the recording mean; NULL without enough rows or variance."""
    means = streams.groupBy(*RECORDING).agg(F.avg(column).alias("centre"))
    centred = join_facts(streams.select(*RECORDING, "idx", column), means, RECORDING, "idx").withColumn("c", F.col(column) - F.col("centre"))
    ahead = {f"c{k}": F.lead("c", k).over(block_window()) for k in lags}
    rows = with_block_columns(centred, ahead, 0, max(lags))
    return rows.groupBy(*RECORDING).agg(
        *[F.try_divide(F.sum(F.col("c") * F.col(f"c{k}")), F.sum(F.col("c") * F.col("c"))).alias(f"acf_{k}") for k in lags]
    )


def predictability(
    streams: DataFrame, persistence_results: DataFrame, thresholds: DataFrame, lags: Sequence[int]
) -> DataFrame:
    """How hard each recording is: spread, persistence error, autocorrelation, tail."""
    spread = streams.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n_processed"), F.stddev_pop("q_f").alias("sd_qf"))
    pers = persistence_results.select(*RECORDING, "n_origins", F.col("rmse_all_horizons").alias("persistence_rmse"))
    return (
        spread.join(pers, list(RECORDING), "left")
        .join(autocorrelation(streams, lags), list(RECORDING))
        .join(thresholds, list(RECORDING))
        .withColumn("persistence_rmse_over_sd", F.try_divide(F.col("persistence_rmse"), F.col("sd_qf")))
    )


def extreme_values(streams: DataFrame, native: DataFrame | None = None, half: int = 5, bounded: bool | None = None) -> DataFrame:
    """Extreme-value audit of q_f per recording; nothing is clipped.

    `native` (dataset, recording_id, q_f) is the unprocessed stream, if at hand.
    """
    above = lambda c: F.sum((F.col("q_f") > c).cast("double"))
    tails = {"q_f_p001": 0.001, "q_f_p01": 0.01, "q_f_p99": 0.99, "q_f_p999": 0.999}
    stats = grouped_stats(
        streams,
        RECORDING,
        [
            F.min("q_f").alias("q_f_min"),
            # Largest value, earliest row on ties.
            F.max(F.struct("q_f", (-F.col("idx")).alias("neg_idx"), "ts_s", "q_w")).alias("peak"),
            *[above(c).alias(f"above_{c}") for c in (30, 50, 100)],
            F.bool_and(is_finite(F.col("q_f")) & is_finite(F.col("q_w"))).alias("finite"),
        ],
        {"q_f": tails},
        bounded,
    )
    steps = exact_quantiles(native_steps(streams), RECORDING, "dt", {"step": 0.5}, bounded)
    peaks = stats.select(*RECORDING, F.col("peak.q_f").alias("top"), (-F.col("peak.neg_idx")).alias("peak_idx"))

    # The few rows around each peak, fetched by exact (recording, idx) keys.
    offsets = F.explode(F.array(*[F.lit(i) for i in range(-half, half + 1) if i]))
    wanted = peaks.select(*RECORDING, "peak_idx", offsets.alias("offset")).select(
        *RECORDING, (F.col("peak_idx") + F.col("offset")).alias("idx")
    )
    near = wanted.join(streams.select(*RECORDING, "idx", "q_f"), [*RECORDING, "idx"])
    around = near.groupBy(*RECORDING).agg(F.median("q_f").alias("neighbour_median"))
    equal = (
        join_facts(streams.select(*RECORDING, "idx", "q_f"), peaks, RECORDING, "idx")
        .groupBy(*RECORDING)
        .agg(F.count(F.when(F.abs(F.col("q_f") - F.col("top")) <= 1e-9, 1)).alias("n_samples_at_max"))
    )
    joined = stats.join(steps, list(RECORDING), "left").join(around, list(RECORDING), "left").join(equal, list(RECORDING))
    if native is None:
        joined = joined.withColumns({"native_q_f_max": F.lit(None).cast("double"), "raw_source_consistent": F.lit("NA")})
    else:
        raw = native.groupBy(*RECORDING).agg(
            F.max("q_f").alias("native_q_f_max"), yes_no(F.bool_and(is_finite(F.col("q_f")))).alias("raw_source_consistent")
        )
        joined = joined.join(raw, list(RECORDING), "left").fillna({"raw_source_consistent": "NA"})

    top, middle = F.col("peak.q_f"), F.col("neighbour_median")
    ratio = F.when(middle == 0, F.lit(float("inf"))).otherwise(top / middle)
    consistent = (
        F.when(middle.isNull(), "NO_NEIGHBORS").when(ratio < 3, "YES").when(ratio < 8, "PARTIAL").otherwise("NO")
    )
    duration = lambda c: F.coalesce(F.col(f"above_{c}") * F.col("step"), F.lit(0.0))
    review = ~F.col("finite") | (F.col("raw_source_consistent") == "NO")
    return joined.select(
        *RECORDING,
        "q_f_min",
        *tails,
        top.alias("q_f_max"),
        F.col("peak.ts_s").alias("timestamp_of_max"),
        F.col("peak.q_w").alias("q_w_at_qf_max"),
        *[duration(c).alias(f"duration_above_{c}") for c in (30, 50, 100)],
        consistent.alias("neighbors_consistent"),
        F.when(ratio < float("inf"), ratio).alias("neighbor_median_ratio"),
        "n_samples_at_max",
        yes_no((top >= 150) & (F.col("n_samples_at_max") >= 3)).alias("possible_saturation"),
        yes_no((consistent == "NO") & (duration(100) < 0.05)).alias("possible_spike"),
        "native_q_f_max",
        "raw_source_consistent",
        F.when(review, "RAW_INTEGRITY_REVIEW_REQUIRED").otherwise("KEEP").alias("action"),
    )
