"""Statistics over recordings: bootstrap intervals, sign-flip tests, summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.config import RECORDING, BaselineSpec, BootstrapSpec
from sensorloom.functions.scalar import skill_score
from sensorloom.operators.forecasts import PERSISTENCE
from sensorloom.operators.metrics import horizon_rows, of_model
from sensorloom.operators.ordering import assign_idx, exact_quantiles

TIE = 1e-12
MAX_SIGN_FLIP = 20
MAX_DRAW_CELLS = 5_000_000


def hash_draw(seed: int, rep: Column, pos: Column, n: Column) -> Column:
    """Portable pseudo-random index below n: 32 bits of md5('seed:rep:pos')."""
    key = F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), pos.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n


def _numpy_draws(values: DataFrame, spec: BootstrapSpec) -> DataFrame:
    """Index table of the published intervals: one generator per sample size.

    The table is built on the driver, so its size is checked first.
    """
    sizes = [r[0] for r in values.select("n").distinct().limit(1001).collect()]
    if len(sizes) > 1000 or sum(sizes) * spec.reps > MAX_DRAW_CELLS:
        raise ValueError("too many recordings for a driver-built draw table; use draws='hash'")
    parts = []
    for n in sizes:
        draws = np.random.default_rng(spec.seed).integers(0, n, size=(spec.reps, n))
        rep, pos = np.indices(draws.shape)
        parts.append(pd.DataFrame({"n": n, "rep": rep.ravel(), "pos": pos.ravel(), "draw": draws.ravel()}))
    table = pd.concat(parts) if parts else pd.DataFrame({"n": [], "rep": [], "pos": [], "draw": []})
    return values.sparkSession.createDataFrame(table.astype("int64"), "n bigint, rep bigint, pos bigint, draw bigint")


def bootstrap_draws(values: DataFrame, by: Sequence[str], spec: BootstrapSpec) -> DataFrame:
    """(by, rep, draw): indices into each group's ranked values.

    `values` has `pos` (0-based rank in the group) and `n` (group size).
    """
    if spec.draws == "numpy":
        return values.select(*by, "pos", "n").join(_numpy_draws(values, spec), ["n", "pos"]).select(*by, "rep", "draw")
    reps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spec.reps - 1).cast("bigint")))
    spread = values.select(*by, "pos", "n", reps.alias("rep"))
    return spread.select(*by, "rep", hash_draw(spec.seed, F.col("rep"), F.col("pos"), F.col("n")).alias("draw"))


def ranked(df: DataFrame, by: Sequence[str], value: str, order: str, bounded: bool | None = None) -> DataFrame:
    """Values with their 0-based rank `pos` and the group size `n`."""
    placed = assign_idx(df.select(*by, order, F.col(value).alias("v")), by, [order], bounded).withColumnRenamed("idx", "pos")
    return placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by))) if bounded else placed.join(
        placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), list(by)
    )


def _joined_means(values: DataFrame, by: Sequence[str], spec: BootstrapSpec) -> DataFrame:
    """Mean of each replicate; a group's values are looked up by a join."""
    drawn = bootstrap_draws(values, by, spec).join(values.select(*by, F.col("pos").alias("draw"), "v"), [*by, "draw"])
    return drawn.groupBy(*by, "rep").agg(F.avg("v").alias("m"))


def _gathered_means(values: DataFrame, by: Sequence[str], spec: BootstrapSpec) -> DataFrame:
    """The same with the values of a bounded group in one array: no row per draw, no join."""
    listed = values.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("vs"), F.count(F.lit(1)).alias("n"))
    reps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spec.reps - 1).cast("bigint")))
    drawn = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda p: F.get("vs", hash_draw(spec.seed, F.col("rep"), p, F.col("n")).cast("int"))["v"])
    total = F.aggregate(drawn, F.lit(0.0), lambda a, v: a + v)
    return listed.select(*by, "vs", "n", reps.alias("rep")).select(*by, "rep", (total / F.col("n")).alias("m"))


def bootstrap_ci(
    df: DataFrame, by: Sequence[str], value: str, order: str, spec: BootstrapSpec = BootstrapSpec(), bounded: bool | None = None
) -> DataFrame:
    """Mean over recordings with a percentile bootstrap interval, plus spread."""
    values = ranked(df.filter(F.col(value).isNotNull()), by, value, order, bounded)
    means = _gathered_means(values, by, spec) if bounded and spec.draws == "hash" else _joined_means(values, by, spec)
    interval = means.groupBy(*by).agg(F.percentile("m", [spec.alpha / 2, 1 - spec.alpha / 2]).alias("q"))
    spread = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_recordings"),
        F.avg("v").alias("mean"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    medians = exact_quantiles(values, by, "v", {"median": 0.5}, bounded)
    return (
        spread.join(medians, list(by))
        .join(interval, list(by))
        .select(*by, "n_recordings", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "median", "std", "min", "max")
    )


def sign_flip_p(df: DataFrame, by: Sequence[str], delta: str, order: str, bounded: bool | None = None) -> DataFrame:
    """Exact two-sided sign-flip p-value of the mean, for at most 20 recordings.

    All 2^n sign patterns are rows. A larger group is an error, raised from its
    size alone: never more than 21 values of a group are gathered.
    """
    values = ranked(df, by, delta, order, bounded)
    groups = values.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("pos") <= MAX_SIGN_FLIP, F.struct("pos", "v")))), lambda s: s["v"]
        ).alias("d"),
    )
    too_many = F.raise_error(F.lit(f"exact sign-flip needs at most {MAX_SIGN_FLIP} recordings"))
    patterns = F.when(F.col("n") > MAX_SIGN_FLIP, too_many.cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n").cast("int")) - 1)
    signed = F.aggregate(
        F.transform("d", lambda v, i: F.when(F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1, v).otherwise(-v)),
        F.lit(0.0),
        lambda a, v: a + v,
    )
    observed = F.abs(F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
    flips = groups.select(*by, "n", "d", F.explode(F.sequence(F.lit(0).cast("bigint"), patterns)).alias("mask"))
    hit = F.abs(signed / F.col("n")) + F.lit(1e-18) >= observed
    return flips.groupBy(*by).agg(F.avg(hit.cast("double")).alias("signflip_p"))


def win_loss_tie(delta: Column) -> dict[str, Column]:
    """Counts of recordings with lower, higher and equal error."""
    return {
        "wins": F.count(F.when(delta < -TIE, 1)),
        "losses": F.count(F.when(delta > TIE, 1)),
        "ties": F.count(F.when(F.abs(delta) <= TIE, 1)),
    }


def paired_deltas(results: DataFrame, baseline_model: str, by: Sequence[str] = ("evaluation_context",)) -> DataFrame:
    """Candidate minus baseline error per recording; recordings without a baseline drop."""
    base = of_model("rmse_all_horizons", baseline_model, by)
    return (
        results.withColumn("baseline_rmse", base)
        .filter((F.col("model") != baseline_model) & F.col("baseline_rmse").isNotNull())
        .withColumn("delta", F.col("rmse_all_horizons") - F.col("baseline_rmse"))
    )


def paired_comparison(
    results: DataFrame,
    baseline_model: str,
    order: str = "recording_id",
    spec: BootstrapSpec = BootstrapSpec(),
    by: Sequence[str] = ("evaluation_context",),
    bounded: bool | None = None,
) -> DataFrame:
    """Paired table: mean and median difference, interval, wins, sign-flip p, improvements."""
    keys = [*by, "model"]
    deltas = paired_deltas(results, baseline_model, by)
    counts = deltas.groupBy(*keys).agg(
        *[c.alias(k) for k, c in win_loss_tie(F.col("delta")).items()],
        F.avg("baseline_rmse").alias("baseline_mean"),
        F.avg("rmse_all_horizons").alias("candidate_mean"),
    )
    boot = bootstrap_ci(deltas, keys, "delta", order, spec, bounded).select(
        *keys, "n_recordings", F.col("mean").alias("mean_delta"), F.col("median").alias("median_delta"), "ci_low", "ci_high"
    )
    flips = sign_flip_p(deltas, keys, "delta", order, bounded)
    gain = F.col("baseline_mean") - F.col("candidate_mean")
    return (
        boot.join(counts, keys)
        .join(flips, keys)
        .withColumns({"absolute_improvement": gain, "relative_improvement_pct": F.try_divide(100.0 * gain, F.col("baseline_mean"))})
    )


def context_summary(
    results: DataFrame,
    baseline: BaselineSpec,
    order: str = "recording_id",
    spec: BootstrapSpec = BootstrapSpec(),
    by: Sequence[str] = ("evaluation_context",),
    bounded: bool | None = None,
) -> DataFrame:
    """Summary per (context, model).

    Both published skills are given: the mean of the per-recording skills, and the
    skill of the mean errors.
    """
    keys = [*by, "model"]
    rows = results.withColumn("base", of_model("rmse_all_horizons", PERSISTENCE, by)).withColumns(
        {"delta": F.col("rmse_all_horizons") - F.col("base"), "rec_skill": skill_score(F.col("rmse_all_horizons"), F.col("base"))}
    )
    learned = F.col("model") != PERSISTENCE
    means = rows.groupBy(*keys).agg(
        F.avg("mae_all_horizons").alias("mean_mae"),
        *[F.avg(f"rmse_at_{h}").alias(f"mean_rmse_at_{h}") for h in baseline.report_horizons],
        F.avg(F.when(learned, F.col("rec_skill"))).alias("mean_recording_skill"),
        F.avg("base").alias("persistence_mean"),
        *[F.when(learned, c).alias(f"{k}_vs_persistence") for k, c in win_loss_tie(F.col("delta")).items()],
    )
    boot = bootstrap_ci(rows, keys, "rmse_all_horizons", order, spec, bounded)
    renamed = {"mean": "mean_rmse", "median": "median_rmse", "std": "sd_rmse", "min": "min_rmse", "max": "max_rmse"}
    return (
        boot.withColumnsRenamed(renamed)
        .join(means, keys)
        .withColumn("skill_of_means", skill_score(F.col("mean_rmse"), F.col("persistence_mean")))
        .drop("persistence_mean")
    )


def setting_comparison(
    results: DataFrame, baseline: BaselineSpec, order: str, spec: BootstrapSpec, primary: str, other: str, bounded: bool | None = None
) -> DataFrame:
    """Two settings of one model side by side, per context and model.

    `results` has a `setting` column beside per-recording errors. Each setting gets the mean with
    its bootstrap interval and the mean error at each reported horizon; `delta` is the other
    setting's mean minus the primary one's.
    """
    by = ["evaluation_context", "model"]
    at = [f"rmse_at_{h}" for h in baseline.report_horizons]
    ci = bootstrap_ci(results, [*by, "setting"], "rmse_all_horizons", order, spec, bounded).select(*by, "setting", "n_recordings", "mean", "ci_low", "ci_high")
    means = results.groupBy(*by, "setting").agg(*[F.avg(c).alias(f"mean_{c}") for c in at])
    values = ["n_recordings", "mean", "ci_low", "ci_high", *[f"mean_{c}" for c in at]]
    of = lambda c, s: F.max(F.when(F.col("setting") == s, F.col(c))).alias(f"{s}_{c}")
    wide = ci.join(means, [*by, "setting"]).groupBy(*by).agg(*[of(c, s) for s in (primary, other) for c in values])
    return wide.withColumn("delta", F.col(f"{other}_mean") - F.col(f"{primary}_mean"))


def horizon_summary(
    results: DataFrame, window_spec, order: str = "recording_id", spec: BootstrapSpec | None = None,
    by: Sequence[str] = ("evaluation_context", "model"), bounded: bool | None = None,
) -> DataFrame:
    """Equal-recording mean per horizon, with intervals if a bootstrap is given."""
    rows = horizon_rows(results, window_spec, list(dict.fromkeys([*by, order])))
    keys = [*by, "horizon_index", "horizon_ms"]
    if spec is None:
        return rows.groupBy(*keys).agg(F.avg("rmse").alias("mean_rmse"))
    boot = bootstrap_ci(rows, keys, "rmse", order, spec, bounded)
    return boot.select(*keys, F.col("mean").alias("mean_rmse"), "ci_low", "ci_high")


def transfer_gaps(summary: DataFrame, directions: DataFrame, value: str = "mean_rmse") -> DataFrame:
    """Zero-shot minus within-target error per direction; persistence has no source model.

    `directions` is a small table (direction, within_context).
    """
    learned = summary.filter(F.col("model") != PERSISTENCE)
    zero = learned.select(F.col("evaluation_context").alias("direction"), "model", F.col(value).alias("zero_shot_rmse"))
    within = learned.select(F.col("evaluation_context").alias("within_context"), "model", F.col(value).alias("within_target_rmse"))
    gap = F.col("zero_shot_rmse") - F.col("within_target_rmse")
    return (
        zero.join(directions, "direction")
        .join(within, ["within_context", "model"])
        .withColumns({"transfer_gap": gap, "relative_transfer_gap_pct": F.try_divide(100.0 * gap, F.col("within_target_rmse"))})
        .drop("within_context")
    )


def high_target_summary(high: DataFrame, summary: DataFrame, by: Sequence[str] = ("evaluation_context", "model")) -> DataFrame:
    """Upper-tail error against the overall error, NULL recordings skipped."""
    means = high.groupBy(*by).agg(F.count(F.lit(1)).alias("n_recordings"), F.avg("rmse_high_p95_targets").alias("rmse_high"))
    up = F.col("rmse_high") - F.col("rmse_all")
    return means.join(summary.select(*by, F.col("mean_rmse").alias("rmse_all")), list(by)).withColumns(
        {
            "difficulty_ratio": F.try_divide(F.col("rmse_high"), F.col("rmse_all")),
            "absolute_increase": up,
            "relative_increase": F.try_divide(up, F.col("rmse_all")),
        }
    )


def input_ablation(runs: DataFrame, by: Sequence[str] = ("source_dataset",)) -> DataFrame:
    """q_f against q_f+q_w validation error, one row per source."""
    wide = runs.groupBy(*by).agg(
        F.max(F.when(F.col("input") == "q_f", F.col("val_rmse"))).alias("qf_only_val_rmse"),
        F.max(F.when(F.col("input") == "q_f+q_w", F.col("val_rmse"))).alias("qf_qw_val_rmse"),
    )
    diff = F.col("qf_qw_val_rmse") - F.col("qf_only_val_rmse")
    return wide.withColumns({"absolute_difference": diff, "relative_difference": F.try_divide(diff, F.col("qf_only_val_rmse"))})


def footprint(runs: DataFrame, by: Sequence[str] = ("model", "source_dataset")) -> DataFrame:
    """Mean cost per trained model, and its mean within-domain error."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fits"),
        F.avg("train_seconds").alias("mean_train_seconds"),
        F.avg("model_bytes").alias("mean_model_bytes"),
        F.avg("within_rmse").alias("mean_within_rmse"),
    )


RESULT_KEYS = ("evaluation_context", "model", *RECORDING)
