"""Forecast errors per recording. A recording is one observation, whatever its length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.config import RECORDING, BaselineSpec, WindowSpec
from sensorloom.functions.arrays import errors, total
from sensorloom.functions.scalar import skill_score
from sensorloom.operators.forecasts import PERSISTENCE
from sensorloom.operators.ordering import join_facts

METRICS = ("rmse_all_horizons", "mae_all_horizons")


def horizon_name(h: int) -> str:
    return f"rmse_h{h:02d}"


def horizon_names(spec: WindowSpec) -> list[str]:
    return [horizon_name(h) for h in range(1, spec.horizon + 1)]


def recording_results(
    predictions: DataFrame, spec: WindowSpec, baseline: BaselineSpec, by: Sequence[str] = ("model",)
) -> DataFrame:
    """RMSE and MAE over all cells, RMSE per horizon and at the report horizons.

    One map-side combined aggregation of per-horizon squared-error sums; the overall
    RMSE is derived from the same sums.
    """
    if max(baseline.report_horizons) > spec.horizon:
        raise ValueError("report horizons must lie within the horizon")
    steps = range(1, spec.horizon + 1)
    sums = (
        predictions.withColumn("e", errors(F.col("yhat"), F.col("y")))
        .groupBy(*by, *RECORDING)
        .agg(
            F.count(F.lit(1)).alias("n_origins"),
            F.sum(total(F.col("e"), F.abs)).alias("sae"),
            *[F.sum(F.get("e", F.lit(h - 1)) * F.get("e", F.lit(h - 1))).alias(f"sse{h}") for h in steps],
        )
    )
    cells = F.col("n_origins") * spec.horizon
    sse = sum((F.col(f"sse{h}") for h in steps), F.lit(0.0))
    curve = {h: F.sqrt(F.col(f"sse{h}") / F.col("n_origins")) for h in steps}
    return sums.select(
        *by,
        *RECORDING,
        "n_origins",
        F.sqrt(sse / cells).alias("rmse_all_horizons"),
        (F.col("sae") / cells).alias("mae_all_horizons"),
        *[curve[h].alias(f"rmse_at_{h}") for h in baseline.report_horizons],
        *[curve[h].alias(horizon_name(h)) for h in steps],
    )


def of_model(column: str, model: str, by: Sequence[str]) -> Column:
    """Value of one model's row, next to every row of the same (by, recording)."""
    same = Window.partitionBy(*by, *RECORDING)
    return F.max(F.when(F.col("model") == model, F.col(column))).over(same)


def with_skill(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Skill against the persistence row of the same recording (NULL on that row)."""
    base = of_model("rmse_all_horizons", PERSISTENCE, by)
    return (
        results.withColumn("persistence_rmse", base)
        .withColumn("skill", F.when(F.col("model") != PERSISTENCE, skill_score(F.col("rmse_all_horizons"), F.col("persistence_rmse"))))
        .drop("persistence_rmse")
    )


def equal_recording_mean(results: DataFrame, by: Sequence[str], values: Sequence[str] = METRICS) -> DataFrame:
    """Unweighted mean over recordings."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_recordings"), *[F.avg(v).alias(f"mean_{v}") for v in values]
    )


def horizon_rows(results: DataFrame, spec: WindowSpec, by: Sequence[str], dt_ms: int = 10) -> DataFrame:
    """Wide horizon columns as rows (by, recording, horizon_index, rmse)."""
    pairs = F.array(
        *[F.struct(F.lit(h).cast("bigint").alias("horizon_index"), F.col(horizon_name(h)).alias("rmse")) for h in range(1, spec.horizon + 1)]
    )
    rows = results.select(*dict.fromkeys([*by, *RECORDING]), F.inline(pairs))
    return rows.withColumn("horizon_ms", F.col("horizon_index") * dt_ms)


def high_target_results(predictions: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """RMSE over cells whose target is above the recording's threshold (NULL if none)."""
    cells = F.filter(F.arrays_zip("yhat", "y"), lambda c: c["y"] > F.col("p95_qf"))
    sse = F.aggregate(cells, F.lit(0.0), lambda a, c: a + (c["yhat"] - c["y"]) * (c["yhat"] - c["y"]))
    return (
        join_facts(predictions, thresholds, RECORDING, "origin")
        .withColumn("cells", cells)
        .groupBy(*by, *RECORDING)
        .agg(
            F.max("p95_qf").alias("p95_threshold"),
            F.sum(F.size("cells").cast("bigint")).alias("n_high_cells"),
            F.sum(sse).alias("sse"),
        )
        .withColumn("rmse_high_p95_targets", F.sqrt(F.try_divide(F.col("sse"), F.col("n_high_cells"))))
        .drop("sse")
    )


def seed_average(results: DataFrame, spec: WindowSpec, baseline: BaselineSpec, by: Sequence[str]) -> DataFrame:
    """Mean over training seeds of the metrics (not of the forecasts)."""
    values = [*METRICS, *[f"rmse_at_{h}" for h in baseline.report_horizons], *horizon_names(spec)]
    return results.groupBy(*by, *RECORDING).agg(
        F.max("n_origins").alias("n_origins"), F.count_distinct("seed").alias("n_seeds"), *[F.avg(v).alias(v) for v in values]
    )


def seed_variability(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spread across seeds of the equal-recording mean, sample SD."""
    per_seed = results.groupBy(*by, "seed").agg(F.avg("rmse_all_horizons").alias("m"))
    return per_seed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("m").alias("mean_across_seeds"),
        F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd_across_seeds"),
        F.min("m").alias("min_seed"),
        F.max("m").alias("max_seed"),
        (F.max("m") - F.min("m")).alias("range"),
    )


def normalised_mse(predictions: DataFrame, scale: Column, by: Sequence[str] = ("model",)) -> DataFrame:
    """Equal-recording mean of squared error in units of `scale`."""
    e = errors(F.col("yhat"), F.col("y"))
    sse = total(e, lambda v: (v / scale) * (v / scale))
    per_recording = predictions.groupBy(*by, *RECORDING).agg(
        (F.sum(sse) / F.sum(F.size("y"))).alias("mse"), F.count(F.lit(1)).alias("n_windows")
    )
    return per_recording.groupBy(*by).agg(F.avg("mse").alias("norm_mse"), F.sum("n_windows").alias("n_windows"))
