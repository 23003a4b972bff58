"""Choosing model configurations from source validation only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.config import RECORDING, BaselineSpec, WindowSpec
from sensorloom.operators.linear import RIDGE_MODELS, Moments, fit_models, moment_rmse, raw_theta, solve_ridge, sum_moments
from sensorloom.operators.splits import held_out_folds


def tied_argmin(scores: DataFrame, by: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Best score per key, ties within a relative tolerance broken towards the
    shortest lag and then the largest alpha. Non-finite scores do not compete."""
    finite = scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    key = Window.partitionBy(*by)
    tied = finite.withColumn("best_score", F.min("score").over(key)).filter(F.col("score") <= F.col("best_score") * (1 + tolerance))
    first = F.min_by(F.struct("lag", "alpha", "score"), F.struct("lag", (-F.col("alpha")).alias("a")))
    return (
        tied.groupBy(*by)
        .agg(first.alias("c"), F.count(F.lit(1)).alias("n_tied"), F.first("best_score").alias("best_score"))
        .select(*by, F.col("c.lag").alias("lag"), F.col("c.alpha").alias("alpha"), F.col("c.score").alias("score"), "n_tied", "best_score")
    )


def select_config(runs: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Config choice from run logs: mean over validation recordings per seed, then over
    seeds; smallest score, then fewest parameters, then id. Epochs are the rounded
    median best epoch (half to even), at least 1."""
    keys = [*by, "config_id"]
    per_seed = (
        runs.select(*keys, "seed", F.explode(F.map_values("rmse_by_seq")).alias("rmse"))
        .groupBy(*keys, "seed")
        .agg(F.avg("rmse").alias("m"))
        .groupBy(*keys)
        .agg(F.avg("m").alias("score"), F.count(F.lit(1)).alias("n_seeds"))
    )
    epochs = runs.groupBy(*keys).agg(F.median("best_epoch").alias("e"), F.count(F.lit(1)).alias("n_records"))
    scored = per_seed.join(epochs, keys).join(sizes, "config_id", "left").fillna({"n_params": 0})
    order = Window.partitionBy(*by).orderBy("score", "n_params", "config_id")
    chosen = scored.withColumn("rank", F.row_number().over(order)).filter("rank = 1")
    return chosen.select(*keys, "score", "n_params", "n_records", "n_seeds", F.greatest(F.bround("e"), F.lit(1)).cast("bigint").alias("selected_epochs"))


def best_model(summary: DataFrame, by: Sequence[str], value: str = "mean_rmse") -> DataFrame:
    """Lowest error per key; the model name breaks exact ties."""
    return summary.groupBy(*by).agg(
        F.min_by("model", F.struct(value, "model")).alias("best_model"), F.min(value).alias("best_value")
    )


# --- ridge selection on moments ------------------------------------------------


def outer_folds(moments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Fits to make: one per held-out recording, and one per dataset with nothing held.

    `held_moments` is the held recording's matrix (NULL when nothing is held).
    """
    loro = held_out_folds(recordings).join(
        moments.select("dataset", F.col("recording_id").alias("held_recording"), F.col("moments").alias("held_moments"), F.col("n_windows").alias("held_windows")),
        ["dataset", "held_recording"],
    )
    source = moments.select("dataset").distinct().select(
        F.concat("dataset", F.lit("_SOURCE")).alias("fold_id"), "dataset"
    )
    return loro.unionByName(source, allowMissingColumns=True)


def _minus(a, b):
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x - y))


def outer_train(moments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Summed train moments of each outer fold: dataset total minus the held recording."""
    totals = sum_moments(moments, ["dataset"])
    held = F.col("held_moments")
    return outer_folds(moments, recordings).join(totals, "dataset").select(
        "fold_id", "dataset", "held_recording", "held_group", "held_moments",
        (F.col("n_rec") - held.isNotNull().cast("bigint")).alias("n_rec"),
        (F.col("n_windows") - F.coalesce("held_windows", F.lit(0))).alias("n_windows"),
        _minus(F.col("moments"), held).alias("moments"),
    )


def inner_train(moments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Train moments of each (outer fold, validation group) inside the outer train set."""
    outer = outer_train(moments, recordings)
    groups = sum_moments(moments, ["dataset", "dependency_group"]).select(
        "dataset", F.col("dependency_group").alias("val_group"), F.col("n_rec").alias("g_rec"), F.col("n_windows").alias("g_windows"), F.col("moments").alias("g_moments")
    )
    inside = F.coalesce(F.col("held_group") == F.col("val_group"), F.lit(False))
    g_rec = F.col("g_rec") - inside.cast("bigint")
    g = F.when(inside, F.zip_with("g_moments", "held_moments", lambda a, b: a - b)).otherwise(F.col("g_moments"))
    return (
        outer.join(groups, "dataset")
        .withColumns({"n_val": g_rec, "n_train": F.col("n_rec") - g_rec})
        .filter("n_val > 0 and n_train > 0")
        .select("fold_id", "dataset", "held_recording", "val_group", F.col("n_train").alias("n_rec"), _minus(F.col("moments"), g).alias("moments"))
    )


def validation_scores(moments: DataFrame, recordings: DataFrame, spec: WindowSpec, grid: Sequence[tuple[str, int, float]]) -> DataFrame:
    """Validation RMSE of every (fold, model, lag, alpha, validation recording).

    Solves happen once per (fold, group); the small coefficient maps then meet the
    validation recordings' own moments on (dataset, group).
    """
    layout = Moments(spec.lookback, spec.horizon)
    jobs = [(m, int(lag), float(a)) for m, lag, a in grid]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                m = np.asarray(row.moments).reshape(layout.width, -1) / row.n_rec
                thetas = [raw_theta(solve_ridge(m, layout, lag, a, RIDGE_MODELS[name]), layout, lag, RIDGE_MODELS[name]).ravel() for name, lag, a in jobs]
                yield pd.DataFrame({"fold_id": [row.fold_id], "dataset": [row.dataset], "held_recording": [row.held_recording], "val_group": [row.val_group], "thetas": [np.concatenate(thetas)]})

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                m = np.asarray(row.moments).reshape(layout.width, -1)
                thetas = np.asarray(row.thetas).reshape(len(jobs), layout.width, layout.horizon)
                rmse = [moment_rmse(t, m, layout) for t in thetas]
                yield pd.DataFrame({
                    "fold_id": row.fold_id, "dataset": row.dataset, "recording_id": row.recording_id,
                    "model": [j[0] for j in jobs], "lag": [j[1] for j in jobs], "alpha": [j[2] for j in jobs], "rmse": rmse,
                })

    solved = inner_train(moments, recordings).mapInPandas(
        solve, "fold_id string, dataset string, held_recording string, val_group string, thetas array<double>"
    )
    held = moments.select("dataset", F.col("dependency_group").alias("val_group"), "recording_id", "moments")
    pairs = solved.join(held, ["dataset", "val_group"]).filter(~F.col("recording_id").eqNullSafe(F.col("held_recording")))
    return pairs.select("fold_id", "dataset", "recording_id", "thetas", "moments").mapInPandas(
        score, "fold_id string, dataset string, recording_id string, model string, lag int, alpha double, rmse double"
    )


def validation_means(
    moments: DataFrame, recordings: DataFrame, spec: WindowSpec, baseline: BaselineSpec, lags: Sequence[int] | None = None
) -> DataFrame:
    """Mean validation RMSE of every (fold, model, lag, alpha) of the grid."""
    grid = [(m, lag, a) for m in RIDGE_MODELS for lag in (lags or baseline.lags) for a in baseline.alphas]
    return (
        validation_scores(moments, recordings, spec, grid)
        .groupBy("fold_id", "dataset", "model", "lag", "alpha")
        .agg(F.avg("rmse").alias("score"), F.count(F.lit(1)).alias("n_val"))
    )


def best_of_grid(scores: DataFrame, baseline: BaselineSpec) -> DataFrame:
    """The selected lag and penalty per fold and model."""
    return tied_argmin(scores, ["fold_id", "dataset", "model"], baseline.tie_tolerance)


def select_ridge(
    moments: DataFrame, recordings: DataFrame, spec: WindowSpec, baseline: BaselineSpec, lags: Sequence[int] | None = None
) -> DataFrame:
    """Nested leave-group-out selection for every outer fold, per ridge model.

    A fold whose train set is a single group cannot be split again and is left out.
    """
    return best_of_grid(validation_means(moments, recordings, spec, baseline, lags), baseline)


def refit(moments: DataFrame, recordings: DataFrame, selected: DataFrame, spec: WindowSpec, shift: tuple[float, float]) -> DataFrame:
    """Final fits: each outer fold's whole train set with its selected configuration."""
    train = outer_train(moments, recordings).drop("held_moments")
    return fit_models(
        train, ["fold_id", "dataset", "held_recording"], spec, shift, selected.select("fold_id", "model", "lag", "alpha")
    )


def assign_models(models: DataFrame, recordings: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Which model scores which recording: held-out ones within a dataset, and every
    target recording for a source model."""
    within = models.filter("held_recording is not null").withColumns(
        {"evaluation_context": F.concat(F.lit("WITHIN_"), "dataset"), "recording_id": F.col("held_recording")}
    )
    source = models.filter("held_recording is null").withColumnRenamed("dataset", "source")
    route = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("dataset")) for s, t in pairs])
    targets = recordings.select(F.col("dataset").alias("own"), "recording_id", F.inline(route)).filter("own = dataset").drop("own")
    across = source.join(targets, "source").withColumn("evaluation_context", F.concat_ws("_TO_", "source", "dataset"))
    return within.unionByName(across.drop("source"))


def local_assignments(recordings: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Contexts in which each recording is scored, for forecasters without a fit."""
    contexts = F.concat(
        F.array(F.concat(F.lit("WITHIN_"), F.col("dataset"))),
        F.filter(
            F.array(*[F.when(F.col("dataset") == t, F.lit(f"{s}_TO_{t}")) for s, t in pairs]), lambda c: c.isNotNull()
        ),
    )
    return recordings.select(*RECORDING, "ord", F.explode(contexts).alias("evaluation_context"))
