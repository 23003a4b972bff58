"""Equal-recording ridge regression from per-recording moment matrices.

With z = [1, q_f lags, q_w lags, targets], every recording contributes the mean of
z z' over its windows. Equal-recording weighting is then a plain mean of these
matrices, a train set is a sum, a held-out recording is a difference, a shorter lag
is a sub-matrix, and the validation error of a fitted model is a quadratic form.
One pass over the windows therefore serves every fold, lag and penalty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING, BaselineSpec, WindowSpec
from sensorloom.functions.arrays import dot, norm2
from sensorloom.operators.forecasts import PREDICTION_COLUMNS, RIDGE_QF, RIDGE_QF_QW, list_column, matrix
from sensorloom.operators.ordering import join_facts

RIDGE_MODELS = {RIDGE_QF: False, RIDGE_QF_QW: True}
MERGE_SALTS = 32
# Models a scoring task may hold: about 64 MB of coefficients.
MAX_BROADCAST_CELLS = 8_000_000


@dataclass(frozen=True)
class Moments:
    """Layout of a moment matrix over z."""

    lookback: int
    horizon: int

    @property
    def width(self) -> int:
        return 1 + 2 * self.lookback + self.horizon

    def inputs(self, lag: int, use_qw: bool) -> list[int]:
        """Columns of the last `lag` q_f (and q_w) values."""
        L = self.lookback
        qf = list(range(1 + L - lag, 1 + L))
        return qf + ([i + L for i in qf] if use_qw else [])

    @property
    def targets(self) -> list[int]:
        first = 1 + 2 * self.lookback
        return list(range(first, first + self.horizon))


def recording_moments(windows: DataFrame, spec: WindowSpec, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(dataset, recording_id, dependency_group, n_windows, moments) per recording.

    Python turns each Arrow batch into one summed matrix per recording in it; the
    sums merge in the JVM with map-side combining, first per salt and then per
    recording, so a long recording never meets in one task at window level.
    `shift` (a constant per channel) keeps the second moments well conditioned.
    """
    layout = Moments(spec.lookback, spec.horizon)
    cf, cw = shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if batch.num_rows == 0:
                continue
            z = np.hstack([
                np.ones((batch.num_rows, 1)),
                matrix(batch["hist_qf"]) - cf,
                matrix(batch["hist_qw"]) - cw,
                matrix(batch["future_qf"]) - cf,
            ])
            keys = pd.DataFrame({c: batch[c].to_pandas() for c in (*RECORDING, "dependency_group")})
            groups = list(keys.groupby(list(keys.columns), sort=False).indices.items())
            sums = np.stack([(z[rows].T @ z[rows]).ravel() for _, rows in groups])
            heads = [pa.array([k[i] for k, _ in groups]) for i in range(3)]
            salt = pa.array([number % MERGE_SALTS] * len(groups), pa.int32())
            counts = pa.array([float(len(rows)) for _, rows in groups])
            yield pa.RecordBatch.from_arrays([*heads, salt, counts, list_column(sums)], names=[*RECORDING, "dependency_group", "salt", "n", "m"])

    partial = windows.select(*RECORDING, "dependency_group", "hist_qf", "hist_qw", "future_qf").mapInArrow(
        run, "dataset string, recording_id string, dependency_group string, salt int, n double, m array<double>"
    )
    keys = [*RECORDING, "dependency_group"]
    salted = partial.withColumn("v", array_to_vector("m")).groupBy(*keys, "salt").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("v")).alias("v"))
    merged = salted.groupBy(*keys).agg(F.sum("n").alias("n"), Summarizer.sum(F.col("v")).alias("v"))
    return merged.select(
        *keys, F.col("n").cast("bigint").alias("n_windows"), F.transform(vector_to_array("v"), lambda e: e / F.col("n")).alias("moments")
    )


def channel_shift(streams: DataFrame) -> tuple[float, float]:
    """Rough centre of each channel, to condition the moments (no effect on fits)."""
    row = streams.agg(F.avg("q_f"), F.avg("q_w")).first()
    return float(row[0] or 0.0), float(row[1] or 0.0)


def sum_moments(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summed moments and number of recordings per group."""
    return (
        df.withColumn("v", array_to_vector("moments"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rec"), F.sum("n_windows").alias("n_windows"), Summarizer.sum(F.col("v")).alias("v"))
        .withColumn("moments", vector_to_array("v"))
        .drop("v")
    )


def solve_ridge(m: np.ndarray, layout: Moments, lag: int, alpha: float, use_qw: bool) -> dict[str, np.ndarray]:
    """Ridge on standardised inputs from a mean moment matrix."""
    x, y = layout.inputs(lag, use_qw), layout.targets
    mean_x, mean_y = m[0, x], m[0, y]
    cov = m[np.ix_(x, x)] - np.outer(mean_x, mean_x)
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    std = np.where(std < 1e-12, 1.0, std)
    cross = (m[np.ix_(x, y)] - np.outer(mean_x, mean_y)) / std[:, None]
    beta = np.linalg.solve(cov / np.outer(std, std) + alpha * np.eye(len(x)), cross)
    return {"mean": mean_x, "std": std, "coef": beta.T, "intercept": mean_y}


def raw_theta(fit: dict[str, np.ndarray], layout: Moments, lag: int, use_qw: bool) -> np.ndarray:
    """The model as a (width, horizon) map from z to forecasts in z's own units."""
    theta = np.zeros((layout.width, layout.horizon))
    slope = fit["coef"] / fit["std"]
    theta[layout.inputs(lag, use_qw)] = slope.T
    theta[0] = fit["intercept"] - slope @ fit["mean"]
    return theta


def moment_rmse(theta: np.ndarray, m: np.ndarray, layout: Moments) -> float:
    """RMSE over all cells of a recording from its moments."""
    residual = -theta.copy()
    residual[layout.targets, range(layout.horizon)] += 1.0
    mse = np.einsum("ij,ik,kj->", residual, m, residual) / layout.horizon
    return float(np.sqrt(max(mse, 0.0)))


FIT_SCHEMA = (
    "model string, lag int, alpha double, n_features int, scaler_mean array<double>, scaler_std array<double>, "
    "coef array<array<double>>, intercept array<double>"
)


def fit_models(train: DataFrame, keys: Sequence[str], spec: WindowSpec, shift: tuple[float, float], configs: DataFrame) -> DataFrame:
    """Fitted models: one per train row and matching config.

    `train` has the keys, `n_rec`, `n_windows` and summed `moments`; `configs` has
    model, lag, alpha and at least one of the keys. Inputs are in channel units.
    """
    layout = Moments(spec.lookback, spec.horizon)
    jobs = train.join(configs, [k for k in keys if k in configs.columns])
    key_types = ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                use_qw, lag = RIDGE_MODELS[row.model], int(row.lag)
                m = np.asarray(row.moments).reshape(layout.width, layout.width) / row.n_rec
                fit = solve_ridge(m, layout, lag, row.alpha, use_qw)
                back = np.repeat([shift[0], shift[1]], lag)[: len(fit["mean"])]
                out.append([getattr(row, k) for k in keys] + [
                    row.model, lag, row.alpha, len(fit["mean"]), fit["mean"] + back, fit["std"], list(fit["coef"]), fit["intercept"] + shift[0], row.n_windows,
                ])
            names = [*keys, "model", "lag", "alpha", "n_features", "scaler_mean", "scaler_std", "coef", "intercept", "n_windows"]
            yield pd.DataFrame(out, columns=names)

    return jobs.select(*keys, "n_rec", "n_windows", "moments", "model", "lag", "alpha").mapInPandas(run, f"{key_types}, {FIT_SCHEMA}, n_windows bigint")


def ridge_predict(windows: DataFrame, models: DataFrame, spec: WindowSpec, assign: Sequence[str] = RECORDING) -> DataFrame:
    """Forecasts of the models assigned to each window's recording.

    `models` carries the `assign` columns (which recordings it scores), an
    `evaluation_context` and a `fold_id`. A small model table goes to every task and
    windows are scored as matrix products; a large one is joined instead.
    """
    needed = models.select(*assign, "evaluation_context", "fold_id", "model", "lag", "scaler_mean", "scaler_std", "coef", "intercept")
    limit = MAX_BROADCAST_CELLS // (spec.horizon * 2 * spec.lookback)
    head = needed.limit(limit + 1).collect()
    if len(head) > limit:
        return _predict_joined(windows, needed, spec, assign)
    return _predict_broadcast(windows, head, spec, assign)


def _predict_joined(windows: DataFrame, models: DataFrame, spec: WindowSpec, assign: Sequence[str]) -> DataFrame:
    L = spec.lookback
    lag = F.col("lag")
    tail = lambda c: F.slice(c, F.lit(L + 1) - lag, lag)
    x = F.when(F.size("scaler_mean") > lag, F.concat(tail("hist_qf"), tail("hist_qw"))).otherwise(tail("hist_qf"))
    scaled = F.zip_with(F.zip_with(x, F.col("scaler_mean"), lambda a, b: a - b), F.col("scaler_std"), lambda a, b: a / b)
    joined = join_facts(windows, models, assign, "origin").withColumn("xs", scaled)
    yhat = F.zip_with(F.transform("coef", lambda c: dot(c, F.col("xs"))), F.col("intercept"), lambda a, b: a + b)
    return joined.withColumns({"yhat": yhat, "y": F.col("future_qf")}).select("evaluation_context", "fold_id", *PREDICTION_COLUMNS)


def _predict_broadcast(windows: DataFrame, models: list, spec: WindowSpec, assign: Sequence[str]) -> DataFrame:
    by_key: dict[tuple, list] = {}
    for r in models:
        slope = np.asarray(r.coef) / np.asarray(r.scaler_std)
        bias = np.asarray(r.intercept) - slope @ np.asarray(r.scaler_mean)
        use_qw = len(r.scaler_mean) > r.lag
        by_key.setdefault(tuple(r[k] for k in assign), []).append((r.evaluation_context, r.fold_id, r.model, int(r.lag), use_qw, slope, bias))
    shared = windows.sparkSession.sparkContext.broadcast(by_key)
    L = spec.lookback

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pd.DataFrame({c: batch[c].to_pandas() for c in assign})
            for key, rows in keys.groupby(list(assign), sort=False).indices.items():
                part = batch.take(pa.array(rows))
                qf, qw = matrix(part["hist_qf"]), matrix(part["hist_qw"])
                for context, fold, model, lag, use_qw, slope, bias in shared.value.get(key if isinstance(key, tuple) else (key,), []):
                    x = np.hstack([qf[:, L - lag :], qw[:, L - lag :]]) if use_qw else qf[:, L - lag :]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([context] * n), pa.array([fold] * n), *[part[c] for c in (*RECORDING, "dependency_group", "origin")],
                         pa.array([model] * n), list_column(x @ slope.T + bias), part["future_qf"]],
                        names=["evaluation_context", "fold_id", *PREDICTION_COLUMNS],
                    )

    schema = (
        "evaluation_context string, fold_id string, dataset string, recording_id string, dependency_group string, "
        "origin bigint, model string, yhat array<double>, y array<double>"
    )
    return windows.select(*RECORDING, "dependency_group", "origin", "hist_qf", "hist_qw", "future_qf").mapInArrow(run, schema)


def coefficient_audit(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Norms and sizes of fitted models and their scalers."""
    return models.select(
        *keys,
        "model",
        "lag",
        "alpha",
        "n_features",
        F.size("coef").alias("n_outputs"),
        (F.col("n_features") * F.size("coef")).alias("n_coefficients"),
        norm2(F.flatten("coef")).alias("coef_norm"),
        norm2(F.col("intercept")).alias("intercept_norm"),
        norm2(F.col("scaler_mean")).alias("mean_l2"),
        norm2(F.col("scaler_std")).alias("std_l2"),
        "n_windows",
    )


# --- weights and scalers as tables ------------------------------------------


def window_weights(windows: DataFrame, fold_keys: Sequence[str]) -> DataFrame:
    """Equal-recording weights per (fold, recording): every window of a recording
    weighs 1/(windows in it * recordings in the fold)."""
    sizes = windows.groupBy(*fold_keys, *RECORDING).agg(F.count(F.lit(1)).alias("n_windows"))
    folds = sizes.groupBy(*fold_keys).agg(F.count(F.lit(1)).alias("n_rec"))
    weight = F.lit(1.0) / (F.col("n_windows") * F.col("n_rec"))
    return sizes.join(folds, list(fold_keys)).withColumns({"weight": weight, "weight_sum": weight * F.col("n_windows")})


def channel_scaler(windows: DataFrame, by: Sequence[str] = ("dataset",), use_qw: bool = True) -> DataFrame:
    """One mean and SD per channel and for the target, pooled over window positions
    with equal-recording weights; a flat channel gets SD 1.

    Per-recording means of x and x^2 are enough: the mean of recordings of each is
    the weighted moment. Deviations are taken from a fixed point first.
    """
    parts = {"f": "hist_qf", "y": "future_qf"} | ({"w": "hist_qw"} if use_qw else {})
    centre = windows.groupBy(*by).agg(*[F.avg(F.get(c, F.lit(0))).alias(f"c_{k}") for k, c in parts.items()])
    rows = windows.join(centre, list(by))
    mean_of = lambda c, k: F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + (v - F.col(f"c_{k}"))) / F.size(c)
    square_of = lambda c, k: F.aggregate(
        F.col(c), F.lit(0.0), lambda a, v: a + (v - F.col(f"c_{k}")) * (v - F.col(f"c_{k}"))
    ) / F.size(c)
    per_rec = rows.groupBy(*dict.fromkeys([*by, *RECORDING])).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.first(f"c_{k}").alias(f"from_{k}") for k in parts],
        *[F.avg(mean_of(c, k)).alias(f"m_{k}") for k, c in parts.items()],
        *[F.avg(square_of(c, k)).alias(f"s_{k}") for k, c in parts.items()],
    )
    pooled = per_rec.groupBy(*by).agg(
        F.sum("n").alias("n_windows"),
        *[(F.first(f"from_{k}") + F.avg(f"m_{k}")).alias(f"{k}_mean") for k in parts],
        *[F.sqrt(F.greatest(F.avg(f"s_{k}") - F.avg(f"m_{k}") * F.avg(f"m_{k}"), F.lit(0.0))).alias(f"{k}_sd") for k in parts],
    )
    names = {"f": "feature_qf", "w": "feature_qw", "y": "target"}
    return pooled.select(
        *by,
        "n_windows",
        *[F.col(f"{k}_mean").alias(f"{names[k]}_mean") for k in parts],
        *[F.when(F.col(f"{k}_sd") < 1e-12, 1.0).otherwise(F.col(f"{k}_sd")).alias(f"{names[k]}_std") for k in parts],
    )
