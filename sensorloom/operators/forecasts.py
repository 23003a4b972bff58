"""Named forecasters over window arrays, and frozen external models.

A forecaster is a function (WindowSpec, BaselineSpec) -> Column giving an array of
`horizon` values from the `hist_qf` / `hist_qw` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING, BaselineSpec, WindowSpec
from sensorloom.functions.arrays import linear_extrapolation, persistence

Forecaster = Callable[[WindowSpec, BaselineSpec], Column]

PERSISTENCE, LINEAR, RIDGE_QF, RIDGE_QF_QW = "B0_PERSISTENCE", "B1_LINEAR", "B2_RIDGE_QF", "B3_RIDGE_QF_QW"

_REGISTRY: dict[str, Forecaster] = {}


def register_forecaster(name: str, column_fn: Forecaster) -> None:
    """Make a local forecaster available to `predict` under `name`."""
    _REGISTRY[name] = column_fn


register_forecaster(PERSISTENCE, lambda w, b: persistence(F.col("hist_qf"), w.horizon))
register_forecaster(LINEAR, lambda w, b: linear_extrapolation(F.col("hist_qf"), b.linear_k, w.lookback, w.horizon, b.dt_s))

PREDICTION_COLUMNS = [*RECORDING, "dependency_group", "origin", "model", "yhat", "y"]


def predict(windows: DataFrame, spec: WindowSpec, baseline: BaselineSpec, models: Sequence[str] = (PERSISTENCE, LINEAR)) -> DataFrame:
    """One row per (window, model) with forecast and target arrays."""
    unknown = [m for m in models if m not in _REGISTRY]
    if unknown:
        raise ValueError(f"unknown forecasters: {unknown}")
    rows = F.array(*[F.struct(F.lit(m).alias("model"), _REGISTRY[m](spec, baseline).alias("yhat")) for m in models])
    return windows.select(*RECORDING, "dependency_group", "origin", F.col("future_qf").alias("y"), F.inline(rows)).select(
        *PREDICTION_COLUMNS
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length list column of an Arrow batch as a 2-D array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def list_column(values: np.ndarray) -> pa.ListArray:
    """2-D array as an Arrow list column."""
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def score_with(
    windows: DataFrame,
    model_name: str,
    model_blob: Any,
    fn: Callable[[Any, np.ndarray], np.ndarray],
    channel_mean: Sequence[float],
    channel_std: Sequence[float],
    target_mean: float,
    target_std: float,
    use_qw: bool = True,
) -> DataFrame:
    """Apply a frozen external model to windows in Arrow batches.

    `fn(blob, x)` gets float32 input of shape (batch, lookback, channels), scaled
    per channel, and returns (batch, horizon) scaled forecasts, which are scaled
    back. The blob travels with the task closure and must be a small frozen model.
    """
    mean, std = np.asarray(channel_mean, float), np.asarray(channel_std, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            channels = [matrix(batch["hist_qf"])] + ([matrix(batch["hist_qw"])] if use_qw else [])
            x = (np.stack(channels, axis=-1) - mean) / std
            yhat = np.asarray(fn(model_blob, x.astype(np.float32)), dtype=np.float64) * target_std + target_mean
            keep = [batch[c] for c in (*RECORDING, "dependency_group", "origin")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array([model_name] * batch.num_rows), list_column(yhat), batch["future_qf"]],
                names=PREDICTION_COLUMNS,
            )

    schema = "dataset string, recording_id string, dependency_group string, origin bigint, model string, yhat array<double>, y array<double>"
    return windows.select(*RECORDING, "dependency_group", "origin", "hist_qf", "hist_qw", "future_qf").mapInArrow(run, schema)
