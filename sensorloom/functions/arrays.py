"""Array expressions: features, local forecasts, window errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lag_slice(history: Column, lag: int, lookback: int) -> Column:
    """Last `lag` values of a history array."""
    if not 1 <= lag <= lookback:
        raise ValueError(f"lag {lag} does not fit a history of {lookback}")
    return F.slice(history, lookback - lag + 1, lag)


def features(lag: int, lookback: int, use_qw: bool = True) -> Column:
    """q_f lags, then q_w lags."""
    parts = ["hist_qf", "hist_qw"] if use_qw else ["hist_qf"]
    return F.concat(*[lag_slice(F.col(c), lag, lookback) for c in parts])


def channel_last(lag: int, lookback: int) -> Column:
    """The same history as an array of (q_f, q_w) pairs."""
    return F.arrays_zip(
        lag_slice(F.col("hist_qf"), lag, lookback).alias("q_f"), lag_slice(F.col("hist_qw"), lag, lookback).alias("q_w")
    )


def persistence(history: Column, horizon: int) -> Column:
    """The last value, repeated."""
    return F.array_repeat(F.element_at(history, -1), horizon)


def linear_extrapolation(history: Column, k: int, lookback: int, horizon: int, dt_s: float) -> Column:
    """Least-squares line through the last k values, read off at the next steps.

    Positions are centred, so the slope is a constant dot product and the line
    passes through the mean at the middle of the k samples.
    """
    centre = (k - 1) / 2.0
    weights = [(i - centre) * dt_s for i in range(k)]
    scale = sum(w * w for w in weights)
    last = lag_slice(history, k, lookback)
    mean = F.aggregate(last, F.lit(0.0), lambda a, v: a + v) / float(k)
    if scale == 0:
        return F.array_repeat(mean, horizon)
    terms = F.zip_with(last, F.array(*[F.lit(w) for w in weights]), lambda v, w: v * w)
    slope = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / scale
    line = F.struct(mean.alias("m"), slope.alias("s"))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    # One-element transform keeps mean and slope from being recomputed per step.
    return F.flatten(
        F.transform(F.array(line), lambda p: F.transform(steps, lambda h: p["m"] + p["s"] * ((h + centre) * dt_s)))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def errors(yhat: Column, y: Column) -> Column:
    return F.zip_with(yhat, y, lambda p, t: p - t)


def total(values: Column, of: Callable[[Column], Column] = lambda e: e) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc + of(e))


def norm2(values: Column) -> Column:
    return F.sqrt(total(values, lambda e: e * e))
