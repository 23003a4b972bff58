"""Causal anti-alias filtering, integer decimation and warm-up removal.

A stable recursive filter forgets: after enough rows the contribution of its past
state falls below double precision. Each idx block is therefore filtered from a
zero state that starts `memory` rows before the block, where `memory` follows from
the filter's own state transition. The result equals one sequential pass to
rounding, every block is an independent bounded task, and no state is carried
along a recording.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.config import BLOCK_ROWS, RECORDING
from sensorloom.operators.ordering import assign_idx, block_tags, halo_rows, join_facts

# Second-order sections [b0, b1, b2, a0, a1, a2] of the two designs.
SOS_200_HZ = (
    (0.0091318170074144, 0.005350949480373, 0.0091318170074144, 1.0, -0.7154723854883437, 0.0),
    (1.0, 1.0, 0.0, 1.0, -1.2780591166411965, 0.65515191910096),
    (1.0, -0.2390030141857213, 1.0, 1.0, -1.1149960257436253, 0.890164733124431),
)
SOS_500_HZ = (
    (1.5855758865265046e-03, -5.8721120498604075e-04, 1.5855758865265042e-03, 1.0, -1.7896232979513227, 0.81342355958889545),
    (1.0, -1.6050513520512639, 0.99999999999999967, 1.0, -1.8055888662122941, 0.89544045541022332),
    (1.0, -1.7425815108590852, 0.99999999999999989, 1.0, -1.8324197734320145, 0.97025346715314031),
)

FORGET = 2.0**-60
CHUNK = 128

Sos = Sequence[Sequence[float]]


def state_space(sos: Sos) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Cascade of sections as z' = A z + B x, y = C z + D x (two states a section)."""
    n = 2 * len(sos)
    A, B, C, D = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, a0, a1, a2) in enumerate(np.asarray(sos, float)):
        i = 2 * k
        b0, b1, b2, a1, a2 = b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0
        # The section's input is C z + D x of the sections before it.
        gain = np.array([b1 - a1 * b0, b2 - a2 * b0])
        A[i : i + 2, :i] = np.outer(gain, C[:i])
        B[i : i + 2] = gain * D
        A[i : i + 2, i : i + 2] = [[-a1, 1.0], [-a2, 0.0]]
        C, D = b0 * C, b0 * D
        C[i] = 1.0
    return A, B, C, D


def memory_rows(sos: Sos) -> int:
    """Rows after which the past state no longer matters in double precision."""
    A = state_space(sos)[0]
    # Repeated poles are only found to about half of double precision.
    if np.abs(np.linalg.eigvals(A)).max() >= 1 - 1e-7:
        raise ValueError("the filter is not stable")
    power, rows = A, 1
    while np.abs(power).sum(axis=1).max() > FORGET:
        power, rows = power @ power, rows * 2
    return rows


def filter_block(sos: Sos, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Response to x from a starting state (zero by default), and the end state.

    Rows are handled in chunks, as matrix products; only the chunk states recur.
    """
    A, B, C, D = state_space(sos)
    n, m = len(B), CHUNK
    powers = [np.eye(n)]
    for _ in range(m):
        powers.append(A @ powers[-1])
    observe = np.array([C @ powers[i] for i in range(m)])  # state -> outputs
    impulse = np.concatenate([[D], observe[: m - 1] @ B])  # input -> output
    lag = np.subtract.outer(np.arange(m), np.arange(m))
    respond = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    charge = np.array([powers[m - 1 - i] @ B for i in range(m)])  # inputs -> end state

    whole, rest = divmod(len(x), m)
    padded = np.zeros((whole + (rest > 0)) * m)
    padded[: len(x)] = x
    chunks = padded.reshape(-1, m)
    ends = chunks @ charge
    states = np.zeros((whole + 1, n))
    states[0] = 0.0 if state is None else state
    for i in range(whole):
        states[i + 1] = powers[m] @ states[i] + ends[i]
    out = (chunks @ respond.T + states[: len(chunks)] @ observe.T).ravel()[: len(x)]
    final = powers[rest] @ states[whole] + (chunks[whole, :rest] @ charge[m - rest :] if rest else 0.0)
    return out, final


def causal_filter(samples: DataFrame, sos: Sos, columns: Sequence[str] = ("q_f", "q_w"), block_rows: int = 8 * BLOCK_ROWS) -> DataFrame:
    """Forward-only filter of each column, in native order, per recording."""
    memory = memory_rows(sos)
    size = max(block_rows, memory)
    tags = block_tags(samples)
    names = [c for c in samples.columns if c not in tags]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        for c in columns:
            pdf[c], _ = filter_block(sos, pdf[c].to_numpy(float))
        return pdf.loc[pdf["own"], names]

    blocks = halo_rows(samples, memory, 0, size)
    return blocks.groupBy(*RECORDING, "block").applyInPandas(run, samples.select(*names).schema)


def decimate(samples: DataFrame, factor: int) -> DataFrame:
    """Every `factor`-th native row, no interpolation; `native_index` keeps the origin."""
    if factor < 1:
        raise ValueError("decimation factor must be >= 1")
    kept = samples.filter(F.col("idx") % factor == 0)
    return kept.withColumns({"native_index": F.col("idx"), "idx": (F.col("idx") / factor).cast("bigint")})


def drop_warmup(decimated: DataFrame, starts: DataFrame, warmup_s: float, bounded: bool | None = None) -> DataFrame:
    """Rows at least `warmup_s` after the first native timestamp, re-indexed from 0.

    The clock may step backwards, so rows can drop out in the middle; the new idx
    is then ranked, otherwise it is a plain shift. Ranking covers both.
    """
    kept = join_facts(decimated, starts, RECORDING, "idx").filter(F.col("ts_s") - F.col("t0") >= warmup_s - 1e-15).drop("t0", "idx")
    return assign_idx(kept, RECORDING, ["native_index"], bounded)


def process_streams(samples: DataFrame, sos: Sos, factor: int, warmup_s: float = 1.0, bounded: bool | None = None) -> DataFrame:
    """Filter, decimate, drop the warm-up: native magnitudes to processed streams."""
    starts = samples.groupBy(*RECORDING).agg(F.min_by("ts_s", "idx").alias("t0"))
    return drop_warmup(decimate(causal_filter(samples, sos), factor), starts, warmup_s, bounded)


def stage_counts(samples: DataFrame, processed: DataFrame, factor: int) -> DataFrame:
    """Rows before filtering, after decimation and after the warm-up."""
    native = samples.groupBy(*RECORDING).agg(
        F.count(F.lit(1)).alias("n_native"), F.count(F.when(F.col("idx") % factor == 0, 1)).alias("n_decimated")
    )
    kept = processed.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n_processed"))
    return native.join(kept, list(RECORDING), "left").fillna({"n_processed": 0})

