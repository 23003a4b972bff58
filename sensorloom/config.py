"""Parameters of the protocol, as small frozen dataclasses.

The defaults are fixed values of the protocol this engine reproduces.
"""

from __future__ import annotations

from dataclasses import dataclass

# Key of a recording. It is the statistical unit of every table here.
RECORDING = ("dataset", "recording_id")

# Rows per idx block. Ordered operators work on blocks of a recording, never on
# a whole recording, so one long recording spreads over many tasks.
BLOCK_ROWS = 8192

# A group up to this many rows may be held by one task. Larger groups take the
# distributed route (range partitions plus prefix sums).
BOUNDED_GROUP_ROWS = 2_000_000


@dataclass(frozen=True)
class WindowSpec:
    """Look-back, horizon and stride in samples, and the gap rule."""

    lookback: int = 100
    horizon: int = 20
    stride: int = 5
    gap_factor: float = 2.0

    def __post_init__(self) -> None:
        if min(self.lookback, self.horizon, self.stride) < 1:
            raise ValueError("lookback, horizon and stride must be >= 1")

    @property
    def block_rows(self) -> int:
        """Block size rounded up to a multiple of the stride."""
        return -(-BLOCK_ROWS // self.stride) * self.stride


@dataclass(frozen=True)
class BaselineSpec:
    """Local and ridge forecasters and the selection grid."""

    linear_k: int = 10
    dt_s: float = 0.01
    lags: tuple[int, ...] = (10, 25, 50, 100)
    alphas: tuple[float, ...] = (1e-6, 1e-4, 1e-2, 1.0, 100.0)
    tie_tolerance: float = 0.01
    report_horizons: tuple[int, ...] = (5, 10, 20)
    high_percentile: float = 0.95


@dataclass(frozen=True)
class BootstrapSpec:
    """Resamples over recordings."""

    reps: int = 10_000
    seed: int = 20260912
    alpha: float = 0.05
    draws: str = "hash"
