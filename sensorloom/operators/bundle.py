"""Audit bundle of many recordings: clocks, axes, overlap and findings of a signal stream and its reference.

Both stream kinds go through every statistic together, tagged by `kind`, so that the clock audit and the
axis inventory are one pass each. Overlap and findings are made from those small tables alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.functions.scalar import overlap_fraction, overlap_seconds
from sensorloom.operators.channels import ACCEL, GYRO, channel_inventory
from sensorloom.operators.rows import union_all
from sensorloom.operators.timestamps import audit_timestamps
from sensorloom.session import materialise

SIGNAL, REFERENCE = "imu", "reference"
MIN_OVERLAP_S, MIN_FINITE = 20.0, 0.99


def both_kinds(signal: DataFrame, reference: DataFrame) -> DataFrame:
    """The two streams as one, the kind in front of the dataset."""
    tag = lambda df, kind: df.withColumn("dataset", F.concat_ws(":", F.lit(kind), "dataset"))
    return union_all(tag(signal, SIGNAL), tag(reference, REFERENCE))


def _untagged(df: DataFrame) -> DataFrame:
    kind = F.substring_index("dataset", ":", 1)
    return df.withColumns({"kind": kind, "dataset": F.substring(F.col("dataset"), F.length(kind) + 2, F.length("dataset"))})


def stream_audits(streams: DataFrame, bounded: bool | None = None) -> DataFrame:
    """The clock audit per recording and kind, with the overlap of the two kinds on the signal's row.

    A recording without a reference has no overlap (NULL); streams that do not meet overlap 0 s.
    """
    audits = materialise(_untagged(audit_timestamps(streams, bounded)), "audits")  # a row per recording, read for the rows and for the spans
    ends = lambda side: [F.max(F.when(F.col("kind") == side, F.col(c))) for c in ("first_timestamp", "last_timestamp")]
    spans = [*ends(SIGNAL), *ends(REFERENCE)]
    overlap = audits.groupBy(*RECORDING).agg(overlap_seconds(*spans).alias("overlap_s"), overlap_fraction(*spans).alias("overlap_fraction"))
    overlap = overlap.withColumn("kind", F.lit(SIGNAL))
    return audits.join(overlap, [*RECORDING, "kind"], "left")


def axis_audits(streams: DataFrame, axes: Sequence[str] = (*ACCEL, *GYRO), bounded: bool | None = None) -> DataFrame:
    """The channel inventory of every axis per recording and kind."""
    return _untagged(channel_inventory(streams, axes, bounded))


def bundle_findings(recordings: DataFrame, audits: DataFrame, axes: DataFrame) -> DataFrame:
    """Findings per recording, from the small tables of `stream_audits` and `axis_audits`.

    A recording without signal rows gets SIGNAL_MISSING alone. The others get MONOTONIC and FINITE for the
    signal, REFERENCE_MONOTONIC where there is a reference, and OVERLAP. A passed check is informational.
    """
    share = lambda names: F.try_divide(
        F.sum(F.when(F.col("channel").isin(*names), F.col("sample_count") - F.col("nonfinite_count"))), F.sum(F.when(F.col("channel").isin(*names), F.col("sample_count")))
    )
    finite = axes.filter(F.col("kind") == SIGNAL).groupBy(*RECORDING).agg(F.least(share(ACCEL), share(GYRO)).alias("finite"))
    clock = lambda kind, to: audits.filter(F.col("kind") == kind).select(
        *RECORDING, *[F.col(c).alias(f"{to}{c}") for c in ("strictly_monotonic", "backward_count", "duplicate_count")], *(["overlap_s"] if kind == SIGNAL else [])
    )
    wide = recordings.select(*RECORDING).distinct()
    for part in (clock(SIGNAL, ""), clock(REFERENCE, "reference_"), finite):
        wide = wide.join(part, list(RECORDING), "left")

    def finding(check: str, category: str, severity: str, ok: Column, observed: Column, rule: str, meaning: str, action: str) -> Column:
        ok = F.coalesce(ok, F.lit(False))
        return F.struct(
            F.lit(check).alias("check_id"), F.lit(category).alias("category"), F.when(ok, "INFO").otherwise(severity).alias("severity"),
            F.when(ok, "PASS").otherwise("FAIL").alias("status"), observed.alias("observed"), F.lit(rule).alias("expected_or_rule"),
            F.lit(meaning).alias("interpretation"), F.when(ok, "none").otherwise(action).alias("action_required"),
        )

    def monotonic(check: str, to: str) -> Column:
        observed = F.format_string("backward=%d dup=%d", f"{to}backward_count", f"{to}duplicate_count")
        return finding(check, "timestamps", "WARNING", F.col(f"{to}strictly_monotonic"), observed, "strictly increasing timestamps", "Order of the native clock.", "report")

    seconds = F.coalesce("overlap_s", F.lit(0.0))
    present = F.filter(
        F.array(
            monotonic("MONOTONIC", ""),
            F.when(F.col("reference_backward_count").isNotNull(), monotonic("REFERENCE_MONOTONIC", "reference_")),
            finding("FINITE", "nan_inf", "MAJOR", F.col("finite") >= MIN_FINITE, F.format_string("finite_fraction=%.6f", "finite"), ">=0.99 finite samples", "Finite share of the worse axis group.", "exclude"),
            finding("OVERLAP", "reference", "MAJOR", seconds >= MIN_OVERLAP_S, F.format_string("overlap_s=%.6f", seconds), ">=20 s common time", "Common time of both streams.", "exclude"),
        ),
        lambda f: f.isNotNull(),
    )
    missing = F.array(finding("SIGNAL_MISSING", "imu", "CRITICAL", F.lit(False), F.lit("missing"), "signal stream present", "No signal rows.", "exclude"))
    return wide.select(*RECORDING, F.inline(F.when(F.col("backward_count").isNull(), missing).otherwise(present)))
