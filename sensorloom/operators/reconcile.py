"""Comparing tables: hash locks, snapshots, recomputed against reported values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.rows import union_all


def verify_hashes(expected: DataFrame, observed: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """PASS, FAIL or MISSING per expected artefact."""
    seen = observed.select(key, F.col(digest).alias("observed_hash"))
    joined = expected.select(key, F.col(digest).alias("expected_hash")).join(seen, key, "left")
    status = (
        F.when(F.col("observed_hash").isNull(), "MISSING")
        .when(F.col("observed_hash") == F.col("expected_hash"), "PASS")
        .otherwise("FAIL")
    )
    return joined.withColumn("status", status)


def changed_artifacts(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Artefacts added, removed or changed between two snapshots."""
    a = before.select(key, F.col(digest).alias("before_hash"))
    b = after.select(key, F.col(digest).alias("after_hash"))
    joined = a.join(b, key, "full").filter(~F.col("before_hash").eqNullSafe(F.col("after_hash")))
    change = F.when(F.col("before_hash").isNull(), "ADDED").when(F.col("after_hash").isNull(), "REMOVED").otherwise("CHANGED")
    return joined.withColumn("change", change)


def metric_rows(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], value: str) -> DataFrame:
    """Wide metric columns as (keys, metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value)) for m in metrics])
    return df.select(*keys, F.inline(pairs))


def reconcile(
    reported: DataFrame, recomputed: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-6
) -> DataFrame:
    """Differences of reported and recomputed metrics; both missing counts as equal.

    Keys present on one side only come out as FAIL.
    """
    a = metric_rows(reported, keys, metrics, "reported_value")
    b = metric_rows(recomputed, keys, metrics, "recomputed_value")
    diff = F.abs(F.col("recomputed_value") - F.col("reported_value"))
    both_missing = F.col("reported_value").isNull() & F.col("recomputed_value").isNull()
    relative = F.when(F.col("reported_value") == 0, diff).otherwise(diff / F.abs("reported_value"))
    return a.join(b, [*keys, "metric"], "full").withColumns(
        {
            "absolute_difference": diff,
            "relative_difference": relative,
            "status": F.when(both_missing | (diff <= tolerance), "PASS").otherwise("FAIL"),
        }
    )


def rename_models(results: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Published names for models; models without one drop."""
    name: Column = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("model")]
    return results.withColumn("pub_model", name).filter(F.col("pub_model").isNotNull())


def union_contexts(tables: Mapping[str, DataFrame], names: Mapping[str, str]) -> DataFrame:
    """Context-tagged result tables as one, with published model names."""
    tagged = [df.withColumn("evaluation_context", F.lit(c)) for c, df in tables.items()]
    return rename_models(union_all(*tagged), names)


def relabel_baseline(results: DataFrame, model: str, alias: str) -> DataFrame:
    """Copy a model's rows under another name, with provenance columns."""
    return results.filter(F.col("model") == model).withColumns(
        {
            "config_id": F.col("model"),
            "model": F.lit(alias),
            "seeds_mean": F.lit("NA_BASELINE"),
            "notes": F.lit("frozen baseline; not refit"),
        }
    )


def merge_manifests(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of manifests; the earlier table wins on equal keys."""
    tagged = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(tables)]
    union = union_all(*tagged)
    values = [c for c in union.columns if c not in (*keys, "source_rank")]
    # The remaining columns break ties inside one table.
    first = F.min_by(F.struct(*values), F.struct("source_rank", *values))
    return union.groupBy(*keys).agg(first.alias("row")).select(*keys, "row.*")


def package_check(expectations: DataFrame, inventory: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Required tables present and non-empty, expected values met.

    `expectations` has item, and optionally expected (a number); `inventory` has item,
    n_rows, and optionally value.
    """
    joined = expectations.join(inventory, "item", "left")
    present = F.coalesce(F.col("n_rows") > 0, F.lit(False))
    met = F.col("expected").isNull() | F.coalesce(F.abs(F.col("value") - F.col("expected")) <= tolerance, F.lit(False))
    return joined.withColumns(
        {"present": F.when(present, "yes").otherwise("no"), "status": F.when(present & met, "PASS").otherwise("FAIL")}
    )
