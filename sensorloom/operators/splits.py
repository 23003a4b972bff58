"""Split manifests and leakage checks. A recording is never on both sides of a fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordering import assign_idx
from sensorloom.schema import FOLDS, conform

TRAIN_ROLES = ("train", "source_train")
HELD_ROLES = ("test", "source_validation", "target_eval")


def fold_numbers(recordings: DataFrame) -> DataFrame:
    """1-based position of each recording within its dataset, in input order."""
    return assign_idx(recordings, ["dataset"], ["ord"]).withColumn("number", F.col("idx") + 1).drop("idx")


def loro_fold(dataset: Column, number: Column, held: Column) -> Column:
    return F.format_string("%s_LORO_%02d_%s", dataset, number, held)


def held_out_folds(recordings: DataFrame) -> DataFrame:
    """Leave-one-recording-out folds in compact form: one row per fold, the train set
    being every other recording of the dataset. Model fitting works from this form."""
    return fold_numbers(recordings).select(
        loro_fold(F.col("dataset"), F.col("number"), F.col("recording_id")).alias("fold_id"),
        "dataset",
        F.col("recording_id").alias("held_recording"),
        F.col("dependency_group").alias("held_group"),
    )


def leave_one_recording_out(recordings: DataFrame) -> DataFrame:
    """The written-out manifest: one row per (fold, recording of the dataset).

    By definition it has a row for each fold and recording, so it is meant for
    audits and files; fitting uses `held_out_folds`.
    """
    folds = held_out_folds(recordings)
    rows = folds.join(recordings, "dataset").select(
        "fold_id",
        F.concat(F.lit("WITHIN_"), "dataset").alias("evaluation_class"),
        F.col("dataset").alias("source_or_domain"),
        F.when(F.col("recording_id") == F.col("held_recording"), "test").otherwise("train").alias("split_role"),
        "dataset",
        F.col("recording_id").alias("sequence_id"),
        "dependency_group",
        F.lit("leave-one-recording-out; windows of held-out sequence never train").alias("notes"),
    )
    return conform(rows, FOLDS)


def group_folds(recordings: DataFrame) -> DataFrame:
    """Dependency groups in first-seen order with their size."""
    return recordings.groupBy("dataset", F.col("dependency_group").alias("held_group")).agg(
        F.min("ord").alias("group_ord"), F.count(F.lit(1)).alias("n_held")
    )


def leave_group_out(recordings: DataFrame, evaluation_class: str = "SOURCE_SELECTION") -> DataFrame:
    """One fold per dependency group; groups of one recording are flagged."""
    note = F.lit("leave-trajectory-group-out source validation")
    rows = recordings.join(group_folds(recordings), "dataset").select(
        F.concat_ws("_LGO_", "dataset", "held_group").alias("fold_id"),
        F.lit(evaluation_class).alias("evaluation_class"),
        F.col("dataset").alias("source_or_domain"),
        F.when(F.col("dependency_group") == F.col("held_group"), "source_validation").otherwise("source_train").alias("split_role"),
        "dataset",
        F.col("recording_id").alias("sequence_id"),
        "dependency_group",
        F.when(F.col("n_held") == 1, F.concat(note, F.lit("; SMALL_GROUP_SINGLE_RECORDING"))).otherwise(note).alias("notes"),
    )
    return conform(rows, FOLDS)


def transfer_manifests(recordings: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Zero-shot transfer: all of the source trains, all of the target is scored."""
    roles = F.array(
        *[
            F.struct(
                F.lit(f"TRANSFER_{s}_TO_{t}").alias("fold_id"),
                F.lit(s).alias("source_or_domain"),
                F.lit(ds).alias("of"),
                F.lit(role).alias("split_role"),
                F.lit(note).alias("notes"),
            )
            for s, t in pairs
            for ds, role, note in (
                (s, "source_train", f"source-only fitting; no {t} parameters"),
                (t, "target_eval", "frozen source system; no target-domain fitting"),
            )
        ]
    )
    rows = recordings.select(
        "dataset", F.col("recording_id").alias("sequence_id"), "dependency_group", F.inline(roles)
    ).filter(F.col("dataset") == F.col("of"))
    return conform(rows.withColumn("evaluation_class", F.lit("ZERO_SHOT_TRANSFER")), FOLDS)


def overlapping_roles(folds: DataFrame) -> DataFrame:
    """Recordings found on both sides of a fold; empty when the folds are disjoint."""
    side = lambda roles: F.bool_or(F.col("split_role").isin(*roles))
    return (
        folds.groupBy("fold_id", "dataset", "sequence_id")
        .agg(side(TRAIN_ROLES).alias("trains"), side(HELD_ROLES).alias("held"))
        .filter("trains and held")
        .select("fold_id", "dataset", "sequence_id")
    )


def transfer_separation(folds: DataFrame) -> DataFrame:
    """Datasets on each side of a transfer fold; status FAIL unless exactly one each, apart."""
    sides = folds.groupBy("fold_id").agg(
        F.max("source_or_domain").alias("source"),
        F.array_sort(F.collect_set(F.when(F.col("split_role") == "source_train", F.col("dataset")))).alias("train"),
        F.array_sort(F.collect_set(F.when(F.col("split_role") == "target_eval", F.col("dataset")))).alias("target"),
    )
    ok = (F.size("train") == 1) & (F.size("target") == 1) & (F.col("train")[0] == F.col("source")) & ~F.arrays_overlap("train", "target")
    return sides.select(
        "fold_id",
        F.array_join("train", ",").alias("train_datasets"),
        F.array_join("target", ",").alias("target_datasets"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
    )


def leak_audit(fit_log: DataFrame, allowed: DataFrame) -> DataFrame:
    """Fit-log rows that touched data their context forbids.

    `fit_log` has evaluation_context, fit_object, fit_dataset, fit_recordings (array);
    `allowed` has evaluation_context, source_dataset, and forbidden_recordings (array).
    """
    joined = fit_log.join(allowed, "evaluation_context", "left")
    wrong_source = F.col("fit_dataset") != F.col("source_dataset")
    touched = F.array_intersect("fit_recordings", "forbidden_recordings")
    return joined.filter(F.coalesce(wrong_source, F.lit(False)) | (F.coalesce(F.size(touched), F.lit(0)) > 0)).select(
        "evaluation_context",
        "fit_object",
        "fit_dataset",
        F.when(wrong_source, "WRONG_SOURCE").otherwise("FORBIDDEN_RECORDING").alias("leak"),
        F.array_join(touched, ",").alias("recordings"),
    )


def forbidden_fits(jobs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Jobs whose train ids contain a forbidden recording of their scope (semi join)."""
    used = jobs.select("job_id", "scope", F.explode("train_ids").alias("recording_id"))
    return used.join(forbidden.select("scope", "recording_id"), ["scope", "recording_id"], "left_semi")


def job_grid(recordings: DataFrame, configs: Sequence[tuple[str, str]], seeds: Sequence[int], purpose: str = "SOURCE_LGO") -> DataFrame:
    """Training jobs: config x seed x validation group per dataset.

    Configs and seeds are literal arrays that each group row is exploded over.
    """
    grid = F.array(*[
        F.struct(F.lit(a).alias("architecture"), F.lit(c).alias("config_id"), F.lit(s).cast("bigint").alias("seed"))
        for a, c in configs
        for s in seeds
    ])
    totals = recordings.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_all"))
    groups = group_folds(recordings).join(totals, "dataset").filter(F.col("n_held") < F.col("n_all"))
    jobs = groups.select("dataset", F.col("held_group").alias("val_group"), "n_held", "n_all", F.inline(grid))
    scope = F.concat("dataset", F.lit("_ALL"))
    return jobs.select(
        F.format_string(f"{purpose}|%s|%s|%s|seed%d|valgrp%s|qw1", scope, "architecture", "config_id", "seed", "val_group").alias("job_id"),
        F.lit(purpose).alias("purpose"),
        scope.alias("scope"),
        "architecture",
        "config_id",
        "seed",
        "dataset",
        "val_group",
        (F.col("n_all") - F.col("n_held")).alias("n_train"),
        F.col("n_held").alias("n_val"),
    )


def nested_job_grid(
    recordings: DataFrame, configs: Sequence[tuple[str, str]], seeds: Sequence[int], purpose: str = "NESTED_LORO"
) -> DataFrame:
    """The same grid inside every leave-one-recording-out train set."""
    grid = F.array(*[
        F.struct(F.lit(a).alias("architecture"), F.lit(c).alias("config_id"), F.lit(s).cast("bigint").alias("seed"))
        for a, c in configs
        for s in seeds
    ])
    totals = recordings.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_all"))
    folds = held_out_folds(recordings).join(totals, "dataset")
    groups = group_folds(recordings).withColumnRenamed("held_group", "val_group")
    own = (F.col("held_group") == F.col("val_group")).cast("bigint")
    inner = folds.join(groups, "dataset").withColumns({"n_val": F.col("n_held") - own, "n_train": F.col("n_all") - 1 - (F.col("n_held") - own)})
    jobs = inner.filter("n_val > 0 and n_train > 0").select("dataset", "held_recording", "val_group", "n_train", "n_val", F.inline(grid))
    scope = F.concat_ws("_HOLD_", "dataset", "held_recording")
    return jobs.select(
        F.format_string(f"{purpose}|%s|%s|%s|seed%d|valgrp%s|qw1", scope, "architecture", "config_id", "seed", "val_group").alias("job_id"),
        F.lit(purpose).alias("purpose"),
        scope.alias("scope"),
        "architecture",
        "config_id",
        "seed",
        "dataset",
        "held_recording",
        "val_group",
        "n_train",
        "n_val",
    )
