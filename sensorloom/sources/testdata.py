"""Recording views over the driver's parquet tables.

`events` becomes 14 recordings in two datasets, `embeddings` and `lineitem`
become 3-axis samples. All reads are column-pruned parquet scans.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.config import BOUNDED_GROUP_ROWS, WindowSpec
from sensorloom.operators.ordering import assign_idx

# Fixed values of the adaptation: 14 recordings, 6 in A and 8 in B, 3 groups.
N_RECORDINGS, N_FIRST_DATASET, N_GROUPS = 14, 6, 3
SPEC = WindowSpec(lookback=10, horizon=4, stride=2, gap_factor=8.0)

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recording_name(number: Column) -> Column:
    return F.format_string("r%02d", number)


def dataset_name(number: Column) -> Column:
    return F.when(number < N_FIRST_DATASET, "A").otherwise("B")


def group_name(number: Column) -> Column:
    return F.format_string("g%d", number % N_GROUPS)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events keyed by recording, with an exact microsecond clock, unordered."""
    number = F.col("user_id") % N_RECORDINGS
    return table(spark, sf_dir, "events").select(
        dataset_name(number).alias("dataset"),
        recording_name(number).alias("recording_id"),
        group_name(number).alias("dependency_group"),
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(ts as timestamp_ntz))").alias("ts_us"),
        "event_id",
        F.col("event_type"),
        F.col("value").alias("q_f"),
        F.get_json_object("props", "$.k").cast("double").alias("q_w"),
    )


def largest_recording(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the longest recording of the events."""
    sizes = table(spark, sf_dir, "events").groupBy((F.col("user_id") % N_RECORDINGS).alias("r")).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def extent(spark: SparkSession, sf_dir: str) -> tuple[int, float]:
    """Rows of the events, and the seconds from the first to the last."""
    clock = event_rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("span"))
    n, span = clock.first()
    return n, span or 0.0


def bounded(spark: SparkSession, sf_dir: str) -> bool:
    """True if no group of these tables is too large for one task.

    Groups differ from query to query (recordings, whole datasets, results of a context, one
    group of everything), so the bound is held against the row counts of the tables themselves,
    which no group exceeds; Parquet answers that from its footers.
    """
    return all(table(spark, sf_dir, name).count() <= BOUNDED_GROUP_ROWS for name in ("events", "embeddings"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as processed streams with a dense idx per recording."""
    rows = event_rows(spark, sf_dir).drop("event_type")
    ordered = assign_idx(rows, ["dataset", "recording_id"], ["ts_us", "event_id"], bounded=bounded(spark, sf_dir))
    return ordered.select(
        "dataset",
        "recording_id",
        "dependency_group",
        "idx",
        (F.col("ts_us") / F.lit(1e6)).alias("ts_s"),
        (F.col("ts_us") * 1000).alias("ts_ns"),
        "q_f",
        "q_w",
        F.col("idx").alias("native_index"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recording: its dataset, group and input order."""
    number = F.col("user_id") % N_RECORDINGS
    return (
        table(spark, sf_dir, "events")
        .groupBy(number.alias("ord"))
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .select(
            dataset_name(F.col("ord")).alias("dataset"),
            recording_name(F.col("ord")).alias("recording_id"),
            group_name(F.col("ord")).alias("dependency_group"),
            "ord",
            "n_samples",
        )
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-axis samples from `embeddings`: specific force in the first three entries,
    angular speed in the next three; vec_id is the native order."""
    axis = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("E").alias("dataset"),
        F.format_string("e%d", F.col("label")).alias("recording_id"),
        F.col("vec_id").alias("idx"),
        *[axis(i).alias(f"f{c}") for i, c in enumerate("xyz")],
        *[axis(i + 3).alias(f"w{c}") for i, c in enumerate("xyz")],
    )
