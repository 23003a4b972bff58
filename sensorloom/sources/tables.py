"""Result tables, processed streams, run logs and grids: scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.config import BLOCK_ROWS, RECORDING
from sensorloom.operators.ordering import halo_rows
from sensorloom.schema import STREAMS, conform


def read_results(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Result CSV with a header; every column is text, as the files do not declare types."""
    if columns:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        return spark.read.schema(schema).option("header", True).csv(paths)
    return spark.read.option("header", True).csv(paths)


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as DOUBLE; blank means missing."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")).try_cast("double") for c in columns})


def cell_text(column: Column, kind: T.DataType) -> Column:
    """Text form of a value in result files: 10 significant digits for numbers, full
    precision below 1e-4, JSON for arrays, blank for missing."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        tiny = (F.abs(column) < 1e-4) & (column != 0)
        general = F.regexp_replace(F.regexp_replace(F.format_string("%.10g", column), r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
        return F.when(column.isNull() | F.isnan(column), "").when(tiny, column.cast("string")).otherwise(general)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(column), F.lit(""))
    return F.coalesce(column.cast("string"), F.lit(""))


def write_results(df: DataFrame, path: str, columns: Sequence[str], csv: bool = False) -> None:
    """Fixed columns in order. Parquet keeps exact values; CSV is the exchange form."""
    picked = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    if csv:
        text = picked.select(*[cell_text(F.col(f.name), f.dataType).alias(f.name) for f in picked.schema])
        text.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    else:
        picked.write.mode("overwrite").parquet(path)


def write_streams(streams: DataFrame, path: str) -> None:
    """Processed streams, partitioned by dataset and sorted by recording and idx.

    Range partitioning on (dataset, recording, idx) spreads a long recording over many
    files and gives tight row-group statistics for later block reads.
    """
    ordered = conform(streams, STREAMS).repartitionByRange(*RECORDING, "idx").sortWithinPartitions(*RECORDING, "idx")
    ordered.write.mode("overwrite").partitionBy("dataset").parquet(path)


def read_streams(spark: SparkSession, paths: str | Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """Processed streams of all recordings; `groups` (recording_id, dependency_group)
    replaces the stored group."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    streams = conform(spark.read.parquet(*paths), STREAMS)
    if groups is not None:
        streams = streams.drop("dependency_group").join(groups.select("recording_id", "dependency_group"), "recording_id", "left")
    return conform(streams, STREAMS)


def write_blocks(
    streams: DataFrame, table: str, before: int, after: int, block_rows: int = BLOCK_ROWS, buckets: int | None = None, path: str | None = None
) -> DataFrame:
    """Processed streams as a bucketed table of (dataset, recording, idx block), read back.

    Every block holds its own rows and `before` and `after` rows of its neighbours (`own` is false there), so
    that ordered operators (steps, windows, filters) start on the stored layout without a shuffle. One task
    writes one file per bucket, sorted by block and idx. The layout is part of the schema: the metadata of
    `block` names the halo and the block size. `buckets` defaults to the session's shuffle partitions; some
    100 to 200 MB a bucket are a good size. `path` puts the table outside the warehouse.

    Aggregates want each row once: `ordering.own_rows` takes the halo away again. Empty streams give an empty
    table; a halo of more than a block reaches over several blocks.
    """
    spark = streams.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*RECORDING, "block"]
    rows = halo_rows(conform(streams, STREAMS), before, after, block_rows).repartition(buckets, *keys)
    layout = {"before": before, "after": after, "rows": block_rows}
    tagged = rows.withColumn("block", F.col("block").alias("block", metadata=layout))
    writer = tagged.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, "idx")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def read_stream_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Processed-stream text: `# key=value` comments, a header, 3 or 4 columns.

    The ids come from the comments of each file; a missing native index becomes -1.
    """
    from sensorloom.operators.ordering import assign_idx
    from sensorloom.sources.text import numbered_lines

    lines = numbered_lines(spark, paths).filter(F.trim("line") != "")
    stated = lambda key: F.max(F.nullif(F.regexp_extract("line", rf"^#\s*{key}=(.*)$", 1), F.lit("")))
    ids = lines.filter(F.col("line").startswith("#")).groupBy("path").agg(
        F.trim(stated("dataset")).alias("dataset"), F.trim(stated("sequence_id")).alias("recording_id")
    )
    parts = F.split("line", ",")
    rows = (
        lines.filter(~F.col("line").startswith("#"))
        .select("path", "line_no", *[F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("ts_s", "q_f", "q_w", "native"))])
        .filter("ts_s is not null and q_f is not null and q_w is not null")
        .join(ids, "path")
        .withColumn("native_index", F.coalesce(F.col("native").cast("bigint"), F.lit(-1).cast("bigint")))
    )
    return conform(assign_idx(rows, RECORDING, ["line_no"]), STREAMS)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run records, stamped so that the last one per job can win; `finished_utc` is the stamp as text."""
    now = F.current_timestamp()
    text = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    runs.withColumns({"appended_at": now, "finished_utc": text}).write.mode("append").parquet(path)


def latest_runs(log: DataFrame, key: str = "job_id") -> DataFrame:
    """Last record per job."""
    values = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*values), "appended_at").alias("r")).select(key, "r.*")


def pending_jobs(jobs: DataFrame, log: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs without a record yet."""
    return jobs.join(log.select(key), key, "left_anti")


def config_grid(configs: DataFrame, most: int | None = None) -> DataFrame:
    """Model configurations as text cells: lists become 'a,b,c', missing cells blank.

    `configs` has architecture, config_id and any further columns. Repeated ids, or more
    than `most` configurations of an architecture, are errors.
    """
    ids = configs.groupBy("config_id").agg(F.count(F.lit(1)).alias("same_id"))
    checked = configs.join(ids, "config_id")
    repeated = F.raise_error(F.format_string("duplicate config_id %s", F.col("config_id"))).cast("string")
    first = F.when(F.col("same_id") > 1, repeated).otherwise(F.col("config_id"))
    if most is not None:
        sizes = configs.groupBy("architecture").agg(F.count(F.lit(1)).alias("n_configs"))
        crowded = F.raise_error(F.format_string(f"%s has more than {most} configs", F.col("architecture"))).cast("string")
        checked = checked.join(sizes, "architecture")
        first = F.when(F.col("n_configs") > most, crowded).otherwise(first)

    def cell(name: str) -> Column:
        kind = configs.schema[name].dataType
        text = F.array_join(F.col(name).cast("array<string>"), ",") if isinstance(kind, T.ArrayType) else F.col(name).cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    rest = [c for c in configs.columns if c not in ("architecture", "config_id")]
    return checked.select("architecture", first.alias("config_id"), *[cell(c) for c in rest])
