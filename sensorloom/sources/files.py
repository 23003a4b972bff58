"""File inventories: content hashes, roles by path, audit scans driven by a manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.sources import text

# Path tokens of the file roles.
IMAGES = r"\.(png|jpg|jpeg|pgm|ppm|pnm)$"
SKIPPED = r"\.(png|jpg|jpeg|pgm|ppm|pnm|tif|tiff|bag|pcd|ply)$"
READY = ("DOWNLOADED", "ALREADY_PRESENT_HASH_VERIFIED")


def file_manifest(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Path, size and SHA-256 of every file. One file is one row, so each must fit the
    2 GB binary limit; larger files are hashed by the store that holds them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def file_role(path: Column) -> Column:
    """Role of a file by its name; NULL for files of no interest."""
    full = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = F.element_at(F.split(full, "/"), -1)
    return (
        F.when(base.rlike(IMAGES), F.lit(None))
        .when(base.contains("imu") & base.rlike(r"\.(txt|csv)$"), "imu")
        .when(base.contains("groundtruth") | base.startswith("gt.") | base.contains("ground_truth"), "gt")
        .when(full.contains("leica"), "leica")
        .when(base.rlike(r"\.(yaml|yml)$"), "yaml")
        .when(base.contains("camchain") | base.contains("imu.yaml") | full.contains("kalibr"), "calib")
        .when(base.endswith(".txt") & ~base.contains("image") & ~base.contains("event"), "text")
    )


def is_table_member(path: Column) -> Column:
    """Text tables and calibration files, without resource forks, images and bags."""
    full = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = F.element_at(F.split(full, "/"), -1)
    return ~full.rlike(SKIPPED) & ~base.startswith("._") & full.rlike(r"\.(csv|yaml|yml)$")


def first_per_role(files: DataFrame, by: Sequence[str], order: str = "ord") -> DataFrame:
    """First file of each role per key."""
    roles = files.withColumn("role", file_role(F.col("path"))).filter("role is not null")
    return roles.groupBy(*by, "role").agg(F.min_by("path", order).alias("path"), F.count(F.lit(1)).alias("n_files"))


def find_named(files: DataFrame, by: Sequence[str], needles: Sequence[str], order: str = "ord") -> DataFrame:
    """First file per key whose path contains every needle."""
    name = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    hit = F.lit(True)
    for n in needles:
        hit = hit & F.contains(name, F.lit(n.lower()))
    return files.filter(hit).groupBy(*by).agg(F.min_by("path", order).alias("path"))


def ready_files(manifest: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """Manifest rows whose file is there, optionally of some roles."""
    rows = manifest.filter(F.col("download_status").isin(*READY))
    return rows.filter(F.col("content_role").isin(*roles)) if roles else rows


# Content roles of a manifest, and what their files are read as.
ROLES = {"IMU": "imu", "IMU_TEXT": "imu", "GROUND_TRUTH": "pose", "LEICA_POSITION": "position"}
CHANNELS = {"imu": text.IMU_CHANNELS, "pose": text.POSE_CHANNELS, "position": text.POSITION}


def scan_manifest(spark: SparkSession, manifest: DataFrame, roles: Mapping[str, str] = ROLES, most_splits: int = text.MOST_SPLITS) -> text.TextScan:
    """All ready files of a manifest in one scan, each parsed as its role says.

    Files: the manifest's columns, kind (imu, pose, position; null for other roles), columns, n_rows and one struct per
    kind with layout, fields, quaternion order and stated units; a file without lines has null columns and 0 rows. Rows: the manifest's columns,
    kind, path, row_no and one struct per kind with clock_int, clock and its channels; the structs of other kinds are null, and rows of files
    of other roles are left out. A path listed under two roles is parsed under both. Spark needs the list of paths on the driver to plan a file
    scan, as it does for any listing of a folder.
    """
    ready = ready_files(manifest)
    paths = [r[0] for r in ready.select("local_path").distinct().collect()]
    scan = text.scan_sensor_text(spark, paths, most_splits)
    bare = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    kind = F.element_at(F.create_map(*[F.lit(v) for pair in roles.items() for v in pair]), F.col("content_role"))
    keyed = ready.withColumns({"kind": kind, "key": bare(F.col("local_path"))})

    imu = text.map_imu_header(scan.files, text.TEXT_IMU_RULES, asl=False)
    triple = lambda k: F.concat_ws(",", *[text.name_at(F.col("header"), F.col(f"places.{k}{c}")) for c in "xyz"])
    unit = lambda flag, name: F.when(F.col(flag), name).otherwise("UNRESOLVED")
    imu = imu.select(
        "path", "places",
        F.struct(
            "layout", text.name_at(F.col("header"), F.col("places.ts")).alias("timestamp_field"), triple("w").alias("gyro_fields"), triple("f").alias("accel_fields"),
            unit("has_gyro_unit", "rad/s").alias("unit_gyro"), unit("has_accel_unit", "m/s^2").alias("unit_acceleration"),
        ).alias("facts"),
    )
    pose = text.map_text_pose_header(scan.files).select(
        "path", "places", F.struct("timestamp_field", "position_fields", "orientation_fields", "quaternion_order", "velocity_fields", "acceleration_fields").alias("facts")
    )
    position = text.map_text_position_header(scan.files).select("path", "places", F.struct("timestamp_field", "position_fields").alias("facts"))
    heads = scan.files.select("path", "header", "n_rows")
    for name, mapped in {"imu": imu, "pose": pose, "position": position}.items():
        heads = heads.join(mapped.select("path", F.col("places").alias(f"{name}_places"), F.col("facts").alias(name)), "path")
    known = keyed.join(heads.withColumn("key", bare(F.col("path"))), "key", "left")
    of_kind = lambda name, value: F.when(F.col("kind") == name, value)
    files = known.select(
        *manifest.columns, "kind", F.col("header").alias("columns"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), *[of_kind(name, F.col(name)).alias(name) for name in CHANNELS]
    )

    dispatch = known.filter("kind is not null and path is not null").select(*manifest.columns, "kind", "path", *[f"{name}_places" for name in CHANNELS])
    if "idx" in scan.rows.columns:  # the scan's facts were checked to be small
        dispatch = F.broadcast(dispatch)
    rows = scan.rows.select("path", "row_no", "tokens").join(dispatch, "path").select(
        *manifest.columns, "kind", "path", "row_no", *[of_kind(name, F.struct(*text.channel_values(channels, f"{name}_places"))).alias(name) for name, channels in CHANNELS.items()]
    )
    return text.TextScan(files, rows)


def audit_files(spark: SparkSession, manifest: DataFrame, role: str) -> DataFrame:
    """All ready files of a role with their columns and row counts."""
    files = scan_manifest(spark, manifest.filter(F.col("content_role") == role)).files
    return files.select(*manifest.columns, "columns", "n_rows")


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each registered table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("item"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
        for name, df in tables.items()
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union


def download_status(raw: Column, digest: Column) -> Column:
    """A present file with a hash is verified; other states pass through."""
    verified = (raw == "ALREADY_PRESENT_HASH_VERIFIED") | ((raw == "DOWNLOADED") & (F.coalesce(digest, F.lit("")) != ""))
    return F.when(verified, "HASH_VERIFIED").otherwise(raw)
