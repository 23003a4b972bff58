"""Catalogue expansion and meaning carried in recording ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def speed_bucket(speed: Column) -> Column:
    return F.when(speed <= 2.0, "low").when(speed <= 4.0, "medium").otherwise("high")


def flight_condition(top_speed: Column) -> Column:
    return (
        F.when(top_speed.isNull(), "UNRESOLVED").when(top_speed < 6.0, "low").when(top_speed <= 12.0, "moderate").otherwise("aggressive")
    )


def speed_token(speed: Column) -> Column:
    """2.5 -> maxSpeed2p5."""
    whole = F.floor(speed)
    return F.format_string("maxSpeed%dp%d", whole.cast("bigint"), F.bround((speed - whole) * 10).cast("bigint"))


def expand_flights(families: DataFrame) -> DataFrame:
    """yaw x family x speed. `families` has yaw, family, folder, speeds (array)."""
    flights = families.select("yaw", "family", "folder", F.explode("speeds").alias("speed"))
    return flights.select(
        F.concat_ws("/", "folder", "yaw", speed_token(F.col("speed"))).alias("recording_id"),
        F.col("family").alias("trajectory_name"),
        F.col("folder").alias("dependency_group"),
        F.col("yaw").alias("yaw_condition"),
        speed_bucket(F.col("speed")).alias("speed_condition"),
        F.col("speed").alias("nominal_max_speed"),
    )


def expand_sensors(specs: DataFrame, sensors: list[str]) -> DataFrame:
    """spec x sensor. `specs` has env, cam, nr, vmax, public_gt."""
    stem = F.concat_ws("_", "env", F.when(F.col("cam") == "forward", "forward").otherwise("45"), "nr")
    rows = specs.withColumn("flight", stem).withColumn("sensor", F.explode(F.array(*[F.lit(s) for s in sensors])))
    name = F.concat_ws("_", "flight", "sensor")
    return rows.select(
        name.alias("recording_id"),
        "flight",
        "sensor",
        F.concat_ws("_", "env", F.when(F.col("cam") == "forward", "forward").otherwise("45")).alias("dependency_group"),
        flight_condition(F.col("vmax")).alias("speed_condition"),
        F.concat(name, F.when(F.col("public_gt"), "_with_gt.zip").otherwise(".zip")).alias("archive"),
        F.when(F.col("public_gt"), "PUBLIC_GT").otherwise("GROUND_TRUTH_WITHHELD").alias("gt_status"),
    )


def expand_archives(archives: DataFrame) -> DataFrame:
    """archive x recording, with environment, room and difficulty from the id.

    `archives` has name, environment, size_bytes, recordings (array).
    """
    rows = archives.filter(F.col("name") != "calibration_datasets.zip").select(
        F.col("name").alias("official_archive"), "environment", "size_bytes", F.explode("recordings").alias("recording_id")
    )
    available = F.when(F.col("environment") == "machine_hall", "YES_OPTIONAL").otherwise("YES")
    return with_id_meaning(rows.withColumn("available", available).drop("environment"))


def with_id_meaning(df: DataFrame, column: str = "recording_id") -> DataFrame:
    """environment, room and difficulty from prefixes such as V1_, V2_ and MH_."""
    name = F.col(column)
    prefix = F.regexp_extract(name, r"^(V1|V2|MH)_", 1)
    parts = F.split(name, "_")
    room = F.when(prefix == "V1", "vicon_room1").when(prefix == "V2", "vicon_room2").when(prefix == "MH", "ETH_machine_hall").otherwise("UNRESOLVED")
    return df.withColumns(
        {
            "environment": F.when(prefix.isin("V1", "V2"), "vicon").when(prefix == "MH", "machine_hall").otherwise("UNRESOLVED"),
            "room": room,
            "difficulty": F.when((prefix != "") & (F.size(parts) >= 3), F.element_at(parts, -1)).otherwise("UNRESOLVED"),
        }
    )
