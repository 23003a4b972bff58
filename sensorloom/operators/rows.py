"""Small helpers on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side_by_side(*tables: DataFrame) -> DataFrame:
    """One-row tables with distinct columns as a single row."""
    union = tables[0]
    for df in tables[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    return union.agg(*[F.max(c).alias(c) for c in union.columns])


def union_all(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; columns a table lacks become NULL."""
    union = tables[0]
    for df in tables[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    return union


def exactly_one(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """The single row that satisfies `condition`; an error if there is none or several."""
    found = df.filter(condition).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    # The test guards every projected value, so it cannot be pruned away.
    wrong = F.raise_error(F.format_string(f"{what}: expected one row, found %d", F.col("n")))
    return found.select(
        *[F.when(F.col("n") == 1, F.col("row")[c]).otherwise(wrong.cast(df.schema[c].dataType)).alias(c) for c in df.columns]
    )
