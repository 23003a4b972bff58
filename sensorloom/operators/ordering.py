"""Order-aware building blocks that stay balanced when one group is huge.

Three primitives carry every ordered operator of the library:

* `halo_rows` cuts recordings into idx blocks and copies the few boundary rows a
  frame needs into the neighbour block, so windows run per block;
* `prefix_sums` gives running sums over an order, per task for bounded groups and
  by range partitions plus partition totals for larger ones;
* `exact_quantiles` picks exact order statistics on top of `prefix_sums`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorloom.config import BLOCK_ROWS, BOUNDED_GROUP_ROWS, RECORDING
from sensorloom.session import materialise


def groups_are_bounded(df: DataFrame, keys: Sequence[str], limit: int = BOUNDED_GROUP_ROWS) -> bool:
    """True if no group has more than `limit` rows (one map-side combined count)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) <= limit


def _decide(df: DataFrame, keys: Sequence[str], bounded: bool | None) -> bool:
    return groups_are_bounded(df, keys) if bounded is None else bounded


# --- facts per group ------------------------------------------------------

SALTS = 32
MAX_FACTS = 500_000  # rows of one group each, some 100 bytes: 50 MB


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread: str, how: str = "inner") -> DataFrame:
    """Join a large table to a table of one or few rows per group.

    The facts are repeated per salt and the rows salted by the hash of `spread`, so that
    no group lies in one task where the planner shuffles both sides. Where the facts turn
    out small, adaptive execution broadcasts them after measuring their size.
    """
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("salt", F.pmod(F.hash(spread), F.lit(SALTS)))
    return own.join(salted, [*keys, "salt"], how).drop("salt")


# --- blocks ---------------------------------------------------------------


def stored_halo(df: DataFrame) -> dict | None:
    """`before`, `after` and `rows` of a table that was written in blocks (`tables.write_blocks`), else None."""
    if not {"block", "own"} <= set(df.columns):
        return None
    return df.schema["block"].metadata or None


def block_tags(df: DataFrame) -> list[str]:
    """The columns that keep a stored block layout through a projection."""
    return ["block", "own"] if stored_halo(df) else []


def own_rows(df: DataFrame) -> DataFrame:
    """Each row once, in plain form: halo rows and tags of a stored block layout go, other tables stay as they are."""
    return df.filter("own").drop("own", "block") if stored_halo(df) else df


def facts_beside(rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread: str) -> DataFrame:
    """`join_facts`, without moving rows that lie in stored blocks.

    Their facts are written and counted first, and broadcast up to MAX_FACTS rows; beyond that the
    facts are joined like those of any other table, and the blocks are made again.
    """
    if not stored_halo(rows):
        return join_facts(rows, facts, keys, spread)
    written = materialise(facts, "facts")
    if written.count() <= MAX_FACTS:
        return rows.join(F.broadcast(written), list(keys))
    return join_facts(own_rows(rows), written, keys, spread)


def halo_rows(df: DataFrame, before: int, after: int, block_rows: int = BLOCK_ROWS, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Tag rows with `block` and copy boundary rows into neighbour blocks.

    A block sees `before` rows ahead of it and `after` rows behind it. `own` marks
    the rows that belong to the block. Rows are partitioned by (keys, block): left to
    itself, Spark would accept an earlier partitioning by keys alone, and with it a
    whole recording in one task.

    A table written in blocks is taken as it lies, without a shuffle, whatever `block_rows`
    says; its stored halo has to be at least as wide.
    """
    stored = stored_halo(df)
    if stored and before <= stored["before"] and after <= stored["after"]:
        return df
    if stored:  # too narrow for this frame: cut anew from the rows themselves
        df = own_rows(df)
    first = F.greatest(F.floor((F.col("idx") - after) / block_rows), F.lit(0))
    last = F.floor((F.col("idx") + before) / block_rows)
    tagged = df.withColumn("block", F.explode(F.sequence(first, last)))
    return tagged.withColumn("own", F.floor(F.col("idx") / block_rows) == F.col("block")).repartition(*keys, "block")


def block_window(keys: Sequence[str] = RECORDING) -> WindowSpec:
    """Native order inside one block."""
    return Window.partitionBy(*keys, "block").orderBy("idx")


def with_block_columns(
    df: DataFrame,
    columns: Mapping[str, Column],
    before: int,
    after: int,
    keys: Sequence[str] = RECORDING,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns (built on `block_window`) whose frames fit the halo."""
    wide = halo_rows(df, before, after, block_rows, keys).withColumns(dict(columns))
    return wide.filter("own").drop("own", "block")


# --- prefix sums ----------------------------------------------------------


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    next_of: Mapping[str, str] | None = None,
    bounded: bool | None = None,
) -> DataFrame:
    """Inclusive running sums of columns per `keys` in `order`.

    `sums` maps output name to summed column; `next_of` maps output name to a
    column whose value in the following row is wanted. `order` must be unique
    within a group. Groups within the bound use one window; larger ones are range
    partitioned on (keys, order), summed per partition, and shifted by the totals
    of the partitions before them.
    """
    next_of = dict(next_of or {})
    if _decide(df, keys, bounded):
        window = Window.partitionBy(*keys).orderBy(*order)
        running = window.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns(
            {out: F.sum(c).over(running) for out, c in sums.items()}
            | {out: F.lead(c).over(window) for out, c in next_of.items()}
        )
    ranged = df.repartitionByRange(*keys, *order).withColumn("slot", F.spark_partition_id())
    slots = materialise(ranged, "prefix")
    head = F.struct(*order)
    totals = slots.groupBy(*keys, "slot").agg(
        *[F.sum(c).alias(f"total_{out}") for out, c in sums.items()],
        *[F.min_by(c, head).alias(f"head_{out}") for out, c in next_of.items()],
    )
    over_slots = Window.partitionBy(*keys).orderBy("slot")
    before = over_slots.rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *keys,
        "slot",
        *[F.coalesce(F.sum(f"total_{out}").over(before), F.lit(0)).alias(f"shift_{out}") for out in sums],
        *[F.lead(f"head_{out}").over(over_slots).alias(f"tail_{out}") for out in next_of],
    )
    local = Window.partitionBy(*keys, "slot").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    return (
        slots.withColumns(
            {out: F.sum(c).over(running) for out, c in sums.items()}
            | {out: F.lead(c).over(local) for out, c in next_of.items()}
        )
        .join(shifts, [*keys, "slot"])
        .withColumns(
            {out: F.col(out) + F.col(f"shift_{out}") for out in sums}
            | {out: F.coalesce(F.col(out), F.col(f"tail_{out}")) for out in next_of}
        )
        .select(*df.columns, *sums, *next_of)
    )


def assign_idx(df: DataFrame, keys: Sequence[str], order: Sequence[str], bounded: bool | None = None) -> DataFrame:
    """Dense 0-based `idx` per group in `order` (unique within a group)."""
    if _decide(df, keys, bounded):
        return df.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)
    counted = prefix_sums(df.withColumn("one", F.lit(1).cast("bigint")), keys, order, {"idx": "one"}, bounded=False)
    return counted.drop("one").withColumn("idx", F.col("idx") - 1)


# --- exact order statistics -----------------------------------------------


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], bounded: bool | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles of `value` per group.

    Bounded groups use the built-in `percentile`. Larger ones collapse equal values
    to counts, rank them with `prefix_sums`, and interpolate between the two ranks.
    """
    data = df.select(*keys, F.col(value).alias("v")).filter("v is not null")
    if _decide(data, keys, bounded):
        picked = data.groupBy(*keys).agg(F.percentile("v", list(probs.values())).alias("q"))
        return picked.select(*keys, *[F.col("q")[i].alias(name) for i, name in enumerate(probs)])
    counts = data.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = prefix_sums(counts, keys, ["v"], {"upto": "c"}, bounded=False)
    wanted = (
        data.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in probs.items()])).alias("q"))
        .select(*keys, "q.name", (F.col("q.p") * (F.col("n") - 1)).alias("at"))
    )
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    low, high = F.floor("at"), F.ceil("at")
    ends = (
        join_facts(ranked, wanted, keys, "v")
        .filter(holds(low) | holds(high))
        .groupBy(*keys, "name", "at")
        .agg(F.min(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    )
    point = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - low)
    wide = ends.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, point)).alias(k) for k in probs])
    return wide


def grouped_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    quantiles: Mapping[str, Mapping[str, float]],
    bounded: bool | None = None,
) -> DataFrame:
    """Plain aggregates plus exact quantiles per group.

    `quantiles` maps a value column to {output: probability}. With bounded groups
    everything is one aggregation; otherwise each value column gets its own
    distributed ranking, joined on the keys.
    """
    if _decide(df, keys, bounded):
        lists = [F.percentile(v, list(p.values())).alias(f"q_{v}") for v, p in quantiles.items()]
        wide = df.groupBy(*keys).agg(*aggregates, *lists)
        for v, probs in quantiles.items():
            wide = wide.withColumns({name: F.col(f"q_{v}")[i] for i, name in enumerate(probs)}).drop(f"q_{v}")
        return wide
    wide = df.groupBy(*keys).agg(*aggregates)
    for v, probs in quantiles.items():
        wide = wide.join(exact_quantiles(df, keys, v, probs, bounded=False), list(keys), "left")
    return wide
