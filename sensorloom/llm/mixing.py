"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sizes are words. Sources in code-point order (null last) take the weights in turn and share `share` times all
words by weight; a target stops at `most` times its source's size and the excess goes to the others by weight,
until none is above. A source's documents get target / size expected copies each. The whole part is certain:
so many copies of every document. For the fraction p, documents are ranked by random odds divided by inclusion
odds, (u / (1 - u)) / (p / (1 - p)), and the sample of fixed size, measured in words, is the head of that order
that fits what is left of the target; the last FILLS places go to the later documents whose sizes come nearest to the gap.

u is a hash of doc_id, text and seed: reruns and other partitionings agree. The order is cut by range
partitions and prefix sums, so no source meets in one task; what comes out of it are a few ranks per source,
and every document is decided by comparing its own rank with it, where it lies.

Defined cases: null text -> size 0, taken 0; a null source is a source of its own; a null doc_id is ranked
like any other value; repeated rows tie, so they are numbered and taken one by one; an empty table stays empty; sources without
words have target 0; clashing column names of the input are not read (`mix` replaces its own output columns).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table, unit_hash
from sensorloom.operators.ordering import join_facts, prefix_sums
from sensorloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
FILLS = 3
OUT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Text that keeps null apart from every source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size and target from (source, words). Each round of resharing is one small aggregate."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = by_source.withColumns({"whole": F.lit(0), "missing": F.col("source").isNull().cast("int"), "name": F.coalesce("source", F.lit("")), "one": F.lit(1).cast("long")})
    ranked = prefix_sums(listed, ["whole"], ["missing", "name"], {"rank": "one"}, bounded=False)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = materialise(ranked.select("source", source_key(F.col("source")).alias("key"), "source_size", turn.alias("weight")), "mix-sources")
    cap = F.col("source_size") * F.lit(most)
    level, capped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        r = known.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("int")).alias("capped"),
        ).first()
        if not r["open"] or r["capped"] == capped:
            break
        level, capped = (share * r["words"] - r["held"]) / r["open"], r["capped"]
    return known.select("source", "key", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def tie(rows: DataFrame) -> DataFrame:
    """rows with one number for all that tie: those of the same source, doc_id and text."""
    return rows.withColumn("tie", F.xxhash64("key", "doc_id", "u"))


def repeats(rows: DataFrame) -> DataFrame | None:
    """The numbers that several rows have (None: there are none). Counts are combined before the shuffle."""
    found = materialise(tie(rows).groupBy("tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tie", F.lit(True).alias("again")), "mix-repeats")
    return None if found.isEmpty() else found


def numbered(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """rows with nth, which counts equal rows from 1; equal rows are alike, so any order will do.

    Only rows that repeat are sorted, in ranges that also split a single row that repeats without end.
    """
    if again is None:
        return rows.withColumn("nth", F.lit(1).cast("long"))
    flagged = join_facts(tie(rows).withColumn("row_id", F.monotonically_increasing_id()), again, ["tie"], "row_id", "left")
    flagged = materialise(flagged, "mix-flagged")
    many = prefix_sums(flagged.where("again").withColumn("one", F.lit(1).cast("long")), ["tie"], ["row_id"], {"nth": "one"}, bounded=False)
    single = flagged.where("again is null").withColumn("nth", F.lit(1).cast("long"))
    return single.select(*rows.columns, "nth").unionByName(many.select(*rows.columns, "nth"))


def boundaries(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with whole copies, p, the last (rank, doc_id, nth) of the sample's head (null: none) and those that fill the gap."""
    sizes = sizes if "nth" in sizes.columns else numbered(sizes, repeats(sizes))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("certain", F.floor(expected + F.lit(1e-12))).withColumn("p", F.greatest(F.lit(0.0), expected - F.col("certain")))
    open_ = sizes.where("size > 0").join(sources.where("p > 0").select("key", "p", (F.col("target") - F.col("certain") * F.col("source_size")).alias("left")), "key")
    ranked = prefix_sums(open_.withColumn("rank", pareto(F.col("u"), F.col("p"))), ["key"], ["rank", "doc_id", "nth"], {"upto": "size"}, bounded=False)
    ranked = materialise(ranked.select("key", "rank", "doc_id", "nth", "size", "upto", "left"), "mix-ranked")
    place = F.struct("rank", "doc_id", "nth")
    empty = F.lit(None).cast(f"struct<rank: double, doc_id: {sizes.schema['doc_id'].dataType.simpleString()}, nth: bigint>")
    head = ranked.groupBy("key").agg(F.max(F.when(F.col("upto") <= F.col("left"), place)).alias("last"), (F.first("left") - F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0))).alias("gap"))
    filled = materialise(head.withColumn("fills", F.array(empty)), "mix-fill-0")
    for k in range(1, FILLS + 1):
        open_ = ranked.where("upto > left").join(filled, "key").where((F.col("size") < 2 * F.col("gap")) & ~F.coalesce(F.array_contains("fills", place), F.lit(False)))
        best = open_.groupBy("key").agg(F.min_by(F.struct(place.alias("place"), "size"), F.struct(F.abs(F.col("size") - F.col("gap")), place)).alias("best"))
        filled = materialise(
            filled.join(best, "key", "left").select("key", "last", (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"), F.array_append("fills", F.col("best.place")).alias("fills")),
            f"mix-fill-{k}",
        )
    return sources.join(filled.drop("gap"), "key", "left")


def pareto(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null without a chance."""
    return F.try_divide(u / (1 - u), p / (1 - p))


def narrow(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, its key, size and the random number of each document."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), unit_hash("doc_id", "text", seed=seed).alias("u"))


def decided(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (doc_id, key, size, u, ...) with source_size, target, copies and taken."""
    rows = rows if "nth" in rows.columns else numbered(rows, repeats(rows))
    place = F.struct(pareto(F.col("u"), F.col("p")).alias("rank"), F.col("doc_id"), F.col("nth"))
    chosen = F.coalesce(place <= F.col("last"), F.lit(False)) | F.coalesce(F.array_contains("fills", place), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("certain") + (chosen & (F.col("p") > 0)).cast("long")).otherwise(0)
    joined = rows.join(limits.drop("source"), "key")
    return joined.withColumn("copies", copies.cast("long")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("certain", "p", "last", "fills", "nth")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies (1 or more) and taken words."""
    docs = docs.drop(*OUT)
    rows = materialise(narrow(docs, seed), "mix-sizes")
    again = repeats(rows)
    limits = materialise(boundaries(numbered(rows, again), targets(rows, weights, share, most)), "mix-limits")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # own names apart from the input's
    own = packed.select("row", F.col("row.doc_id"), source_key(F.col("row.source")).alias("key"), word_count(F.col("row.text")).alias("size"), unit_hash("row.doc_id", "row.text", seed=seed).alias("u"))
    return decided(numbered(own, again), limits).where("copies > 0").select("row.*", *OUT)


@query("op9_mixing")
def op9_mixing(spark, sf_dir):
    rows = materialise(narrow(table(spark, sf_dir, "documents"), 9), "mix-sizes")
    own = numbered(rows, repeats(rows))
    limits = materialise(boundaries(own, targets(rows, (5, 2, 1), 1.5, 2.0)), "mix-limits")
    return decided(own, limits).select("doc_id", "size", "source_size", "target", "taken")
