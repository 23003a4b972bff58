"""Document fingerprints: one-permutation MinHash in DataFrame operations only.

Each shingle (5 words, case kept; fewer words: the whole sequence) is hashed once. Its leading bits name one of
BINS bins, and every bin keeps its smallest hash. Empty bins are filled by optimal densification: each looks
at bins given by its own fixed sequence of 2-universal hashes until one of the originally filled is met; after TRIES
misses, which only very short texts have, it takes the filled bin of smallest joint hash instead, so the search ends
and stays consistent between texts. Stored are BITS low-order bits of each bin, as hexadecimal text; likeness is
the share of equal bins, corrected for the equality of random bits, (share - 2^-BITS) / (1 - 2^-BITS).

A document is compared with its successor in doc_id order and with its edited text (see `op6`). Successors
are found in blocks of neighbouring ids cut at actual ids (approximate percentiles); the documents at the cuts
travel to the block before as well, so one shuffle and one bounded window do it.

Defined cases: null text is the empty text; a text without words has the empty fingerprint, like only another
empty one (likeness 1, else 0); null doc_ids come first, repeated ids in order of their texts; the last document's
successor is the one of smallest id; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.base import SPACES, query, table

LOG_BINS, BITS, SHINGLE, TRIES = 8, 8, 5, 12
BINS = 1 << LOG_BINS
PRIME = 8191
_draw = random.Random(6)
#: Multiplier and offset of the 2-universal hash of each try.
PLACES = [(_draw.randrange(1, PRIME), _draw.randrange(PRIME)) for _ in range(TRIES)]
HEX = [f"{i:02x}" for i in range(256)]


def _sentinels() -> Column:
    """For each bin a value above every hash in it; hashes have a zero as lowest bit."""
    low = (1 << (64 - LOG_BINS)) - 1
    return F.expr(f"transform(sequence(0, {BINS - 1}), j -> shiftleft(cast(j AS BIGINT), {64 - LOG_BINS}) | {low}L)")


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Append array `out`: BITS bits of each densified bin (empty array: no words)."""
    words = df.withColumn("__w", F.filter(F.split(text, SPACES), lambda w: w != ""))
    n = F.size("__w")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (SHINGLE - 1))), lambda i: F.xxhash64(F.slice("__w", i, SHINGLE)).bitwiseAND(F.lit(-2)))
    hashed = words.withColumn("__h", F.when(n > 0, F.array_sort(F.concat(shingles, _sentinels()))).otherwise(F.array().cast("array<bigint>"))).drop("__w")
    bin_of = lambda h: F.shiftrightunsigned(h, 64 - LOG_BINS)
    first = hashed.withColumn("__m", F.filter("__h", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("__h", i - 1))))).drop("__h")
    # An odd hash is a sentinel: the bin is empty.
    open_ = first.withColumn("__e", F.transform("__m", lambda h: F.when(h.bitwiseAND(F.lit(1)) == 0, h))).drop("__m")
    filled = open_.withColumn("__f", F.filter("__e", lambda h: h.isNotNull()))

    def densified(h: Column, i: Column) -> Column:
        tries = [F.get("__e", F.pmod(F.pmod(i * m + c, F.lit(PRIME)), F.lit(BINS)).cast("int")) for m, c in PLACES]
        nearest = F.array_min(F.transform("__f", lambda v: F.struct(F.xxhash64(bin_of(v), i).alias("k"), v.alias("v"))))
        return F.coalesce(h, *tries, nearest["v"])

    low = F.transform("__e", lambda h, i: F.shiftright(densified(h, i), 1).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    return filled.withColumn(out, F.when(F.size("__f") + F.size("__e") > 0, low).otherwise(F.array().cast("array<int>"))).drop("__e", "__f")


def packed(bins: Column) -> Column:
    table_ = F.array(*[F.lit(h) for h in HEX])
    return F.array_join(F.transform(bins, lambda v: F.get(table_, v)), "")


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of equal bins."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    chance = 1.0 / (1 << BITS)
    inside = F.greatest(F.lit(0.0), (equal / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(inside)


def with_successor(docs: DataFrame, columns: list[str], blocks: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with `next`, a struct of `columns` of the next document."""
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / blocks for i in range(blocks)]
    cuts = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, 100 * blocks).alias("cuts")).first()
    bounds = sorted({cuts["low"], *(cuts["cuts"] or [])} - {None})
    if not bounds:
        return docs.withColumn("next", F.struct(*columns))
    listed = F.lit(bounds)
    steps = [1 << k for k in range(max(1, len(bounds).bit_length()) - 1, -1, -1)]
    at = lambda lo, s: F.coalesce(F.get(listed, (lo + s).cast("int")) <= F.col("doc_id"), F.lit(False))
    block = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(at(lo, s), lo + s).otherwise(lo))
    own = F.struct(F.col("__b").alias("block"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("__b") - 1, F.lit(len(bounds))).alias("block"), F.lit(True).alias("ghost"))
    cut = F.coalesce(F.get(listed, F.col("__b")) == F.col("doc_id"), F.lit(False))
    placed = docs.withColumn("__b", block).withColumn("__p", F.explode(F.when(cut, F.array(own, ghost)).otherwise(F.array(own))))
    order = Window.partitionBy("__p.block").orderBy("__p.ghost", "doc_id", "text")
    return placed.withColumn("next", F.lead(F.struct(*columns)).over(order)).where(~F.col("__p.ghost")).drop("__b", "__p")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


@query("op6_fingerprints")
def op6_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_successor(with_bins(docs, "text", "bins"), ["text", "bins"])
    both = with_bins(own.withColumn("edited", edited(F.col("text"), F.col("next.text"))), "edited", "edited_bins")
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next.bins")).alias("near_next"),
    )
