"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of the test items.

Every training passage (windows of twice the longest item, half overlapping, so that each occurrence lies
whole in one) is a query. An item's score is divided by the score it gives itself; items at `threshold` or
above are retrieved, all of them. Lists that cannot decide alone are set aside: each item's commonest terms, up to
half the threshold together. A passage's sums over the other (essential) terms tell exactly which items can
still reach the threshold; a passage with such an item walks the postings with WAND: cursors in item order, a
pivot by list maxima, skips by block maxima, full scores at the pivot.
Retrieved pairs are verified: of the item's question (all but its last sentence) and of its answer (the last
sentence; of a single sentence the last third of its words) the share of word 3-grams found in the passage
must reach `overlap` each.

The index is broadcast. Its size is checked: items are dealt into shards of about SHARD_ITEMS items and
SHARD_CHARS characters, one pass over the documents per shard. Document frequencies, number of items, mean and
longest length are those of the whole benchmark, so scores and passages do not depend on the shards. Shards are
built and broadcast one after the other; the driver holds one.

Words are runs between white space, lower-cased, without characters that are neither letters nor digits.
Defined cases: null or empty texts match nothing; items without words are no items; items with equal texts
each match; an empty benchmark leaves every document; repeated rows are judged alike; other columns are kept.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table
from sensorloom.llm.suffix_tree import slices
from sensorloom.session import materialise

K1, LENGTH_SHARE, BLOCK = 1.2, 0.75, 16
SHARD_ITEMS, SHARD_CHARS = 4096, 8 << 20


def plain(words: pa.Array) -> pa.Array:
    """Lower case, letters and digits only."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")


def words_of(text: str) -> list[str]:
    return [w for w in plain(pc.ascii_split_whitespace(pa.array([text], pa.string())).flatten()).to_pylist() if w]


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words of an item."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if words_of(s)]
    if len(sentences) > 1:
        return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])
    words = words_of(text)
    cut = max(1, len(words) - max(1, len(words) // 3))
    return words[:cut], words[cut:]


@dataclass
class Facts:
    """Of the whole benchmark."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]  # at least of the terms of the items at hand


@dataclass
class Index:
    ids: list[int]
    sides: list[tuple[list[int], list[int]]]  # question and answer as term numbers
    terms: list[str]
    postings: list[tuple[list[int], list[float]]]  # of each term: item positions and shares of the item's own score
    list_max: np.ndarray
    block_max: list[dict[int, float]]  # of each term, by block of items
    first: np.ndarray  # of each term's essential pairs
    pair_item: np.ndarray
    pair_share: np.ndarray
    need: np.ndarray  # of each item: least sum over its essential terms
    window: int
    threshold: float
    overlap: float


def build(items: list[tuple[int, str]], threshold: float, overlap: float, facts: Facts | None = None) -> Index | None:
    """Index of some items of a benchmark with `facts`; without them the items are the benchmark."""
    items = sorted((i, t) for i, t in items if t and words_of(t))
    if not items:
        return None
    bags = [Counter(words_of(t)) for _, t in items]
    sizes = [sum(b.values()) for b in bags]
    facts = facts or Facts(len(items), sum(sizes) / len(sizes), max(sizes), Counter(w for b in bags for w in b))
    mean, n, df = facts.mean, len(items), facts.df
    terms = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
    idf = {w: math.log(1 + (facts.items - df[w] + 0.5) / (df[w] + 0.5)) for w in terms}
    postings: list[tuple[list[int], list[float]]] = [([], []) for _ in terms]
    block_max: list[dict[int, float]] = [{} for _ in terms]
    pairs, need = [], np.zeros(n)
    for i, bag in enumerate(bags):
        part = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * sizes[i] / mean)) for w, tf in bag.items()}
        own = sum(part.values())
        rest = 0.0
        order = sorted(part, key=lambda w: (-df[w], len(w), w))  # common and short words first: they occur everywhere
        while order and rest + part[order[0]] / own <= threshold / 2:
            rest += part[order.pop(0)] / own
        need[i] = threshold - rest - 1e-6
        pairs += [(terms[w], i, part[w] / own) for w in order]
        for w, x in part.items():
            k = terms[w]
            postings[k][0].append(i)
            postings[k][1].append(x / own)
            block_max[k][i // BLOCK] = max(block_max[k].get(i // BLOCK, 0.0), x / own)
    sides = [tuple([terms[w] for w in side] for side in halves(t)) for _, t in items]
    pairs.sort()
    first = np.searchsorted([p[0] for p in pairs], np.arange(len(terms) + 1))
    item, share = np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])
    return Index([i for i, _ in items], sides, list(terms), postings, np.array([max(b.values()) for b in block_max]), block_max, first, item, share, need, 2 * facts.longest, threshold, overlap)


def wand(index: Index, terms: list[int]) -> list[tuple[int, float]]:
    """All items whose share reaches the threshold, by block-max WAND over the passage's terms."""
    out, least = [], index.threshold - 1e-6
    lists = [(index.postings[t], float(index.list_max[t]), index.block_max[t]) for t in terms]
    at = [0] * len(lists)
    while True:
        live = sorted((lists[k][0][0][at[k]], k) for k in range(len(lists)) if at[k] < len(lists[k][0][0]))
        bound, pivot = 0.0, None
        for j, (_, k) in enumerate(live):
            bound += lists[k][1]
            if bound >= least:
                pivot = j
                break
        if pivot is None:
            return out
        item = live[pivot][0]
        while pivot + 1 < len(live) and live[pivot + 1][0] == item:
            pivot += 1
        block = item // BLOCK
        if sum(lists[k][2].get(block, 0.0) for _, k in live[: pivot + 1]) < least:
            # No item of this block up to the next list's position can reach it.
            beyond = (block + 1) * BLOCK if pivot + 1 == len(live) else min((block + 1) * BLOCK, live[pivot + 1][0])
            for _, k in live[: pivot + 1]:
                at[k] = bisect_left(lists[k][0][0], max(beyond, item + 1), at[k])
        elif live[0][0] == item:
            share = sum(lists[k][0][1][at[k]] for _, k in live[: pivot + 1])
            if share >= least:
                out.append((item, share))
            for _, k in live[: pivot + 1]:
                at[k] += 1
        else:
            for i, k in live[:pivot]:
                if i < item:
                    at[k] = bisect_left(lists[k][0][0], item, at[k])


def coverage(side: list[int], passage: list[int]) -> float:
    """Share of the side's word 3-grams (shorter sides: of the one n-gram) that the passage has."""
    n = min(3, len(side))
    if not n:
        return 1.0
    have = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
    own = [tuple(side[k : k + n]) for k in range(len(side) - n + 1)]
    return sum(g in have for g in own) / len(own)


def candidates(index: Index, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """(text, first word) of the passages that the vectorised bounds leave."""
    step = index.window // 2
    hits = np.flatnonzero(ids >= 0)
    hits = hits[index.first[ids[hits] + 1] > index.first[ids[hits]]]
    if not len(hits):
        return []
    text = np.searchsorted(bounds, hits, side="right") - 1
    k = (hits - bounds[text]) // step
    passages = int(k.max()) + 1
    key = (text * passages + k) * len(index.terms) + ids[hits]
    key = np.unique(np.concatenate([key, (key - len(index.terms))[k > 0]]))  # each term once a passage
    passage, term = key // len(index.terms), key % len(index.terms)
    size = index.first[term + 1] - index.first[term]
    at = np.repeat(index.first[term] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    pair, where = np.unique(np.repeat(passage, size) * len(index.ids) + index.pair_item[at], return_inverse=True)
    total = np.bincount(where, index.pair_share[at])
    left = np.unique(pair[total >= index.need[pair % len(index.ids)]] // len(index.ids))
    return [(int(p // passages), int(p % passages) * step) for p in left]


def matches(index: Index, part: pa.RecordBatch) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item id, share, question overlap, answer overlap, first word), the best passage of each pair."""
    lists = pc.ascii_split_whitespace(pc.fill_null(part.column(part.schema.get_field_index("text")), ""))
    coded = lists.flatten().dictionary_encode()
    distinct = plain(coded.dictionary.cast(pa.string()))
    term = pc.fill_null(pc.index_in(distinct, value_set=pa.array(index.terms, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term[pc.equal(distinct, "").to_numpy(zero_copy_only=False)] = -2
    ids = term[coded.indices.to_numpy(zero_copy_only=False)]
    real = ids > -2
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[real]
    ids = ids[real]
    bounds = np.searchsorted(row, np.arange(len(part) + 1))
    best: dict[tuple[int, int], tuple] = {}
    for text, start in candidates(index, ids, bounds):
        passage = ids[bounds[text] + start : min(bounds[text] + start + index.window, bounds[text + 1])].tolist()
        for item, share in wand(index, sorted({t for t in passage if t >= 0})):
            q, a = (coverage(side, passage) for side in index.sides[item])
            if q >= index.overlap and a >= index.overlap:
                best[text, item] = max(best.get((text, item), (0.0,)), (share, q, a, -start))
    return [(text, index.ids[item], *x[:3], -x[3]) for (text, item), x in sorted(best.items())]


class Shards:
    """The indexes of the items (item_id, text), built when they are reached."""

    def __init__(self, benchmark: DataFrame, threshold: float, overlap: float):
        counts = benchmark.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
        self.shards = max(1, -(-counts["n"] // SHARD_ITEMS), -(-(counts["chars"] or 0) // SHARD_CHARS))
        self.items = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.shards)).alias("shard"))
        self.threshold, self.overlap, self.facts, self.terms = threshold, overlap, None, None
        if self.shards == 1:
            return

        def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(shard, words_of(t or "")) for t, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([s for s, _ in rows], [len(w) for _, w in rows], [sorted(set(w)) for _, w in rows]), kinds, strict=True)], ["shard", "size", "words"])

        bag = materialise(self.items.select("text", "shard").mapInArrow(bags, "shard long, size long, words array<string>").where("size > 0"), "benchmark-words")
        whole = bag.agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("longest")).first()
        self.facts = (whole["n"], (whole["words"] or 0) / max(1, whole["n"]), whole["longest"] or 0)
        word = bag.select("shard", F.explode("words").alias("word"))
        self.terms = materialise(word.select("shard", "word").distinct().join(word.groupBy("word").agg(F.count("*").alias("df")), "word"), "benchmark-terms")

    def _index(self, k: int) -> Index | None:
        facts = self.facts and Facts(*self.facts, {r["word"]: r["df"] for r in self.terms.where(F.col("shard") == k).collect()})
        return build([(r["item_id"], r["text"]) for r in self.items.where(F.col("shard") == k).collect()], self.threshold, self.overlap, facts)

    def __len__(self) -> int:
        return self.shards

    def __iter__(self) -> Iterator[Index]:
        for k in range(self.shards):
            if index := self._index(k):
                yield index


def indexes(benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6) -> list[Index] | Shards:
    """One index per shard of the items (item_id, text): a list of one or none, or shards that are built one after the other."""
    shards = Shards(benchmark, threshold, overlap)
    return list(shards) if shards.shards == 1 else shards


def find(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, item_id, score, question and answer overlap and first word of each verified pair."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    names = ["doc_id", "item_id", "score", "question", "answer", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = matches(held.value, part)
                rows = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([rows, *(pa.array([f[k + 1] for f in found], kinds[k]) for k in range(5))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, score double, question double, answer double, start long")


def clean(docs: DataFrame, found: list[Index] | Shards) -> DataFrame:
    """The rows of `docs` in which no item was verified."""
    many, hits = isinstance(found, Shards), []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for index in found:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    matched = np.zeros(len(part), bool)
                    matched[[m[0] for m in matches(held.value, part)]] = True
                    yield part.filter(pa.array(matched if many else ~matched))

        if not many:
            return docs.mapInArrow(run, schema)
        # Written before the next shard is built, so that no two are held; rows with equal texts are judged alike.
        hits.append(materialise(docs.select("text").mapInArrow(run, "text string").select(F.sha2(F.col("text").cast("binary"), 256).alias("benchmark_hit")).distinct(), "clean"))
        held.destroy()
    for hit in hits:
        docs = docs.join(hit, F.sha2(docs["text"].cast("binary"), 256) == hit["benchmark_hit"], "left_anti")
    return docs


def pairs(docs: DataFrame, found: list[Index] | Shards) -> DataFrame | None:
    """The verified pairs of all shards."""
    out = None
    for index in found:
        got = find(docs, index)
        if isinstance(found, Shards):
            got = materialise(got, "pairs")
        out = got if out is None else out.unionByName(got)
    return out


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = pairs(docs, indexes(benchmark))
    return spark.createDataFrame([], "doc_id long, item_id long, score double, question double, answer double, start long") if out is None else out
