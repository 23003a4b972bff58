"""Language-model scoring: unigram base scores and a probabilistic suffix tree.

Texts are lower-cased (A-Z), split at white space and read as the bytes of the words with a blank after
each and an end mark, so every token sequence has one spelling and the tree gives it a probability. Bytes
fall in 64 fixed classes; the tree predicts the next class from up to DEPTH classes before it, and a byte is
drawn inside its class by its share there. A context is kept if it was seen `seen` times or more and its
next-class distribution diverges from its parent's by more than the description length of that distribution,
or if a longer kept context needs it; so the tree grows with the text. Kept distributions hold all their
next-class counts and are smoothed towards the parent's; the state of a position is the longest kept suffix.
The score of a text is the sum of the log10 probabilities that the states give its bytes and its end; word
counts serve base_score and n_known only.

The tree is a table. DEPTH classes and the next one (a gram) decide a probability, so each distinct gram of
the training and scored texts is a row; grams with the same NEAR nearest context classes meet in one task,
which has all their longer contexts, and counts of shorter contexts are a fixed array. GRAMS commonest grams are
looked up in the scoring tasks; all others meet their documents in a join.

Counts cover all training documents: every class string and every word is counted in one pass, combined per
task, and summed by key. Words carry two 64-bit hashes, the first as key, the second to prove that no two
words share a key. Words of relative frequency HEAD or more (at most 1/HEAD of them) are looked up in the
scoring tasks; the counts of all other words meet their documents in a join.

Defined cases: null or empty text -> only the end token; repeated rows score alike (they are counted as often
as they occur); without training documents N = V = 0 and the tree is the uniform root; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import fold, query, table
from sensorloom.session import materialise

DEPTH, WIDTH = 5, 64
HEAD = 1e-5
#: Contexts up to NEAR - 1 classes have their counts in one array of WIDTH ** NEAR.
NEAR = 3
#: Grams that scoring tasks look up themselves, at most.
GRAMS = 1 << 19
SLICE_BYTES = 2 << 20
MERGE_ROWS = 1 << 20


def _classes() -> np.ndarray:
    """Byte to class: 0 end, 1 blank, letters, digits, seven signs, other, UTF-8 first bytes, following bytes by four."""
    out = np.full(256, 45, np.uint8)
    out[0], out[32] = 0, 1
    out[97:123] = 2 + np.arange(26)
    out[48:58] = 28 + np.arange(10)
    for i, c in enumerate(b".,!?-|:"):
        out[c] = 38 + i
    out[0xC3], out[0xC4:0x100] = 46, 47
    out[0x80:0xC0] = 48 + (np.arange(64) >> 2)
    out[0xC0:0xC3] = 47
    return out


CLASS = _classes()


def words_of(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lists of words of each text, and all words (an empty text has the one empty word)."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    lists = pc.ascii_split_whitespace(text)
    return lists, lists.flatten()


def slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def stream(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with a blank after each word, then an end mark and DEPTH - 1 more zeros; and where each text starts."""
    joined = pc.binary_join(lists, " ")
    joined = pc.if_else(pc.equal(joined, ""), "", pc.binary_join_element_wise(joined, " ", ""))
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data = np.where(data == 0, 1, data)
    lengths = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + DEPTH * (1 + np.arange(len(lengths)))
    out = np.zeros(len(data) + DEPTH * (len(lengths) + 1), np.uint8)
    out[np.arange(len(data)) + DEPTH * (1 + np.repeat(np.arange(len(lengths)), lengths))] = data
    return out, starts


def predicted(n: int, starts: np.ndarray) -> np.ndarray:
    """Flags of the positions that are predicted: all bytes and one end mark of each text."""
    ends = np.concatenate((starts[1:] - DEPTH, [n - DEPTH]))
    flags = np.zeros(n + 1, np.int8)
    np.add.at(flags, starts, 1)
    np.add.at(flags, ends + 1, -1)
    return np.cumsum(flags[:-1], dtype=np.int8) > 0


def context_codes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` classes before each position, the nearest in the low bits (the first `depth` positions are pads)."""
    code = np.zeros(len(symbols), np.int64)
    for d in range(depth, 0, -1):
        code[depth:] = (code[depth:] << 6) | symbols[depth - d : len(symbols) - d]
    return code


def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    w = words.to_numpy(zero_copy_only=False)
    return tuple(pd.util.hash_array(w, hash_key=k, categorize=False).view(np.int64) for k in ("0123456789abcdef", "fedcba9876543210"))


def _summed(key: list[np.ndarray], n: list[np.ndarray], other: list[np.ndarray] | None = None):
    k, first, inverse = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.concatenate(n), len(k)).astype(np.int64)
    return k, total, None if other is None else np.concatenate(other)[first]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, other, n): class strings ('g'), bytes ('b') and words ('w')."""
    gram, word = ([], []), ([], [], [])
    size = np.zeros(256, np.int64)

    def out(kind: str, k: np.ndarray, n: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(k), pa.string()), "key": k, "other": k if other is None else other, "n": n})

    for batch in batches:
        for part in slices(batch):
            lists, words = words_of(part.column(part.schema.get_field_index("text")))
            data, starts = stream(lists)
            symbols = CLASS[data]
            at = predicted(len(data), starts)
            size += np.bincount(data[at], minlength=256)
            k, n = np.unique(((context_codes(symbols, DEPTH) << 6) | symbols)[at], return_counts=True)
            gram[0].append(k)
            gram[1].append(n)
            counted = pc.value_counts(words)
            values, n = counted.field(0), counted.field(1).to_numpy(zero_copy_only=False)
            full = pc.greater(pc.binary_length(values), 0)
            h, h2 = hashes(values.filter(full))
            word[0].append(np.append(h, END[0]))
            word[1].append(np.append(n[full.to_numpy(zero_copy_only=False)], len(part)))
            word[2].append(np.append(h2, END[1]))
        k, n, _ = _summed(*gram)
        gram = ([k], [n])
        w, m, h2 = _summed(*word)
        word = ([w], [m], [h2])
        if len(k) > MERGE_ROWS:
            yield out("g", k, n, None)
            gram = ([], [])
        if len(w) > MERGE_ROWS:
            yield out("w", w, m, h2)
            word = ([], [], [])
    if gram[0]:
        yield out("g", *_summed(*gram))
    if word[0]:
        yield out("w", *_summed(*word))
    yield out("b", np.arange(256), size, None)


#: The end token's hashes: no word is empty, so the empty word's stand for it.
END = tuple(int(h[0]) for h in hashes(pa.array([""])))


# --- tree -------------------------------------------------------------------------


@dataclass
class Tree:
    start: np.ndarray  # the three classes before a position -> state of up to three
    depth: np.ndarray  # of each state
    child: np.ndarray  # state * 64 + the class one further back -> state, 0 if there is none
    logp: np.ndarray  # state * 64 + next class -> log10
    byte: np.ndarray  # log10 share of each byte in its class


def byte_shares(sizes: np.ndarray) -> np.ndarray:
    """log10 share of each byte in its class."""
    byte = np.zeros(256)
    for c in range(WIDTH):
        members = np.flatnonzero(CLASS == c)
        byte[members] = np.log10((sizes[members] + 0.5) / (sizes[members].sum() + 0.5 * len(members))) if len(members) else 0
    return byte


def build(rows: list[tuple[int, int, int]], sizes: np.ndarray, least: float, prior: float = 4.0) -> Tree:
    """The same tree in memory, for small texts and tests. rows: (length of context, context and next class as one code, count)."""
    byte = byte_shares(sizes)
    level, code, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    contexts, counts = [], []
    for d in range(DEPTH + 1):
        own = level == d
        ctx, inverse = np.unique(code[own] >> 6, return_inverse=True)
        table_ = np.zeros((len(ctx), WIDTH))
        np.add.at(table_, (inverse, code[own] & 63), n[own])
        contexts.append(ctx)
        counts.append(table_)
    if not len(contexts[0]):
        contexts[0], counts[0] = np.zeros(1, np.int64), np.zeros((1, WIDTH))
    total = counts[0].sum()
    parent, keep = [None], [np.ones(1, bool)]
    for d in range(1, DEPTH + 1):
        up = np.searchsorted(contexts[d - 1], contexts[d] & ((1 << 6 * (d - 1)) - 1)) if len(contexts[d]) else np.zeros(0, np.int64)
        own, above = counts[d], counts[d - 1][np.minimum(up, len(counts[d - 1]) - 1)]
        size = own.sum(1, keepdims=True)
        p, q = own / np.maximum(size, 1), (above + 0.01) / (above + 0.01).sum(1, keepdims=True)
        divergence = size[:, 0] * np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / q), 0).sum(1)
        price = 0.5 * np.maximum((own > 0).sum(1) - 1, 1) * np.log(np.maximum(size[:, 0], 2))
        parent.append(up)
        keep.append((size[:, 0] >= least * total) & (divergence > price))
    for d in range(DEPTH, 1, -1):
        keep[d - 1][parent[d][keep[d]]] = True
    number, at = [np.zeros(1, np.int64)], 1
    for d in range(1, DEPTH + 1):
        ids = np.where(keep[d], at + np.cumsum(keep[d]) - 1, 0)
        at += int(keep[d].sum())
        number.append(ids)
    depth = np.zeros(at, np.int8)
    child = np.zeros((at, WIDTH), np.int32)
    p = np.empty((at, WIDTH))
    p[0] = (counts[0][0] + 1) / (total + WIDTH)
    for d in range(1, DEPTH + 1):
        k = keep[d]
        ids, up = number[d][k], number[d - 1][parent[d][k]]
        depth[ids] = d
        child[up, contexts[d][k] >> (6 * (d - 1))] = ids
        own = counts[d][k]
        p[ids] = (own + prior * p[up]) / (own.sum(1, keepdims=True) + prior)
    codes3 = np.arange(WIDTH**3)
    start = np.zeros(WIDTH**3, np.int32)
    alive = np.ones(WIDTH**3, bool)
    for d in range(3):
        to = child[start, (codes3 >> (6 * d)) & 63]
        alive &= to > 0
        start = np.where(alive, to, start)
    return Tree(start.astype(np.int32), depth, child.ravel(), np.log10(p).astype(np.float32).ravel(), byte)


def states(tree: Tree, symbols: np.ndarray) -> np.ndarray:
    """Longest kept suffix before each position."""
    state = tree.start[context_codes(symbols, 3)]
    deep = np.flatnonzero(tree.depth[state] == 3)
    for d in range(4, DEPTH + 1):
        deep = deep[deep >= d]
        to = tree.child[state[deep].astype(np.int64) * WIDTH + symbols[deep - d]]
        found = to > 0
        deep = deep[found]
        state[deep] = to[found]
    return state


def token_scores(tree: Tree, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the spelling of each word, in order, and of the end of each text."""
    data, starts = stream(lists)
    symbols = CLASS[data].astype(np.int64)
    logp = tree.logp[states(tree, symbols).astype(np.int64) * WIDTH + symbols] + tree.byte[data]
    inside = predicted(len(data), starts)
    logp[~inside] = 0
    first = np.zeros(len(data), bool)
    first[starts] = True
    first[1:] |= (data[:-1] == 32) & inside[1:]
    at = np.flatnonzero(first)
    total, is_end = np.add.reduceat(logp, at), data[at] == 0
    return total[~is_end], total[is_end]


# --- Spark ------------------------------------------------------------------------


@dataclass
class Model:
    grams: DataFrame  # key, n: counts of all training grams
    near: list[np.ndarray]  # of each length below NEAR: counts by context and next class
    byte: np.ndarray  # log10 share of each byte in its class
    words: DataFrame  # key, n: counts of all training words and the end token
    total: int
    distinct: int
    seen: int
    head_key: np.ndarray
    head_n: np.ndarray


def worth(size: np.ndarray, kinds: np.ndarray, divergence: np.ndarray, seen: int) -> np.ndarray:
    """Contexts that pay for themselves: size seen, kinds of next classes, divergence from the parent's."""
    return (size >= seen) & (divergence > 0.5 * np.maximum(kinds - 1, 1) * np.log(np.maximum(size, 2)))


def levels(key: np.ndarray, n: np.ndarray, near: list[np.ndarray], seen: int) -> list[tuple]:
    """Per length from NEAR to DEPTH, of grams that hold all their NEAR nearest classes' rows: count of each gram's
    (context, next), size of its context, whether the context is kept (without what longer ones need), its number."""
    out, above_n, above_size = [], near[NEAR - 1].ravel()[key & (WIDTH**NEAR - 1)], near[NEAR - 1].sum(1)[(key >> 6) & (WIDTH ** (NEAR - 1) - 1)]
    for d in range(NEAR, DEPTH + 1):
        code, first, inverse = np.unique(key & ((1 << 6 * (d + 1)) - 1), return_index=True, return_inverse=True)
        count = np.bincount(inverse, n, len(code))
        context, where = np.unique(code >> 6, return_inverse=True)
        size = np.bincount(where, count, len(context))
        q = (above_n[first] + 0.01) / (above_size[first] + 0.01 * WIDTH)
        part = np.where(count > 0, count * np.log(np.maximum(count, 1) / np.maximum(size[where], 1) / q), 0)
        keep = worth(size, np.bincount(where, count > 0, len(context)), np.bincount(where, part, len(context)), seen)
        above_n, above_size, of = count[inverse], size[where][inverse], where[inverse]
        out.append((above_n, above_size, keep, of))
    for d in range(len(out) - 1, 0, -1):  # a longer kept context needs the shorter ones
        np.logical_or.at(out[d - 1][2], out[d - 1][3][out[d][2][out[d][3]]], True)
    return out


def near_levels(near: list[np.ndarray], needed: np.ndarray, seen: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each context of NEAR - 1 classes: its state's probabilities, and whether it is kept; `needed` ones have a kept longer one."""
    keep = [np.ones(1, bool)]
    for d in range(1, NEAR):
        own, above = near[d], near[d - 1][np.arange(WIDTH**d) % WIDTH ** (d - 1)]
        size = own.sum(1)
        p, q = own / np.maximum(size, 1)[:, None], (above + 0.01) / (above + 0.01).sum(1, keepdims=True)
        divergence = size * np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / q), 0).sum(1)
        keep.append(worth(size, (own > 0).sum(1), divergence, seen))
    keep[NEAR - 1][needed] = True
    for d in range(NEAR - 1, 1, -1):
        keep[d - 1][np.flatnonzero(keep[d]) % WIDTH ** (d - 1)] = True
    p = (near[0] + 1) / (near[0].sum() + WIDTH)
    for d in range(1, NEAR):
        up = p[np.arange(WIDTH**d) % WIDTH ** (d - 1)]
        p = np.where(keep[d][:, None], (near[d] + prior * up) / (near[d].sum(1, keepdims=True) + prior), up)
    return p, keep[NEAR - 1]


def gram_scores(key: np.ndarray, n: np.ndarray, near: list[np.ndarray], near_p: np.ndarray, seen: int, prior: float) -> np.ndarray:
    """log10 probability that each gram's state gives its last class."""
    p = near_p.ravel()[key & (WIDTH**NEAR - 1)]
    for count, size, keep, of in levels(key, n, near, seen):
        p = np.where(keep[of], (count + prior * p) / (size + prior), p)
    return np.log10(p)


def whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """key and n of a partition, sorted."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    key, n = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(2))
    order = np.argsort(key, kind="stable")
    return key[order], n[order]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of texts to score, with count 0."""
    key = [np.zeros(0, np.int64)]
    for batch in batches:
        for part in slices(batch):
            codes, at = _codes(part)[:2]
            key.append(np.unique(codes[at]))
        key = [np.unique(np.concatenate(key))]
        if len(key[0]) > MERGE_ROWS:
            yield pa.RecordBatch.from_pydict({"key": key[0], "n": np.zeros(len(key[0]), np.int64)})
            key = [np.zeros(0, np.int64)]
    yield pa.RecordBatch.from_pydict({"key": key[0], "n": np.zeros(len(key[0]), np.int64)})


def _codes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram of each position, flags of those predicted, bytes, and where each text starts."""
    data, starts = stream(words_of(part.column(part.schema.get_field_index("text")))[0])
    symbols = CLASS[data]
    return (context_codes(symbols, DEPTH) << 6) | symbols, predicted(len(data), starts), data, starts


def fit(train: DataFrame, seen: int = 20) -> Model:
    """Learn from all rows of `train` (text). To the driver come at most WIDTH ** NEAR counts and 1 / HEAD words."""
    counted = materialise(train.select("text").mapInArrow(_counted, "kind string, key long, other long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("other").alias("a"), F.max("other").alias("b")), "suffix-counts")
    words = counted.where("kind = 'w'")
    facts = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("clash")).first()
    if facts["clash"]:
        raise ValueError("two words share a 64-bit hash; change the hash key")
    total = facts["n"] or 0
    head = words.where((F.col("n") >= max(1.0, HEAD * total)) | (F.col("key") == END[0])).select("key", "n").toPandas().sort_values("key")
    grams = counted.where("kind = 'g'").select("key", "n")
    near = [np.zeros((WIDTH**d, WIDTH)) for d in range(NEAR)]
    rows = grams.groupBy(F.col("key").bitwiseAND(F.lit(WIDTH**NEAR - 1)).alias("key")).agg(F.sum("n").alias("n")).toPandas()
    for d in range(NEAR):
        np.add.at(near[d].reshape(-1), rows["key"].to_numpy(np.int64) % WIDTH ** (d + 1), rows["n"].to_numpy(float))
    sizes = np.zeros(256)
    for r in counted.where("kind = 'b'").collect():
        sizes[r["key"]] = r["n"]
    return Model(grams, near, byte_shares(sizes), words.select("key", "n"), total, facts["v"], seen, head["key"].to_numpy(np.int64), head["n"].to_numpy(np.int64))


def scored_grams(docs: DataFrame, model: Model, prior: float = 4.0) -> DataFrame:
    """key, n and log10 probability of every gram of the training texts and of `docs`."""
    near, seen = model.near, model.seen
    held = docs.sparkSession.sparkContext.broadcast(near)
    every = model.grams.unionByName(docs.select("text").mapInArrow(_grams, "key long, n long")).groupBy("key").agg(F.sum("n").alias("n"))
    group = F.shiftright("key", 6).bitwiseAND(F.lit(WIDTH**NEAR - 1))
    dealt = materialise(every, "suffix-grams").repartition(group)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = whole(batches)
        _, _, keep, of = levels(key, n, held.value, seen)[0]
        yield pa.RecordBatch.from_pydict({"context": np.unique((key[keep[of]] >> 6) & (WIDTH ** (NEAR - 1) - 1))})

    contexts = [r["context"] for r in dealt.mapInArrow(needed, "context long").distinct().collect()]
    near_p = docs.sparkSession.sparkContext.broadcast(near_levels(near, np.array(contexts, np.int64), seen, prior)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = whole(batches)
        yield pa.RecordBatch.from_pydict({"key": key, "n": n, "logp": gram_scores(key, n, held.value, near_p.value, seen, prior)})

    return materialise(dealt.mapInArrow(run, "key long, n long, logp double"), "suffix-tree")


def look_up(keys: np.ndarray, sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Value of each key, 0 if it is not there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0)


def _tokens(part: pa.RecordBatch, model: tuple):
    """Of a slice: words per text; (text, count) of each word of the head; (text, key) of all other words; log10 sums of
    the grams looked up and of the byte shares; (text, gram, times) of all other grams."""
    head_key, head_n, gram_key, gram_p, byte = model
    lists, words = words_of(part.column(part.schema.get_field_index("text")))
    coded = words.dictionary_encode()
    index, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    real = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)[index]
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)[real]
    index = index[real]
    key = hashes(values)[0]
    n = look_up(key, head_key, head_n)[index]
    head = n > 0
    codes, at, data, starts = _codes(part)
    text = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(data))))[np.flatnonzero(at) - starts[0]]
    where, gram = pd.factorize(codes[at])
    known = np.minimum(np.searchsorted(gram_key, gram), max(0, len(gram_key) - 1))
    found = gram_key[known] == gram if len(gram_key) else np.zeros(len(gram), bool)
    p = np.where(found, gram_p[known], 0.0) if len(gram_key) else np.zeros(len(gram))
    spelled = np.bincount(text, p[where] + byte[data[at]], len(part))
    rest = np.flatnonzero(~found[where])
    pair, times = np.unique(text[rest] * len(gram) + where[rest], return_counts=True)
    return np.bincount(row, minlength=len(part)), (row[head], n[head]), (row[~head], key[index[~head]]), spelled, (pair // max(1, len(gram)), gram[pair % max(1, len(gram))], times)


def head_grams(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and scores of the commonest grams, at most GRAMS."""
    step = F.floor(F.log2(F.col("n") + 1) * 16)
    sizes = sorted(((r["step"], r["rows"]) for r in grams.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, rows = math.inf, 0
    for k, more in sizes:
        rows += more
        if rows > GRAMS:
            break
        least = k
    if least == math.inf:
        return np.zeros(0, np.int64), np.zeros(0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({x: pa.array([batch.column(x).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for x in ("key", "logp")})

    got = grams.where(step >= least).select("key", "logp").mapInArrow(packed, "key binary, logp binary").collect()  # as bytes: rows would fill the driver
    key, logp = np.frombuffer(b"".join(r["key"] for r in got), np.int64), np.frombuffer(b"".join(r["logp"] for r in got), float)
    order = np.argsort(key)
    return key[order], logp[order]


def score(docs: DataFrame, model: Model, new: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of `docs` (doc_id, text); `new`: those that were not trained on."""
    grams = scored_grams(docs if new is None else new, model)
    held = docs.sparkSession.sparkContext.broadcast((model.head_key, model.head_n, *head_grams(grams), model.byte))
    total = model.total
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_n = int(look_up(np.array([END[0]]), *held.value[:2])[0])
        for batch in batches:
            for part in slices(batch):
                words, (row, n), other, spelled, rest = _tokens(part, held.value)
                size = len(part)
                known = np.bincount(row, minlength=size) + (end_n > 0)
                base = np.bincount(row, np.log10(n + 0.1), size) + math.log10(end_n + 0.1)
                tail = np.bincount(other[0], minlength=size) + np.bincount(rest[0], minlength=size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(words + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(tail, pa.int64()), pa.array(spelled)],
                    ["doc_id", "row", "n_tokens", "head_known", "head_base", "n_tail", "head_score"],
                )

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, (row, key), _, (text, gram, times) = _tokens(part, held.value)
                ids = part.column(2).to_numpy(zero_copy_only=False)
                columns = [np.concatenate(x) for x in ((ids[row], ids[text]), (key, gram), (np.zeros(len(key), np.int64), times.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["row", "key", "times"])

    scored = rows.mapInArrow(own, f"doc_id {kind}, row long, n_tokens long, head_known long, head_base double, n_tail long, head_score double")
    # One join for both: words have 0 times, grams one or more.
    facts = model.words.select("key", F.lit(False).alias("gram"), F.col("n").cast("double").alias("value")).unionByName(grams.select("key", F.lit(True).alias("gram"), F.col("logp").alias("value")))
    met = rows.mapInArrow(tail, "row long, key long, times long").withColumn("gram", F.col("times") > 0).join(facts, ["key", "gram"], "left")
    per_row = met.groupBy("row").agg(
        F.count("*").alias("tail"),
        F.sum(F.when(~F.col("gram") & F.col("value").isNotNull(), 1).otherwise(0)).alias("known"),
        F.sum(F.when(~F.col("gram"), F.log10(F.coalesce("value", F.lit(0.0)) + 0.1)).otherwise(0.0)).alias("base"),
        F.sum(F.when(F.col("gram"), F.col("times") * F.col("value")).otherwise(0.0)).alias("tree"),
    )
    copies = F.col("tail") / F.col("n_tail")  # equal rows share a key, so their sums hold each of them
    mass = math.log10(total + 0.1 * (model.distinct + 1))
    return scored.join(per_row, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("head_known") + F.coalesce(F.round(F.col("known") / copies), F.lit(0)).cast("long")).alias("n_known"),
        (F.col("head_base") + F.coalesce(F.col("base") / copies, F.lit(0.0)) - F.col("n_tokens") * F.lit(mass)).alias("base_score"),
        (F.col("head_score") + F.coalesce(F.col("tree") / copies, F.lit(0.0))).alias("score"),
    )


@query("op5_suffix_tree")
def op5_suffix_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 10) == 0
    model = fit(docs.where(~held_out))
    out = score(docs, model, docs.where(held_out))
    return out.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
