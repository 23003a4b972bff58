"""N-gram Jaccard self-join: count-vector R-trees over word shingles.

A document's set is its distinct `words`-word shingles (fewer words: the whole sequence; none: empty and
linked with nothing) as 64-bit hashes. Two documents link when den * |A and B| >= num * |A or B|.

The tree: hashes are dealt into groups (about as many as a set has hashes, within LEAST_GROUPS and MOST_GROUPS), a document is
the point of its group counts, tree nodes keep the largest count of each group and the range of set sizes below them. The overlap of two sets is at most the
sum of the smaller counts, so a node or point whose bound cannot reach the threshold is left out; the pairs
that survive are verified on the sets.

Random documents are about equally far from each other in so many groups, so one tree over all of them would be
read nearly whole by every query. The search is therefore routed first, without loss: for each size class the
hashes are dealt into more groups than a linking pair can have differing hashes, so it agrees in the whole
content of at least one. A document sends the contents (signatures) of its fullest groups, as many as that argument
needs (all, empty ones too, where it needs them); a pair's class is the larger document's. The documents
that share a signature form a sharing, and every linking pair is inside one. Trees are then built and searched in two kinds of
candidate sets:

* clusters: documents that agree with the first document of their sharings in at least STRONG of the groups
  the argument needs. Near copies agree in most, so their many sharings become one set; a passage that
  unrelated documents have in common gives few agreements and chains nothing;
* open sharings: those whose members are not all in one cluster. A tree over the points alone (a few bytes instead of a
  text) keeps the members whose bound reaches a member of another cluster; what has the same members left counts once.

So a linking pair is either inside a cluster or inside an open sharing, and both are searched and verified; components are
made of verified links alone. A set beyond BLOCK_ROWS documents or BLOCK_CHARS characters is split: all members meet
its first document, and only those that do not link to it meet all the blocks of the others, block by block; pairs
inside the linked rest are connected already.

Defined cases: null or empty text -> n 0, its own component. Join: a null doc_id is counted but linked with nothing;
rows with one doc_id are one node, linked by any of them; ties and copies are in the component of the smallest
doc_id; other columns are ignored. Dedupe decides by row: of the rows of a component the one with the smallest doc_id stays
(null last, then by hash of id and text), and one of rows equal in both; rows with null ids or one id for several texts are
compared like all others; rows with empty texts stay, once per id; all columns are kept. Ids may be of any type. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table
from sensorloom.llm.suffix_tree import slices
from sensorloom.session import discard, materialise

LEAST_GROUPS, MOST_GROUPS, FANOUT, CLASS_BITS = 64, 2048, 16, 8
BLOCK_ROWS, BLOCK_CHARS = 4000, 24_000_000
#: Share of the needed groups in which two documents of a cluster agree at least.
STRONG = 0.05
#: Sharings up to so many members are known by their list, so that equal ones count once.
LISTED = 64
#: Added to the size class of signatures of whole sets.
WHOLE = 128
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted in each, and where each text starts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = lists.flatten().dictionary_encode()
    full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    index = coded.indices.to_numpy(zero_copy_only=False)
    real = full[index]
    h = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[index[real]]
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)[real]
    n = len(column)
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(len(h)) - first[row]
    size = np.minimum(count, words)  # words of a shingle of this text
    starts = place <= (count - size)[row]
    out = np.zeros(len(h), np.uint64)
    for k in range(words):
        at = np.minimum(np.arange(len(h)) + k, max(0, len(h) - 1))
        out = np.where(k < size[row], out * MIX + mixed(h[at] + np.uint64(k + 1)), out)
    out, row = mixed(out + size[row].astype(np.uint64))[starts], row[starts]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[keep], row[keep]
    return out, np.searchsorted(row, np.arange(n + 1))


# --- routing ----------------------------------------------------------------------


def size_classes(largest: int, num: int, den: int) -> list[int]:
    """Lower ends of size classes; a partner is at most one class above."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * den // num)))
    lows.append(max(lows[-1] + 1, -(-lows[-1] * den // num)))
    return [*lows, max(lows[-1] + 1, -(-lows[-1] * den // num))]


def differing_groups(low: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most groups in which a linking pair can differ; `low`: lower end of the class above its own."""
    return 2 * (low - 1) * (den - num) // (den + num)


def in_class(key: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Signatures whose top CLASS_BITS bits are the size class."""
    low = np.uint64(64 - CLASS_BITS)
    return ((key >> np.uint64(CLASS_BITS)) | (level.astype(np.uint64) << low)).view(np.int64)


def class_of(sig: np.ndarray) -> np.ndarray:
    return (sig.view(np.uint64) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def signatures(sets: np.ndarray, starts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature): contents of the groups, in the class of the text and in the one above."""
    size = np.diff(starts)
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lows = np.array(size_classes(int(size.max()), num, den))
    own = np.searchsorted(lows, size, side="right") - 1
    row = np.repeat(np.arange(len(size)), size)
    rows, out = [], []
    for up in (0, 1):
        level = own + up
        differing = differing_groups(lows[np.minimum(level + 1, len(lows) - 1)], num, den)
        groups = differing + 1 + differing // 8 + (differing > 0)
        groups = np.where(size > 0, groups, 0)
        first = np.concatenate(([0], np.cumsum(groups)))
        at = first[row] + ((sets >> np.uint64(20)) % groups[row].astype(np.uint64)).astype(np.int64)
        content = np.zeros(first[-1], np.uint64)
        np.add.at(content, at, mixed(sets))
        held = np.bincount(at, minlength=first[-1])
        text = np.repeat(np.arange(len(size)), groups)
        # The fullest groups, as many as are needed for one to agree; all groups, empty ones too, if that takes them.
        least = np.zeros(len(size), np.int64)
        for c in range(1, 16):
            least[np.bincount(text[held >= c], minlength=len(size)) > differing] = c
        keep = held >= least[text]
        number = np.arange(first[-1]) - first[text]
        key = mixed(content + mixed((number * 64 + level[text] * 2_000_003).astype(np.uint64)))
        rows.append(text[keep])
        out.append(in_class(key[keep], level[text][keep]))
    return np.concatenate(rows), np.concatenate(out)


def set_hashes(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per whole set (0: empty)."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mixed(sets))))
    return total[starts[1:]] - total[starts[:-1]]


def shared(sig: np.ndarray, ids: np.ndarray, last: tuple | None) -> tuple[dict[str, np.ndarray] | None, tuple]:
    """Members (sharing, level, head, id, n) of signatures with two ids or more, from rows sorted by both.

    `last`: signature, head, last id and whether the head is out already, of the rows before; n: signatures with this list.
    """
    if last is not None:
        ids, sig = np.concatenate(([last[2]], ids)), np.concatenate(([last[0]], sig))
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
    sig, ids = sig[new], ids[new]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.concatenate((first, [len(sig)])))
    head, out, group = ids[first], np.zeros(len(first), bool), np.repeat(np.arange(len(first)), size)
    if last is not None:
        head[0], out[0] = last[1], last[3]
    keep = (size[group] > 1) & ~(out[group] & (np.arange(len(sig)) == first[group]))
    # A group within the batch (not its first or last one) is known by the list of its ids.
    whole = (size > 1) & (size <= LISTED)
    whole[[0, -1]] = False
    level = class_of(sig)
    name = sig[first].copy()
    content = np.zeros(len(first), np.uint64)
    np.add.at(content, group, mixed(ids.astype(np.uint64) + np.uint64(1)))
    name[whole] = mixed(content + mixed(level[first].astype(np.uint64)))[whole].view(np.int64)
    rank = np.full(len(first), -1)
    _, at, n = np.unique(name[whole], return_index=True, return_counts=True)
    count = np.ones(len(first), np.int64)
    where = np.flatnonzero(whole)
    rank[where[at]] = 0
    count[where[at]] = n
    keep &= ~whole[group] | (rank[group] == 0)
    rows = group[keep]
    state = (sig[-1], head[-1], ids[-1], bool(size[-1] > 1 or out[-1]))
    if not len(rows):
        return None, state
    return {"sharing": name[rows], "level": level[keep].astype(np.int32), "head": head[rows], "id": ids[keep], "n": count[rows]}, state


def sharings(nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(sharing, level, head, id, n): the documents (id, text) that agree in a group of a size class; head is the smallest id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, starts = shingle_sets(part.column(1), words)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                # Of equal sets of a batch one sends its groups; all send the hash of the whole.
                key, full = set_hashes(sets, starts), np.diff(starts) > 0
                order = np.lexsort((ids, key))
                again = np.zeros(len(ids), bool)
                again[order[1:]] = key[order[1:]] == key[order[:-1]]
                copied = np.isin(key, key[again & full]) & full
                text, sig = signatures(sets, starts, num, den)
                own = ~again[text]
                size = np.diff(starts)[copied]
                lows = np.array(size_classes(int(size.max(initial=1)), num, den))
                level = np.searchsorted(lows, size, side="right") - 1 + WHOLE
                yield pa.RecordBatch.from_pydict({"sig": np.concatenate([sig[own], in_class(mixed(key[copied]), level)]), "id": np.concatenate([ids[text[own]], ids[copied]])})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:  # sorted by signature and id
            if len(batch):
                rows, last = shared(batch.column(0).to_numpy(), batch.column(1).to_numpy(), last)
                if rows:
                    yield pa.RecordBatch.from_pydict(rows)

    rows = nodes.mapInArrow(emit, "sig long, id long")
    return rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(meet, "sharing long, level int, head long, id long, n long")


def points(nodes: DataFrame, words: int) -> DataFrame:
    """(id, size, point): the group counts of each set, one byte a group, half as many groups as hashes or more."""

    def packed(s: np.ndarray) -> bytes:
        groups = 8
        while 2 * groups <= len(s) or counts_of(s, groups).max(initial=0) > 255:
            groups *= 2
        return counts_of(s, groups).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, starts = shingle_sets(part.column(1), words)
                made = [packed(sets[a:b]) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(made, pa.binary())], ["id", "size", "point"])

    return nodes.mapInArrow(run, "id long, size long, point binary")


def reaching(loose: DataFrame, point: DataFrame, num: int, den: int) -> DataFrame:
    """(job, id) of the members of sharings (sharing, id, comp) whose bound (from the points) reaches the threshold with one of another cluster.

    A sharing beyond BLOCK_ROWS members is searched in tiles of two blocks. Sharings of which the same members are left become one job.
    """

    def left(rows: list[tuple]) -> tuple[list[int], list[int]]:
        ids, comp, size = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        groups = min(len(r[3]) for r in rows)
        tree = CountTree([folded(np.frombuffer(r[3], np.uint8), groups) for r in rows], size, num, den)
        kept = np.zeros(len(rows), bool)
        for p in range(len(rows)):
            if not kept[p]:
                near = tree.search(tree.points[p], int(size[p]))
                near = near[comp[near] != comp[p]]
                kept[near] = True
                kept[p] = len(near) > 0
        found = np.unique(ids[kept])
        job = mixed(np.array([mixed(found.astype(np.uint64) + np.uint64(3)).sum()], np.uint64)).view(np.int64)[0] if len(found) else 0
        return [int(job)] * len(found), found.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        out: tuple[list[int], list[int]] = ([], [])
        pack = lambda: pa.RecordBatch.from_pydict({"job": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64())})

        def close():
            if len({r[1] for r in rows}) > 1:
                for o, x in zip(out, left(rows), strict=True):
                    o.extend(x)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for *now, i, comp, size, point in zip(*columns, strict=True):
                if now != key:
                    close()
                    key, rows = now, []
                rows.append((i, comp, size, point))
            if len(out[0]) > 10_000:
                yield pack()
                out = ([], [])
        close()
        yield pack()

    sizes = loose.groupBy("sharing").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_ROWS)
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    pointed = loose.join(point.hint("merge"), "id")
    tiled = pointed.join(sizes.hint("merge"), "sharing", "left").withColumns({"blocks": F.coalesce(blocks, F.lit(1)), "y": F.pmod(F.xxhash64("id"), F.coalesce(blocks, F.lit(1))).cast("int")})
    tiled = tiled.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiled.select("sharing", F.least("y", "z").alias("x"), F.greatest("y", "z").alias("z"), "id", "comp", "size", "point")
    return tiles.repartition("sharing", "x", "z").sortWithinPartitions("sharing", "x", "z", "id").mapInArrow(run, "job long, id long").distinct()


def candidate_sets(nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(job, id): clusters and what is left of open sharings; together they hold every linking pair."""
    met = materialise(sharings(nodes, words, num, den), "jaccard-sharings")
    level = F.col("level") % WHOLE
    lows = size_classes(1 << 40, num, den)[:WHOLE]
    least = F.element_at(F.array(*[F.lit(int(np.ceil(STRONG * (differing_groups(np.array(low), num, den) + 1)))) for low in [*lows[1:], lows[-1]]]), (level + 1).cast("int"))
    stars = met.where("id <> head").groupBy("level", "id", "head").agg(F.sum("n").alias("n"))
    strong = stars.where((F.col("level") >= WHOLE) | (F.col("n") >= least)).select(level.alias("level"), F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    clusters = components(strong, "jaccard-near")
    placed = met.select("sharing", level.alias("level"), "id").join(clusters.hint("merge"), ["level", "id"], "left").select("sharing", "id", F.coalesce("comp", "id").alias("comp"))
    placed = materialise(placed, "jaccard-placed")
    discard(met)
    open_ = placed.groupBy("sharing").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("sharing")
    loose = materialise(placed.join(open_.hint("merge"), "sharing").distinct(), "jaccard-loose")
    discard(placed)
    dense = clusters.select(F.xxhash64(F.lit("cluster"), "comp").alias("job"), "id").distinct()  # the same cluster may stand in two classes
    jobs = materialise(dense.union(reaching(loose, points(nodes, words), num, den)), "jaccard-jobs")
    discard(clusters, loose)
    return jobs


def components(links: DataFrame, name: str) -> DataFrame:
    """(level, id, comp): smallest id of the component of each linked id of a level, by contraction.

    In a round each id goes over to the first of itself and its neighbours (by id, later in a random order that changes
    with the round); links between those that are left go on, ended components do not. So the rows fall from round to round.
    """
    edges = materialise(links.select("level", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links-0")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(steps)
        rank = lambda c: F.xxhash64(c, F.lit(k)) if k else F.col(c)  # noqa: B023, E731
        ends = edges.select("level", F.col("a").alias("id"), "b").union(edges.select("level", F.col("b").alias("id"), F.col("a").alias("b")))
        near = ends.groupBy("level", "id").agg(F.min(rank("b")).alias("least"), F.min_by("b", rank("b")).alias("b"))
        step = materialise(near.select("level", "id", F.when(F.col("least") < rank("id"), F.col("b")).otherwise(F.col("id")).alias("up")), f"{name}-{k}")
        over = lambda end: step.select("level", F.col("id").alias(end), F.col("up").alias(f"up_{end}"))  # noqa: B023, E731
        moved = edges.join(over("a"), ["level", "a"]).join(over("b"), ["level", "b"]).where("up_a <> up_b")
        left = materialise(moved.select("level", F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), f"{name}-links-{k + 1}")
        discard(edges)
        edges = left
        steps.append(step)
    if not steps:
        empty = edges.select("level", F.col("a").alias("id"), F.col("b").alias("comp"))
        empty.written_to = edges.written_to
        return empty
    roots = steps[-1].select("level", "id", F.col("up").alias("root"))
    for step in steps[-2::-1]:
        above = roots.withColumnRenamed("id", "up")
        roots = step.join(above, ["level", "up"], "left").select("level", "id", F.coalesce("root", "up").alias("root"))
    roots = materialise(roots, f"{name}-roots")
    discard(edges, *steps)
    least = roots.groupBy("level", "root").agg(F.min("id").alias("comp"))
    labels = materialise(roots.join(least, ["level", "root"]).select("level", "id", "comp"), f"{name}-comps")
    discard(roots)
    return labels


# --- tree -------------------------------------------------------------------------


def counts_of(s: np.ndarray, groups: int) -> np.ndarray:
    """Point of a set: hashes in each group."""
    return np.bincount((s >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same set's point in fewer groups."""
    return point.reshape(-1, groups).sum(0, dtype=np.int64)


class CountTree:
    """R-tree over group counts, packed bottom-up along set size and total counts of halves of the groups."""

    def __init__(self, points: list[np.ndarray], size: np.ndarray, num: int, den: int):
        self.num, self.den, self.size = num, den, size
        kind = np.uint8 if max(c.max() for c in points) < 256 else np.int32
        self.points = np.stack([c.astype(kind) for c in points])
        self.order = np.lexsort((self.points[:, : self.points.shape[1] // 2].sum(1), self.size))
        self.levels = []  # from the leaves up: largest counts, least size of each node
        high, low = self.points[self.order], self.size[self.order]
        while len(low) > FANOUT:
            cut = np.arange(0, len(low), FANOUT)
            high, low = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(low, cut)
            self.levels.append((high, low))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], num: int, den: int) -> CountTree:
        size = np.array([len(s) for s in sets], np.int64)
        groups = LEAST_GROUPS
        while groups < min(MOST_GROUPS, np.median(size)):
            groups *= 2
        return cls([counts_of(s, groups) for s in sets], size, num, den)

    def reaches(self, point: np.ndarray, size: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        bound = np.minimum(high, point).sum(1, dtype=np.int64)
        return self.den * bound >= self.num * (size + np.maximum(low, bound) - bound)

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose bound reaches the threshold."""
        if not self.levels:
            return self.order[self.reaches(point, size, self.points[self.order], self.size[self.order])]
        high, low = self.levels[-1]
        at = np.flatnonzero(self.reaches(point, size, high, low))
        for high, low in [*self.levels[-2::-1], (None, None)]:
            count = len(self.order) if high is None else len(low)
            below = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = below[below < count]
            if high is None:
                found = self.order[below]
                return found[self.reaches(point, size, self.points[found], self.size[found])]
            at = below[self.reaches(point, size, high[below], low[below])]
        return at


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or den * len(a) < num * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def connect(ids: np.ndarray, sets: list[np.ndarray], probes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Label of each member after linking every probe with all members: the smallest number it reaches."""
    label = np.arange(len(ids))

    def merge(a: int, b: int) -> None:
        low, gone = sorted((label[a], label[b]))
        label[label == gone] = low

    first_of: dict = {}
    own = np.arange(len(ids))  # the first member with this set, which stands for it in the tree
    for k, (i, s) in enumerate(zip(ids.tolist(), sets, strict=True)):
        own[k] = first_of.setdefault(s.tobytes(), k)
        for at in (first_of.setdefault(i, k), own[k] if len(s) else k):
            if label[at] != label[k]:
                merge(at, k)
    single = np.unique(own)
    tree, place = CountTree.of_sets([sets[k] for k in single], num, den), np.searchsorted(single, own)
    for p in np.unique(place[probes]):
        me = single[p]
        near = single[tree.search(tree.points[p], int(tree.size[p]))]
        near = near[label[near] != label[me]]
        while len(near):
            if linked(sets[me], sets[near[0]], num, den):
                merge(me, near[0])
                near = near[1:][label[near[1:]] != label[me]]
            else:
                near = near[1:]
    return label


# --- verification -----------------------------------------------------------------


def _groups(words: int, num: int, den: int):
    """Links inside each (comp, x, y): members (id, text, probe) stream in, sorted by group."""

    def flush(rows: list[tuple]) -> tuple[list[int], list[int]]:
        ids = np.array([r[0] for r in rows])
        label = connect(ids, [r[1] for r in rows], np.flatnonzero([r[2] for r in rows]), num, den)
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        return ids.tolist(), low[label].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        out: tuple[list[int], list[int]] = ([], [])

        def close():
            if len(rows) > 1:
                for o, x in zip(out, flush(rows), strict=True):
                    o.extend(x)

        for batch in batches:
            for part in slices(batch):
                sets, starts = shingle_sets(part.column(4), words)
                comp, x, y, ids = (part.column(k).to_pylist() for k in range(4))
                probe = part.column(5).to_pylist()
                for k, now in enumerate(zip(comp, x, y, strict=True)):
                    if now != key:
                        close()
                        key, rows = now, []
                    rows.append((ids[k], sets[starts[k] : starts[k + 1]].copy(), probe[k]))
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
                out = ([], [])
        close()
        yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _pivot(words: int, num: int, den: int):
    """Does each member (comp, head, id, text, first) link to the first text of its component?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                a, at = shingle_sets(part.column(3), words)
                b, bt = shingle_sets(part.column(4), words)
                yes = [linked(a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]], num, den) for k in range(len(part))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(yes, pa.bool_())], ["comp", "head", "id", "yes"])

    return run


def verified_links(nodes: DataFrame, jobs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect each true component, from the candidate sets (job, id).

    Texts travel instead of sets (they are smaller) and are fetched once; the join to the documents is a merge join at every size.
    """
    own = nodes.select("id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = own.select("id", F.length("text").alias("chars")).join(jobs.hint("merge"), "id")
    facts = lengths.groupBy("job").agg(F.count("*").alias("m"), F.sum("chars").alias("chars"), F.min("id").alias("head"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("chars") / BLOCK_CHARS)).cast("int")
    placed = jobs.join(facts, "job").select(F.col("job").alias("comp"), "head", "id", blocks.alias("blocks"))
    placed = materialise(placed, "jaccard-sets")
    members = own.join(placed.hint("merge"), "id").select("comp", "head", "id", "text", "blocks")
    columns = ("comp", "x", "y", "id", "text", "probe")
    met, used, split = None, [placed], not placed.where("blocks > 1").isEmpty()
    if split:  # the members are read several times
        members = materialise(members, "jaccard-members")
        used.append(members)
    small = members.where("blocks <= 1").select("comp", F.lit(0).alias("x"), F.lit(0).alias("y"), "id", "text", F.lit(True).alias("probe"))
    if split:
        large = materialise(members.where("blocks > 1"), "jaccard-large")
        first = large.where("id = head").groupBy("comp").agg(F.min("text").alias("first"))
        met = large.join(first, "comp").select("comp", "head", "id", "text", "first").mapInArrow(_pivot(words, num, den), "comp long, head long, id long, yes boolean")
        met = materialise(met.groupBy("comp", "head", "id").agg(F.max("yes").alias("yes")), "jaccard-pivots")
        used += [large, met]
        open_ = met.where("not yes").select("comp", "id")
        sizes = open_.groupBy("comp").agg(F.count("*").alias("m_open"))
        parted = large.join(sizes, "comp").withColumns({"opens": F.ceil(F.col("m_open") / BLOCK_ROWS).cast("int"), "y": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")})
        every = parted.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("opens") - 1))).withColumn("probe", F.lit(False))
        probes = parted.drop("y").join(open_, ["comp", "id"]).withColumn("x", F.pmod(F.xxhash64("id", F.lit(1)), F.col("opens")).cast("int"))
        probes = probes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
        small = small.unionByName(every.select(*columns)).unionByName(probes.select(*columns))
    found = small.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y", "id").mapInArrow(_groups(words, num, den), "a long, b long").where("a <> b")
    found = materialise(found if met is None else found.union(met.where("yes and id <> head").select("id", "head")), "jaccard-found")
    discard(*used)
    return found


def linked_components(nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(id, comp) of every node (id long, text) that links with another id; comp is the smallest id of its component."""
    jobs = candidate_sets(nodes, words, num, den)
    found = verified_links(nodes, jobs, words, num, den)
    discard(jobs)
    linked_ids = components(found.select(F.lit(0).alias("level"), "a", "b").distinct(), "jaccard")
    discard(found)
    return linked_ids.drop("level")


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(shingle_sets(part.column(1), words)[1]), pa.int64())], ["doc_id", "n_shingles"])

    whole = kind in INTEGRAL
    node = F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id")
    comps = linked_components(docs.where("doc_id is not null").select(node.alias("id"), "text"), words, num, den)
    if not whole:  # the smallest doc_id of a component instead of the smallest node
        named = docs.where("doc_id is not null").select(node.alias("id"), "doc_id").distinct().join(comps, "id")
        comps = comps.join(named.groupBy("comp").agg(F.min("doc_id").alias("name")), "comp").select("id", F.col("name").alias("comp"))
    counted = docs.select("doc_id", "text").mapInArrow(sizes, f"doc_id {kind}, n_shingles long").withColumn("id", F.when(F.col("doc_id").isNotNull(), node))
    out = counted.join(comps, "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", F.col("doc_id").cast("long") if whole else F.col("doc_id")).alias("component_id"))


def dedupe(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of near duplicates, with all columns of `docs`."""
    plain = docs.schema["doc_id"].dataType.simpleString() in INTEGRAL
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if plain and repeated.isEmpty():
        comps = linked_components(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), words, num, den)
        gone = comps.where("id <> comp").select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    node = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # own names apart from the input's
    packed = docs.select(node.alias("id"), "doc_id", "text", row.alias("row"))
    comps = linked_components(packed.select("id", "text"), words, num, den)
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "id")
    narrow = packed.select("id", "doc_id").distinct().join(comps, "id")
    stays = narrow.groupBy("comp").agg(F.min(place)["id"].alias("first"))
    gone = comps.join(stays, "comp").where("id <> first").select("id")
    return packed.join(gone, "id", "left_anti").dropDuplicates(["id"]).select("row.*")


@query("op10_jaccard_join")
def op10_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
