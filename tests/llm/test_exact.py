"""Operators with an exact answer: brute force, round trips, estimation error, targets met."""

import hashlib
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import chat, decontaminate, fingerprints, jaccard, mixing
from sensorloom.llm.base import QUERIES

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text, k, low=True):
    w = (text or "").encode("utf-8", "surrogatepass")
    w = (w.translate(LOW) if low else w).split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_components(rows, k, num, den):
    """doc_id -> (set size, smallest id) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        both = Counter(m for g in s for m in seen[g])
        for m, c in both.items():
            if den * c >= num * (len(s) + len(sets[m][1]) - c):
                a, b = root(i), root(sets[m][0])
                up[max(a, b)] = min(a, b)
        for g in s:
            seen[g].append(n)
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


# --- Jaccard join ------------------------------------------------------------------


def near_copies(seed=1):
    """Chains and groups of near copies on both sides of the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, base = [], []
    for g in range(30):
        base = [word() for _ in range(rng.choice([1, 3, 5, 9, 30, 80, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append(" ".join(base))
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = word()
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_join_is_the_brute_force_join(spark, k, num, den):
    rows = near_copies()
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, k, num, den)


def test_join_splits_large_components(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(120):  # a drifting chain: few link with the first, all are connected
        base[rng.randrange(60)] = word()
        rows.append((i, " ".join(base)))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 10)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 4, 85, 100)


def test_large_components_fetch_their_texts_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 10)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [(i, " ".join(f"w{i // 40}x{j}" for j in range(30))) for i in range(80)]
    nodes = spark.createDataFrame(rows, "id long, text string").mapInArrow(counted, "id long, text string")
    jobs = spark.createDataFrame([(i // 40, i) for i in range(80)], "job long, id long")
    links = {(r["a"], r["b"]) for r in jaccard.verified_links(nodes, jobs, 4, 85, 100).collect()}
    assert {a for a, b in links if b == a // 40 * 40} == {i for i in range(80) if i % 40}
    assert read.value == 2 * len(rows)  # once for their lengths, once for the texts


def test_components_leave_ended_ones_behind(spark, monkeypatch):
    written, write = [], jaccard.materialise

    def counted(df, name):
        out = write(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    path = [(0, i, i + 1) for i in range(300)]
    pairs = [(1, 2 * i + 1, 2 * i) for i in range(2000)]
    ring = [(2, 7 * i % 101, 7 * (i + 1) % 101) for i in range(101)]
    got = jaccard.components(spark.createDataFrame(path + pairs + ring, "level int, a long, b long").coalesce(1), "test").collect()
    want = {(0, i, 0) for i in range(301)} | {(1, i, i // 2 * 2) for i in range(4000)} | {(2, i, 0) for i in range(101)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(written) < 8 * (len(path) + len(pairs) + len(ring))  # links, steps, roots, result; later rounds have a share of them


def test_join_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op10_jaccard_join"](spark, sf).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 4, 85, 100)


def test_join_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = jaccard.join(odd_docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 4, 85, 100)
    left = jaccard.dedupe(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [1, 2, 3, 4, 5, 8, 8, 9, 10, 11]
    assert jaccard.join(odd_docs.where("false")).count() == 0


def test_dedupe_decides_by_row(spark):
    """Repeated ids with other texts, null ids, repeated rows and text ids: one row of each group of texts stays."""
    rows = near_copies(5)
    rng = random.Random(6)
    odd = [(rng.choice([None, i, i // 3]), t) for i, t in rows] + [rows[0], rows[0], (None, rows[1][1]), (None, "")]
    nodes = sorted(set(odd), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    comps = {i: c for i, _, c in plain_components(list(enumerate(t for _, t in nodes)), 5, 80, 100)}
    groups = defaultdict(list)
    for k, node in enumerate(nodes):
        groups[comps[k]].append(node)
    for kind in ("long", "string"):
        cast = lambda i: None if i is None else f"{i:09d}" if kind == "string" else i
        docs = spark.createDataFrame([(cast(i), t, "x") for i, t in odd], f"doc_id {kind}, text string, id string")
        left = Counter((r["doc_id"], r["text"]) for r in jaccard.dedupe(docs).collect())
        assert set(left.values()) == {1} and len(left) == len(groups)
        for members in groups.values():
            kept = [m for m in members if (cast(m[0]), m[1]) in left]
            assert len(kept) == 1 and kept[0][0] == members[0][0]


def test_join_takes_text_ids(spark):
    rows = [(f"{i:05d}", t) for i, t in near_copies(7)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 4, 85, 100)


def test_shared_lists_survive_batch_ends():
    """Signatures cut into batches anywhere give the members of all groups of two or more ids."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(s), int(i)) for s, i in zip(rng.integers(0, 60, 400), rng.integers(0, 30, 400))} | {(7, i) for i in range(90)})
    expected = defaultdict(set)
    for s, i in rows:
        expected[s].add(i)
    expected = {frozenset(v) for v in expected.values() if len(v) > 1}
    rows = [x for x in rows for _ in range(1 + x[1] % 2)]
    for size in (1, 3, 50, len(rows)):
        last, found, heads = None, defaultdict(set), {}
        for a in range(0, len(rows), size):
            sig, ids = (np.array(c, np.int64) for c in zip(*rows[a : a + size]))
            out, last = jaccard.shared(sig, ids, last)
            for g, h, i in zip(out["sharing"], out["head"], out["id"]) if out else ():
                assert i not in found[g] or size < len(rows)
                found[g].add(i)
                heads[g] = h
        assert {frozenset(v) for v in found.values()} == expected and all(min(v) == heads[g] for g, v in found.items())


def test_open_sharings_and_clusters_hold_every_link(spark):
    """Documents with one long passage in common are no cluster, and their true copies are found."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    passage, rows = words(150), []
    for i in range(60):
        own = passage + words(rng.randint(90, 140))
        rows.append((2 * i, " ".join(own)))
        if i % 4 == 0:
            own[-1] = "changed"
            rows.append((2 * i + 1, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 4, 85, 100)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = []
    for _ in range(300):
        s = set(rng.choice(pool, 60, replace=False).tolist())
        sets += [np.array(sorted(s), np.uint64), np.array(sorted(set(list(s)[rng.integers(0, 12) :])), np.uint64)]
    tree = jaccard.CountTree.of_sets(sets, 85, 100)
    left = 0
    for i, s in enumerate(sets):
        found = set(tree.search(tree.points[i], int(tree.size[i])).tolist())
        left += len(found)
        assert {j for j, o in enumerate(sets) if jaccard.linked(s, o, 85, 100)} <= found
    assert left < 0.2 * len(sets) ** 2


# --- decontamination -----------------------------------------------------------------


def test_wand_retrieves_what_full_scoring_does():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    pick = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(80)], k=n))
    items = [(i, pick(rng.randint(4, 25))) for i in range(60)]
    index = decontaminate.build(items, 0.5, 0.5)
    for _ in range(200):
        passage = sorted(set(decontaminate.words_of(pick(30))))
        terms = [index.terms.index(w) for w in passage if w in index.terms]
        full = Counter()
        for t in terms:
            for item, share in zip(*index.postings[t], strict=True):
                full[item] += share
        got = dict(decontaminate.wand(index, terms))
        assert set(got) == {i for i, s in full.items() if s >= 0.5 - 1e-6}
        assert all(abs(got[i] - full[i]) < 1e-9 for i in got)


def plain_matches(index, docs):
    """Every passage against every item, without any bound."""
    out, step = set(), index.window // 2
    for d, text in docs:
        ids = [index.terms.index(w) if w in index.terms else -1 for w in decontaminate.words_of(text or "")]
        for start in range(0, max(1, len(ids)), step):
            passage = ids[start : start + index.window]
            score = Counter()
            for t in {t for t in passage if t >= 0}:
                for item, share in zip(*index.postings[t], strict=True):
                    score[item] += share
            for item, s in score.items():
                if s >= index.threshold - 1e-6 and all(decontaminate.coverage(side, passage) >= index.overlap for side in index.sides[item]):
                    out.add((d, index.ids[item]))
    return out


def test_decontamination_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    index = decontaminate.indexes(spark.read.parquet(f"{sf}/benchmark.parquet"))[0]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, sf).collect()}
    assert got == plain_matches(index, docs) and got
    whole = {(d, i) for d, t in docs for i, s in zip(index.ids, (index.sides), strict=True) if " ".join(index.terms[w] for side in s for w in side) in " ".join(decontaminate.words_of(t))}
    assert whole <= got


def test_decontamination_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "nine more small animals look on"), (2, None), (3, "..."), (4, "Is it a fox? The quick brown fox jumps")], "item_id long, text string")
    found = decontaminate.indexes(items)
    assert len(found) == 1 and found[0].ids == [1, 4]
    left = decontaminate.clean(odd_docs, found)
    assert left.columns == odd_docs.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4, 8, 9, 10, 11}
    assert decontaminate.indexes(items.where("false")) == [] and decontaminate.clean(odd_docs, []).count() == odd_docs.count()
    assert decontaminate.find(odd_docs.where("false"), found[0]).count() == 0


def test_shards_find_the_same(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {(r["doc_id"], r["item_id"]) for x in decontaminate.indexes(items) for r in decontaminate.find(docs, x).collect()}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 15)
    shards = decontaminate.indexes(items)
    assert len(shards) > 1 and {(r["doc_id"], r["item_id"]) for x in shards for r in decontaminate.find(docs, x).collect()} == one


def test_shards_do_not_change_scores(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda: sorted(map(tuple, decontaminate.pairs(docs, decontaminate.indexes(items)).collect()))
    left = lambda: sorted(r["doc_id"] for r in decontaminate.clean(docs, decontaminate.indexes(items)).select("doc_id").collect())
    one, kept = rows(), left()
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 15)
    several = rows()
    assert len(one) == len(several) > 0 and left() == kept
    for a, b in zip(one, several, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


# --- fingerprints --------------------------------------------------------------------


def test_fingerprints_whole_table(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op6_fingerprints"](spark, sf).collect()}
    errors, prints = [], defaultdict(set)
    for k, (d, t) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + follower[:half]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        prints[t].add(got[d]["fingerprint"])
        a, b, c = (shingles(x, 5, False) for x in (t, new, follower))
        errors += [got[d]["near_edited"] - len(a & b) / len(a | b), got[d]["near_next"] - len(a & c) / len(a | c)]
    assert all(len(p) == 1 for p in prints.values())
    assert abs(statistics.mean(errors)) < 0.005 and statistics.pstdev(errors) < 0.03 and max(map(abs, errors)) < 0.15


def test_fingerprints_odd_rows(spark, odd_docs):
    rows = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = fingerprints.with_successor(fingerprints.with_bins(rows, "text", "bins"), ["doc_id", "text", "bins"], 3).collect()
    assert len(out) == odd_docs.count()
    following = {(r["doc_id"], r["text"]): r["next"]["doc_id"] for r in out}
    order = [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 8, 9, 10, 11]
    assert following[11, "12345 !!! ???"] == 1 and following[1, ""] == 2 and sorted(x or 0 for x in following.values())[0] == 1
    assert Counter(r["doc_id"] for r in out) == Counter(order)
    assert all(len(r["bins"]) == (fingerprints.BINS if r["text"].split() else 0) for r in out)
    assert len({tuple(r["bins"]) for r in out if r["doc_id"] in (5, 6)}) == 1
    none = fingerprints.with_successor(fingerprints.with_bins(rows.where("false"), "text", "bins"), ["text", "bins"])
    assert none.count() == 0


# --- mixing -------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, level = set(), 0.0
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            break
        level = (share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if most * sizes[s] <= weight[s] * level}
        if not more:
            break
        capped |= more
    return {s: min(most * sizes[s], weight[s] * level) for s in names}


def test_mix_meets_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    rows = QUERIES["op9_mixing"](spark, sf).collect()
    assert len(rows) == len(source)
    sizes, taken = Counter(), Counter()
    for r in rows:
        s, text = source[r["doc_id"]]
        assert r["size"] == len((text or "").encode().split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[s] += r["size"]
        taken[s] += r["taken"]
    want = plain_targets(sizes)
    for r in rows:
        s = source[r["doc_id"]][0]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert statistics.median(abs(taken[s] - want[s]) / want[s] for s in sizes) < 0.02
    again = spark.createDataFrame(docs.repartition(7).collect(), docs.schema)
    limits = mixing.boundaries(mixing.narrow(again, 9), mixing.targets(mixing.narrow(again, 9), (5, 2, 1), 1.5, 2.0))
    other = mixing.decided(mixing.narrow(again, 9), limits).select("doc_id", "taken").collect()
    assert {tuple(r) for r in other} == {(r["doc_id"], r["taken"]) for r in rows}


def test_sampling_is_even_over_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(docs, weights=(1, 1), share=0.5, most=2.0).collect()
    small = [r for r in out if r["source"] == "a"]
    assert sum(r["taken"] for r in small) == 3000 and abs(sum(r["doc_id"] < 2000 for r in small) - 500) < 60
    assert sum(r["taken"] for r in out) == pytest.approx(6000, abs=3)


def test_equal_rows_are_taken_one_by_one(spark):
    """1,000 equal rows, and 500 without id, next to distinct rows of other sources."""
    rows = [(7, "one two three", "a")] * 1000 + [(None, "four five", "b")] * 500 + [(i, "six seven", "c") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    counts = []
    for again in (docs, docs.repartition(3)):
        out = mixing.mix(again, weights=(3, 2, 1), share=1.2, most=2.0).collect()
        want = plain_targets({"a": 3000, "b": 1000, "c": 600}, (3, 2, 1), 1.2)
        taken = Counter()
        for r in out:
            taken[r["source"]] += r["taken"]
            assert r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"]
        for s, target in want.items():
            assert taken[s] == pytest.approx(target, abs=3), s
        counts.append(Counter((r["doc_id"], r["source"], r["copies"]) for r in out))
    assert counts[0] == counts[1], "reruns agree"
    assert counts[0][7, "a", 1] == 920 and want["a"] == pytest.approx(2760)


def test_mix_odd_rows(spark, odd_docs):
    out = mixing.mix(odd_docs)
    assert out.columns == [c for c in odd_docs.columns if c not in mixing.OUT] + list(mixing.OUT)
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] > 0 for r in out.collect())
    assert mixing.mix(odd_docs.where("false")).count() == 0


# --- chat ------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["<|", "|>", "<~|", "<~~|", "im_end", "<|im_start|>", "<|im_end|>", "\n", "~", "<", "|", "assistant\n", "\\", "$1", "é\U0001f600"]
    made = lambda: "".join(rng.choices(parts, k=rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", made()]), made()) for c in range(60) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.formatted(chat.from_texts(df))).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in own]
        assert r["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant")
        assert [r["formatted"][s["start"] : s["end"]] for s in r["loss"]] == [x[3].replace("<|", "<~|") if "<~" not in x[3] else __import__("re").sub(r"<(~*)\|", r"<~\1|", x[3]) for x in own if x[2] == "assistant"]


def test_chat_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "look at"), part("image", ref="a.png", w=28, h=15), part("text", "and <|image|>"), part("audio", ref="b.wav", s=1.5)]),
        (1, 1, "assistant", [part("text", "I see")]),
        (1, 2, "user", [part("document", "two words", "c.pdf", p=2), part(None, "plain"), part("image")]),
        (2, 0, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    one, two = sorted(chat.formatted(df).collect(), key=lambda r: r["conv_id"])
    assert one["formatted"] == (
        "<|im_start|>user\nlook at<|image|>and <~|image|><|audio|><|im_end|>\n<|im_start|>assistant\nI see<|im_end|>\n"
        "<|im_start|>user\n<|document|>plain<|image|><|im_end|>\n"
    )
    assert [(a["place"], a["turn"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, 0, "image", "a.png", 4), (1, 0, "audio", "b.wav", 38), (2, 2, "document", "c.pdf", 514), (3, 2, "image", None, 0)]
    assert one["tokens"] == 2 + 4 + 2 + 38 + 2 + 514 + 1 and two["formatted"] == "<|im_start|>\n<|im_end|>\n" and two["tokens"] == 0
    assert chat.formatted(df.where("false")).count() == 0


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, None, "user", "b"), (5, 1, None, None), (5, 1, "assistant", "z"), (5, 1, "assistant", "z")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.from_texts(df))).collect()}
    assert [t["text"] for t in out[None]["turns"]] == ["b", "a"]
    assert [(t["role"], t["text"]) for t in out[5]["turns"]] == [("", ""), ("assistant", "z"), ("assistant", "z")] and out[5]["loss_text"] == "zz"
