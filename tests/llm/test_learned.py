"""Learned operators: awkward inputs, brute force where there is one, held-out accuracy elsewhere."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sensorloom.llm import language, pii, secrets, suffix_tree, toxicity
from sensorloom.llm.base import QUERIES


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- language ---------------------------------------------------------------------


def test_language_held_out(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, odd_docs):
    out = language.identify(odd_docs, language.fit(odd_docs))
    assert out.count() == odd_docs.count() and set(odd_docs.columns) - {"score"} <= set(out.columns)
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or (r["rejected"] and r["score"] == 0))
    none = odd_docs.where("false")
    assert language.fit(none) is None and language.identify(none, None).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs, None).collect()} == {"und"}


def test_language_rejects_what_is_far():
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(40)]
    idf = np.ones(language.DIMS, np.float32)
    v = language.vectors(language.counts(made)[0], idf)
    model = language.Model(["xx"], idf, language.clusters(v, 2, 4), np.zeros(2, int), np.full((1, len(language.LENGTHS) + 1), 0.3))
    told, score, rejected = language.classify([made[0], "是的没有人知道这里发生了什么事情" * 5], model)
    assert not rejected[0] and rejected[1] and score[0] > score[1]


def test_language_limits_reject_what_was_not_learned(spark):
    rnd = np.random.default_rng(3)
    stems = {"aa": "lor mi suta ren dol kesa vi tamu por nal".split(), "bb": "schun gref olt wem ziek hart brun eich fal tur".split()}

    def text(lang):
        return " ".join(rnd.choice(stems[lang]) + rnd.choice(stems[lang]) for _ in range(40))

    docs = spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 400)], "doc_id long, text string, lang string")
    model = language.fit(docs, sample=100)
    assert model.least.min() > 0.3  # all documents set the limits, not the sample's lowest
    clean = [text(lang) for lang in ["aa", "bb"] * 100]
    assert language.classify(clean, model)[2].mean() <= 0.02
    italian = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita"
    code = "for (auto it = m.begin(); it != m.end(); ++it) { if (it->second > 0) v.push_back(it->second * 2); } return v;"
    letters = " ".join("".join(rnd.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(40))
    assert language.classify([italian, code, letters], model)[2].all()


def test_language_limit_is_the_quantile():
    h = np.zeros((1, 2, language.BINS))
    h[0, :, 200], h[0, :, 600:610] = 3, 200  # 3 of 2003 lie at 0.2, more than one in a thousand
    assert (language.limits(h, 0.001) == 0.2).all() and (language.limits(h, 0.01) == 0.6).all()


# --- toxicity ----------------------------------------------------------------------


def test_toxicity_learns_words_it_is_shown():
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioubdgkl") for _ in range(6)) for _ in range(300)]
    make = lambda bad: " ".join([*rng.choices(words, k=60), *(["zworstq"] * 3 if bad else [])])
    y = np.array([i % 4 == 0 for i in range(240)], int)
    model = toxicity.train([make(b) for b in y], y, 0.25, 4, 4.0, 1.0, 60)
    fresh = np.array([i % 2 for i in range(60)])
    s = toxicity.score([make(b) for b in fresh], model)
    assert ((s >= 0.5) == fresh).mean() >= 0.95


def test_toxicity_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 0, 1), (6, 1, 0), (7, 0, None), (8, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(odd_docs, toxicity.fit(odd_docs, labels)).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    same = {r["score"] for r in out if r["doc_id"] == 5}
    assert len(same) == 1
    assert toxicity.fit(odd_docs, labels.where("false")) is None
    assert {r["score"] for r in toxicity.classify(odd_docs, None).collect()} == {0.0}
    assert toxicity.classify(odd_docs.where("false"), None).count() == 0


# --- personal data and secrets ---------------------------------------------------------

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_pii(text):
    keep = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(pii.digits(s)) <= 19 and pii.luhn(pii.digits(s)),
        "phone": lambda s: 9 <= len(pii.digits(s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in p.finditer(text) if keep[k](m[0])]


def plain_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_patterns_agree_with_plain_regular_expressions(spark, sf):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.z", "@@", "1.2.3.4", ".", "999.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "-", " ", "4", "+49 170 123", "+", "(", ")", "token", "=", ": ", '"', "API_KEY", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef", "0123456789abcdef", "é", "secret\n"]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(4000)]
    for t in [*made, *texts(spark, sf).values(), ""]:
        assert pii.base_spans(t) == plain_pii(t)
        assert [s[:3] for s in secrets.base_spans(t)] == plain_secrets(t)


def test_long_runs_stay_linear():
    assert pii.base_spans("1" * 100_000 + ".1" * 3 + "a" * 200_000 + "@") == [] and secrets.base_spans("g" + "0" * 100_000)[0][0] == "hex"


def test_network_finds_other_spellings():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k=6: "".join(rng.choices(letters, k=rng.randint(2, k)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def card():
        n = "4" + digits(14)
        return next(n + str(d) for d in range(10) if pii.luhn(n + str(d)))

    make = {
        "email": lambda: f"{word(9)}.{word()}{digits(2)}@{word(9)}.{rng.choice(['com', 'org', 'net'])}",
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": lambda: " ".join(re.findall("....", card())),
        "phone": lambda: f"+{rng.randint(10, 99)} {digits(3)} {digits(7)}",
    }
    rows = []
    for k in range(400):
        kind = rng.choice([*make, None])
        before, after = " ".join(word() for _ in range(5)), " ".join(word() for _ in range(5))
        middle = make[kind]() if kind else rng.choice([digits(4), f"{digits(2)}:{digits(2)}", f"{digits(3)} {word()} {digits(2)}"])
        text = f"{before} {middle} {after}"
        rows += pii.examples(text[: pii.WINDOW], pii.base_spans(text[: pii.WINDOW]), 0, k)
    net = pii.fit(np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows]), 24, batch=32)
    hits = 0
    for k in range(60):
        kind = rng.choice(list(make))
        odd = pii.variants(kind, make[kind](), k)
        text = " ".join(word() for _ in range(30)) + f" {odd} " + " ".join(word() for _ in range(30))
        _, added = pii.tag([text], net)[0]
        at = text.index(odd)
        hits += any(a < at + len(odd) and at < b for _, a, b in added) or bool(pii.base_spans(text))
    assert hits >= 54
    clean = [" ".join(word() for _ in range(80)) for _ in range(50)]
    assert not any(base or added for base, added in pii.tag(clean, net))


def test_reconciliation_takes_the_best_set():
    text = "x" * 10 + "1234567890123 " * 3
    tags = np.zeros(pii.WINDOW, int)
    tags[10], tags[11:23] = 5, 6
    weak = tags.copy()
    weak[5], weak[6:20] = 5, 6
    margin = np.ones(pii.WINDOW)
    assert pii.reconcile(text, [(0, tags, margin * 2), (0, weak, margin)], []) == [("card", 10, 23)]
    assert pii.reconcile(text, [(0, tags, margin)], [("phone", 12, 14)]) == []
    assert pii.masked("ab 1 cd", [("ip", 3, 4), ("card", 3, 4)]) == "ab <ip> cd"


def test_pii_odd_rows(spark, odd_docs):
    out = {(r["doc_id"], r["spans"]) for r in pii.find(odd_docs, None).collect()}
    assert (8, "email:5:20,phone:24:39") in out and (1, "") in out and (None, "") in out
    new = pii.redact(odd_docs, pii.train(odd_docs, epochs=1))
    assert new.columns == odd_docs.columns and new.count() == odd_docs.count()
    by_id = {(r["doc_id"], r["text"]) for r in new.collect()}
    assert (8, "mail <email> or <phone>") in by_id and (1, None) in by_id
    assert pii.train(odd_docs.where("false")) is None and pii.find(odd_docs.where("false"), None).count() == 0


def test_field_finds_secrets_without_known_key_words():
    rng = random.Random(5)
    value = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    rows = []
    for k in range(300):
        text = f"set token = {value(rng.randint(20, 40))}9z then go on" if k % 2 else f"see chapter_{k} of http://example.org/page_{k} and go on"
        for hit, _, at, tags in secrets.labelled(text):
            words = [text[a:b] if text[a:b] != "token" else "name7" for a, b in at]
            rows.append(([secrets.numbers(secrets.token_features(words, i, secrets.file_features(text))) for i in range(len(words))], np.array([secrets.eligible(w) for w in words]), tags))
    field = secrets.fit(rows, 4, 1e-4)
    found = sum(len(secrets.tag(f"the name7 = {value(30)}8q then go on", field)[1]) == 1 for _ in range(40))
    wrong = sum(len(secrets.tag(f"see chapter_{k} of http://example.org/page_{k} and go on", field)[1]) for k in range(400, 440))
    assert found >= 36 and wrong == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(6)
    field = secrets.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)) + secrets.FORBIDDEN)
    for n in (1, 2, 5):
        e = rng.normal(size=(n, 3))
        paths = [[]]
        for _ in range(n):
            paths = [[*p, t] for p in paths for t in range(3)]
        value = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(field.t[a, b] for a, b in zip(p, p[1:])) - 1e9 * (p[0] == secrets.I)  # noqa: B023, E731
        assert field.viterbi(e) == max(paths, key=value)


def test_secrets_odd_rows(spark, odd_docs):
    assert secrets.find(odd_docs, secrets.train(odd_docs)).count() == odd_docs.count()
    assert secrets.train(odd_docs.where("false")) is None and secrets.find(odd_docs.where("false"), None).count() == 0


# --- suffix tree -----------------------------------------------------------------------


def test_base_scores_by_hand(spark, sf):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = {i: [*(t or "").encode().translate(low).split(), b""] for i, t in texts(spark, sf).items()}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, distinct = sum(count.values()), len(count)
    for r in QUERIES["op5_suffix_tree"](spark, sf).collect():
        ws = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws))
        assert r["score"] < 0


def test_tree_is_a_distribution_over_kept_contexts():
    rng = random.Random(7)
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(rng.choices(["zabcq", "yabcr", "gamma"], k=50)) for _ in range(60)] + [None, ""]})
    rows, sizes = [], np.zeros(256)
    for out in suffix_tree._counted(iter([batch])):
        kind, key, n = out.column(0)[0].as_py(), out.column(1).to_numpy(), out.column(3).to_numpy()
        if kind == "b":
            sizes = n
        if kind == "g":
            for d in range(suffix_tree.DEPTH + 1):
                codes, where = np.unique(key & ((1 << 6 * (d + 1)) - 1), return_inverse=True)
                rows += [(d, int(c), int(x)) for c, x in zip(codes, np.bincount(where, n))]
    tree = suffix_tree.build(rows, sizes, 1e-4)
    p = 10.0 ** tree.logp.reshape(-1, suffix_tree.WIDTH).astype(float)
    assert np.allclose(p.sum(1), 1, atol=1e-4) and tree.depth.max() >= 3
    for c in range(suffix_tree.WIDTH):
        members = suffix_tree.CLASS == c
        assert not members.any() or np.isclose((10.0 ** tree.byte[members]).sum(), 1)
    # Longest kept suffix, position by position.
    data, starts = suffix_tree.stream(suffix_tree.words_of(batch.column(0))[0])
    symbols = suffix_tree.CLASS[data].astype(np.int64)
    state = suffix_tree.states(tree, symbols)
    for i in range(starts[0], starts[0] + 200):
        node = 0
        for d in range(1, suffix_tree.DEPTH + 1):
            to = tree.child[node * suffix_tree.WIDTH + symbols[i - d]]
            if not to:
                break
            node = to
        assert state[i] == node
    words, end = suffix_tree.token_scores(tree, suffix_tree.words_of(batch.column(0))[0])
    assert len(words) == 60 * 50 and len(end) == 62 and words.mean() > -1.0


def test_score_is_the_tree_s_and_feels_word_order(spark):
    cycle = "alder birch cedar dogwood elm fir ginkgo hazel".split()
    train = [" ".join(cycle[(i + k) % 8] for k in range(80)) for i in range(40)]
    text = train[0]
    mixed = " ".join(random.Random(4).sample(text.split(), 80))
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_tree.score(frame([text, mixed, "birch"]), suffix_tree.fit(frame(train))).collect()}
    assert got[0]["n_known"] == got[1]["n_known"] == 81 and got[0]["base_score"] == pytest.approx(got[1]["base_score"])
    assert got[1]["score"] < got[0]["score"] - 50
    # Brute force for one short text: the tree in memory, walked byte by byte.
    rows, sizes = Counter(), np.zeros(256)
    for t in train:
        b = np.frombuffer(f"{t} \0".encode(), np.uint8)
        sizes += np.bincount(b, minlength=256)
        c = [0] * suffix_tree.DEPTH + suffix_tree.CLASS[b].tolist()
        for i in range(suffix_tree.DEPTH, len(c)):
            for d in range(suffix_tree.DEPTH + 1):
                code = 0
                for x in c[i - d : i + 1]:
                    code = code << 6 | x
                rows[d, code] += 1
    tree = suffix_tree.build([(d, c, n) for (d, c), n in rows.items()], sizes, 19.5 / sum(n for (d, _), n in rows.items() if d == 0))
    b = np.frombuffer(b"birch \0", np.uint8)
    c, want = [0] * suffix_tree.DEPTH + suffix_tree.CLASS[b].tolist(), 0.0
    for i in range(suffix_tree.DEPTH, len(c)):
        node = 0
        for d in range(1, suffix_tree.DEPTH + 1):
            if not (to := tree.child[node * 64 + c[i - d]]):
                break
            node = to
        want += tree.logp[node * 64 + c[i]] + tree.byte[b[i - suffix_tree.DEPTH]]
    assert got[2]["score"] == pytest.approx(want, abs=1e-4)


def test_tree_grows_with_the_text_and_the_join_scores_alike(spark, monkeypatch):
    rows = ["aaa bbb ccc " * 250_000] + ["quixotic"] * 30  # the word is a hundred thousandth of the text
    train = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs = spark.createDataFrame([(0, "quixotic"), (1, "quiet aaa"), (2, "aaa ccc"), (2, "aaa ccc"), (3, None)], "doc_id long, text string")
    model = suffix_tree.fit(train)
    got = sorted(map(tuple, suffix_tree.score(docs, model).collect()))
    assert got[0][-1] > -3
    monkeypatch.setattr(suffix_tree, "GRAMS", 0)
    monkeypatch.setattr(suffix_tree, "SLICE_BYTES", 1)
    joined = sorted(map(tuple, suffix_tree.score(docs, model).collect()))
    assert len(joined) == 5 and all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:]) for a, b in zip(got, joined, strict=True))


def test_suffix_tree_odd_rows(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text")
    out = suffix_tree.score(rows, suffix_tree.fit(rows)).collect()
    assert len(out) == rows.count()
    five = [r for r in out if r["doc_id"] == 5]
    assert len(five) == 2 and five[0] == five[1] and five[0]["n_known"] == five[0]["n_tokens"] == 22
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    alone = suffix_tree.score(rows, suffix_tree.fit(rows.where("false"))).collect()
    assert len(alone) == rows.count() and all(r["n_known"] == 0 for r in alone)
