"""op1: whole-span recall of the network on planted spans, and the registered query beside plain regular expressions."""

import hashlib
import random
import re

import pytest

from sensorloom.llm import pii
from sensorloom.llm.base import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KEEP = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 13 <= len(pii.digits(s)) <= 19 and pii.luhn(pii.digits(s)),
    "phone": lambda s: 9 <= len(pii.digits(s)) <= 15,
}


def spans_of(joined):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in joined.split(",") if s)]


@pytest.fixture(scope="module")
def planted(spark, sf):
    """A table to train on (the next larger one: a hundred documents have a dozen windows) and clean given texts with one span each in a spelling the patterns do not know: all kinds, names of 5 to 120 characters."""
    r = random.Random(99)
    number = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda a, b: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(a, b)))

    def span(kind, i):
        if kind == "email":
            size, name = (5, 10, 20, 40, 80, 120)[i % 6], ""
            while len(name) < size:
                name += ("." if name else "") + word(3, 14)
            return f"{name[:size].strip('.')}@{word(4, 12)}.{r.choice(['com', 'org', 'example.net'])}"
        if kind == "ip":
            return ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            n = "4" + number(14)
            return n + next(d for d in "0123456789" if pii.luhn(n + d))
        return f"+{r.randint(10, 99)}{number(9)}"

    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    clean = [x.text for x in docs.orderBy("doc_id").collect() if x.text and 100 < len(x.text) < 3000 and not pii.TRIGGER.search(x.text)]
    rows, want = [], {}
    for i in range(480):
        kind = pii.KINDS[i % 4]
        odd, text = pii.variants(kind, span(kind, i // 12), i // 4 % 3), r.choice(clean)
        at = r.choice([m.start() for m in re.finditer(" ", text)])
        rows.append((i, f"{text[:at]} {odd}{text[at:]}"))
        want[i] = (kind, at + 1, at + 1 + len(odd))
    rows += [(1000 + i, t) for i, t in enumerate(clean[:300])]
    return docs, spark.createDataFrame(rows, "doc_id bigint, text string"), want


def test_whole_span_recall_on_planted_spans(planted):
    docs, table, want = planted
    got = {r["doc_id"]: spans_of(r["spans"]) for r in pii.find(table, pii.train(docs)).collect()}
    for kind in pii.KINDS:
        mine = [i for i, s in want.items() if s[0] == kind]
        assert sum(want[i] in got[i] for i in mine) >= 0.9 * len(mine), kind
    assert not any(spans for i, spans in got.items() if i >= 1000)


def test_query_beside_plain_patterns(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        base = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if KEEP[k](m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(base) <= set(spans_of(r["spans"])) and len(spans_of(r["spans"])) == len(base) + r["n_added"]


def test_spans_grow_to_the_ends_of_their_runs():
    text = "mail " + "n" * 150 + " (at) " + "h" * 120 + ".org now 12 3456789012345x"
    assert pii.whole("email", text, 100, 180) == (5, text.index(" now"))
    assert pii.whole("card", text, text.index("567"), text.index("890")) == (text.index("345"), text.index("x"))
    assert pii.whole("phone", "00", 0, 2) == (0, 2)


def test_a_span_wider_than_a_window_comes_out_whole():
    name = "n" * 200
    text = f"x {name}[at]host.org y"
    at = text.index("[at]")
    start = at - pii.MARGIN
    tags = [0] * pii.WINDOW
    tags[: pii.MARGIN + len("[at]host.org")] = [2] * (pii.MARGIN + len("[at]host.org"))
    assert pii.reconcile(text, [(start, tags, pii.np.ones(pii.WINDOW))], []) == [("email", 2, text.index(" y"))]
