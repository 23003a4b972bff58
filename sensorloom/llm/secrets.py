"""Secrets: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of `[A-Za-z0-9+/_=.-]`, or single other visible characters. A token can be part of a secret
only if it has SHORTEST characters and a digit, underscore, plus, slash or equals sign; all other tokens are
O by that rule, so a chain needs decoding only near such tokens, with CONTEXT neighbours on both sides, and
the rest of the text is decided without it. Features: shape, length, character mix, entropy and prefix of
the token, the neighbouring words and whether one of them is a key word, and of the file its share of
digits, of punctuation and its length. Tags are begin, inside and outside; decoding is Viterbi.

Training: exact gradients of the chain likelihood (forward-backward) with AdaGrad, on about `chains` (a
parameter) smallest by hash over all documents, labelled by the patterns; in every other one the key word
before the secret is changed, so that shape and neighbours have to carry the decision.

Defined cases: null or empty text -> no spans; spans of one kind never overlap, kinds may; the field's
spans are added where they touch no pattern's span; without training chains only the patterns speak;
repeated rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, ranked_sample, table, texts_of

KINDS = ("assign", "access", "hex")
ADDED = "crf"
Span = tuple[str, int, int]

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of at least 16 are the maximal runs that pass the length test


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), by start and then kind as listed."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# --- chains -----------------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]+|[^\sA-Za-z0-9+/_=.-]")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
MARK = re.compile(r"[0-9_+/=]")
SHORTEST, CONTEXT, REACH = 12, 3, 60
BITS = 14
KEY_WORDS = frozenset("password passwd pwd secret token key apikey api_key auth bearer credential credentials private access signature".split())


def eligible(token: str) -> bool:
    return len(token) >= SHORTEST and MARK.search(token) is not None


def shape(token: str) -> str:
    """Runs of upper case, lower case, digits and others, each as one sign."""
    signs = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token[:64]]
    return "".join(c for i, c in enumerate(signs) if not i or c != signs[i - 1])


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    punctuation = sum(text.count(c) for c in "{}[]()=;:\"'")
    return [f"fp{min(9, int(200 * punctuation / n))}", f"fl{min(6, int(math.log10(n) * 1.5))}", f"fn{min(9, text.count(chr(10)) * 50 // n)}"]


def token_features(tokens: list[str], i: int, file: list[str]) -> list[str]:
    t = tokens[i]
    kind = shape(t)
    out = ["1", f"s{kind[:8]}", f"n{min(8, len(t) // 6)}", f"p{t[:4]}" if len(t) >= SHORTEST else f"w{t.lower()}"]
    if len(t) >= SHORTEST:
        digit = sum(c.isdigit() for c in t) / len(t)
        out += [f"e{int(entropy(t) * 2)}", f"d{int(digit * 5)}", f"u{int(5 * sum(c.isupper() for c in t) / len(t))}", f"c{min(6, len(kind) // 3)}", f"dots{min(3, t.count('.'))}", f"x{set(t) <= set('0123456789abcdefABCDEF')}"]
        out += [f"{f}&{eligible(t)}" for f in file]
    out.append(f"ok{eligible(t)}")
    near = [tokens[j].lower() for j in range(max(0, i - CONTEXT), i)]
    out += [f"l{near[-1][:12]}" if near else "l^", f"r{tokens[i + 1].lower()[:12]}" if i + 1 < len(tokens) else "r$", f"k{any(w.strip('_.-=') in KEY_WORDS or w.endswith(('key', 'token', 'secret')) for w in near)}&{eligible(t)}"]
    return out


def numbers(features: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(f.encode("utf-8", "replace")) & ((1 << BITS) - 1) for f in features], np.int64)


@dataclass
class Field:
    w: np.ndarray  # feature x tag
    t: np.ndarray  # tag x next tag

    def emissions(self, tokens: list[str], file: list[str]) -> np.ndarray:
        e = np.stack([self.w[numbers(token_features(tokens, i, file))].sum(0) for i in range(len(tokens))])
        e[[not eligible(t) for t in tokens], :2] = -1e9
        return e

    def viterbi(self, e: np.ndarray) -> list[int]:
        best, back = e[0] + np.array([0.0, -1e9, 0.0]), []
        for k in range(1, len(e)):
            step = best[:, None] + self.t
            back.append(step.argmax(0))
            best = step.max(0) + e[k]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


B, I, O = 0, 1, 2
FORBIDDEN = np.array([[0, 0, 0], [0, 0, 0], [0, -1e9, 0]])  # inside cannot follow outside


def fit(chains: list[tuple[list[np.ndarray], np.ndarray, list[int]]], epochs: int, penalty: float, seed: int = 2) -> Field:
    """chains: features of each token, whether it is eligible, tags."""
    w, t = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for c in order.permutation(len(chains)):
            feats, ok, tags = chains[c]
            n = len(tags)
            e = np.stack([w[f].sum(0) for f in feats])
            e[~ok, :2] = -1e9
            move = t + FORBIDDEN
            a, b = np.empty((n, 3)), np.zeros((n, 3))
            a[0] = e[0] + np.array([0.0, -1e9, 0.0])
            for k in range(1, n):
                a[k] = np.logaddexp.reduce(a[k - 1][:, None] + move, 0) + e[k]
            for k in range(n - 2, -1, -1):
                b[k] = np.logaddexp.reduce(move + (e[k + 1] + b[k + 1])[None], 1)
            z = np.logaddexp.reduce(a[-1])
            p = np.exp(a + b - z)
            p[np.arange(n), tags] -= 1
            dt = penalty * t
            for k in range(1, n):
                dt = dt + np.exp(a[k - 1][:, None] + move + (e[k] + b[k])[None] - z)
                dt[tags[k - 1], tags[k]] -= 1
            gt += dt * dt
            t -= 0.2 * dt / np.sqrt(gt)
            for f, g in zip(feats, p, strict=True):
                g = g + penalty * w[f]
                gw[f] += g * g
                w[f] -= 0.2 * g / np.sqrt(gw[f])
    return Field(w, t + FORBIDDEN)


def pieces(text: str) -> list[tuple[int, int]]:
    """Stretches of the text around eligible tokens, merged where they meet."""
    out: list[list[int]] = []
    done = 0
    for m in MARK.finditer(text):
        if m.start() < done:
            continue
        a = m.start()
        while a > done and RUN.match(text[a - 1]):
            a -= 1
        done = RUN.match(text, m.start()).end()
        if done - a < SHORTEST:
            continue
        first, last = max(0, a - REACH), min(len(text), done + REACH)
        while first > 0 and not text[first - 1].isspace() and a - first < 4 * REACH:
            first -= 1
        while last < len(text) and not text[last].isspace() and last - done < 4 * REACH:
            last += 1
        if out and first <= out[-1][1]:
            out[-1][1] = last
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def tokens_of(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]


def tag(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and the field's further spans."""
    base = [s[:3] for s in base_spans(text)]
    if field is None:
        return base, []
    added, file = [], None
    for a, b in pieces(text):
        at = tokens_of(text, a, b)
        words = [text[x:y] for x, y in at]
        file = file or file_features(text)
        tags = field.viterbi(field.emissions(words, file))
        k = 0
        while k < len(tags):
            first = k
            k += 1
            if tags[first] == O:
                continue
            while k < len(tags) and tags[k] == I:
                k += 1
            x, y = at[first][0], at[k - 1][1]
            if not any(s[1] < y and x < s[2] for s in base):
                added.append((ADDED, x, y))
    return base, added


def labelled(text: str) -> Iterator[tuple[bool, int, list[tuple[int, int]], list[int]]]:
    """Chains around eligible tokens with tags from the patterns."""
    spans = base_spans(text)
    for a, b in pieces(text):
        at = tokens_of(text, a, b)
        tags = []
        for x, y in at:
            inside = next((s for s in spans if s[3] < y and x < s[2]), None)
            tags.append(O if inside is None or not eligible(text[x:y]) else B if x <= inside[3] or not tags or tags[-1] == O else I)
        yield any(t != O for t in tags), a, at, tags


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("hit", pa.bool_()), ("rank", pa.float64()), ("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("file", pa.list_(pa.string()))])
    for batch in batches:
        rows: dict[str, list] = {n: [] for n in schema.names}
        for i, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            if not MARK.search(text):
                continue
            for hit, a, at, tags in labelled(text):
                h = int.from_bytes(hashlib.blake2b(f"{i}:{a}".encode(), digest_size=6).digest(), "big") / 2.0**48
                k = next((j for j, t in enumerate(tags) if t != O), len(tags) // 2)  # long chains: the part around the secret
                part = slice(max(0, k - 12), k + 13)
                rows["hit"].append(hit)
                rows["rank"].append(h if hit else 2 * h)
                rows["words"].append([text[x:y] for x, y in at[part]])
                rows["tags"].append(tags[part])
                rows["file"].append(file_features(text))
        yield pa.RecordBatch.from_pydict(rows, schema)


def train(docs: DataFrame, chains: int = 2000, epochs: int = 4, penalty: float = 1e-4) -> Field | None:
    """Fit on about `chains` labelled chains that rank first by hash (chains without a secret count half)."""
    rows = docs.select("doc_id", "text").mapInArrow(_labelled, "hit boolean, rank double, words array<string>, tags array<int>, file array<string>")
    made = []
    for k, r in enumerate(ranked_sample(rows, chains)):
        words = list(r["words"])
        if k % 2:  # unknown key words
            words = [f"name{zlib.crc32(w.encode()) % 97}" if w.lower() in KEY_WORDS else w for w in words]
        feats = [numbers(token_features(words, i, r["file"])) for i in range(len(words))]
        made.append((feats, np.array([eligible(w) for w in words]), list(r["tags"])))
    if not any(t != O for m in made for t in m[2]):
        return None
    return fit(made, epochs, penalty)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, counts of pattern spans per kind, base (joined pattern spans) and spans (all, by start and kind)."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"]
    rank = {k: i for i, k in enumerate((*KINDS, ADDED))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tag(t, held.value) for t in texts_of(batch)]
            count = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            whole = [joined(sorted(base + more, key=lambda s: (s[1], rank[s[0]]))) for base, more in found]
            columns = [pa.array([joined(base) for base, _ in found], pa.string()), pa.array(whole, pa.string()), pa.array([len(m) for _, m in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *count, *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base string, spans string, n_added long")


@query("op2_secrets")
def op2_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
