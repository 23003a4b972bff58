"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds spans.

The network reads windows of WINDOW characters, half overlapping, around every character that can belong
to a span of the four kinds (a digit, an at sign or a written-out one); elsewhere every tag but O is
excluded. Windows are decoded by Viterbi. A span whose edge stands inside an unbroken run (of digits, or of
the characters of a name or host) grows to the run's end, so that names and hosts longer than a window come out
whole; other spans that a window edge cuts are left to the neighbour window. What is found is reconciled over the
whole text by weighted interval scheduling (largest total margin over O, no overlaps). Spans of the patterns
always stay; the network's spans are added where they touch none of them and have the digits their kind needs,
card numbers with their check digit.

Training is numpy back-propagation through the CRF likelihood on labelled windows: about `windows` (a
parameter) smallest by hash over all documents, labelled by the patterns, and copies of them in which a new span is
planted. Kinds and spellings take turns there: the pattern's, and others that the patterns do not know (double
separators, 00 for +, written-out at signs); every fifth copy gets a decoy instead (dates, short numbers, "at" between words).

Defined cases: null or empty text -> no spans; kinds may overlap each other, spans of one kind never do;
repeated rows give equal results; without any labelled window only the patterns speak; other columns are
kept (redact) or ignored (find).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, ranked_sample, table, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits starts a match or none of its later digits does: the look-behind keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each at sign outward: the same matches as the pattern read left to right, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_PART.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and then start."""
    if not TRIGGER.search(text):
        return []
    spans = list(emails(text))
    spans += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-400:]) <= 255 and not p[:-400].strip("0") for p in m[0].split("."))]
    spans += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(n := digits(m[0])) <= 19 and luhn(n)]
    spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return spans


# --- network ------------------------------------------------------------------

WINDOW, MARGIN, HIDDEN = 96, 24, 16
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
SYMBOLS = 98  # padding, 95 printable ASCII characters, other letters, other characters


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((c >= 32) & (c < 127), c - 31, np.where(c > 191, 96, 97))
    return np.pad(out, (0, WINDOW - len(out)))


def labels(spans: list[Span], start: int, size: int) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for kind, a, b in reversed(spans):
        a, b, k = a - start, b - start, KINDS.index(kind)
        if 0 <= a and b <= size:
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
    return tags


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logsum(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis))


@dataclass
class Tagger:
    """x: symbol to gates, u: state to gates (both by direction), o: states to tags, t: tag to next tag, s: first tag."""

    x: np.ndarray
    u: np.ndarray
    o: np.ndarray
    t: np.ndarray
    s: np.ndarray

    @classmethod
    def new(cls, seed: int) -> Tagger:
        r, h = np.random.default_rng(seed), HIDDEN
        x = r.normal(0, 0.3, (2, SYMBOLS, 4 * h))
        x[:, :, h : 2 * h] += 1.0  # forget gates start open
        draw = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        return cls(x.astype(np.float32), draw(0.2, 2, h, 4 * h), draw(0.2, 2 * h + 1, TAGS), draw(0.1, TAGS, TAGS), draw(0.1, TAGS))

    def states(self, ids: np.ndarray, keep: bool = False):
        """Outputs (windows, WINDOW, 2 * HIDDEN + 1), and the trace that training needs."""
        n, h = len(ids), HIDDEN
        both = np.stack([ids, ids[:, ::-1]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, trace = np.ones((n, WINDOW, 2 * h + 1), np.float32), []
        for k in range(WINDOW):
            at = both[:, :, k]
            z = np.stack([self.x[0, at[0]], self.x[1, at[1]]]) + state @ self.u
            gate, new = _sigmoid(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
            before = (state, cell)
            cell = gate[..., h : 2 * h] * cell + gate[..., :h] * new
            flat = np.tanh(cell)
            state = gate[..., 2 * h :] * flat
            out[:, k, :h], out[:, WINDOW - 1 - k, h : 2 * h] = state[0], state[1]
            if keep:
                trace.append((at, gate, new, flat, *before))
        return out, trace

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        n, h, rows = len(ids), HIDDEN, np.arange(len(ids))
        out, trace = self.states(ids, keep=True)
        e = out @ self.o
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = self.s + e[:, 0]
        for k in range(1, WINDOW):
            alpha[:, k] = _logsum(alpha[:, k - 1, :, None] + self.t, 1) + e[:, k]
        for k in range(WINDOW - 2, -1, -1):
            beta[:, k] = _logsum(self.t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        de, dt = np.exp(alpha + beta - z[:, None, None]), np.zeros_like(self.t)
        ds = de[:, 0].sum(0)
        for k in range(1, WINDOW):
            dt += np.exp(alpha[:, k - 1, :, None] + self.t + (e[:, k] + beta[:, k] - z[:, None])[:, None, :]).sum(0)
        gold = e[rows[:, None], np.arange(WINDOW), tags].sum(1) + self.s[tags[:, 0]] + self.t[tags[:, :-1], tags[:, 1:]].sum(1)
        de[rows[:, None], np.arange(WINDOW), tags] -= 1
        np.add.at(ds, tags[:, 0], -1)
        np.add.at(dt, (tags[:, :-1], tags[:, 1:]), -1)
        dout = (de @ self.o.T)[..., : 2 * h]
        do = out.reshape(-1, 2 * h + 1).T @ de.reshape(-1, TAGS)
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dstate, dcell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for k in range(WINDOW - 1, -1, -1):
            at, gate, new, flat, state, cell = trace[k]
            i, f, o = gate[..., :h], gate[..., h : 2 * h], gate[..., 2 * h :]
            dstate = dstate + np.stack([dout[:, k, :h], dout[:, WINDOW - 1 - k, h:]])
            dcell = dcell + dstate * o * (1 - flat * flat)
            dz = np.concatenate([dcell * new * i * (1 - i), dcell * cell * f * (1 - f), dstate * flat * o * (1 - o), dcell * i * (1 - new * new)], -1)
            du += state.transpose(0, 2, 1) @ dz
            for d in (0, 1):
                np.add.at(dx[d], at[d], dz[d])
            dstate, dcell = dz @ self.u.transpose(0, 2, 1), dcell * f
        return float((z - gold).mean()), [g / n for g in (dx, du, do, dt, ds)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of each window, and the margin of each character's tag over O."""
        e = self.states(ids)[0] @ self.o
        best, back = self.s + e[:, 0], []
        for k in range(1, WINDOW):
            step = best[:, :, None] + self.t
            back.append(step.argmax(1))
            best = step.max(1) + e[:, k]
        tags = np.empty(ids.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        for k in range(WINDOW - 2, -1, -1):
            tags[:, k] = back[k][np.arange(len(ids)), tags[:, k + 1]]
        return tags, np.take_along_axis(e, tags[..., None], 2)[..., 0] - e[..., 0]


def fit(ids: np.ndarray, tags: np.ndarray, epochs: int, seed: int = 1, batch: int = 64, rate: float = 0.01) -> Tagger:
    """Adam on the CRF likelihood."""
    net, r, step = Tagger.new(seed), np.random.default_rng(seed), 0
    parts = [net.x, net.u, net.o, net.t, net.s]
    m1, m2 = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for epoch in range(epochs):
        order = r.permutation(len(ids))
        for a in range(0, len(order), batch):
            step += 1
            _, grads = net.gradients(ids[order[a : a + batch]], tags[order[a : a + batch]])
            slope = rate * (1 - epoch / epochs) + 0.001
            for p, g, a1, a2 in zip(parts, grads, m1, m2, strict=True):
                g = np.clip(g, -1, 1)
                a1 += 0.1 * (g - a1)
                a2 += 0.01 * (g * g - a2)
                p -= slope * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-7)
    return net


# --- windows, variants, reconciliation ------------------------------------------


def window_starts(text: str) -> list[int]:
    """Starts of half-overlapping windows over the surroundings of every trigger."""
    starts, end = [], 0
    first = None
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if first is None or a > end:
            if first is not None:
                starts += range(first, max(first + 1, end - WINDOW // 2), WINDOW // 2)
            first = a
        end = b
    if first is not None:
        starts += range(first, max(first + 1, end - WINDOW // 2), WINDOW // 2)
    return starts


def variants(kind: str, s: str, k: int) -> str:
    """Another spelling of a span."""
    if kind == "email":
        name, _, host = s.partition("@")
        return (f"{name}[at]{host}", f"{name} (at) {host}", f"{name} @ {host}")[k % 3]
    if kind == "ip":
        return s.replace(".", (" . ", "-", "[.]")[k % 3])
    if kind == "card":
        n = digits(s)
        return (".", "  ", "/")[k % 3].join(n[i : i + 4] for i in range(0, len(n), 4))
    n = digits(s)
    return ("00" + n, f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}")[k % 3]


def examples(text: str, spans: list[Span], start: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A labelled window, and one with its first whole span spelled otherwise."""
    piece = text[start : start + WINDOW]
    inside = [s for s in spans if start <= s[1] and s[2] <= start + len(piece)]
    out = [(symbols(piece), labels(inside, start, len(piece)))]
    if len(inside) == 1:
        kind, a, b = inside[0]
        new = variants(kind, text[a:b], k)
        piece = (text[start:a] + new + text[b : start + WINDOW])[:WINDOW]
        if a - start + len(new) <= WINDOW:
            out.append((symbols(piece), labels([(kind, a, a + len(new))], start, len(piece))))
    return out


def made_span(kind: str, words: list[str], r: random.Random) -> str:
    """A new span of a kind in its pattern's spelling: names and hosts from words of the text and random letters, random numbers."""
    number = lambda n: "".join(r.choices("0123456789", k=n))
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    word = lambda: r.choice(words) if words and r.random() < 0.5 else letters(r.randint(2, 12))
    if kind == "email":
        name = r.choice(("", ".", "_", "-", "+")).join(word() for _ in range(r.randint(1, 3))) + r.choice(("", "", number(2), f".{number(2)}"))
        host = ".".join(word() + r.choice(("", "", number(1))) for _ in range(r.randint(1, 2)))
        return f"{name}@{host}.{r.choice(('com', 'org', 'net', 'de', 'io', 'co.uk', letters(r.randint(2, 4))))}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        n = r.choice("3456") + number(r.choice((13, 14, 14, 14, 15, 17)))
        return n + next(d for d in "0123456789" if luhn(n + d))
    return f"+{r.randint(1, 99)} {number(3)} {number(r.randint(6, 8))}"


def decoy(words: list[str], r: random.Random) -> str:
    """What looks like a span and is none."""
    number = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: r.choice(words) if words else "so"
    return r.choice((
        lambda: f"{word()} (at) {word()}", lambda: f"{word()} @ {word()}", lambda: f"{word()} [at] {word()}", lambda: number(r.randint(1, 7)),
        lambda: f"{number(2)}.{number(2)}.{number(4)}", lambda: f"{number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}", lambda: f"{number(1)}.{number(1)}.{number(2)}",
        lambda: f"{number(3)},{number(3)}.{number(2)}", lambda: f"{number(4)}/{number(4)}", lambda: f"{number(2)}-{number(3)}",
    ))()


def planted(piece: str, spans: list[Span], k: int, r: random.Random) -> tuple[np.ndarray, np.ndarray] | None:
    """The window with a new span, or every fifth time a decoy, in place of its only span or of a word.

    Kinds and spellings (the pattern's and all variants) take turns, so that each comes equally often.
    """
    words = [w for w in re.findall(r"[A-Za-z]+", piece) if len(w) < 16]
    gaps = [m.span() for m in re.finditer(r"(?<=\s)\w+(?=\s)", piece)]
    if len(spans) > 1 or not (spans or gaps):
        return None
    a, b = spans[0][1:] if spans else r.choice(gaps)
    kind, turn = KINDS[k % len(KINDS)], k // len(KINDS) % 5
    new = decoy(words, r) if turn == 4 else made_span(kind, words, r)
    if turn < 3:
        new = variants(kind, new, turn)
    first = max(0, min(a, a + len(new) + r.randint(8, 40) - WINDOW))  # what follows the span stays in the window
    text = (piece[first:a] + new + piece[b:])[:WINDOW]
    a -= first
    if turn != 4 and a + len(new) > WINDOW:
        return None
    return symbols(text), labels([(kind, a, a + len(new))] if turn != 4 else [], 0, len(text))


def plausible(kind: str, s: str) -> bool:
    n = len(digits(s))
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9].*(?:@|[\[(] ?at ?[\])]).*[A-Za-z0-9]\W{0,3}\w", s))
    if kind == "ip":
        return re.sub(r"[^0-9]+", " ", s).strip().count(" ") == 3 and 4 <= n <= 12
    return 13 <= n <= 19 if kind == "card" else 9 <= n <= 15


RUN = {"email": (LOCAL_PART, re.compile(r"[A-Za-z0-9.-]")), "ip": (re.compile("[0-9]"),) * 2, "card": (re.compile("[0-9]"),) * 2, "phone": (re.compile("[0-9+]"),) * 2}


def whole(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span grown to the ends of the unbroken runs its edges stand in, however long."""
    left, right = RUN[kind]
    while a > 0 and left.match(text[a]) and left.match(text[a - 1]):
        a -= 1
    while b < len(text) and right.match(text[b - 1]) and right.match(text[b]):
        b += 1
    while b > a and text[b - 1] in ".-":
        b -= 1
    return a, b


def valid(kind: str, s: str) -> bool:
    """Plausible, and a card number passes its check digit."""
    return plausible(kind, s) and (kind != "card" or luhn(digits(s)))


def reconcile(text: str, decoded: list[tuple[int, np.ndarray, np.ndarray]], base: list[Span], holds: Callable[[str, str], bool] = plausible) -> list[Span]:
    """Spans of all windows of a text that stand: whole, of a form that `holds`, clear of the patterns', best in total."""
    found: dict[Span, float] = {}
    for start, tags, margin in decoded:
        size, k = min(WINDOW, len(text) - start), 0
        while k < size:
            tag, first = tags[k], k
            k += 1
            if not tag:
                continue
            kind = (tag - 1) // 2
            while k < size and tags[k] == 2 + 2 * kind:
                k += 1
            a, b = start + first, start + k
            cut = (first == 0 and start > 0) or (k == WINDOW and start + WINDOW < len(text))
            if cut and KINDS[kind] != "email":
                continue
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1] in " \t\r\n,;:.|":
                b -= 1
            a, b = whole(KINDS[kind], text, a, b)
            span = (KINDS[kind], a, b)
            if holds(KINDS[kind], text[a:b]) and not any(s[1] < b and a < s[2] for s in base):
                found[span] = max(found.get(span, 0.0), float(margin[first:k].sum()))
    spans = sorted(((s, w) for s, w in found.items() if w > 0), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # value, span taken, place to go back to
    ends = [s[2] for s, _ in spans]
    for i, (s, w) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], s[1], side="right"))
        take = best[j][0] + w
        best.append((take, i, j) if take > best[-1][0] else (best[-1][0], -1, i))
    out, at = [], len(best) - 1
    while at > 0:
        _, took, back = best[at]
        if took >= 0:
            out.append(spans[took][0])
        at = back
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def tag(texts: list[str], net: Tagger | None, step: int = 2048) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if net is None:
        return list(zip(base, added, strict=True))
    jobs = [(i, a) for i, t in enumerate(texts) for a in window_starts(t)]
    decoded: dict[int, list] = {}
    for k in range(0, len(jobs), step):
        part = jobs[k : k + step]
        tags, margin = net.decode(np.stack([symbols(texts[i][a : a + WINDOW]) for i, a in part]))
        for j, (i, a) in enumerate(part):
            if tags[j].any():
                decoded.setdefault(i, []).append((a, tags[j], margin[j]))
    for i, d in decoded.items():
        added[i] = reconcile(texts[i], d, base[i], valid)
    return list(zip(base, added, strict=True))


# --- Spark ------------------------------------------------------------------------


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"hit": [], "rank": [], "piece": [], "spans": []}
        ids = batch.column(0).to_pylist()
        for i, text in zip(ids, texts_of(batch), strict=True):
            starts = window_starts(text)
            if not starts:
                continue
            spans = base_spans(text)
            for a in starts:
                h = int.from_bytes(hashlib.blake2b(f"{i}:{a}".encode(), digest_size=6).digest(), "big") / 2.0**48
                inside = [s for s in spans if a <= s[1] and s[2] <= a + WINDOW]
                rows["hit"].append(bool(inside))
                rows["rank"].append(h if inside else 2 * h)
                rows["piece"].append(text[a : a + WINDOW])
                rows["spans"].append([f"{k}:{b - a}:{c - a}" for k, b, c in inside])
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("hit", pa.bool_()), ("rank", pa.float64()), ("piece", pa.string()), ("spans", pa.list_(pa.string()))]))


def train(docs: DataFrame, windows: int = 1000, epochs: int = 14, made: int = 2000, seed: int = 5) -> Tagger | None:
    """Fit on about `windows` labelled windows that rank first by hash (windows without a span count half),
    and about `made` copies of them with a new span planted, as many of each."""
    rows = docs.select("doc_id", "text").mapInArrow(_labelled, "hit boolean, rank double, piece string, spans array<string>")
    return fitted([(r["piece"], [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r["spans"]]) for r in ranked_sample(rows, windows)], epochs, made, seed)


def fitted(pieces: list[tuple[str, list[Span]]], epochs: int, made: int, seed: int) -> Tagger | None:
    """The network of labelled windows; none if no window has a span."""
    if not any(spans for _, spans in pieces):
        return None
    r, copies = random.Random(seed), -(-made // len(pieces))
    rows = [(symbols(p), labels(spans, 0, len(p))) for p, spans in pieces]
    rows += [x for c in range(copies) for k, (p, spans) in enumerate(pieces) if (x := planted(p, spans, k * copies + c, r))]
    return fit(np.stack([x[0] for x in rows]), np.stack([x[1] for x in rows]), epochs)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """doc_id, counts of pattern spans per kind, base (joined pattern spans) and spans (all, by kind and start)."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tag(texts_of(batch), held.value)
            count = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            whole = [joined(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))) for base, more in found]
            columns = [pa.array([joined(base) for base, _ in found], pa.string()), pa.array(whole, pa.string()), pa.array([len(m) for _, m in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *count, *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (of overlapping ones the union) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """`docs` with masked texts; n_chars follows if there is such a column. A null text stays null."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            found = tag(texts, held.value)
            new = [masked(t, base + more) for t, (base, more) in zip(texts, found, strict=True)]
            at = batch.schema.get_field_index("text")
            null = batch.column(at).is_null().to_pylist()
            yield batch.set_column(at, "text", pa.array([None if z else t for z, t in zip(null, new, strict=True)], pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


@query("op1_pii")
def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
