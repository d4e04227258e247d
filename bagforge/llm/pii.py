"""Personal data: exact patterns, and a skip-chain conditional random field that adds mentions which the patterns miss.

The patterns' tokens are given to the field. Tokens that are alike (the same digits in other clothes, one mailbox) share
potentials through a node of their likeness; loopy messages then label what the patterns can't see: a phone number
told again without its country, a card with dots or a wrong last digit. The weights are learnt from the corpus itself:
known mentions are told again in broken form, and numbers that are no personal data too.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, give_back, map_rows, read, small, thinned

KINDS = ("email", "ip", "card", "phone")
OUT = len(KINDS)  # the label of all other tokens
#: Lessons that the field's weights are fitted on at most, tokens of each, and ways in which one document is retold.
SAMPLE, SAMPLE_TOKENS, WAYS = 2000, 200, 4
#: Documents looked at for each lesson.
PER_NODE = 20
#: Marginal probability from which a token is labelled, unless held-out documents tell; and the precision they must show there.
SURE, PRECISE = 0.9, 0.98
#: Messages are passed until they change by less than this, in so many rounds at most.
STILL, ROUNDS = 1e-3, 200

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_PLAIN = re.compile(r"[0-9+().,/_-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns: leftmost, non-overlapping within a kind; matches that fail a check are dropped."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # around each @, which is where a leftmost match must have one
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((start, 0, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _names(core: str, digits: str) -> set[str]:
    """What makes tokens alike: the last seven digits, the first eight of a long number, four groups in a row, a mailbox."""
    out = set()
    if len(digits) >= 7:
        out.add("7 " + digits[-7:])
    if len(digits) >= 12:
        out.add("8 " + digits[:8])
    if len(groups := re.findall("[0-9]+", core)) >= 4 and len(digits) < 16:
        out.add(". " + ".".join(groups))
    if (box := core.split("@")[0].lower()) != core.lower() and len(box) >= 3:
        out.add("@ " + box)
    return out


class Field:
    """The nodes of one document: its tokens with a digit or @ (all others are OUT for certain).

    label is the kind of the base span that a token lies in, or OUT; names are the likenesses that it shares.
    """

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        self.names: list[set[str]] = []
        self.label: list[int] = []
        self.chain: list[bool] = []
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        b, before = 0, -2
        base = sorted(base, key=lambda s: (s[2], s[0]))
        run: list[int] = []  # nodes in a row without letters
        for k, (i, j) in enumerate(tokens):
            raw = text[i:j]
            if not _ANY.search(raw):
                continue
            core = raw.lstrip("\"'([{<,;:").rstrip("\"')]}>,;:.!?") or raw
            left = raw.index(core)
            self.spans.append((i + left, i + left + len(core)))
            while b < len(base) and base[b][2] <= i:
                b += 1
            owner = next(((s, kind, e) for s, kind, e in base[b : b + 4] if s < j and e > i), None)
            self.label.append(owner[1] if owner else OUT)
            digits = re.sub("[^0-9]", "", core)
            self.names.append(_names(core, digits))
            if owner and not (i <= owner[0] and owner[2] <= j):  # part of a longer mention
                self.names[-1] |= _names("", re.sub("[^0-9]", "", text[owner[0] : owner[2]]))
            previous = text[slice(*tokens[k - 1])].lower().strip(":,.") if k else ""
            self.features.append(_describe(core, digits, previous, text[slice(*tokens[k + 1])] if k + 1 < len(tokens) else ""))
            self.chain.append(before == k - 1)
            if not self.chain[-1] or not _PLAIN.fullmatch(raw):
                self._join(text, run)
                run = []
            if _PLAIN.fullmatch(raw):
                run.append(len(self.spans) - 1)
            before = k
        self._join(text, run)

    def _join(self, text: str, run: list[int]) -> None:
        """Numbers in a row may be one mention: they share its likeness."""
        if len(run) < 2:
            return
        digits = "".join(re.sub("[^0-9]", "", text[slice(*self.spans[k])]) for k in run)
        if 7 <= len(digits) <= 19:
            for k in run:
                self.names[k] |= _names("", digits)

    def edges(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
        """(neighbours in the text; (likeness, token) where at least two tokens share one; the likenesses' given kinds, or OUT + 1).

        Every token of a likeness hangs on its one node, so edges grow with the tokens; what is alike in several ways
        has one node for them, so that nothing counts twice. A likeness of which the patterns
        know a token has that token's kind for given.
        """
        near = [(k - 1, k) for k, c in enumerate(self.chain) if c]
        held: dict[str, list[int]] = defaultdict(list)
        for k, names in enumerate(self.names):
            for name in sorted(names):
                held[name].append(k)
        skip, given = [], []
        for tokens in sorted({tuple(t) for t in held.values()}):
            if len(tokens) > 1:
                skip += [(len(given), k) for k in tokens]
                kinds = Counter(self.label[k] for k in tokens if self.label[k] != OUT)
                given.append(min(kinds, key=lambda x: (-kinds[x], x)) if kinds else OUT + 1)
        return near, skip, given


def _shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub("[0-9]", "9", re.sub("[^\\W\\d_]", "a", s)))[:24]


def _describe(core: str, digits: str, previous: str, following: str) -> list[str]:
    return [
        "shape " + _shape(core),
        f"digits {min(len(digits), 20)}",
        f"letters {min(sum(map(str.isalpha, core)), 12)}",
        "at" if "@" in core else "no at",
        f"dots {min(core.count('.'), 5)}",
        "plus" if core[:1] == "+" else "no plus",
        "all digits" if core == digits else "mixed",
        "after " + (_shape(previous) if _ANY.search(previous) else previous if previous in ("mail", "email", "tel", "phone", "call", "fax", "card", "visa", "ip", "host", "key", "password", "token", "secret") else "word"),
        "before " + (_shape(following) if _ANY.search(following) else "word"),
    ]


def broken(kind: int, told: str, rng: random.Random) -> str:
    """A mention of kind in a form that the patterns don't know."""
    if kind == 0:
        box, _, host = told.partition("@")
        return box + "@" + rng.choice([host.split(".")[0], host.replace(".", ","), host.replace(".", " . "), host.replace(".", "_")])
    groups, digits = re.findall("[0-9]+", told), re.sub("[^0-9]", "", told)
    if kind == 1:
        return rng.choice(["-", ",", "_", "[.]"]).join(groups)
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        four = rng.choice([digits, wrong])
        return rng.choice([".", "_", "/", ". "]).join(four[i : i + 4] for i in range(0, len(four), 4)) if rng.random() < 0.6 else rng.choice([wrong, " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4))])
    d = digits[-10:]
    return rng.choice([f"{d[:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[:-7]}.{d[-7:-4]}.{d[-4:]}", f"({d[:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[:-7]} {d[-7:-4]} {d[-4:]}", d, "00" + digits, f"{d[:-7]}/{d[-7:]}"])


def _strange(kind: int, rng: random.Random) -> str:
    """A made-up value in a mention's form that nobody told anywhere."""
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        return "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) + f"{some(2)}@host{some(1)}.example.com"
    return ".".join(str(rng.randint(0, 255)) for _ in range(4)) if kind == 1 else some(16) if kind == 2 else "+" + some(11)


def retold(text: str, way: int = 0) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with mentions told again in broken form, strange ones and other numbers put between its words, and (start, kind, end) of the broken ones.

    Whatever it puts in is chosen by the text and the way alone. Strange mentions and other numbers are no personal data.
    """
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"), way))
    base = base_spans(text)
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    plain = [not _ANY.search(text[i:j]) for i, j in tokens]
    gaps = [tokens[k][1] for k in range(len(tokens)) if plain[k] and (k + 1 == len(tokens) or plain[k + 1])]
    new: list[tuple[int, str]] = []  # kind, what is told
    for s, kind, e in rng.sample(base, min(len(base), 6)):
        new += [(kind, broken(kind, text[s:e], rng)) for _ in range(rng.randint(1, 2))]
    new += [(OUT, broken(kind, _strange(kind, rng), rng)) for kind in range(OUT) for _ in range(rng.randint(0, 2 if base else 1))]
    others = [text[i:j] for (i, j), p in zip(tokens, plain) if not p and not any(s < j and e > i for s, _, e in base)]
    new += [(OUT, x) for x in rng.sample(others, min(len(others), 3))]
    places = sorted(rng.sample(gaps, min(len(gaps), len(new))))
    rng.shuffle(new)
    out, spans, at, size = [], [], 0, 0
    for place, (kind, told) in zip(places, new):
        out += [text[at:place], " ", told]
        size += place - at + 1
        if kind != OUT:
            spans.append((size, kind, size + len(told)))
        size += len(told)
        at = place
    return "".join([*out, text[at:]]), spans


def lesson(text: str, way: int = 0) -> dict | None:
    """The field of the retold text, with the truth of each token; those that the patterns know are given, not asked."""
    nodes = (m for m in _TOKEN.finditer(text) if _ANY.search(m[0]))
    if sum(1 for _ in islice(nodes, SAMPLE_TOKENS + 1)) > SAMPLE_TOKENS:
        return None
    told, spans = retold(text, way)
    base = base_spans(told)
    f = Field(told, base)
    if not 0 < len(f.spans) <= SAMPLE_TOKENS:
        return None
    near, skip, given = f.edges()
    truth = [label if label != OUT else next((kind for s, kind, e in spans if s < j and e > i), OUT) for label, (i, j) in zip(f.label, f.spans)]
    return {"features": f.features, "label": f.label, "truth": truth, "near": near, "skip": skip, "given": given, "held": zlib.crc32(text.encode("utf-8", "surrogatepass")) % 4 == 3}


class Weights:
    """State weights of features, potentials of label pairs for neighbours and of (likeness, token), the likenesses' own weights, and the probability from which a label counts."""

    def __init__(self, names: dict[str, int], w: np.ndarray, near: np.ndarray, skip: np.ndarray, hub: np.ndarray | None = None, sure: float = SURE):
        self.names, self.w, self.near, self.skip, self.sure = names, w, near, skip, sure
        self.hub = np.zeros(OUT + 1) if hub is None else hub

    def unary(self, features: list[list[str]]) -> np.ndarray:
        u = np.zeros((len(features), OUT + 1))
        for k, f in enumerate(features):
            u[k] = self.w[[self.names[x] for x in f if x in self.names]].sum(axis=0)
        return u


class Graphs:
    """The fields of many documents side by side."""

    def __init__(self) -> None:
        self.features: list[list[str]] = []
        self.label: list[int] = []
        self.near: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.given: list[int] = []

    def add(self, features: list[list[str]], label: list[int], near: list, skip: list, given: list[int]) -> int:
        """Where the document's tokens begin."""
        at, hub = len(self.label), len(self.given)
        self.features += features
        self.label += label
        self.near += [(at + a, at + b) for a, b in near]
        self.skip += [(hub + h, at + k) for h, k in skip]
        self.given += given
        return at

    def marginals(self, weights: Weights) -> np.ndarray:
        unary = weights.unary(self.features)
        told = np.array(self.label, int)
        unary[told != OUT, told[told != OUT]] += 50.0  # base tokens are given
        pairs = [np.array(e, int).reshape(-1, 2) for e in (self.near, self.skip)]
        return marginals(unary, *pairs, np.array(self.given, int), weights)


def fit(lessons: list[dict], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-5) -> Weights:
    """Maximum pseudo-likelihood: each token that is asked, given its features and the truth of its neighbours and likenesses, and each likeness that nobody knows, given its tokens'; the lessons of a fourth of the documents only set Weights.sure."""
    names: dict[str, int] = {}
    cols, truth, asked, near, skip, kinds, free = [], [], [], [], [], [], []
    held = [x for x in lessons if x["held"]]
    for f in (x for x in lessons if not x["held"]):
        at = len(truth)
        for x in f["features"]:
            cols.append([names.setdefault(name, len(names)) for name in x])  # as many for each token
        truth += f["truth"]
        asked += [label == OUT for label in f["label"]]
        near += [(at + a, at + b) for a, b in f["near"]]
        hub = len(kinds)
        skip += [(hub + h, at + k) for h, k in f["skip"]]
        free += [g > OUT for g in f["given"]]
        kinds += [min(g, OUT) for g in f["given"]]
        for h, k in f["skip"]:
            kinds[hub + h] = min(kinds[hub + h], f["truth"][k]) if free[hub + h] else kinds[hub + h]
    y, k, n = np.array(truth, int), OUT + 1, len(truth)
    if not n:  # nothing to learn from: nothing is added
        return Weights({}, np.zeros((0, k)), *np.zeros((2, k, k)))
    ask, unknown = np.array(asked, float)[:, None], np.array(free, float)[:, None]
    yh = np.array(kinds, int)
    target_h = np.eye(k)[yh]
    columns = np.array(cols, int).reshape(n, -1)
    each = columns.shape[1]
    target = np.eye(k)[y]
    e, h = np.array(near, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2)
    w, pots = np.zeros((len(names), k)), [np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)]
    w_sq, pots_sq = np.full(w.shape, 1e-8), [np.full(p.shape, 1e-8) for p in pots]
    for _ in range(rounds):
        z = w[columns].sum(axis=1)
        np.add.at(z, e[:, 1], pots[0][y[e[:, 0]]])
        np.add.at(z, e[:, 0], pots[0].T[y[e[:, 1]]])
        np.add.at(z, h[:, 1], pots[1][yh[h[:, 0]]])
        zh = np.repeat(pots[2][None], len(yh), 0)
        np.add.at(zh, h[:, 0], pots[1].T[y[h[:, 1]]])
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = ask * (z / z.sum(axis=1, keepdims=True) - target) / max(ask.sum(), 1)
        zh = np.exp(zh - zh.max(axis=1, keepdims=True, initial=0.0))
        dh = unknown * (zh / zh.sum(axis=1, keepdims=True) - target_h) / max(ask.sum(), 1)
        g = ridge * w + np.stack([np.bincount(columns.ravel(), np.repeat(d[:, c], each), len(names)) for c in range(k)], axis=1)
        w_sq += g * g
        w = w - rate * g / np.sqrt(w_sq)
        g = [ridge * p for p in pots]
        np.add.at(g[0], y[e[:, 0]], d[e[:, 1]])
        np.add.at(g[0].T, y[e[:, 1]], d[e[:, 0]])
        np.add.at(g[1], yh[h[:, 0]], d[h[:, 1]])
        np.add.at(g[1].T, y[h[:, 1]], dh[h[:, 0]])
        g[2] = g[2] + dh.sum(axis=0)
        for i in range(3):
            pots_sq[i] += g[i] * g[i]
            pots[i] = pots[i] - rate * g[i] / np.sqrt(pots_sq[i])
    weights = Weights(names, w, *pots)
    told, p = asked_of(held, weights)
    best, label = p.max(axis=1, initial=0.0), p.argmax(axis=1) if len(p) else np.zeros(0, int)
    for sure in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99):
        new = (label != OUT) & (best >= sure)
        weights.sure = sure
        if new.sum() >= 20 and (label == told)[new].mean() >= PRECISE:
            return weights
    weights.sure = SURE
    return weights


def asked_of(lessons: list[dict], weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """(truth, marginals) of the tokens that the patterns don't know."""
    all_of, truth = Graphs(), []
    for f in lessons:
        all_of.add(f["features"], f["label"], f["near"], f["skip"], f["given"])
        truth += f["truth"]
    ask = np.array(all_of.label, int) == OUT
    return (np.array(truth, int)[ask], all_of.marginals(weights)[ask]) if truth else (np.zeros(0, int), np.zeros((0, OUT + 1)))


def marginals(unary: np.ndarray, near: np.ndarray, skip: np.ndarray, given: np.ndarray, weights: Weights) -> np.ndarray:
    """Tokens' label probabilities by loopy sum-product messages over all documents' graphs at once.

    near: pairs of tokens; skip: (likeness, token); given: each likeness's kind, or OUT + 1 for one that nobody knows.
    """
    n, k = unary.shape
    hubs = np.repeat(weights.hub[None], len(given), 0)
    known = np.flatnonzero(given <= OUT)
    hubs[known, given[known]] = 50.0
    all_unary = np.concatenate([unary, hubs])
    edges = np.concatenate([near, skip + [n, 0]]).astype(int).reshape(-1, 2)
    if not len(edges):
        z = np.exp(unary - unary.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)
    pots = np.concatenate([np.repeat(weights.near[None], len(near), 0), np.repeat(weights.skip[None], len(skip), 0)])
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pot = np.exp(np.concatenate([pots, pots.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    log_m = np.zeros((len(src), k))
    for _ in range(ROUNDS):
        belief = all_unary.copy()
        np.add.at(belief, dst, log_m)
        out = belief[src] - log_m[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.einsum("ei,eij->ej", out, pot)
        new = np.log(new / new.sum(axis=1, keepdims=True) + 1e-300)
        moved = np.abs(new - log_m).max()
        log_m = 0.5 * log_m + 0.5 * new
        if moved < STILL:
            break
    belief = unary.copy()
    to = dst < n
    np.add.at(belief, dst[to], log_m[to])
    z = np.exp(belief - belief.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def all_spans(texts: list[str], weights: Weights) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; inference runs once over the graphs of all of them."""
    base = [base_spans(t) if _ANY.search(t) else [] for t in texts]
    fields, graphs = [], Graphs()
    for k, t in enumerate(texts):
        if not _ANY.search(t):
            continue
        f = Field(t, base[k])
        if f.spans:
            fields.append((k, f, graphs.add(f.features, f.label, *f.edges())))
    out = [(b, list(b)) for b in base]
    if not fields:
        return out
    p = graphs.marginals(weights)
    for k, f, at in fields:
        run: list | None = None
        for i, (s, e) in enumerate(f.spans):
            q = p[at + i]
            label = int(q.argmax())
            new = label != OUT and q[label] >= weights.sure and f.label[i] == OUT
            if new and run and f.chain[i] and run[1] == label:
                run[2] = e
                continue
            if run:
                out[k][1].append(tuple(run))
            run = [s, label, e] if new else None
        if run:
            out[k][1].append(tuple(run))
        out[k][1].sort()
    return out


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans)


def learn(docs: DataFrame, tag: str = "pii") -> Broadcast:
    """Weights from lesson() on SAMPLE documents that have nodes; bounded, whatever the input."""

    def lessons(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in small(batches):
            told = [json.dumps(x) for text in b.column(0).to_pylist() if text and _ANY.search(text) for way in range(WAYS) if (x := lesson(text, way))]
            yield {"field": told, "h": [zlib.crc32(x.encode()) for x in told]}

    # few documents have nodes: of PER_NODE times as many, those that have are what is chosen from
    some = thinned(docs, PER_NODE * SAMPLE, docs.count(), "doc_id", "text").select("text")
    rows = map_rows(some, "field string, h long", lessons).orderBy("h", "field").limit(SAMPLE)
    return docs.sparkSession.sparkContext.broadcast(fit([json.loads(r.field) for r in rows.select("field").collect()]))


def find_personal_data(docs: DataFrame, tag: str = "pii") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs(doc_id, text, ...).

    The counts and base_sha256 are of the patterns; spans tells all spans as kind:start:end in code points, those of
    the patterns and those that the field adds. A null or empty text has none; a very long one is one field. A token
    exactly at the field's threshold is labelled; of equal labels the first kind is taken. Repeated rows keep a row each; other columns are not used; an empty table gives none.
    """
    docs = documents(docs)
    weights = learn(docs, tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in small(batches):
            if not b.num_rows:
                continue
            out = defaultdict(list)
            for base, every in all_spans([t.as_py() or "" for t in b.column(1)], weights.value):
                for kind, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(s[1] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(_told(base).encode()).hexdigest())
                out["spans"].append(_told(every))
            yield {"doc_id": b.column(0)} | out

    return map_rows(docs, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", run)


def redact(docs: DataFrame, tag: str = "pii") -> DataFrame:
    """docs with every span of personal data in text replaced by <KIND>, and n_chars, where there is such a column, recounted for what changed.

    Null and empty texts and very long ones without such data stay as they are; repeated rows keep a row each; other
    columns pass through; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    weights = learn(documents(docs), tag)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            if not b.num_rows:
                continue
            texts = b.column(at).to_pylist()
            clean = []
            for text, (_, spans) in zip(texts, all_spans([t or "" for t in texts], weights.value)):
                done, free = [], 0
                for s, kind, e in spans:
                    if e > free:
                        done += [text[free : max(s, free)], f"<{KINDS[kind].upper()}>"]
                        free = e
                clean.append(text if text is None or not done else "".join([*done, text[free:]]))
            columns = list(b.columns)
            columns[at] = pa.array(clean, b.schema.field(at).type)
            if "n_chars" in names:
                changed = b.schema.get_field_index("n_chars")
                columns[changed] = pa.array([old if t == c or c is None else len(c) for old, t, c in zip(columns[changed].to_pylist(), texts, clean)], b.schema.field(changed).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents"))
