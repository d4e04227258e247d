"""Quality: expectation-maximisation over overlapping heuristic labellers, and a hashed linear scorer of their posteriors."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, documents, map_rows, read, small, utf8

#: Documents, by a hash of doc_id and text, that the scorer is fitted on at most, and hashed features that it has.
SAMPLE, BUCKETS = 8000, 1 << 14
#: A worker's memo of word buckets is emptied beyond this many words.
MEMO = 500_000
GOOD, NONE, POOR = 1, 0, -1
_LETTERS = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_PLAIN = _LETTERS + b" \t\r\n\x0b\x0c.,;:?!'\"-()"


def measure(text: bytes) -> dict[str, float]:
    """What the labellers look at."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, w = max(len(text), 1), max(len(words), 1)
    counts = Counter(words)
    letters = n - len(text.translate(None, _LETTERS)) or 1
    return {
        "words": len(words),
        "symbols": len(text.translate(None, _PLAIN)) / n,
        "upper": (len(text) - len(text.translate(None, _UPPER))) / letters,
        "digits": (len(text) - len(text.translate(None, _DIGIT))) / letters,
        "shout": text.count(b"!") / w,
        "commonest": counts.most_common(1)[0][1] / w if counts else 1.0,
        "distinct": len(counts) / w,
        "twice": 1 - len(set(lines)) / max(len(lines), 1),
        "length": len(text) / w,
        "ends": sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"', b")") for x in lines) / max(len(lines), 1),
    }


def _vote(x: float, good: float, poor: float) -> int:
    """GOOD up to one bound, POOR from the other; between them none."""
    return (GOOD if x <= good else POOR if x >= poor else NONE) if good <= poor else (GOOD if x >= good else POOR if x <= poor else NONE)


#: Heuristic labellers: each votes GOOD, POOR or not at all; how far each is right is estimated, not assumed.
LABELLERS = {
    "few symbols": lambda m: _vote(m["symbols"], 0.005, 0.03),
    "few capitals": lambda m: _vote(m["upper"], 0.06, 0.25),
    "no shouting": lambda m: _vote(m["shout"], 0.05, 0.4),
    "no dominant word": lambda m: _vote(m["commonest"], 0.12, 0.3) if m["words"] >= 20 else NONE,
    "varied words": lambda m: _vote(m["distinct"], 0.45, 0.2) if 20 <= m["words"] <= 3000 else NONE,
    "lines once": lambda m: _vote(m["twice"], 0.1, 0.4) if m["words"] >= 20 else NONE,
    "word length": lambda m: _vote(abs(m["length"] - 6.2), 1.3, 2.6) if m["words"] >= 20 else NONE,
    "sentences end": lambda m: _vote(m["ends"], 0.8, 0.3) if m["words"] else POOR,
    "few digits": lambda m: _vote(m["digits"], 0.1, 0.4),
}


def posteriors(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """P(good) of each vote pattern (letters +, 0, - by labeller), and each labeller's P(vote | class) as estimated.

    Labellers are independent given the class and their abstentions tell nothing. A POOR vote is rare on good texts
    and each labeller sees only some kinds of poor text: expectation-maximisation starts from that. Patterns are at
    most 3^labellers, whatever the corpus.
    """
    if not patterns:
        return {}, np.zeros((0, 2, 3))
    names = sorted(patterns)
    v = np.array([["-0+".index(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    k = v.shape[1]
    theta = np.array([[[0.3, 1.0, 0.7], [0.02, 1.0, 0.98]]] * k)  # labeller, class, vote
    prior = 0.85
    for _ in range(rounds):
        log = np.log(np.array([[1 - prior], [prior]])) + sum(np.log(theta[j][:, v[:, j]]) for j in range(k))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        for j in range(k):
            for c, weight in enumerate(((1 - good) * n, good * n)):
                poor, _, fine = np.bincount(v[:, j], weight, 3)
                theta[j, c] = (poor + 0.5) / (poor + fine + 1), 1.0, (fine + 0.5) / (poor + fine + 1)
        prior = float(np.clip((good * n).sum() / n.sum(), 0.02, 0.98))
    return dict(zip(names, good.tolist())), theta


class Hasher:
    """Hashed features of a text: its words, by count's logarithm, and coarse measures; unit length."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def features(self, text: bytes, m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(text.split())
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in counts:
            if w not in memo:
                memo[w] = zlib.crc32(w) % BUCKETS
        at = np.fromiter((memo[w] for w in counts), np.int64, len(counts))
        x = np.log1p(np.fromiter(counts.values(), float, len(counts)))
        x /= np.sqrt((x * x).sum()) or 1.0
        coarse = [f"{k} {min(int(v * 20), 40) if k != 'words' else int(v).bit_length()}" for k, v in m.items()] + ["bias"]
        at = np.append(at, [zlib.crc32(c.encode()) % BUCKETS for c in coarse])
        return at, np.append(x, np.full(len(coarse), 0.5))


def _votes(m: dict[str, float]) -> str:
    return "".join("-0+"[f(m) + 1] for f in LABELLERS.values())


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 8, rate: float = 0.5, ridge: float = 1e-6) -> np.ndarray:
    """Logistic weights by AdaGrad over (buckets, values, probability)."""
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30)))
            g = (p - y) * x + ridge * w[at]
            np.add.at(g2, at, g * g)
            np.add.at(w, at, -rate * g / np.sqrt(g2[at]))
    return w


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) for every row of docs(doc_id, text, ...).

    Every document's votes count towards the labellers' accuracies. The scorer learns the posteriors of at most
    SAMPLE documents and scores all. keep: score >= threshold, so a score that is equal is kept. A null or empty text
    gets the votes of a text without words; a very long one is measured whole. Repeated rows keep a row each; other columns are not used; an empty table gives none.
    """
    docs = documents(docs)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        seen: Counter = Counter()
        for b in small(batches):
            seen.update(_votes(measure(x)) for x in utf8(b.column(0)))
        yield {"votes": list(seen), "n": list(seen.values())}

    patterns = map_rows(docs.select("text"), "votes string, n long", vote).groupBy("votes").agg(F.sum("n").alias("n"))
    good, _ = posteriors({r.votes: r.n for r in patterns.collect()})

    texts = bounded_sample(docs, SAMPLE, docs.count(), "doc_id", "text", spare=1.2)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        h = Hasher()
        for b in small(batches):
            out = defaultdict(list)
            for text in utf8(b.column(0)):
                m = measure(text)
                at, x = h.features(text, m)
                out["at"].append(at.astype(np.uint16).tobytes())
                out["x"].append(x.astype(np.float32).tobytes())
                out["p"].append(good.get(_votes(m), 0.5))
            if b.num_rows:
                yield out

    rows = map_rows(texts.select("text"), "at binary, x binary, p double", hashed).collect()  # at most SAMPLE rows
    rows = sorted((bytes(r.at), bytes(r.x), r.p) for r in rows)
    weights = docs.sparkSession.sparkContext.broadcast(train([(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(float), p) for a, x, p in rows]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        h, w = Hasher(), weights.value
        for b in small(batches):
            if not b.num_rows:
                continue
            out = defaultdict(list)
            for text in utf8(b.column(1)):
                m = measure(text)
                at, x = h.features(text, m)
                s = float(1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30))))
                out["votes"].append(_votes(m))
                out["posterior"].append(good.get(out["votes"][-1], 0.5))
                out["score"].append(s)
                out["keep"].append(s >= threshold)
            yield {"doc_id": b.column(0)} | out

    return map_rows(docs, "doc_id long, votes string, posterior double, score double, keep boolean", score)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))
