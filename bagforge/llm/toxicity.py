"""Toxicity by class-conditional Kneser-Ney models of word forms with shared backoff counts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, decide, documents, give_back, map_rows, read, scratch, small, split_of

#: Letters of context and predicted letter; words are padded with one boundary on each side.
ORDER = 6
#: Discount of all counts where the counts of counts are too few to tell.
DISCOUNT = 0.75
#: Labelled rows of each class, by a hash of doc_id, that the classifier is fitted on at most.
SAMPLE = 20_000
#: Words of a window whose likelihoods are compared.
WINDOW = 2
#: Words whose letters are looked up at once.
TOGETHER = 20_000
#: The best so many words whose mean ratios are compared, and how many features that makes with the text's mean, its best window and its length.
BEST = (1, 3, 6)
FEATURES = len(BEST) + 3
#: Leading bits of a hash that index the tables of ratios, at least.
TOP = 18
#: Probability of a letter without any count.
UNSEEN = 1 / 65536
_EDGE = "\x02"
_ALL = (1 << 64) - 1


def grams(word: str) -> list[str]:
    """Each letter of a word, and its end, with up to ORDER - 1 letters before it."""
    s = f"{_EDGE}{word}{_EDGE}"
    return [s[max(0, j - ORDER + 1) : j + 1] for j in range(1, len(s))]


def hashed_grams(words: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """grams() of many words at once: (joined words, end of each gram, its letters, its hash, its context's hash, first gram of each word)."""
    joined = _EDGE + _EDGE.join(words) + _EDGE
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(np.append(0, sizes[:-1]))
    at = np.arange(1, len(code))
    letters = np.minimum(at - np.repeat(first, sizes) + 1, ORDER)
    whole, context = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    code, factor = np.append(np.zeros(ORDER, np.uint64), code), np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(ORDER):  # the letter that many places before, where the gram still has one
            term = code[ORDER + 1 - back : ORDER + 1 - back + len(at)] * factor
            if back > 1:
                term *= letters > back
            whole += term
            if back:
                context += term
            factor *= np.uint64(0x100000001B3)
        context *= np.uint64(0xD6E8FEB86659FD93)
    return joined, at, letters, whole, context, first


def _hash(key: str, context: bool) -> int:
    """A gram's hash, or a context's, as hashed_grams gives it."""
    factor, x = 1, 0
    for back, c in enumerate(reversed(key + " " if context else key)):
        code = (ord(c) + 1) * 0x9E3779B97F4A7C15 & _ALL
        code ^= code >> 29
        if not context:
            x += code * factor
        elif back:
            x += code * factor * 0xD6E8FEB86659FD93
        factor = factor * 0x100000001B3 & _ALL
    return x & _ALL


def _table(values: dict[str, float], context: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """_sorted() of grams, or of contexts."""
    return _sorted(np.array([_hash(k, context) for k in values], np.uint64), np.array(list(values.values()), np.float64))


def _sorted(h: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes and values: sorted, with the first place of each top bits and the most that share them."""
    order = np.argsort(h)
    h = h[order]
    bits = max(TOP, len(h).bit_length())
    places = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    most = int(np.diff(np.append(places, len(h))).max()) if len(h) else 0
    return np.append(h, np.zeros(most + 1, np.uint64)), np.append(values[order], np.zeros(most + 1)), places, most


def _look_up(table: tuple[np.ndarray, np.ndarray, np.ndarray, int], h: np.ndarray) -> np.ndarray:
    """The value of each hash, nan for those that aren't there."""
    keys, values, places, most = table
    at, out = places[h >> np.uint64(64 - (len(places) - 1).bit_length())], np.full(len(h), np.nan)
    for step in range(most):
        hit = keys[at + step] == h
        out[hit] = values[at[hit] + step]
    return out


class Ratio:
    """Log likelihood ratio (toxic over ordinary) of words.

    A gram has a ratio of its own if a class counted it; else its context's. All other grams come from the
    shared backoff in both classes, so they have ratio 0.
    """

    def __init__(self, own: tuple, rest: tuple):
        self.own, self.rest = own, rest

    def words(self, words: list[str]) -> list[float]:
        return [x for i in range(0, len(words), TOGETHER) for x in self._words(words[i : i + TOGETHER]).tolist()]

    def _words(self, words: list[str]) -> np.ndarray:
        _, _, _, whole, context, first = hashed_grams(words)
        x = _look_up(self.own, whole)
        others = np.flatnonzero(np.isnan(x))
        x[others] = np.nan_to_num(_look_up(self.rest, context[others]))
        return np.add.reduceat(x, first)

    def batch(self, texts: list[str | None]) -> np.ndarray:
        """features() of each text, a row each; the words of all of them are scored together, each once."""
        split = [(t or "").lower().split() for t in texts]
        words = list(set().union(*split))
        scores = dict(zip(words, self.words(words)))
        return np.array([self.features(w, scores, len(t or "")) for w, t in zip(split, texts)]).reshape(-1, FEATURES)

    def features(self, words: list[str], scores: dict[str, float], size: int) -> np.ndarray:
        """Mean ratio a letter of the text, best mean of WINDOW words in a row, means of the BEST words, log of words; all 0 without words."""
        out = np.zeros(FEATURES)
        if words:
            x = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
            sums = np.cumsum(np.append(0.0, x))
            most = BEST[-1]
            top = np.sort(np.partition(x, len(x) - most)[-most:] if len(x) > most else x)[::-1]
            out[0] = x.sum() / (size + 1)
            out[1] = (sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW if len(x) >= WINDOW else x.sum() / WINDOW
            out[2:-1] = [top[:k].mean() for k in BEST]
            out[-1] = np.log1p(len(x))
        return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """What counts of 1, 2 and 3 or more are reduced by, from how many grams have counts 1 to 4 (modified Kneser-Ney).

    A count keeps a part of itself and a higher one no less: so rare grams weigh little but are never dropped.
    """
    if not all(n):
        return DISCOUNT, DISCOUNT, DISCOUNT
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    out: list[float] = []
    for k, x in enumerate(d):
        out.append(min(max(x, 0.1, out[-1] if out else 0.0), out[-1] + 0.95 if out else 0.95))
    return out[0], out[1], out[2]


def _count_of_counts(c: str, name: str) -> list[Column]:
    return [F.count_if(F.col(c) == k).alias(f"{name}{k}") for k in (1, 2, 3, 4)]


def _less(c: str, d: tuple[float, float, float]) -> Column:
    """A count less its discount; 0 stays 0."""
    x = F.col(c)
    return F.when(x >= 3, x - d[2]).when(x == 2, 2 - d[1]).when(x == 1, 1 - d[0]).otherwise(F.lit(0.0))


def _words(docs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, word, n): each task's own counts, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in small(batches):
            seen: dict[tuple, Counter] = {}
            keys = list(zip(*(b.column(i).to_pylist() for i in range(1, b.num_columns)))) or [()] * b.num_rows
            for key, text in zip(keys, b.column(0)):
                seen.setdefault(key, Counter()).update((text.as_py() or "").lower().split())
            for key, c in seen.items():
                yield {"word": list(c), "n": list(c.values())} | {k: [v] * len(c) for k, v in zip(by, key)}

    schema = ", ".join(["word string", "n long", *(f"{k} int" for k in by)])
    return map_rows(docs.select("text", *by), schema, count).groupBy("word", *by).agg(F.sum("n").alias("n"))


def _class_grams(sample: DataFrame) -> DataFrame:
    """(gram, n0, n1): letters of the sample's words by class."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in batches:
            c: tuple[Counter, Counter] = (Counter(), Counter())
            for word, n, toxic in zip(*(b.column(i).to_pylist() for i in range(3))):
                for g in grams(word):
                    c[toxic][g] += n
            both = list(c[0].keys() | c[1].keys())
            yield {"gram": both, "n0": [c[0][g] for g in both], "n1": [c[1][g] for g in both]}

    words = _words(sample, ["toxic"]).select("word", "n", "toxic")
    return map_rows(words, "gram string, n0 long, n1 long", split).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _continuations(docs: DataFrame, tag: str) -> list[DataFrame]:
    """Per order below ORDER, from the highest: (gram, c), in how many longer grams of the whole corpus it ends."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        words: set[str] = set()
        seen = np.zeros(0, np.uint64)

        def new() -> dict:
            nonlocal seen
            if not words:
                return {"gram": []}
            joined, at, letters, whole, _, _ = hashed_grams(list(words))
            got, where = np.unique(whole, return_index=True)
            fresh = ~np.isin(got, seen, assume_unique=True)
            where = where[fresh]
            seen = np.union1d(seen, got) if len(seen) < 2_000_000 else got
            words.clear()
            return {"gram": [joined[e - n + 1 : e + 1] for e, n in zip(at[where].tolist(), letters[where].tolist())]}

        for b in small(batches):
            for text in b.column(0):
                words.update((text.as_py() or "").lower().split())
            if len(words) > 2 * TOGETHER:
                yield new()
        yield new()

    table = scratch(map_rows(docs.select("text"), "gram string", split).distinct(), tag)
    out = []
    for k in range(ORDER - 1, 0, -1):
        # the first gram of a word is as long as its place allows and stays as it is
        shorter = F.when(F.length("gram") > k, F.expr(f"right(gram, {k})")).otherwise(F.col("gram"))
        table = scratch(table.groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c")), tag)
        out.append(table)
    return out


def fit(docs: DataFrame, labels: DataFrame, tag: str = "toxicity") -> tuple[Broadcast, np.ndarray]:
    """(ratio model, logistic weights) from labels(doc_id, toxic) of rows whose split is not 2.

    At most SAMPLE rows of each class count; those of split 3 only calibrate, each with the weight of the labelled rows
    of its class that it stands for, so that the scores keep the classes' real shares. The shared backoff counts come from all
    of docs. What the driver holds is bounded by the sample: 16 bytes, and a place, for each of its grams and contexts.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(split_of("doc_id") != 2)
    total = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    picked = [bounded_sample(marks.where(F.col("toxic") == y), SAMPLE, total.get(y, 0), "doc_id") for y in (0, 1)]
    chosen = scratch(picked[0].union(picked[1]), tag)
    stands_for = {r.toxic: total[r.toxic] / r["count"] for r in chosen.groupBy("toxic").count().collect()}
    sample = scratch(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", split_of("doc_id")), tag)

    context = F.expr("left(gram, length(gram) - 1)").alias("ctx")
    counts = scratch(_class_grams(sample.where("part != 3")).select("gram", context, "n0", "n1"), tag)
    about, ratio = _ratios(counts, _continuations(docs, tag), tag)
    own, rest = _hashes(ratio, False), _hashes(about, True)
    model = spark.sparkContext.broadcast((own, rest))

    del own, rest
    give_back()
    held = features(sample.where("part = 3").select("text", "toxic"), model, ["toxic int"]).toPandas()
    return model, logistic(held[[f"f{i}" for i in range(FEATURES)]].to_numpy(), held.toxic.to_numpy(), weight=held.toxic.map(stands_for).to_numpy(float))


def _ratios(counts: DataFrame, levels: list[DataFrame], tag: str) -> tuple[DataFrame, DataFrame]:
    """(ctx, x) and (gram, x): log ratios of the classes' backoff weights, and of their probabilities of grams that one of them counted.

    counts(gram, ctx, n0, n1) are the classes' own; levels the shared continuation counts, of which both back off.
    """
    told = counts.agg(*_count_of_counts("n0", "a"), *_count_of_counts("n1", "b")).first()
    kept = [_less(f"n{y}", discounts([told[f"{c}{k}"] for k in (1, 2, 3, 4)])) for y, c in ((0, "a"), (1, "b"))]
    sums = counts.groupBy("ctx").agg(*(x.alias(f"{a}{y}") for y in (0, 1) for a, x in (("m", F.sum(f"n{y}")), ("k", F.sum(kept[y])))))
    free = (F.when(F.col(f"m{y}") > 0, 1 - F.col(f"k{y}") / F.col(f"m{y}")).otherwise(1.0).alias(f"f{y}") for y in (0, 1))
    about = scratch(sums.select("ctx", "m0", "m1", *free), tag)
    backoff = _backoff(levels, tag).withColumnRenamed("gram", "low")
    both = counts.join(about, "ctx").withColumn("low", F.expr("substring(gram, 2)")).join(backoff, "low", "left").withColumn("p", F.coalesce("p", F.lit(UNSEEN)))
    p = [F.when(F.col(f"m{y}") > 0, kept[y] / F.col(f"m{y}") + F.col(f"f{y}") * F.col("p")).otherwise(F.col("p")) for y in (0, 1)]
    return about.select("ctx", F.log(F.col("f1") / F.col("f0")).alias("x")), both.select("gram", F.log(p[1] / p[0]).alias("x"))


def _hashes(ratios: DataFrame, context: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """_sorted() of (gram or context, x), hashed by the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in batches:
            yield {"h": np.array([_hash(k, context) for k in b.column(0).to_pylist()], np.uint64).view(np.int64), "x": b.column(1)}

    found = map_rows(ratios, "h long, x double", run).toArrow()
    return _sorted(found["h"].to_numpy().view(np.uint64), found["x"].to_numpy())


def _backoff(levels: list[DataFrame], tag: str) -> DataFrame:
    """(gram, p): shared probability of each gram's last letter, by continuation counts discounted from the shortest context up."""
    lower, out = None, None
    for k, table in zip(range(1, ORDER), reversed(levels)):
        there = table.where(F.length("gram") == k).withColumn("ctx", F.expr("left(gram, length(gram) - 1)"))
        told = there.agg(*_count_of_counts("c", "n")).first()
        there = there.withColumn("k", _less("c", discounts([told[f"n{j}"] for j in (1, 2, 3, 4)])))
        x = there.join(there.groupBy("ctx").agg(F.sum("c").alias("n"), F.sum("k").alias("ks")), "ctx")
        if lower is None:
            x = x.withColumn("q", F.lit(UNSEEN))
        else:
            x = x.withColumn("low", F.expr("substring(gram, 2)")).join(lower.select(F.col("gram").alias("low"), F.col("p").alias("q")), "low", "left")
        p = (F.col("k") + (F.col("n") - F.col("ks")) * F.coalesce("q", F.lit(UNSEEN))) / F.col("n")
        lower = scratch(x.select("gram", p.alias("p")), tag)
        out = out.union(lower) if out else lower
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights of the columns of x, bias last, by Newton's method, ridge on standardised columns; a row counts `weight` times; without rows the score is low and constant."""
    if not len(x):
        return np.append(np.zeros(x.shape[1]), -5.0)
    weight = np.ones(len(x)) if weight is None else weight
    mean = weight @ x / weight.sum()
    sd = np.sqrt(weight @ (x - mean) ** 2 / weight.sum()) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.append(np.zeros(x.shape[1]), -2.0)
    prior = w.copy()

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float(weight @ (np.logaddexp(0, t) - y * t) + ridge * ((w - prior) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * (w - prior)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        while (after := loss(w - step)) > now and np.abs(step).max() >= 1e-6:  # a whole step can overshoot
            step = step / 2
        if np.abs(step).max() < 1e-6:
            break
        w, now = w - step, after
    return np.append(w[:-1] / sd, w[-1] - w[:-1] @ (mean / sd))


def features(rows: DataFrame, model: Broadcast, carry: list[str]) -> DataFrame:
    """(*carry, f0, f1, ...) for rows(text, *carry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        ratio = Ratio(*model.value)
        for b in small(batches):
            f = ratio.batch(b.column(0).to_pylist())
            yield {c.split()[0]: b.column(i + 1) for i, c in enumerate(carry)} | {f"f{j}": f[:, j] for j in range(FEATURES)}

    return map_rows(rows, ", ".join([*carry, *(f"f{j} double" for j in range(FEATURES))]), run)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, tag: str = "toxicity") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    A text's toxic and ordinary log likelihoods are compared a letter over the whole text, a word in its worst window
    and in its worst 1, 3 and 6 words; a logistic of these and of the text's length, by which the worst of many
    ordinary words seems worse, is the score. Null, empty and blank texts score as texts without
    evidence. Labels train only where the document's split is not 2 and are never looked at for a score. Without
    labels every score is low. A score equal to the threshold is predicted toxic; a very long text is compared whole,
    its mean beside its worst words. Repeated rows keep a row each; other columns are not used; an empty table gives none.
    """
    docs = documents(docs)
    model, w = fit(docs, labels, tag)
    f = features(docs.select("text", "doc_id"), model, ["doc_id long"])
    z = sum((F.col(f"f{i}") * float(w[i]) for i in range(FEATURES)), F.lit(float(w[-1])))
    scored = f.withColumn("score", 1 / (1 + F.exp(F.greatest(F.least(-z, F.lit(30.0)), F.lit(-30.0)))))
    return scored.select("doc_id", F.coalesce(split_of("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, tag: str = "toxicity") -> DataFrame:
    """docs, all columns, without the documents that score() predicts toxic; what has no words stays, as do repeated rows that aren't toxic."""
    model, w = fit(documents(docs), labels, tag)
    at = docs.columns.index("text")
    limit = float(np.log(threshold / (1 - threshold)))

    def clean(b: pa.RecordBatch) -> list[bool]:
        f = Ratio(*model.value).batch(b.column(at).to_pylist())
        return (f @ w[:-1] + w[-1] < limit).tolist()

    return decide(docs, clean)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
