"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import decide, documents, map_rows, read, scratch, small

K1, B = 1.2, 0.75
#: Items whose largest contributions one block bound covers.
BLOCK = 4
#: Windows that are bounded together.
TOGETHER = 64
#: Bytes of item texts that one index holds (about); more items make more indexes, of which workers hold one at a time and each sees all documents.
INDEX_BYTES = 4_000_000
#: Share of an item's own BM25 score at which a passage is retrieved.
RETRIEVE = 0.6
#: Share of the question's and of the answer's words that common runs of SHINGLE words, or the whole part, must cover.
OVERLAP, SHINGLE = 0.6, 5
_WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case runs of letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").lower().encode().translate(_WORD_BYTES).split()


def answer_at(text: str, n: int) -> int:
    """The word at which an item's answer begins: after its last line break or question mark, else after two thirds."""
    cut = max(text.rstrip().rfind("\n"), text.rstrip().rfind("?"))
    at = len(words(text[: cut + 1])) if cut > 0 else 0
    return at if 0 < at < n else n - max(1, n // 3)


class Stats:
    """What BM25 asks of all items: how many there are, their mean and greatest length, and in how many each term is."""

    def __init__(self, n: int, mean: float, longest: int, df: dict[bytes, int]):
        self.n, self.mean, self.longest, self.df = n, mean, longest, df

    @classmethod
    def of(cls, lists: list[list[bytes]]) -> Stats:
        sizes = list(map(len, lists))
        return cls(len(sizes), sum(sizes) / max(len(sizes), 1), max(sizes, default=0), Counter(t for w in lists for t in set(w)))


class Index:
    """Postings of items (id, text): per term, items in order, their share of the item's own score, block maxima.

    stats are those of all items, of which these may be a part: so scores and windows are the same in any part.
    """

    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None):
        self.items = [(i, w, answer_at(t, len(w))) for i, t in sorted(items) if (w := words(t))]
        stats = stats or Stats.of([w for _, w, _ in self.items])
        tf = [Counter(w) for _, w, _ in self.items]
        n, df, mean = stats.n, stats.df, stats.mean
        self.term: dict[bytes, int] = {t: k for k, t in enumerate(sorted({t for c in tf for t in c}))}
        posts: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for d, c in enumerate(tf):
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            s = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(s.values())
            for t, x in s.items():
                posts[self.term[t]].append((d, x / own))
        self.docs = [[d for d, _ in p] for p in posts]
        self.shares = [[x for _, x in p] for p in posts]
        self.most = [max(x) for x in self.shares]
        self.blocks: list[dict[int, float]] = []
        for p in posts:
            top: dict[int, float] = {}
            for d, x in p:
                top[d // BLOCK] = max(top.get(d // BLOCK, 0.0), x)
            self.blocks.append(top)
        self.n_blocks = max(1, -(-len(self.items) // BLOCK))
        self.block_size = np.array([len(x) for x in self.blocks] + [0])
        self.block_start = np.cumsum(self.block_size) - self.block_size
        self.block_id = np.array([k for x in self.blocks for k in x], np.int64)
        self.block_most = np.array([v for x in self.blocks for v in x.values()])
        self.longest = stats.longest
        self.shingles = [{tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} for _, w, _ in self.items]

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items to which the distinct terms give at least `least` of their own score."""
        cursors = sorted([self.docs[t][0], 0, t] for t in terms)  # next item, place in the postings, term
        out = []
        eps = 1e-9
        while cursors:
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least - eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[t].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) < least - eps:
                # no item of the block up to the next cursor can do: those skip to what comes first
                after = (block + 1) * BLOCK
                self._skip(cursors, pivot, min(after, cursors[pivot + 1][0]) if pivot + 1 < len(cursors) else after)
            elif cursors[0][0] == item:
                score = sum(self.shares[t][at] for _, at, t in cursors[: pivot + 1])
                if score >= least - eps:
                    out.append((item, score))
                self._skip(cursors, pivot, item + 1)
            else:
                self._skip(cursors, pivot, item)
        return out

    def _skip(self, cursors: list[list[int]], pivot: int, to: int) -> None:
        """Moves the cursors up to the pivot to their first item from `to` on."""
        for c in cursors[: pivot + 1]:
            docs = self.docs[c[2]]
            c[1] = bisect_left(docs, to, c[1])
            c[0] = docs[c[1]] if c[1] < len(docs) else -1
        cursors[:] = sorted(c for c in cursors if c[0] >= 0)

    def _promising(self, ids: np.ndarray, windows: int, least: float, none: int) -> list[tuple[int, list[int]]]:
        """(first word, distinct terms) of the windows in which some block's maxima sum up to `least`."""
        at = np.flatnonzero(ids != none)
        term, window = ids[at], at // self.longest  # a word is in the window that starts with its step, and in the one before
        own, before = window < windows, window > 0
        pairs = np.unique(np.concatenate([window[own] * none + term[own], (window[before] - 1) * none + term[before]]))
        window, term = pairs // none, pairs % none
        size = self.block_size[term]
        place = np.repeat(self.block_start[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        bound = np.bincount(np.repeat(window, size) * self.n_blocks + self.block_id[place], self.block_most[place], windows * self.n_blocks)
        good = np.flatnonzero(bound.reshape(windows, -1).max(axis=1) >= least - 1e-6)
        return [(int(k) * self.longest, term[window == k].tolist()) for k in good]

    def overlap(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and of the answer's words that lie in runs common with the passage."""
        _, w, answer = self.items[item]
        size, want = min(SHINGLE, len(w)), self.shingles[item]
        there = {g for i in range(len(passage) - size + 1) if (g := tuple(passage[i : i + size])) in want}
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in there:
                hit[i : i + size] = True
        if len(w) >= SHINGLE:  # a part too short for such a run counts where it stands whole, anywhere in the passage
            for first, end in ((0, answer), (answer, len(w))):
                size = end - first
                if 0 < size < SHINGLE and any(passage[i : i + size] == w[first:end] for i in range(len(passage) - size + 1)):
                    hit[first:end] = True
        return float(hit[:answer].mean()) if answer else 1.0, float(hit[answer:].mean())

    def search(self, text: str | None, least: float, overlap: float) -> dict[int, float]:
        """item id -> best share, for the items that some passage of the text holds.

        Passages are windows of twice the longest item at steps of the longest item: any run of words up to an
        item's length lies in one whole.
        """
        w = words(text)
        if not w or not self.items:
            return {}
        none = len(self.term)
        get = self.term.get
        ids = np.fromiter(map(get, w, repeat(none)), np.int64, len(w))
        step = self.longest
        windows = len(range(0, max(len(w) - step, 1), step))
        found: dict[int, float] = {}
        for k in range(0, windows, TOGETHER):
            last = min(k + TOGETHER, windows)
            for b, terms in self._promising(ids[k * step : (last + 1) * step], last - k, least, none):
                b += k * step
                for item, share in self.wand(terms, least):
                    key = self.items[item][0]
                    if share > found.get(key, 0.0) and min(self.overlap(item, w[b : b + 2 * step])) >= overlap:
                        found[key] = share
        return found


def _indexes(items: DataFrame, tag: str) -> Iterator[tuple[Broadcast, bool]]:
    """Indexes of bounded size that together hold every item, one after the other, and whether it is the last: at least one."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(total / INDEX_BYTES) or 1
    if n == 1:
        yield spark.sparkContext.broadcast(Index([tuple(r) for r in rows.collect()])), True
        return
    rows = scratch(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), tag)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in small(batches):
            out: dict[str, list] = {"item": [], "part": [], "size": [], "term": []}
            for part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w := words(text):
                    terms = sorted(set(w))
                    out["part"] += [part] * len(terms)
                    out["size"] += [len(w)] + [0] * (len(terms) - 1)  # an item's size stands with its first term
                    out["item"] += [1] + [0] * (len(terms) - 1)
                    out["term"] += terms
            yield out

    terms = scratch(map_rows(rows.select("part", "text"), "item int, part int, size long, term binary", split), tag)
    one = terms.agg(F.sum("item").alias("n"), F.sum("size").alias("words"), F.max("size").alias("longest")).first()
    df = scratch(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), tag)
    for k in range(n):
        own = terms.where(F.col("part") == k).select("term").distinct()
        told = {bytes(r.term): r.df for r in df.join(own, "term").collect()}
        stats = Stats(one.n or 0, (one.words or 0) / max(one.n or 0, 1), one.longest or 0, told)
        yield spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows.where(F.col("part") == k).select("item_id", "text").collect()], stats)), k == n - 1


def decontaminate(docs: DataFrame, items: DataFrame, least: float = RETRIEVE, overlap: float = OVERLAP, tag: str = "decontaminate") -> DataFrame:
    """(doc_id, n_items, item_ids, best_share, contaminated) for every row of docs(doc_id, text, ...).

    items(item_id, text) make the index. A document is contaminated if one of its passages reaches `least` of an
    item's own BM25 score and common runs of five words cover `overlap` of the item's question and of its answer; a
    question or answer of fewer than five words is also covered where it stands whole anywhere in the passage. Exactly
    `least` or `overlap` is enough.
    More items than one index takes are asked in parts, by the frequencies and lengths of all: the documents pass once a
    part, and what is found is written in between, so that no worker holds two parts.
    Null and empty texts, and items without words or an id, match nothing; an item of fewer than five words must occur whole.
    Very long texts are searched passage by passage. Repeated rows keep a row each, repeated items count once; other
    columns are not used; empty tables give no rows, or no hits.
    """
    known = "array<struct<item:long,share:double>>"
    found = documents(docs).withColumn("found", F.array().cast(known))
    last: Broadcast | None = None
    for index, ends in _indexes(items, tag):
        if last:
            found = scratch(found, tag)
            last.unpersist()
        last = index
        carried = "doc_id long" if ends else "doc_id long, text string"
        found = map_rows(found, f"{carried}, found {known}", _searched(index, least, overlap, ends))
    best = F.least(F.lit(1.0), F.coalesce(F.array_max("found.share"), F.lit(0.0)))
    ids = F.array_sort(F.array_distinct("found.item"))
    return found.select("doc_id", F.size(ids).alias("n_items"), ids.alias("item_ids"), best.alias("best_share"), (F.size("found") > 0).alias("contaminated"))


def _searched(index: Broadcast, least: float, overlap: float, ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterable[dict]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in small(batches):
            out = []
            for text, found in zip(b.column(1), b.column(2)):
                new = index.value.search(text.as_py(), least, overlap)
                out.append((found.as_py() or []) + [{"item": i, "share": x} for i, x in new.items()])
            yield {"doc_id": b.column(0), "found": out} | ({} if ends else {"text": b.column(1)})

    return run


def without_leaks(docs: DataFrame, items: DataFrame, least: float = RETRIEVE, overlap: float = OVERLAP, tag: str = "decontaminate") -> DataFrame:
    """docs, all columns, without the documents that decontaminate() finds contaminated; null and empty texts and repeated clean rows stay."""
    at = docs.columns.index("text")
    last: Broadcast | None = None
    for index, _ in _indexes(items, tag):
        if last:
            docs = scratch(docs, tag)
            last.unpersist()
        last = index
        docs = decide(docs, _clean(index, at, least, overlap))
    return docs


def _clean(index: Broadcast, at: int, least: float, overlap: float) -> Callable[[pa.RecordBatch], list[bool]]:
    return lambda b: [not index.value.search(t, least, overlap) for t in b.column(at).to_pylist()]


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
