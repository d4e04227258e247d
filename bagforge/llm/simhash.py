"""SimHash near-duplicates by covering locality-sensitive hashing (no false negatives within the radius)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import links
from .common import documents, map_rows, read, scratch, small, spread_join, utf8
from .components import connected_components

SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits: a bit is set if it is in over half the hashes of the text's shingles, repeats included.

    Words are split at ASCII white space, A-Z in lower case. Fewer words than a shingle: the whole sequence is the
    one shingle. No word: 0.
    """
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    begins = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    n = len(w) - words + 1
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        total += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int, bits: int = 64) -> np.ndarray:
    """2^(radius+1) - 1 masks: for any set of at most radius bits, some mask has none of them.

    Bit i carries the (radius+1)-bit vector v_i = 1 + i mod (2^(radius+1) - 1); mask m has bit i iff the inner
    product of m and v_i over GF(2) is 1. At most radius vectors leave a non-zero m orthogonal to all of them.
    """
    size = (1 << (radius + 1)) - 1
    v = [1 + i % size for i in range(bits)]
    return np.array([sum(1 << i for i in range(bits) if (m & v[i]).bit_count() & 1) for m in range(1, size + 1)], np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, *more: str) -> DataFrame:
    """(doc_id, fp long) of every document; more: columns like `h long` of docs that go along."""
    docs = docs.select("text", "doc_id", *[m.split()[0] for m in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in small(batches):
            fp = np.fromiter((fingerprint(x, words) for x in utf8(b.column(0))), np.uint64, b.num_rows)
            yield {"doc_id": b.column(1), "fp": fp.view(np.int64)} | {m.split()[0]: b.column(2 + i) for i, m in enumerate(more)}

    return map_rows(docs, ", ".join(["doc_id long, fp long", *more]), run)


def near_links(fps: DataFrame, radius: int = 3, tag: str = "") -> DataFrame:
    """Edges (src, dst) over distinct fingerprints (id, fp) that span every group within the radius.

    Each fingerprint goes to one bucket per mask, keyed by its masked bits; buckets of one row go nowhere. What
    shares a bucket is compared in blocks (see links).
    """
    masks = covering_masks(radius)
    keyed = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("k")) for i, m in enumerate(masks)])).alias("_b")
    rows = fps.select("id", "fp", keyed).select("id", "fp", F.xxhash64("_b.t", "_b.k").alias("bucket"))
    order = ["bucket", "_low", "_high"]
    pairs = links.block_pairs(rows, ["bucket"], "id", tag).repartition(*order).sortWithinPartitions(*order, "_mine", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for t in links.grouped(batches, order):
            ids, fp = t["id"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
            starts = links.starts_of([t[c].to_numpy() for c in order])
            a, b = links.tiny_pairs(starts)
            hit = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            src, dst = [ids[a[hit]]], [ids[b[hit]]]
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s > links.TINY:
                    own, near = ids[s:e], fp[s:e]
                    for i, got in links.forest(e - s, lambda i, rest: np.bitwise_count(near[rest] ^ near[i]) <= radius):
                        src.append(np.full(len(got), own[i]))
                        dst.append(own[got])
            yield {"src": np.concatenate(src), "dst": np.concatenate(dst)}

    return map_rows(pairs.select("id", "fp", "bucket", "_low", "_high"), "src long, dst long", run)


def _roots(own: DataFrame, radius: int, tag: str) -> DataFrame:
    """(fp, root, n) of the fingerprints of own(fp, ...): one root a group, n rows of each fingerprint."""
    nodes = scratch(own.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), tag)
    found = connected_components(near_links(nodes.select(F.col("fp").alias("id"), "fp"), radius, tag), tag)
    return scratch(nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "n"), tag)


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3, tag: str = "simhash") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id reachable over fingerprints that differ in at most radius bits. Documents
    of one fingerprint are one node, so copies cost one comparison. Null and empty texts have fingerprint 0 and
    link like any other; a very long text is one fingerprint of all its shingles; a bit set in exactly half of them is
    0. Repeated doc_ids keep a row each; rows without a doc_id link like any other, and a group of such rows alone
    has component_id null. Other columns are not used; an empty table gives none.
    """
    own = scratch(fingerprints(documents(docs), words), tag)
    roots = _roots(own, radius, tag)
    least = own.groupBy("fp").agg(F.min("doc_id").alias("id")).join(roots, "fp")
    named = roots.join(least.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("fp", "component_id", "n")
    return spread_join(own, scratch(named, tag), ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, tag: str = "simhash") -> DataFrame:
    """docs, all columns, with one row of each of simhash_groups()'s groups: that of the smallest doc_id, then text's hash.

    Rows without a doc_id come after all others; of rows equal in both one stays. Null, empty and very long texts are
    texts like any other; an empty table stays empty.
    """
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = scratch(fingerprints(documents(docs, h.alias("h")), words, "h long"), tag)
    judged = scratch(spread_join(own, _roots(own, radius, tag), ["fp"], "n").select("root", F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("h").alias("c")).alias("k")), tag)
    first = scratch(judged.groupBy("root").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), tag)  # the others are alone
    told = scratch(spread_join(judged, first, ["root"], "n").groupBy("k", "first").agg(F.count(F.lit(1)).alias("n")), tag)
    gone = scratch(told.where("k != first").select(F.col("k.b").alias("_gone_id"), F.col("k.c").alias("_gone_h")), tag)
    again = scratch(told.where("k = first and n > 1").select(F.col("k.b").alias("_gone_id"), F.col("k.c").alias("_gone_h")), tag)

    def held(x: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return x.join(keys, x["doc_id"].cast("long").eqNullSafe(keys["_gone_id"]) & (F.xxhash64(F.coalesce(x["text"].cast("string"), F.lit(""))) == keys["_gone_h"]), how)

    rest = held(docs, gone, "left_anti")
    if again.isEmpty():
        return rest
    twice = held(rest, again, "left_semi").withColumn(unused := f"h{uuid.uuid4().hex}", h)
    return held(rest, again, "left_anti").unionByName(twice.dropDuplicates(["doc_id", unused]).drop(unused))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))
