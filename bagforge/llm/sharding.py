"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gapless, map_rows, read, scratch

#: Groups that are differenced one by one at most; beyond it as many bundles of lighter groups are differenced beside them.
ITEMS = 20_000


def differencing(partials: list[list[tuple[int, list]]], shards: int) -> list[tuple[int, list]]:
    """Karmarkar-Karp: combines the two partial partitions of largest spread, oppositely ordered, until one is left.

    A partial partition is its non-empty shards as (sum, members), largest sum first, at most `shards` of them;
    members are lists that the result takes over.
    """
    heap = []
    for i, p in enumerate(partials):
        heap.append((-_spread(p, shards), i, p))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        free = shards - len(a)
        if len(b) <= free:  # every shard of b meets an empty one of a
            both = a + b
        else:
            # b's largest meet a's empty shards; the others meet a's shards from the smallest on
            both = b[:free] + a[: len(a) - (len(b) - free)]
            for (x, mine), (y, theirs) in zip(reversed(a[len(a) - (len(b) - free) :]), b[free:]):
                big, little = (mine, theirs) if len(mine) >= len(theirs) else (theirs, mine)
                big.extend(little)
                both.append((x + y, big))
        both.sort(key=_weight, reverse=True)
        n += 1
        heapq.heapreplace(heap, (-_spread(both, shards), n, both))
    return heap[0][2] if heap else []


def _weight(x: tuple[int, list]) -> int:
    return x[0]


def _spread(p: list[tuple[int, list]], shards: int) -> int:
    return p[0][0] - (p[-1][0] if len(p) == shards else 0) if p else 0


def partition(weights: list[int], shards: int) -> np.ndarray:
    """The shard of each weight. One that outweighs an equal share of what is left gets a shard of its own; differencing levels the others."""
    order = sorted(range(len(weights)), key=lambda i: -weights[i])
    out, alone, rest = np.zeros(len(weights), np.int32), 0, sum(weights)
    while alone < min(shards - 1, len(order)) and weights[order[alone]] * (shards - alone) > rest:
        out[order[alone]] = alone
        rest -= weights[order[alone]]
        alone += 1
    for k, (_, members) in enumerate(differencing([[(weights[i], [i])] for i in order[alone:]], shards - alone)):
        out[members] = alone + k
    return out


def _items(groups: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """(item, w) to be differenced, ITEMS x 2 at most, and (gid) of the groups that are items of their own; the others are bundled by hash."""
    total = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    single = groups if total.n <= ITEMS else groups.where(F.col("w") * F.lit(ITEMS) > F.lit(total.w or 0))
    named = scratch(single.select("gid", "w"), tag)
    item = F.concat(F.lit("g"), F.hex("gid"))
    if total.n <= ITEMS:
        return named.select(item.alias("item"), "w"), named.select("gid")
    light = groups.join(F.broadcast(named.select("gid")), "gid", "left_anti").groupBy(_bundle().alias("item")).agg(F.sum("w").alias("w"))
    return named.select(item.alias("item"), "w").unionByName(light), named.select("gid")


def _bundle() -> Column:
    return F.concat(F.lit("b"), F.pmod(F.xxhash64("gid"), F.lit(ITEMS)).cast("string"))


def balanced_shards(docs: DataFrame, shards: int = 40, tag: str = "sharding") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text, ...).

    The law is `bytes`: a document's size is its text's UTF-8 bytes plus 16, and shard totals come out near equal.
    Documents of equal text are one indivisible group and share a shard, however many they are: a group that
    outweighs a shard's share has a shard of its own and the other shards are level among themselves. One task
    differences all groups one by one; of more than ITEMS groups those below 1 / ITEMS of all bytes are first bundled by
    a hash into ITEMS bundles, so that task holds at most 2 x ITEMS rows at any size. slot numbers a shard's rows
    from 0 without gaps. Rows are told their shard by a broadcast of those items, so a common text is no hot key.
    A null text has no bytes and crc 0 and is grouped with empty texts; a very long one is one weight like any other;
    groups of equal size and repeated rows (which keep a row each) are ordered by their text's hash; other columns are
    not used; an empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    data = text.cast("binary")
    gid = F.unhex(F.substring(F.sha2(data, 256), 1, 32)).alias("gid")
    rows = scratch(documents(docs).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), gid), tag)
    groups = scratch(rows.groupBy("gid").agg(F.sum("size").alias("w")), tag)
    items, single = _items(groups, tag)

    def seat(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("item", ignore_index=True)
        return pd.DataFrame({"item": g["item"], "shard": partition(g["w"].tolist(), shards)})

    seats = scratch(items.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(seat, "item string, shard int"), tag)
    own = single.select("gid", F.concat(F.lit("g"), F.hex("gid")).alias("_own"))
    told = rows.join(F.broadcast(own), "gid", "left").withColumn("item", F.coalesce("_own", _bundle()))
    dealt = told.join(F.broadcast(seats), "item").select("doc_id", "size", "text_crc32", "shard")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            shard = b.column(3).to_numpy()
            local = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                local[at] = seen[s] + np.arange(len(at))
                seen[s] += len(at)
            yield {"doc_id": b.column(0), "size": b.column(1), "text_crc32": b.column(2), "shard": shard, "part": np.full(len(shard), part, np.int32), "local": local}

    numbered = scratch(map_rows(dealt, "doc_id long, size long, text_crc32 long, shard int, part int, local long", number), tag)
    return gapless(numbered, "part", "shard", "local", "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(read(spark, sf_dir, "documents"))
