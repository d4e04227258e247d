"""Comparing the rows of buckets in blocks: used by the two operators that hash vectors and fingerprints.

A bucket of n rows is cut by a hash of the row's id into about n / BLOCK blocks; each pair of blocks is one
group of at most about 2 x BLOCK rows, so a bucket of any size spreads over the cluster. A group never emits its
pairs: it emits the edges of a spanning forest and, where wanted, how many links each row has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread_join

#: Rows that a block holds on average.
BLOCK = 512
#: A group up to this size is compared in one sweep with others of its kind.
TINY = 12


def block_pairs(rows: DataFrame, bucket: list[str], row_id: str, tag: str = "") -> DataFrame:
    """rows of buckets with at least two rows, once for each pair of blocks; adds _low and _high, the pair.

    rows must be cheap to compute twice (a written table): sizes are counted first.
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = scratch(sizes.withColumn("_rows", F.col("_n")), tag)
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int")
    held = spread_join(rows, sizes, bucket, "_rows").withColumn("_blocks", blocks).withColumn("_mine", mine).drop("_n")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    return held.select("*", other).select(*[c for c in rows.columns], F.col("_mine"), F.least("_mine", "_other").alias("_low"), F.greatest("_mine", "_other").alias("_high"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches: rows of a group never come apart."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(b.schema.get_field_index(k))[-1].as_py() for k in keys]
        cut = _first_of_last(b, keys, last)
        if cut == 0 and kept and [kept[-1].column(kept[-1].schema.get_field_index(k))[-1].as_py() for k in keys] == last:
            kept.append(b)
            continue
        kept.append(b.slice(0, cut))
        if sum(x.num_rows for x in kept):
            yield pa.Table.from_batches(kept)
        kept = [b.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def _first_of_last(b: pa.RecordBatch, keys: list[str], last: list) -> int:
    low, high = 0, b.num_rows - 1
    columns = [b.column(b.schema.get_field_index(k)) for k in keys]
    while low < high:
        mid = (low + high) // 2
        if [c[mid].as_py() for c in columns] == last:
            high = mid
        else:
            low = mid + 1
    return low


def starts_of(columns: list[np.ndarray]) -> np.ndarray:
    """Where each group of equal neighbours begins, and the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), n)


def tiny_pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs within the groups of at most TINY rows."""
    sizes = np.diff(starts)
    first, last = starts[:-1][sizes <= TINY], starts[1:][sizes <= TINY]
    left, right = [], []
    rows = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(first) else np.empty(0, np.int64)
    end = np.repeat(last, last - first)
    for d in range(1, TINY):
        ok = rows + d < end
        if not ok.any():
            break
        left.append(rows[ok])
        right.append(rows[ok] + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Spanning forest of n rows as (row, rows reached from it); near(i, rest) says which of rest link with i."""
    rest, out = np.arange(n), []
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = near(i, rest)
            if hit.any():
                got = rest[hit]
                out.append((i, got))
                todo += got.tolist()
                rest = rest[~hit]
    return out
