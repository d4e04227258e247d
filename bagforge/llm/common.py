"""What the operators share: the scratch folder, batch mapping, word splitting, gapless ranks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import drop_scratch, scratch, shared_dir

__all__ = ["drop_scratch", "scratch", "shared_dir"]  # and what follows

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that Spark hands to a Python worker at a time.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_BYTES, so that long texts arrive few at a time."""
    n, unit = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", spark.conf.get(_BATCH, "64m").lower()).groups()
    now = int(n) * 1024 ** "bkmgtp".index(unit or "b")
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_rows(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]]) -> DataFrame:
    """mapInArrow for a function that yields dictionaries of columns (lists or arrays)."""
    bound_batches(df.sparkSession)
    like = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type, from_pandas=False) for f in want], schema=want)
        give_back()

    return df.mapInArrow(run, like)


def give_back() -> None:
    """Returns a worker's free memory to the system: workers live on from task to task and share an executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def decide(df: DataFrame, fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Rows of df that fn, which sees its batches, keeps (a boolean each); every column passes through, nothing is joined."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            if b.num_rows:
                yield b.filter(pa.array(fn(b), pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)


def small(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut to a row count that keeps a worker's Python objects few."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and more) under their own names, whatever else the table carries."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def gapless(df: DataFrame, part: str, key: str, local: str, out: str) -> DataFrame:
    """Adds out: a gapless number from 0 within each key.

    local numbers a key's rows within one part (a task of the pass that wrote df), so one row per (part, key)
    is all that is gathered per key; no key's rows ever meet in one task.
    """
    sizes = df.groupBy(part, key).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(sizes.withColumn("_before", before).drop("_n"), [part, key]).withColumn(out, F.col("_before") + F.col(local)).drop("_before")


def bounded_sample(df: DataFrame, n: int, total: int, *key: str, spare: float = 1.5) -> DataFrame:
    """At most n rows of df, by a hash of key; total is how many df has.

    The hash first thins df to about spare x n rows, so that what the final choice gathers doesn't grow with df.
    """
    return thinned(df, int(spare * n), total, *key).orderBy(F.xxhash64(*key, F.lit(17)), *key).limit(n)


def thinned(df: DataFrame, n: int, total: int, *key: str) -> DataFrame:
    """About n of df's total rows, by a hash of key; all if there are no more. Rows of one key all come or all stay away."""
    h = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 40))
    return df.where(h < int(n / total * (1 << 40))) if total > n else df


#: A key with more than this share of all rows is hot: there are fewer than 1 / HOT such keys.
HOT = 1 / 1000


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], size: str) -> DataFrame:
    """rows joined with table, which has one row a key and in column size how many of rows have it (dropped here).

    The few hot keys' rows are joined by broadcast where they lie, so that no task gets a whole hot key; the others
    are shuffled. Both sides are read twice: written tables.
    """
    limit = (table.agg(F.sum(size)).first()[0] or 0) * HOT
    hot = F.broadcast(table.where(F.col(size) > limit).drop(size))
    cold = rows.join(hot.select(*key), key, "left_anti").join(table.where(F.col(size) <= limit).drop(size), key)
    return rows.join(hot, key).unionByName(cold)


def split_of(name: str) -> Column:
    """crc32 of a document id's decimal text, modulo 4."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 4
