"""Ranking, score fusion, first-of-kind, lookups, chunks, samples and folds over tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import draw
from ..shared import released
from .dictionary import numbered


def dense_ranks(rows: DataFrame, score: str, out: str = "rank", ascending: bool = False) -> DataFrame:
    """Adds out: equal scores share a rank from 0, the highest score first (or the lowest).

    Distinct scores are numbered by range partitions, so no window takes all rows into one task.
    """
    values = numbered(rows.select(F.col(score).alias("_v")).where("_v is not null").distinct(), [F.asc("_v") if ascending else F.desc("_v")], out)
    return rows.join(values, rows[score] == values["_v"], "left").drop("_v")


def zscores(rows: DataFrame, name: str, score: str, higher_is_better: bool = True) -> DataFrame:
    """(name, z): population z-scores, turned so that higher is better; of a name's duplicates the worst counts for a turned score, the best else.

    For scores where lower is better the smallest turned value is kept, as established.
    """
    x = rows.select(F.col(name).alias("name"), F.col(score).cast("double").alias("x")).dropna()
    stats = x.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = (F.col("x") - F.col("m")) / F.col("sd")
    turned = x.join(F.broadcast(stats)).select("name", (z if higher_is_better else -z).alias("z"))
    return turned.groupBy("name").agg((F.max if higher_is_better else F.min)("z").alias("z"))


def merge_scores(files: list[DataFrame], reducer: str, top: int | None = None) -> DataFrame:
    """(name, score) of names that all files(name, z) have, by avg, min or max, the highest first."""
    f = {"avg": F.avg, "min": F.min, "max": F.max}[reducer]
    tagged = reduce(DataFrame.unionByName, [d.withColumn("_f", F.lit(i)) for i, d in enumerate(files)])
    out = tagged.groupBy("name").agg(f("z").alias("score"), F.count_distinct("_f").alias("_n")).where(F.col("_n") == len(files)).drop("_n")
    out = out.orderBy(F.desc("score"), "name")
    return out if top is None else exactly(out.limit(top), top)


def exactly(rows: DataFrame, n: int) -> DataFrame:
    """rows, which must be n: fewer is an error."""
    found = rows.count()
    if found != n:
        raise ValueError(f"{n} rows asked for, {found} there")
    return rows


def first_of(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The first row, by order, of each key; reduced by an aggregate, so a common key costs no sort."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_m"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in rows.columns])


def run_starts(rows: DataFrame, key: str, order: str, within: str | None = None) -> DataFrame:
    """Rows whose key differs from the row before, by order; within: runs are per value of this column."""
    w = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy(order)
    return rows.withColumn("_same", F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1)).where("not _same").drop("_same")


def lookup(names: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """records of names(key, order), in the order asked; names without a record keep their place with nulls."""
    return names.join(records, key, "left").orderBy(order)


def lookup_first(names: DataFrame, files: list[DataFrame], key: str, order: str) -> DataFrame:
    """As lookup over several files: a name's record comes from the first file that has it; a name twice in a file is an error."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("_file", F.lit(i)) for i, f in enumerate(files)])
    rest = [c for c in files[0].columns if c != key]
    first = tagged.groupBy(key, "_file").agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r")).groupBy(key).agg(F.min_by(F.struct("_n", "_r"), "_file").alias("_m"))
    once = first.where(F.assert_true(F.col("_m._n") == 1, F.concat(F.lit("a name occurs twice: "), F.col(key).cast("string"))).isNull())
    return lookup(names, once.select(key, *[F.col(f"_m._r.{c}").alias(c) for c in rest]), key, order)


def same_name_joined(records: DataFrame, key: str, value: str, order: str, between: str = "\n") -> DataFrame:
    """(key, value): the values of records of one name, in order, as one; how many of one name there are must fit a row."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value])
    return records.groupBy(key).agg(F.array_join(texts, between).alias(value))


def missing(names: DataFrame, records: DataFrame, key: str) -> DataFrame:
    return names.join(records, key, "left_anti")


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds chunk: rows in order, size to a chunk, named by the running count at its start."""
    return numbered(rows, [order], "_n").withColumn("chunk", (F.floor(F.col("_n") / size) * size).cast("long")).drop("_n")


def shuffled(rows: DataFrame, key: str, seed: int, n: int | None = None) -> DataFrame:
    """Rows in an order that only the key and the seed decide; the first n of it."""
    out = rows.orderBy(draw(key, seed), key)
    return out if n is None else out.limit(n)


def placed(rows: DataFrame, key: str, seed: int, out: str) -> DataFrame:
    """Adds out: each row's place in the shuffled order, from 0."""
    return numbered(rows.withColumn("_h", draw(key, seed)), ["_h", key], out).drop("_h")


def train_part(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds train: true for the first ceil(share x n) rows of the shuffled order."""
    n = rows.count()
    return placed(rows, key, seed, "_n").withColumn("train", F.col("_n") < math.ceil(share * n)).drop("_n")


def folds(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Adds fold: contiguous folds of ceil(n / k) rows."""
    size = max(1, math.ceil(rows.count() / k))
    return numbered(rows, [order], "_n").withColumn("fold", F.floor(F.col("_n") / size).cast("int")).drop("_n")


def in_all(files: list[DataFrame], key: str) -> DataFrame:
    """(key) that every file has."""
    return reduce(DataFrame.intersect, [f.select(key) for f in files])


def zip_lines(a: DataFrame, b: DataFrame, line: str, name: str) -> DataFrame:
    """Two files side by side by line number; different names on a line are an error."""
    both = a.join(b.withColumnRenamed(name, "_other"), line)
    check: Column = F.assert_true(F.col(name) == F.col("_other"), F.lit("names differ"))
    return both.where(check.isNull()).drop("_other")


def finder(queries: DataFrame, reference: DataFrame, molecules: DataFrame, dist: DataFrame) -> DataFrame:
    """Nearest neighbours dist(a_id, nn_id, dist) with the neighbours' molecules(mol_id, smiles, value); duplicate names are an error."""
    twice = molecules.groupBy("mol_id").count().where("count > 1")
    with released(molecules.sparkSession):
        if not twice.isEmpty():
            raise ValueError("a name occurs twice")
    return dist.join(molecules, dist.nn_id == molecules.mol_id, "left").select("a_id", "nn_id", "smiles", (1 - F.col("dist")).alias("tani"), "value")
