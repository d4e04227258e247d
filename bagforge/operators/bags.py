"""Bags as one long table (mol_id, feat_id, cnt), and the way to and from packed maps and fields of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import draw, place


def bag_of(rows: DataFrame, mol: str, feature: str, count: Column | None = None) -> DataFrame:
    """(mol_id, feat_id, cnt): how often each entity has each feature; null entities and features are left out."""
    kept = rows.where(F.col(mol).isNotNull() & F.col(feature).isNotNull())
    return kept.groupBy(F.col(mol).alias("mol_id"), F.col(feature).alias("feat_id")).agg(F.sum(F.lit(1) if count is None else count).cast("int").alias("cnt"))


def pack(fp: DataFrame) -> DataFrame:
    """(mol_id, bag): a map per entity."""
    return fp.groupBy("mol_id").agg(F.map_from_entries(F.collect_list(F.struct("feat_id", "cnt"))).alias("bag"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("mol_id", F.explode("bag").alias("feat_id", "cnt"))


def sizes(fp: DataFrame) -> DataFrame:
    """(mol_id, s): sum of counts."""
    return fp.groupBy("mol_id").agg(F.sum("cnt").alias("s"))


def field(line: Column, separator: str, number: int) -> Column:
    """The number-th (from 1) field of a line."""
    return F.split_part(line, F.lit(separator), F.lit(number))


def normalise(fp: DataFrame, norm: str = "max") -> DataFrame:
    """Instance-wise: v over the entity's largest count (max) or sum (l1); features number from 1."""
    whole = {"max": F.max, "l1": F.sum}[norm]("cnt").alias("_w")
    return fp.join(fp.groupBy("mol_id").agg(whole), "mol_id").select("mol_id", (F.col("feat_id") + 1).alias("feat"), (F.col("cnt") / F.col("_w")).alias("value"))


def fold(fp: DataFrame, hashes: int, size: int) -> DataFrame:
    """Counted Bloom folding: each feature adds its count to up to `hashes` distinct places of `size`."""
    places = F.array_distinct(F.array(*[place("feat_id", i, size) for i in range(hashes)]))
    return fp.select("mol_id", "cnt", F.explode(places).alias("feat_id")).groupBy("mol_id", "feat_id").agg(F.sum("cnt").cast("int").alias("cnt"))


def drop_coordinates(fp: DataFrame, share: float, seed: int) -> tuple[DataFrame, float]:
    """fp without a random share of the feature ids, and the factor 1 / (1 - share) for its sums."""
    drawn = draw("feat_id", seed) < int(share * 2**60)
    return fp.where(~drawn), 1 / (1 - share)
