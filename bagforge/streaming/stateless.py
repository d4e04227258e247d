"""Operators of fixed references over unbounded text: each is a stream-static join or a row-wise expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bags as B


def fingerprints(lines: DataFrame) -> DataFrame:
    """(name, value, bag) of a stream of `name,value,[k:v;...]` lines; others are left out."""
    good = lines.where(F.col("value").rlike(r"^[^,]*,\s*[-+0-9.eE]+,\[(\d+:[1-9]\d*(;\d+:[1-9]\d*)*)?\]$"))
    part = lambda i: F.regexp_extract("value", r"^([^,]*),([^,]*),(\[.*\])$", i)
    return good.select(part(1).alias("name"), part(2).cast("double").alias("val"), B.parse(part(3)).alias("bag")).withColumnRenamed("val", "value")


#: Features of a domain that one broadcast map holds at most (some 100 MB).
MOST_FEATURES = 2_000_000


def within_box(mols: DataFrame, domain: DataFrame) -> DataFrame:
    """Bags whose counts stay within a fixed domain (feat_id, max_cnt), packed into one broadcast map: a domain has one row a feature, and more than MOST_FEATURES are an error."""
    few = domain.limit(MOST_FEATURES + 1)
    fits = F.assert_true(F.count(F.lit(1)) <= MOST_FEATURES, F.lit("the domain has too many features to be broadcast")).isNull()
    packed = few.agg(fits.alias("_fits"), F.map_from_entries(F.collect_list(F.struct("feat_id", "max_cnt"))).alias("_box")).where("_fits").drop("_fits")
    inside = F.forall(F.map_entries("bag"), lambda e: e["value"] <= F.coalesce(F.element_at("_box", e["key"]), F.lit(0)))
    return mols.join(F.broadcast(packed)).where(inside).drop("_box")


def first_seen(rows: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
