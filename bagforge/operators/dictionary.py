"""Feature dictionaries: how ids are given, and what happens to features that a fixed dictionary lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import scratch


def numbered(rows: DataFrame, order: list, out: str, start: int = 0) -> DataFrame:
    """Adds out: gapless numbers from start in the given order, without a window over everything in one task.

    Rows are range-partitioned by the order; a partition's numbers start where the sizes of those before it end. The
    placed rows are written and read back: range bounds are sampled anew whenever a plan runs again, so that both
    uses must read one placement.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_num_part", F.spark_partition_id())
    placed = placed.withColumn("_num_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_num_part").cast("long"), 33))
    placed = scratch(placed, "numbered")
    sizes = placed.groupBy("_num_part").count()
    ahead = F.coalesce(F.sum("count").over(Window.orderBy("_num_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    before = sizes.select("_num_part", ahead.alias("_num_ahead"))
    return placed.join(F.broadcast(before), "_num_part").withColumn(out, (F.col("_num_row") + F.col("_num_ahead") + start).cast("long")).drop("_num_part", "_num_row", "_num_ahead")


def first_seen(enc: DataFrame, idx: str, feat: str, cnt: str, base: int = 0) -> DataFrame:
    """(feat, feat_id, stat): ids in the order entities show features, then by feature; stat is the largest count."""
    one = enc.groupBy(F.col(feat).alias("feat")).agg(F.min(idx).alias("_first"), F.max(cnt).cast("long").alias("stat"))
    return numbered(one, ["_first", "feat"], "feat_id", base).select("feat", "feat_id", "stat")


def by_frequency(enc: DataFrame, feat: str, cnt: str) -> DataFrame:
    """(feat, feat_id, stat): ids by total count, then feature, both falling; the same for any order of input."""
    one = enc.groupBy(F.col(feat).alias("feat")).agg(F.sum(cnt).cast("long").alias("stat"))
    return numbered(one, [F.desc("stat"), F.desc("feat")], "feat_id").select("feat", "feat_id", "stat")


def apply(enc: DataFrame, dictionary: DataFrame, feat: str, unknown: str = "drop") -> DataFrame:
    """(mol_id, feat_id, cnt) by a fixed dictionary.

    unknown='drop' leaves out what it lacks; 'zero' counts each distinct one once under id 0.
    """
    if unknown == "drop":
        return enc.join(dictionary.select(F.col("feat").alias(feat), "feat_id"), feat).select("mol_id", "feat_id", "cnt")
    found = enc.join(dictionary.select(F.col("feat").alias(feat), "feat_id"), feat, "left")
    count = F.when(F.col("feat_id").isNull(), 1).otherwise(F.col("cnt"))
    return found.groupBy("mol_id", F.coalesce("feat_id", F.lit(0)).alias("feat_id")).agg(F.sum(count).cast("int").alias("cnt"))


def prune(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """The dictionary without ids(feat_id), renumbered from 0 in the old order."""
    return numbered(dictionary.join(ids, "feat_id", "left_anti").withColumnRenamed("feat_id", "_old"), ["_old"], "feat_id").select("feat", "feat_id", "stat")


def words(tokens: DataFrame, word: str) -> DataFrame:
    """(word, word_id, n): ids from 3 by falling frequency, then word; 0 pads, 1 starts, 2 is unknown."""
    one = tokens.groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(one, [F.desc("n"), "word"], "word_id", 3).select("word", "word_id", "n")
