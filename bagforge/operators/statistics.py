"""Entropy, ranks, tests, metrics and histograms as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dictionary import numbered


#: Rows in order whose sums one task runs up.
CHUNK = 4096


def running_sums(rows: DataFrame, order: list, sums: dict[str, str], before: bool = False) -> DataFrame:
    """rows with sums {out: column} over all rows up to each in order (before: up to the one ahead, 0 for the first).

    Rows are numbered and summed by chunks; a chunk starts from the sums of the chunks ahead, a row each, so no window
    takes all rows into one task.
    """
    placed = numbered(rows, order, "_place").withColumn("_chunk", F.floor(F.col("_place") / CHUNK))
    names = list(sums)
    parts = placed.groupBy("_chunk").agg(*[F.sum(sums[o]).alias(f"_s{i}") for i, o in enumerate(names)])
    past = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("_chunk", *[F.coalesce(F.sum(f"_s{i}").over(past), F.lit(0)).alias(f"_a{i}") for i in range(len(names))])
    own = Window.partitionBy("_chunk").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    run = placed.select("*", *[F.coalesce(F.sum(sums[o]).over(own), F.lit(0)).alias(f"_w{i}") for i, o in enumerate(names)])
    return run.join(ahead, "_chunk").select(*[F.col(c) for c in rows.columns], *[(F.col(f"_a{i}") + F.col(f"_w{i}")).alias(o) for i, o in enumerate(names)])


def entropy(fp: DataFrame) -> DataFrame:
    """(feat_id, entropy, before): Shannon entropy in bits of each feature's counts over all occurrences, positive ones.

    before sums the entropies of the features ahead, by falling entropy then feature.
    """
    n = fp.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    per = fp.groupBy("feat_id", "cnt").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n))
    p = F.col("k") / F.col("_n")
    one = per.groupBy("feat_id").agg(F.sum(-p * F.log2(p)).alias("entropy")).where("entropy > 0")
    return running_sums(one.withColumn("_r", F.round("entropy", 9)), [F.desc("_r"), "feat_id"], {"before": "entropy"}, before=True).drop("_r")


def average_ranks(rows: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Adds out: ranks from 1, equal values at their mean rank. Distinct values are what gets ordered."""
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).where("_v is not null")
    ranks = running_sums(counts, ["_v"], {"_b": "_c"}, before=True).select("_v", (F.col("_b") + (F.col("_c") + 1) / 2).alias(out))
    return rows.join(ranks, rows[value] == ranks["_v"], "left").drop("_v")


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, r and the approximate two-sided p (normal tail of Fisher's z)."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    z = 0.5 * F.log((1 + F.col("r")) / (1 - F.col("r"))) * F.sqrt(F.col("n") - 3.0)
    return one.select("n", "r", (2 * normal_tail(F.abs(z))).alias("p"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    return average_ranks(average_ranks(rows, x, "_rx"), y, "_ry").agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("r"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, z >= 0, by the five-term polynomial of Abramowitz and Stegun, 26.2.17."""
    # Its coefficients
    k = 1 / (1 + 0.2316419 * z)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def wilcoxon(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: n1, n2, rank sum of the rows where first holds, z and two-sided p by the normal approximation."""
    r = average_ranks(rows.withColumn("_g", first), value, "_r")
    one = r.agg(F.sum(F.when(F.col("_g"), 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("_g"), 0).otherwise(1)).alias("n2"), F.sum(F.when(F.col("_g"), F.col("_r")).otherwise(0.0)).alias("w"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    z = (F.col("w") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return one.select("n1", "n2", "w", z.alias("z"), (2 * normal_tail(F.abs(z))).alias("p"))


def regression(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: r2 (1 - residual over total squares) and rmse."""
    mean = rows.agg(F.avg(truth).alias("_m"))
    e, t = F.col(truth) - F.col(predicted), F.col(truth) - F.col("_m")
    return rows.join(F.broadcast(mean)).agg((1 - F.sum(e * e) / F.sum(t * t)).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def roc_auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: area under the ROC curve from mean ranks."""
    r = average_ranks(rows.withColumn("_y", positive), score, "_r")
    one = r.agg(F.sum(F.when(F.col("_y"), F.col("_r"))).alias("s"), F.sum(F.when(F.col("_y"), 1).otherwise(0)).cast("double").alias("p"), F.sum(F.when(F.col("_y"), 0).otherwise(1)).cast("double").alias("n"))
    return one.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))


def roc_curve(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """(score, tpr, fpr) at each distinct score, from the highest."""
    c = rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("_p"), F.sum(F.when(positive, 0).otherwise(1)).alias("_n"))
    total = c.agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    run = running_sums(c, [F.desc("score")], {"_up": "_p", "_un": "_n"})
    return run.join(F.broadcast(total)).select("score", (F.col("_up") / F.col("_tp")).alias("tpr"), (F.col("_un") / F.col("_tn")).alias("fpr"))


def matthews(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: Matthews correlation, 0 where a margin is empty."""
    count = lambda a, b, n: F.sum(F.when(a & b, 1.0).otherwise(0.0)).alias(n)
    c = rows.agg(count(truth, predicted, "tp"), count(~truth, ~predicted, "tn"), count(~truth, predicted, "fp"), count(truth, ~predicted, "fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(F.when(bottom == 0, 0.0).otherwise((tp * tn - fp * fn) / bottom).alias("mcc"))


def histogram(rows: DataFrame, value: str, steps: int, low: float | None = None, high: float | None = None, drop: bool = False, norm: bool = False, tail: int = 0) -> DataFrame:
    """(bin, start, n) for bins 0 to steps + tail; bin = floor((x - low) / width); empty bins are there.

    Bounds come from the data, and reach to low and high where these are given and lie beyond. drop: values beyond low
    and high are left out instead, and bounds are exactly those. norm: n is the share of all values counted.
    """
    found = rows.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    ends = [F.lit(x).cast("double") for x in (low, high)]
    bounds = found.select(*[end if drop and x is not None else (pick(F.col(c).cast("double"), end) if x is not None else F.col(c).cast("double")) for x, end, c, pick in ((low, ends[0], "_min", F.least), (high, ends[1], "_max", F.greatest))]).toDF("_lo", "_hi")
    width = (F.col("_hi") - F.col("_lo")) / steps
    x = rows.join(F.broadcast(bounds)).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    n = x.groupBy(F.floor((F.col(value) - F.col("_lo")) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = bounds.select(F.explode(F.sequence(F.lit(0), F.lit(steps + tail))).alias("bin"), "_lo", width.alias("_w"))
    out = bins.join(n, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))
    return out if not norm else out.join(F.broadcast(out.agg(F.sum("n").alias("_all")))).select("bin", "start", (F.col("n") / F.col("_all")).alias("n"))


def two_sample_ks(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: largest difference of the two distribution functions, n1, n2."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    c = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = c.agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"))
    run = running_sums(c, ["v"], {"_ux": "x", "_uy": "y"})
    d = run.join(F.broadcast(total)).select("n1", "n2", F.abs(F.col("_ux") / F.col("n1") - F.col("_uy") / F.col("n2")).alias("d"))
    return d.groupBy("n1", "n2").agg(F.max("d").alias("d"))


def two_sample_histogram(a: DataFrame, b: DataFrame, value: str, steps: int) -> DataFrame:
    """(bin, start, fa, fb): frequencies of both over shared bounds."""
    lo, hi = a.select(value).unionByName(b.select(value)).agg(F.min(value), F.max(value)).first()
    na, nb = a.count(), b.count()
    x, y = histogram(a, value, steps, lo, hi), histogram(b, value, steps, lo, hi)
    return x.select("bin", "start", (F.col("n") / na).alias("fa")).join(y.select("bin", (F.col("n") / nb).alias("fb")), "bin")


def ks_p(d: float, n1: int, n2: int) -> float:
    """Asymptotic p of a two-sample Kolmogorov-Smirnov difference."""
    if d <= 0:
        return 1.0
    x = math.sqrt(n1 * n2 / (n1 + n2)) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def minimal_sample(rows: DataFrame, key: str, value: str, sure: float = 0.95, repeats: int = 50, seed: int = 1) -> int:
    """Rows of a random sample that a Kolmogorov-Smirnov test can't tell from the whole (p > sure): the most over repeated halvings.

    Each step of a halving is one distributed test; the driver only steers.
    """
    n, worst = rows.count(), 0
    for r in range(repeats):
        placed = numbered(rows.select(value, F.xxhash64(key, F.lit(seed + r)).alias("_h")), ["_h", value], "_n").cache()
        low, high = 1, n
        while low < high:
            mid = (low + high) // 2
            d = two_sample_ks(placed.where(F.col("_n") < mid), rows, value).first()
            low, high = (low, mid) if d and ks_p(d.d, d.n1, d.n2) > sure else (mid + 1, high)
        placed.unpersist()
        worst = max(worst, low)
    return worst


def growing_sample(rows: DataFrame, key: str, value: str, sizes: list[int], seed: int = 1) -> list[tuple[int, float]]:
    """(size, p) of the rank-sum test between the first `size` rows of a seeded order and the rest of the next as many."""
    placed = numbered(rows.select(value, F.xxhash64(key, F.lit(seed)).alias("_h")), ["_h", value], "_n").cache()
    out = []
    for size in sizes:
        one = wilcoxon(placed.where(F.col("_n") < 2 * size), value, F.col("_n") < size).first()
        out.append((size, one.p))
    return out
