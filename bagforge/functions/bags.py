"""Column expressions over bags: a bag is a map from feature id to a positive count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(bag: Column) -> Column:
    """Sum of counts."""
    return F.aggregate(F.map_values(bag), F.lit(0).cast("long"), lambda a, x: a + x)


def common(a: Column, b: Column) -> Column:
    """Sum over features of the smaller count."""
    return F.aggregate(F.map_entries(a), F.lit(0).cast("long"), lambda s, e: s + F.least(e["value"], F.coalesce(F.element_at(b, e["key"]), F.lit(0))))


def tanimoto_of(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Sum of minima over sum of maxima; 0 for two empty bags."""
    whole = size_a + size_b - shared
    return F.when(whole == 0, F.lit(0.0)).otherwise(shared.cast("double") / whole)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def tanimoto(a: Column, b: Column) -> Column:
    return once(common(a, b), lambda i: tanimoto_of(i, size(a), size(b)))


def parse(text: Column) -> Column:
    """Bag of a `[k:v;k:v]` text; fails unless keys rise from 0 and counts are positive."""
    inner = F.regexp_extract(text, r"^\[(.*)\]$", 1)
    pairs = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ";"))
    keys = F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(1)).cast("int"))
    counts = F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(2)).cast("int"))
    rising = F.aggregate(keys, F.lit(-1), lambda last, k: F.when((last >= -1) & (k > last), k).otherwise(F.lit(-2))) >= -1
    good = text.rlike(r"^\[.*\]$") & rising & F.forall(counts, lambda c: c > 0)
    return F.when(F.assert_true(good, F.concat(F.lit("not a bag: "), text)).isNull(), F.map_from_arrays(keys, counts))


def show(bag: Column) -> Column:
    """The `[k:v;k:v]` text of a bag, keys rising."""
    entries = F.array_sort(F.transform(F.map_entries(bag), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["k"], e["v"])), ";"), F.lit("]"))


def dense(bag: Column, n: int) -> Column:
    """Counts of features 0 to n - 1; 0 where the bag has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(bag, i), F.lit(0)))


def highest(bag: Column) -> Column:
    """Largest feature id, null for an empty bag."""
    return F.array_max(F.map_keys(bag))


def drop_features(bag: Column, ids: list[int]) -> Column:
    return F.map_filter(bag, lambda k, _: ~k.isin(ids)) if ids else bag


def liblinear(label: Column, bag: Column) -> Column:
    """`+1 k:v ...` with feature numbers from 1."""
    entries = F.array_sort(F.transform(F.map_entries(bag), lambda e: F.struct((e["key"] + 1).alias("k"), e["value"].alias("v"))))
    return F.concat_ws(" ", F.when(label, "+1").otherwise("-1"), F.transform(entries, lambda e: F.concat_ws(":", e["k"], e["v"])))


def bits(text: Column) -> Column:
    """1-based places of the ones in a text of zeros and ones."""
    chars = F.split(text, "")
    return F.filter(F.transform(chars, lambda c, i: F.when(c == "1", i + 1)), lambda i: i.isNotNull())


def is_active(name: Column) -> Column:
    return name.startswith("active")
