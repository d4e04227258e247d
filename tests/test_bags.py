"""Bags, similarity and dictionaries against values worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bagforge.functions import bags as B
from bagforge.operators import bags, dictionary, graphs, selection, similarity, statistics, tables

MOLS = {1: "[0:1;1:2;5:1;11:4]", 2: "[1:1;3:2;11:3]", 3: "[]", 4: "[1:2;5:1;11:2]"}


@pytest.fixture(scope="module")
def packed(spark):
    return spark.createDataFrame(list(MOLS.items()), "mol_id long, t string").select("mol_id", B.parse(F.col("t")).alias("bag")).cache()


def random_bags(n=60, seed=3):
    rng = random.Random(seed)
    return {i: {rng.randrange(12): rng.randint(1, 4) for _ in range(rng.randint(1, 6))} for i in range(n)}


def tani(a, b):
    lo = sum(min(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
    hi = sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
    return lo / hi if hi else 0.0


@pytest.fixture(scope="module")
def fp(spark):
    return spark.createDataFrame([(i, k, c) for i, m in random_bags().items() for k, c in m.items()], "mol_id long, feat_id int, cnt int").cache()


def test_codec_and_tanimoto(packed):
    assert {r.mol_id: r.t for r in packed.select("mol_id", B.show(F.col("bag")).alias("t")).collect()} == MOLS
    a, b = packed.select(F.col("mol_id").alias("a"), F.col("bag").alias("x")), packed.select(F.col("mol_id").alias("b"), F.col("bag").alias("y"))
    got = {(r.a, r.b): r.s for r in a.crossJoin(b).select("a", "b", B.tanimoto(F.col("x"), F.col("y")).alias("s")).collect()}
    assert got[1, 1] == got[2, 2] == got[4, 4] == 1 and got[3, 3] == 0
    assert got[1, 2] == 0.4 and got[1, 3] == 0 and got[1, 4] == 5 / 8


@pytest.mark.parametrize("bad", ["[1:1;1:2]", "[2:1;1:1]", "[1:0]", "1:1", "[-1:2]"])
def test_codec_refuses(spark, bad):
    with pytest.raises(Exception):
        spark.createDataFrame([(bad,)], "t string").select(B.parse(F.col("t"))).collect()


@pytest.mark.parametrize("t", [0.3, 0.5, 0.9])
def test_threshold_pairs(fp, t):
    m = random_bags()
    want = {(i, j) for i, j in itertools.combinations(m, 2) if 1 - tani(m[i], m[j]) <= 1 - t}
    got = {(r.a_id, r.b_id): r.tani for r in similarity.threshold_pairs(fp, t).collect()}
    assert got.keys() == want and all(got[p] == pytest.approx(tani(m[p[0]], m[p[1]])) for p in want)


def test_diversify_is_the_greedy_pass(fp):
    m, kept = random_bags(), []
    for i in m:
        if all(1 - tani(m[i], m[k]) > 1 - 0.5 for k in kept):
            kept.append(i)
    assert sorted(r.mol_id for r in selection.diversify(fp, 0.5).collect()) == kept


def test_butina_is_the_greedy_order(fp):
    m, t = random_bags(), 0.5
    near = {i: {j for j in m if i == j or 1 - tani(m[i], m[j]) <= 1 - t} for i in m}
    live, want = set(m), {}
    while live:
        c = min(live, key=lambda i: (-len(near[i] & live), i))
        want |= dict.fromkeys(near[c] & live, c)
        live -= near[c]
    got = graphs.butina(fp, t).collect()
    assert {r.member: r.center for r in got} == want and len(got) == len(m)
    assert all(r["size"] == sum(c == r.center for c in want.values()) for r in got)


def test_spanning_forest(fp):
    edges = sorted((r.d, r.src, r.dst) for r in graphs.distances(fp).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    want = []
    for d, a, b in edges:
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b))
    assert sorted((r.src, r.dst) for r in graphs.spanning_forest(graphs.distances(fp)).collect()) == sorted(want)


def test_pareto(spark):
    rng = random.Random(5)
    p = {(rng.randrange(20), rng.randrange(20), rng.randrange(5)) for _ in range(200)}
    want = {a for a in p if not any(all(y >= x for x, y in zip(a, b)) and a != b for b in p)}
    got = graphs.pareto(spark.createDataFrame(list(p) * 2, "a int, b int, c int").repartition(4), ["a", "b", "c"]).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_dictionaries(spark):
    e = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (1, "c", 5), (1, "a", 1)], "mol_id long, feat string, cnt int")
    assert [(r.feat, r.feat_id, r.stat) for r in dictionary.first_seen(e, "mol_id", "feat", "cnt").orderBy("feat_id").collect()] == [("a", 0, 2), ("b", 1, 1), ("c", 2, 5)]
    d = dictionary.by_frequency(e, "feat", "cnt")
    assert [(r.feat, r.feat_id, r.stat) for r in d.orderBy("feat_id").collect()] == [("c", 0, 5), ("a", 1, 3), ("b", 2, 1)]
    p = dictionary.prune(d, spark.createDataFrame([(1,)], "feat_id long"))
    assert [(r.feat, r.feat_id) for r in p.orderBy("feat_id").collect()] == [("c", 0), ("b", 1)]
    known = d.where("feat = 'c'").withColumn("feat_id", F.col("feat_id") + 1)
    assert {tuple(r) for r in dictionary.apply(e, known, "feat", "zero").collect()} == {(0, 0, 2), (1, 0, 1), (1, 1, 5)}


def test_ranks_and_medians(spark):
    x = spark.createDataFrame([(v,) for v in [-1, 0, 0, 1, 1, 2, 2]], "v int")
    assert sorted(r["rank"] for r in tables.dense_ranks(x, "v").collect()) == [0, 0, 1, 1, 2, 2, 3]
    y = spark.createDataFrame([(v,) for v in [2, 4, 7, 7, 12]], "v int")
    assert sorted(r["rank"] for r in statistics.average_ranks(y, "v").collect()) == [1, 2, 3.5, 3.5, 5]


def test_bloom_and_subset_keep_totals(fp):
    total = fp.agg(F.sum("cnt")).first()[0]
    assert total <= bags.fold(fp, 2, 64).agg(F.sum("cnt")).first()[0] <= 2 * total
    kept, factor = bags.drop_coordinates(fp, 0.5, 1)
    assert factor == 2 and kept.count() < fp.count()


def test_minhash_of_equal_bags(spark):
    fp = spark.createDataFrame([(i, f, 2) for i in (1, 2) for f in (3, 4)] + [(3, 9, 1)], "mol_id long, feat_id int, cnt int")
    got = similarity.minhash_pairs(fp, 16, 4).collect()
    assert [(r.a_id, r.b_id, r.estimate) for r in got] == [(1, 2, 1.0)]


def test_same_results_for_any_partitioning(spark, fp):
    one, many = fp.coalesce(1), fp.repartition(7)
    for f in (lambda x: similarity.threshold_pairs(x, 0.5), lambda x: dictionary.by_frequency(x, "feat_id", "cnt"), lambda x: selection.diversify(x, 0.5)):
        assert sorted(map(tuple, f(one).collect())) == sorted(map(tuple, f(many).collect()))
