"""Shapes of physical plans, indexes, samples and learning."""

import pytest
from pyspark.sql import functions as F

from bagforge.operators import bags, learn, similarity, statistics, tables
from bagforge.plans import catalogue
from bagforge.sources import writers

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tanimoto_pairs", "nearest_neighbour", "tversky_components", "bbad_filter", "dict_apply_zero", "token_bigrams", "uniq_first"])
def test_no_cross_products(spark, name):
    plan = plan_of(catalogue.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_what_they_need(spark):
    plan = plan_of(catalogue.QUERIES["bbad_filter"](spark, DATA))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_totalprice" not in plan
    plan = plan_of(catalogue.order_parts(spark, DATA))
    assert "l_extendedprice" not in plan


def test_index_answers_like_the_bags(spark, tmp_path):
    fp = catalogue.order_parts(spark, DATA)
    writers.write_index(fp, str(tmp_path / "index"), 4)
    again = spark.read.parquet(str(tmp_path / "index")).select("mol_id", "feat_id", "cnt")
    q = fp.where("mol_id = 1")
    assert [tuple(r) for r in similarity.top_k(q, again, 5).collect()] == [tuple(r) for r in similarity.top_k(q, fp, 5).collect()]


def test_samples(spark):
    rows = spark.range(400).select("id", (F.col("id") % 100).cast("double").alias("v"))
    n = statistics.minimal_sample(rows, "id", "v", repeats=1)
    assert 1 < n <= 400
    assert all(0 <= p <= 1 for _, p in statistics.growing_sample(rows, "id", "v", [20, 100]))
    a, b = tables.shuffled(rows, "id", 1, 10).collect(), tables.shuffled(rows.repartition(5), "id", 1, 10).collect()
    assert a == b and tables.shuffled(rows, "id", 2, 10).collect() != a
    assert tables.train_part(rows, "id", 0.8, 3).where("train").count() == 320
    assert sorted(r["count"] for r in tables.folds(rows, "id", 3).groupBy("fold").count().collect()) == [132, 134, 134]


def test_zip_and_lookups_refuse_bad_input(spark):
    a = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "line long, name string, a int")
    b = spark.createDataFrame([(0, "x", 3), (1, "z", 4)], "line long, name string, b int")
    assert tables.zip_lines(a.where("line = 0"), b, "line", "name").count() == 1
    with pytest.raises(Exception):
        tables.zip_lines(a, b, "line", "name").collect()
    with pytest.raises(ValueError):
        tables.exactly(a, 3)


def test_learning(spark):
    fp = spark.createDataFrame([(i, i % 4, 1 + i % 3) for i in range(80)], "mol_id long, feat_id int, cnt int")
    value = fp.select("mol_id", (F.col("feat_id") * 2.0).alias("value"))
    rows = tables.folds(learn.vectors(fp, value, 4), "mol_id", 4).cache()
    got = learn.cross_validated(rows, lambda x: learn.random_forest(x, 5), 4)
    assert statistics.regression(got, "label", "prediction").first().r2 > 0.9
    counts = bags.pack(fp).select("mol_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.element_at("bag", i), F.lit(0)).cast("double")).alias("counts")).join(rows.select("mol_id", "label", "fold"), "mol_id")
    gp = learn.gaussian_process_folds(counts, 500)
    assert gp.count() == 80 and statistics.regression(gp, "label", "mean").first().r2 > 0.9
    with pytest.raises(Exception):
        learn.vectors(fp, value, 3).collect()


def test_z_scores_and_fusion(spark):
    x = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 2.0), ("c", 3.0, 1.0)], "n string, up double, down double")
    merged = tables.merge_scores([tables.zscores(x, "n", "up"), tables.zscores(x, "n", "down", False)], "avg", top=2).collect()
    assert [r.name for r in merged] == ["c", "b"] and merged[0].score == pytest.approx(1.5**0.5)


def test_numbers_survive_a_dropped_cache(spark):
    """Both uses of a numbering read one placement, whatever is cached in between."""
    from bagforge.operators.dictionary import numbered

    rows = spark.range(200_000).select((F.col("id") * 2654435761 % 1_000_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    got = numbered(rows, ["k"], "n")
    spark.catalog.clearCache()
    assert got.count() == 200_000 and got.select("n").distinct().count() == 200_000
    assert got.agg(F.min("n"), F.max("n")).first() == (0, 199_999)
    w = got.select("k", "n").orderBy("n").limit(1000).collect()
    assert [r.k for r in w] == sorted(r.k for r in w)


def test_lines_are_numbered_without_a_sort(spark, tmp_path):
    from bagforge.sources import records

    for name, n in (("b.txt", 3000), ("a.txt", 5000), ("c.txt", 1)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(n)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = records.lines(spark, str(tmp_path))
        assert "RangePartitioning" not in plan_of(df) and "Sort" not in plan_of(df) and df.rdd.getNumPartitions() > 5
        got = [r.value.split()[:2] for r in df.orderBy("line_no").collect()]
        assert [r.line_no for r in df.orderBy("line_no").collect()] == list(range(8001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [[name, str(i)] for name, n in (("a.txt", 5000), ("b.txt", 3000), ("c.txt", 1)) for i in range(n)]


def test_running_sums_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(statistics, "CHUNK", 16)
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 5).alias("_p"))
    got = statistics.running_sums(rows, ["k"], {"up": "_p", "n": "k"}).orderBy("k").collect()
    up = n = 0
    for r in got:
        up, n = up + r["_p"], n + r.k
        assert (r.up, r.n) == (up, n)
    first = statistics.running_sums(rows, ["k"], {"up": "_p"}, before=True).orderBy("k").first()
    assert first.up == 0
    plan = plan_of(statistics.roc_curve(rows, "k", F.col("_p") > 2))
    assert "SinglePartition" not in plan.split("Window")[0]


def test_histogram_options(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 2.5, 4, 9)], "v double")
    get = lambda **kw: [(r.bin, r.start, r.n) for r in statistics.histogram(rows, "v", 4, **kw).orderBy("bin").collect()]
    assert get() == [(0, 1.0, 2), (1, 3.0, 1), (2, 5.0, 0), (3, 7.0, 0), (4, 9.0, 1)] or [n for _, _, n in get()] == [3, 1, 0, 0, 1]
    assert [s for _, s, _ in get(low=-7.0, high=5.0, tail=1)] == [-7.0, -3.0, 1.0, 5.0, 9.0, 13.0]  # bounds only reach further
    assert [n for _, _, n in get(low=2.0, high=6.0, drop=True)] == [2, 0, 1, 0, 0]
    assert sum(n for _, _, n in get(norm=True)) == pytest.approx(1.0)


def test_lookups_over_files(spark):
    names = spark.createDataFrame([(0, "b"), (1, "z"), (2, "a")], "ord int, name string")
    one, two = (spark.createDataFrame(x, "name string, v int") for x in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert [(r.name, r.v) for r in tables.lookup_first(names, [one, two], "name", "ord").collect()] == [("b", 3), ("z", None), ("a", 1)]
    with pytest.raises(Exception):
        tables.lookup_first(names, [one.union(one)], "name", "ord").collect()
    parts = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "w")], "name string, i int, text string")
    assert {r.name: r.text for r in tables.same_name_joined(parts, "name", "text", "i").collect()} == {"a": "x\ny", "b": "w"}


def test_xz_lines(spark, tmp_path):
    import lzma

    from bagforge.sources import records

    for name, n in (("b", 25_000), ("a", 3)):
        with lzma.open(tmp_path / f"{name}.xz", "wt") as f:
            f.write("".join(f"{name}{i}\n" for i in range(n)))
    got = records.xz_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.value for r in got] == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(25_000)] and got[-1].line_no == 25_002


def test_kernels_and_ranges(spark):
    from bagforge.functions import numbers

    x = F.col("id") / 1000.0
    whole = spark.range(2000).agg(F.sum(numbers.kernel(1.5, x)) / 1000).first()[0]
    assert 2 * whole == pytest.approx(2 * 0.5, abs=0.01)
    r = spark.range(1).select(numbers.kernel(2.0, F.lit(2.0)).alias("z"), numbers.triweight(F.lit(0.0)).alias("t"), numbers.approx_equal(0.5, F.lit(1.0), F.lit(1.5)).alias("a"), numbers.each_within(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("m")).first()
    assert tuple(r) == (0.0, 35 / 32, True, False)


def test_unreadable_molecules_keep_their_rows(spark):
    from bagforge.operators import encode

    mols = spark.createDataFrame([(0, "a", "CCO"), (1, "b", "C(("), (2, "c", None)], "idx long, name string, smiles string")
    got = {r.name: r for r in encode.properties(mols).collect()}
    assert got["a"].formula == "C2H6O" and got["a"].error is None and got["b"].formula is None and got["b"].error and got["c"].error
    types = encode.typed(spark.createDataFrame([(0, "x", "C1CC1O")], "idx long, name string, smiles string"), "daylight").first().types
    assert types == ["(6,2,2,2,0,1)", "(6,2,2,2,0,1)", "(6,3,1,3,0,1)", "(8,1,1,1,0,0)"]


def test_kernels_of_gaussian_processes():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (120, 8)).astype(float)
    y = x[:, 0] - x[:, 1] + 0.05 * rng.standard_normal(120)
    for kernel in ("tanimoto", "flexible", "rbf"):
        mean, sd = learn.gaussian_process(x[:90], y[:90], x[90:], kernel=kernel)
        assert np.corrcoef(mean, y[90:])[0, 1] > 0.8 and (sd > 0).all()
        p = learn.gaussian_classifier(x[:90], (y[:90] > 0).astype(int), x[90:], "tanimoto" if kernel != "rbf" else "rbf")
        assert ((p > 0.5) == (y[90:] > 0)).mean() > 0.75 and ((p > 0) & (p < 1)).all()


def test_models_are_kept(spark, tmp_path):
    fp = spark.createDataFrame([(i, i % 4, 1 + i % 3) for i in range(80)], "mol_id long, feat_id int, cnt int")
    rows = learn.vectors(fp, fp.select("mol_id", (F.col("feat_id") > 1).cast("int").alias("value")), 4).cache()
    for k, model in enumerate((learn.random_forest(rows, 5), learn.random_forest(rows, 5, classify=True), learn.elastic_net(rows))):
        learn.save(model, str(tmp_path / str(k)))
        again = learn.load(str(tmp_path / str(k)))
        assert [r.prediction for r in again.transform(rows).collect()] == [r.prediction for r in model.transform(rows).collect()]


def test_nearest_lines_and_merged_points(spark):
    from bagforge.operators import molecules
    from bagforge.sources import records

    mols = lambda *x: spark.createDataFrame([(i, *m) for i, m in enumerate(x)], "idx long, name string, smiles string")
    got = molecules.nearest_lines(mols(("q", "CCCO"), ("none", "[Na]")), mols(("a", "CCO"), ("b", "CCCO"), ("c", "CCCO")), 0.3).orderBy("idx", "line").collect()
    assert [r.value for r in got] == ["CCCO\tq", "CCCO\tb_T=1.00"]
    points = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 9.0, 0.0, 0.0), ("n", 0, 1.0, 1.0, 1.0)], "mol string, at int, x double, y double, z double")
    assert sorted(map(tuple, molecules.merged_points(points).collect())) == [("m", 0.5, 0.0, 0.0), ("m", 9.0, 0.0, 0.0), ("n", 1.0, 1.0, 1.0)]
    lines = spark.createDataFrame([(0, "CCO one two"), (1, "CC")], "line_no long, value string")
    assert [r.name for r in records.smiles(lines, "second").collect()] == ["one", "CC"]


def test_fronts_in_blocks(spark, monkeypatch):
    from bagforge.operators import graphs

    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("x"), ((F.col("id") * 104729 % 2999) - F.col("id") * 7919 % 3001).alias("y"))
    one = sorted(map(tuple, graphs.pareto(rows, ["x", "y"]).collect()))
    monkeypatch.setattr(graphs, "FRONT_BLOCK", 7)
    assert sorted(map(tuple, graphs.pareto(rows, ["x", "y"]).collect())) == one and len(one) > 5
    points = [tuple(r) for r in rows.distinct().collect()]
    assert one == sorted(p for p in points if not any(q[0] >= p[0] and q[1] >= p[1] and q != p for q in points))
