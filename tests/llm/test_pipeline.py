"""The pipeline's stages, each held against its operator, on the smallest tables."""

import zlib

import corpus_pipeline
from bagforge.llm import decontaminate, pii, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{DATA}/documents.parquet"), None
    columns = docs.columns
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == columns
        kept.append((docs, new))
        docs = new
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").distinct().collect())
    before, after = kept[0]
    toxic = {r.doc_id for r in toxicity.score(before, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    assert toxic and ids(after) == sorted(set(ids(before)) - toxic)
    before, after = kept[1]
    assert ids(after) == sorted({r.component_id for r in simhash.simhash_groups(before).collect()}) and len(ids(after)) < len(ids(before))
    before, after = kept[2]
    bad = {r.doc_id for r in decontaminate.decontaminate(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()}
    assert ids(after) == sorted(set(ids(before)) - bad)
    before, after = kept[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    changed = 0
    for r in after.collect():
        assert not pii.base_spans(r.text) and (r.text == texts[r.doc_id] or r.n_chars == len(r.text))
        changed += r.text != texts[r.doc_id]
    assert changed == sum(bool(pii.base_spans(t)) for t in texts.values())
    before, after = kept[4]
    assert ids(before) == ids(after)
    assert zlib.crc32(b"") == 0 and sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()) == ids(after)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, columns whose names the operators use, and no rows at all."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    plain = "a plain story of a ship that sails home over a calm sea in spring"
    rows = [
        (None, None, None, None, None, "h", 1), (1, None, "en", "s", 0, "h", 1), (2, "", "en", "s", 0, "h", 1), (3, "   ", "en", "s", 3, "h", 1),
        (4, plain, "en", "s", 65, "h", 1), (4, plain, "en", "s", 65, "h", 1), (None, plain, "en", "s", 65, "h", 1), (5, f"before it {bench} and after", None, None, None, None, None),
        (6, "write to me@mail.example.com or call +1 (988) 555-2485 any day of the week", "en", "s", 72, "h", 1), (7, "x" * 50_000, "en", "s", 50_000, "h", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string, fp int").repartition(3)
    for name, df in (("odd", docs), ("none", docs.limit(0))):
        columns, kept = df.columns, []
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, df, DATA).write.parquet(str(tmp_path / name / stage))
            df = spark.read.parquet(str(tmp_path / name / stage))
            kept.append(df)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert df.columns == columns
        if name == "none":
            assert all(d.count() == 0 for d in kept)
    toxic, near, clean, private, packed = kept_of(spark, tmp_path / "odd")
    assert len(toxic) == len(rows)
    ids = [r.doc_id for r in near]
    assert ids.count(4) == 1 and None not in ids and 1 in ids and 2 not in ids and 3 not in ids  # null and empty texts are one group
    assert 5 not in [r.doc_id for r in clean] and {1, 4, 6, 7} == {r.doc_id for r in clean}
    said = {r.doc_id: r for r in private}
    assert said[6].text == "write to <EMAIL> or call <PHONE> any day of the week" and said[6].n_chars == len(said[6].text) and said[1].text is None and said[4].text == plain
    assert {r.doc_id for r in packed} == {1, 4, 6, 7}


def kept_of(spark, folder):
    return [spark.read.parquet(str(folder / name)).collect() for name, _ in corpus_pipeline.STAGES]
