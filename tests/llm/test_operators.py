"""The pipeline operators against brute force on small tables, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bagforge.llm import components, decontaminate, embeddings, licenses, links, packing, pii, quality, sharding, simhash, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, id long, part int, fp string, k string, word string, n int"


def prose(rng, n, words=("the", "of", "license", "mit", "under", "cc", "by", "nc", "Haus", "été", "x1", "42")):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [prose(rng, n) for n in (0, 1, 2, 3, 5, 40, 200, 900) for _ in range(4)]
    same = "one text that many documents share, word for word. " * 8
    near = [same.replace("many", f"many{i}", 1) for i in range(6)]
    odd = [None, "", "   \n\t", "\x00\x01", "🙂 漢字 ß É", "a" * 30_000, "@" * 50 + "a@b.c", "1.2.3.4" * 30, "+1 (988) 555-2485 call 4111 1111 1111 1111 me@mail.example.com"]
    return base + [same] * 20 + near + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Odd texts, repeated rows, null ids, and extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", 7, 1, "f", "k", "w", 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a text without an id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def classes(edges, nodes):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


# ---- shared parts


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    want = classes(edges, {n for e in edges for n in e})
    assert got == {n: want[n] for n in nodes}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_forest_and_tiny_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 5, 40):
        near = rng.random((n, n)) < 0.1
        near |= near.T
        got = classes([(i, j) for i, js in links.forest(n, lambda i, rest: near[i, rest]) for j in js.tolist()], range(n))
        assert got == classes([(i, j) for i in range(n) for j in range(n) if near[i, j]], range(n))
    a, b = links.tiny_pairs(np.array([0, 3, 4, 4 + links.TINY + 1, 4 + links.TINY + 3]))
    assert set(zip(a.tolist(), b.tolist())) == {(0, 1), (1, 2), (0, 2), (4 + links.TINY + 1, 4 + links.TINY + 2)}


def test_very_long_texts(spark):
    """A megabyte of one character or word in a row, for every operator that reads text."""
    import public_tokenizers

    n = 1_000_000
    texts = [" " * n, "\n" * n, "a" * n, "🙂" * (n // 4), "漢" * (n // 3), "a " * (n // 2), "1" * n, "1 " * (n // 2), "@" * n, "a@b." * (n // 4), "mit license " * (n // 12), "1.2.3.4 " * (n // 8), "\u3000" * (n // 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    per_row = [
        sharding.balanced_shards(docs, 4), quality.quality(docs), licenses.license_scan(docs), pii.find_personal_data(docs), decontaminate.decontaminate(docs, bench),
        token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")), simhash.simhash_groups(docs), toxicity.score(docs, labels), pii.redact(docs), simhash.without_near_duplicates(docs),
    ]
    for df in per_row:
        assert len({r[0] for r in df.select("doc_id").collect()}) >= len(texts) - 5 * (df is per_row[-1])
    packed = packing.pack(docs, packing.vocabulary_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(packed) == len(texts) and all(r.n == r.t for r in packed)


# ---- 1


@pytest.mark.parametrize("block", [512, 8])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.standard_normal(16) * (0.02 if i % 3 else 0.3)
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(300 + i, rows[5][1], 1) for i in range(30)] + [(340, (2 * np.array(rows[5][1])).tolist(), 1)]
    usable = len(rows)
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, rows[5][1], None), (905, [], 1), (906, [1.0, 2.0], 1), (907, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, grp string, m int")
    got = {r.vec_id: r for r in embeddings.embedding_groups(df.repartition(3)).collect()}
    x = np.array([np.array(r[1], np.float32).astype(float) for r in rows[:usable]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:usable]])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    ids = [r[0] for r in rows[:usable]]
    want = classes([(ids[i], ids[j]) for i, j in zip(*np.nonzero(link))], ids)
    assert len(got) == len(rows)
    for k, i in enumerate(ids):
        assert got[i].n_links == link[k].sum() and got[i].component_id == want[i] and got[i].kept == (i == want[i])
    for r in rows[usable:]:
        assert got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] and got[r[0]].kept
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_embeddings_of_extreme_lengths(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1e-200, 3e-200]), (5, [5e-324, 5e-324]), (6, [1e308, -1e308]), (7, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_groups(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6), 7: (0, 7)}


# ---- 2


def test_differencing_by_brute_force():
    assert [s for s, _ in sharding.differencing([[(w, [i])] for i, w in enumerate([8, 7, 6, 5, 4])], 2)] == [16, 14]
    rng = random.Random(1)
    w = [rng.randint(1, 1000) for _ in range(400)]
    done = sharding.differencing([[(x, [i])] for i, x in enumerate(w)], 7)
    assert sorted(i for _, m in done for i in m) == list(range(400)) and all(s == sum(w[i] for i in m) for s, m in done)
    assert done[0][0] - done[-1][0] <= 3


@pytest.mark.parametrize("items", [20_000, 7])
def test_sharding(spark, docs, empty, texts, monkeypatch, items):
    monkeypatch.setattr(sharding, "ITEMS", items)
    got = sharding.balanced_shards(docs, 5).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for r in got:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    at = {}
    for r in got:
        if r.doc_id is not None:
            at.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert all(len(s) == 1 for t, s in at.items())
    assert sharding.balanced_shards(empty).count() == 0


def test_partition_levels_around_what_outweighs_a_share():
    rng = random.Random(5)
    w = [10_000, 6000, *(rng.randint(1, 90) for _ in range(300))]
    at = sharding.partition(w, 6)
    sums = [sum(x for x, s in zip(w, at) if s == k) for k in range(6)]
    assert sums[0] == 10_000 and sums[1] == 6000 and max(sums[2:]) - min(sums[2:]) <= 3
    light = [rng.randint(1, 1000) for _ in range(400)]
    done = sharding.differencing([[(x, [i])] for i, x in enumerate(light)], 7)
    at = sharding.partition(light, 7)
    sums = sorted(sum(x for x, s in zip(light, at) if s == k) for k in range(7))
    assert sums[-1] - sums[0] == done[0][0] - done[-1][0]
    assert sharding.partition([], 4).tolist() == [] and sorted(sharding.partition([5, 5], 4).tolist()) in ([0, 1], [0, 3])
    assert len(set(sharding.partition([1] * 4, 4).tolist())) == 4


@pytest.mark.parametrize("items", [20_000, 100])
def test_equal_texts_share_a_shard_at_any_weight(spark, monkeypatch, items):
    monkeypatch.setattr(sharding, "ITEMS", items)
    rng = random.Random(2)
    texts = ["same " * 50] * 500 + ["other " * 30] * 40 + [f"text {i} " * rng.randint(1, 20) for i in range(600)]
    got = sharding.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 10).collect()
    at, sums = {}, {}
    for r in got:
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in at.values()) and len(sums) == 10
    (alone,) = at["same " * 50]
    assert sums.pop(alone) == 500 * (250 + 16)
    if items > len(at):  # the spread of one differencing over all other groups
        w = {}
        for t in texts[500:]:
            w[t] = w.get(t, 0) + len(t) + 16
        done = sharding.differencing([[(x, [0])] for x in w.values()], 9)
        assert max(sums.values()) - min(sums.values()) == done[0][0] - done[-1][0]
    assert max(sums.values()) < 1.1 * min(sums.values())


# ---- 3


def test_quality(spark, docs, empty):
    votes = {"++++": 900, "+++0": 100, "--++": 60, "++--": 50, "-0+-": 10}
    good, _ = quality.posteriors(votes)
    assert good["++++"] > 0.95 and good["+++0"] > 0.9 and max(good["--++"], good["++--"], good["-0+-"]) < 0.1
    got = quality.quality(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    assert quality.quality(empty).count() == 0


def test_accuracies_by_direct_expectation_maximisation():
    """Patterns drawn from known labellers: the estimates against plain loops over rows, and against the truth."""
    rng = random.Random(5)
    right = [0.95, 0.9, 0.85, 0.8]  # P(vote is right)
    patterns = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = "".join("0" if rng.random() < 0.2 else "+" if good == (rng.random() < r) else "-" for r in right)
        patterns[votes] = patterns.get(votes, 0) + 1
    got, theta = quality.posteriors(patterns)
    p, t = 0.85, [{True: {"-": 0.02, "+": 0.98}, False: {"-": 0.3, "+": 0.7}} for _ in right]
    for _ in range(60):
        post = {}
        for v in patterns:
            like = {g: (p if g else 1 - p) for g in (True, False)}
            for j, c in enumerate(v):
                for g in like:
                    like[g] *= t[j][g].get(c, 1.0)
            post[v] = like[True] / (like[True] + like[False])
        for j in range(len(right)):
            for g in (True, False):
                mass = {c: sum((post[v] if g else 1 - post[v]) * n for v, n in patterns.items() if v[j] == c) for c in "+-"}
                t[j][g] = {c: (mass[c] + 0.5) / (mass["+"] + mass["-"] + 1) for c in "+-"}
        p = sum(post[v] * n for v, n in patterns.items()) / sum(patterns.values())
    assert all(got[v] == pytest.approx(post[v], abs=1e-6) for v in patterns)
    assert all(theta[j, 1, 2] == pytest.approx(r, abs=0.04) for j, r in enumerate(right))


def test_scorer_learns_a_linear_rule():
    rng = np.random.default_rng(1)
    h = quality.Hasher()
    texts = [" ".join(rng.choice(["good", "fine", "bad", "poor", "neutral"], 12, p=[0.4, 0.3, 0.05, 0.05, 0.2] if i % 2 else [0.05, 0.05, 0.4, 0.3, 0.2])).encode() for i in range(400)]
    rows = [(*h.features(t, quality.measure(t)), float(i % 2)) for i, t in enumerate(texts)]
    w = quality.train(rows[:300])
    p = [1 / (1 + np.exp(-(w[a] @ x))) for a, x, _ in rows[300:]]
    assert np.mean([(x > 0.5) == (y > 0.5) for x, (_, _, y) in zip(p, rows[300:])]) > 0.95


def test_samples_are_bounded_where_ids_are_one(spark):
    """Null ids and one id throughout: the sample is neither empty nor all."""
    from bagforge.llm import common

    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    n = common.bounded_sample(df, 500, 5000, "doc_id", "text").count()
    assert 400 <= n <= 500
    assert common.bounded_sample(spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text")), 500, 5000, "doc_id", "text").count() <= 500


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    m = quality.op3_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in m}
    assert n.get((1, True), 0) >= 0.95 * sum(v for k, v in n.items() if k[0] == 1)
    assert n.get((0, False), 0) >= 0.9 * sum(v for k, v in n.items() if k[0] == 0)


# ---- 4


def base_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), at


def test_licenses(docs, empty, texts):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    found = 0
    for i, t in enumerate(texts):
        n, at = base_of(t)
        r, places = got[i], [p for p, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (not at or r.score == 1)
        found += len(at)
    assert found and licenses.license_scan(empty).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(6)
    seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(8)]
    a = licenses.Automaton(seqs)
    text = [rng.randrange(5) for _ in range(200)]
    for i, (v, n) in enumerate(a.stream(text)):
        held = [m for m in range(i + 2) if m == 0 or any(s[j : j + m] == text[i + 1 - m : i + 1] for s in seqs for j in range(len(s) - m + 1))]
        assert n == max(held)
        ends = {(k, j) for k, s in enumerate(seqs) for j in range(len(s)) if n and s[j + 1 - n : j + 1] == text[i + 1 - n : i + 1] and j + 1 >= n}
        assert not n or {e for e in a.ends[v] if e[1] + 1 >= n} == ends
        whole = {k for k, s in enumerate(seqs) if len(s) <= n and text[i + 1 - len(s) : i + 1] == s}
        assert {k for m, k in a.whole[v] if m <= n} == whole


def test_license_with_an_edit():
    text = "Permission is hereby granted, free of charge, to any human obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    x = licenses.Scanner().scan(("intro words here. " + text + " and more").encode())
    assert [label for label, *_ in x["spans"]] == ["mit"] and 0.9 < x["score"] < 1 and not x["places"]


def test_chains_by_brute_force():
    """The best chain at each match against all orders of matches, by the words that lie under them."""
    import itertools

    rng = random.Random(3)
    template = " ".join(f"w{i}" for i in range(14))
    s = licenses.Scanner(templates=[("x", template)])
    k = len(s.sequences) - 1
    for _ in range(200):
        found = set()
        for _ in range(rng.randint(1, 6)):
            size = rng.randint(3, 6)
            found.add((rng.randint(size, 60), rng.randint(size, 14), size))
        found = sorted(found)
        got = s._chain(k, found)
        for i, (end, last, size) in enumerate(found):
            best = 0
            for chosen in itertools.chain.from_iterable(itertools.combinations(range(i), n) for n in range(i + 1)):
                covered, before = 0, None
                for e, l, z in [found[j] for j in chosen] + [(end, last, size)]:
                    new = z if before is None else min(z, e - before[0], l - before[1])
                    if new <= 0 or (before and e - new - before[0] > licenses.GAP):
                        break
                    covered, before = covered + new, (e, l)
                else:
                    best = max(best, covered)
            assert got[i][0] == best / 14


def test_edited_notices_are_found():
    """Recall of notices with a share of their words replaced, and none found in prose."""
    rng = random.Random(4)
    s = licenses.Scanner()
    long = [(label, t) for label, t in licenses.TEMPLATES if len(t.split()) >= 20]
    told = {}
    for share in (0.02, 0.05, 0.1):
        hit = n = 0
        for label, t in long:
            for _ in range(20):
                w = [x if rng.random() > share else "edited" for x in t.split()]
                n += 1
                hit += label in {x for x, *_ in s.scan((prose(rng, 50) + " " + " ".join(w) + " " + prose(rng, 50)).encode())["spans"]}
        told[share] = hit / n
    print("EDITED", told)
    assert told[0.02] > 0.95 and told[0.05] > 0.85


def test_every_notice_is_a_span():
    s = licenses.Scanner()
    whole = licenses.TEMPLATES[1][1]
    edited = whole.replace("any person", "any human").replace("limitation the", "limits, the")
    n = len(licenses.words(whole.encode()))
    for between in (0, 5, 200):
        text, want = "", []
        for t in (whole, edited, edited, whole, edited):
            want.append(len(licenses.words(text.encode())))
            text += t + " " + "filler " * between
        assert [(i, j) for label, i, j, _ in sorted(s.scan(text.encode())["spans"], key=lambda x: x[1]) if label == "mit"] == [(i, i + n) for i in want]
    assert len(s.scan(b"All rights reserved. " * 5000)["spans"]) == 5000


# ---- 5


def test_packing(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack(docs.where("doc_id is not null"), packing.vocabulary_path(), 256).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by[i], key=lambda r: (r.start, r.sequence_id))
        copies = 3 if i == 3 else 1
        assert sum(r.length for r in pieces) == copies * len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0  # nothing is padded
    assert sum(sum(r.length for r in p) != 256 for p in seqs.values()) <= 8
    whole = packing.pack(docs, packing.vocabulary_path(), 256)
    assert whole.agg(F.sum("length")).first()[0] > sum(r.length for r in got)
    assert packing.pack(empty, packing.vocabulary_path()).count() == 0


def test_minimum_bin_slack():
    rng = random.Random(3)
    for case in range(30):
        counts = {rng.randint(1, 63): rng.randint(1, 9) for _ in range(rng.randint(1, 20))} if case else {40: 100}
        plan = packing.minimum_bin_slack(counts, 64)
        fill = {}
        for n, c in counts.items():
            seq, off, pos = plan.place(n, np.arange(c))
            for s, o, p in zip(seq.tolist(), off.tolist(), pos.tolist()):
                for skip, size, s2, o2 in [(0, n, s, o)] if p < 0 else plan.cuts(p, n):
                    fill.setdefault(s2, []).append((o2, size))
        total = 0
        for pieces in fill.values():
            at = 0
            for o, size in sorted(pieces):
                assert o == at
                at += size
            assert at <= 64 and at & (at - 1) == 0
            total += at
        assert total == sum(n * c for n, c in counts.items())
    assert packing._subset({3: 2, 5: 1, 7: 1}, 13) in ({3: 2, 7: 1},) and packing._subset({4: 3}, 6) == {4: 1} and packing._subset({4: 3}, 3) == {}


def test_closest_fill_by_brute_force():
    import itertools

    rng = random.Random(4)
    for _ in range(300):
        left = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        target = rng.randint(0, 60)
        sums = {sum(n * c for n, c in zip(left, take)) for take in itertools.product(*(range(c + 1) for c in left.values()))}
        got = packing._subset(left, target)
        assert sum(n * c for n, c in got.items()) == max(x for x in sums if x <= target) and all(0 < c <= left[n] for n, c in got.items())


def test_windows_take_whole_pieces_where_they_fit():
    """Like lengths: windows of the closest fill, and pieces cut only to fill what those leave."""
    plan = packing.minimum_bin_slack({40: 100}, 64)
    assert plan.uses == {40: [(0, 1, 0, 0)]} and plan.slack == [(0, 24, 0, 40)]
    assert plan.sequences == 62 and plan.stream == {40: (62, 0)} and plan.total == 38 * 40 and plan.pending == 62 * 24
    assert packing.minimum_bin_slack({30: 64, 34: 64}, 64).stream == {}


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.vocabulary_path()), packing.tokenizer(packing.vocabulary_path())
    assert fast.fast
    for t in ["", "a<|endoftext|>b", "  two  spaces ", "it's 10% of naïve\r\n\tcode", "日本語🙂", "x" * 5000, "Hello  world\n\n it's 12345 été ß!?  ", " a" * 40, "  \r\n", "naïve—“quotes” don't", "\x00\x7f́"]:
        assert fast(t) == slow.encode(t, add_special_tokens=False).ids
    for run in (" ", "\n", "\u3000", "\r\n", " \t", "a", "🙂", "0", "'"):
        for n in (3990, 4001, 1_000_000):
            t = "before" + (run * n)[:n] + " after"
            assert fast(t) == slow.encode(t, add_special_tokens=False).ids
    rng = random.Random(0)
    for _ in range(300):
        t = "".join(rng.choice([" ", "\n", "é", "a", "B", "'s", "1", "漢", "🙂", "!", "\u00a0", "_", "\u0301"]) for _ in range(rng.randint(0, 60)))
        assert fast(t) == slow.encode(t, add_special_tokens=False).ids
    assert not packing._ranked({"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "pre_tokenizer": {"type": "Whitespace"}})


# ---- 6

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def patterns(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15])


def test_patterns_by_the_expressions():
    rng = random.Random(1)
    for _ in range(20_000):
        s = "".join(rng.choice("aB@@..--+ 0012395() ") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(s) == patterns(s)
    pii.base_spans("1" * 200_000), pii.base_spans("a" * 200_000 + "@"), pii.base_spans("1." * 50_000)


def test_personal_data(docs, empty, texts):
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        base = patterns(t or "") if len(t or "") < 20_000 else []
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert set(told.split(",")) <= set(got[i].spans.split(",")) | {""}
    assert pii.find_personal_data(empty).count() == 0
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[len(texts) - 1].text == "<PHONE> call <CARD> <EMAIL>" and clean[5].text == texts[5] and clean[len(texts) - 9].text is None


def test_likenesses_carry_labels():
    """A number that only looks like a phone number is one where it is told as one elsewhere in the text."""
    names = {"shape phone": 0}
    near, skip = np.zeros((5, 5)), np.eye(5) * 4.0
    w = pii.Weights(names, np.array([[0, 0, 0, 1.0, 2.0]]), near, skip)
    unary = w.unary([["shape phone"]] * 3)
    unary[0, 3] += 50
    none = np.zeros((0, 2), int)
    p = pii.marginals(unary, none, np.array([[0, 0], [0, 1]]), np.array([3]), w)
    assert p[1].argmax() == 3 and p[2].argmax() == pii.OUT
    assert pii.marginals(unary, none, none, np.zeros(0, int), w)[1].argmax() == pii.OUT


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    w = pii.Weights({}, np.zeros((0, 5)), rng.standard_normal((5, 5)), rng.standard_normal((5, 5)))
    u = rng.standard_normal((4, 5))
    # tokens 0 - 1 - 2, and a likeness that nobody knows of tokens 2 and 3
    joint = np.exp(np.einsum("a,b,c,d,h->abcdh", *([np.zeros(5)] * 5)) + u[0][:, None, None, None, None] + u[1][:, None, None, None] + u[2][:, None, None] + u[3][:, None]
                   + w.near[:, :, None, None, None] + w.near[None, :, :, None, None] + w.skip.T[None, None, :, None, :] + w.skip.T[None, None, None, :, :])
    want = [joint.sum(axis=tuple(a for a in range(5) if a != t)) for t in range(4)]
    got = pii.marginals(u, np.array([[0, 1], [1, 2]]), np.array([[0, 2], [0, 3]]), np.array([pii.OUT + 1]), w)
    assert np.allclose(got, [x / x.sum() for x in want], atol=5e-3)


@pytest.fixture(scope="module")
def field(spark):
    """A field fitted on some documents, and lessons of others."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").collect()]
    texts = [t for t in texts if t and pii._ANY.search(t)]
    cut = 2 * len(texts) // 3
    of = lambda part: [x for t in part for way in range(pii.WAYS) if (x := pii.lesson(t, way))]
    return pii.fit(of(texts[:cut])), of(texts[cut:])


def recovered(weights, lessons):
    """(share of hidden mentions' tokens labelled right, share of labelled tokens that are right)."""
    truth, p = pii.asked_of(lessons, weights)
    label = np.where(p.max(axis=1) >= weights.sure, p.argmax(axis=1), pii.OUT)
    hidden, new = truth != pii.OUT, label != pii.OUT
    return (label == truth)[hidden].mean(), (label == truth)[new].mean() if new.any() else 1.0, hidden.sum()


def test_hidden_mentions_are_recovered(field):
    weights, lessons = field
    found, right, n = recovered(weights, lessons)
    without = pii.Weights(weights.names, weights.w, weights.near, np.zeros_like(weights.skip), weights.hub, weights.sure)
    alone = recovered(without, lessons)
    print("HIDDEN", found, right, n, weights.sure, "WITHOUT", alone)
    assert found >= 0.95 and right >= 0.95 and alone[0] < 0.5


def test_broken_repeats_are_found(field):
    weights, _ = field
    words = "and some more words follow here "
    spans = lambda t: [(k, t[s:e]) for s, k, e in pii.all_spans([t], weights)[0][1]]
    assert spans(f"call +1 (988) 555-2485 today {words} then 988-555-2485 again {words} or 988.555.2486 not") == [(3, "+1 (988) 555-2485"), (3, "988-555-2485")]
    assert spans(f"the card 4111 1111 1111 1111 {words} was typed 4111 1111 1111 1112 {words}") == [(2, "4111 1111 1111 1111"), (2, "4111 1111 1111 1112")]
    assert spans(f"{words} order 988-555-2485 and 4111 1111 1111 1112 {words} 300.1.2.3 {words}") == []
    many = f"+1 (988) 555-2485 {words}" + f"988-555-2485 {words}" * 50
    assert len(spans(many)) == 51


# ---- 7


def test_wand_is_exhaustive_scoring():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(4, 20)))) for i in range(70)]
    ix = decontaminate.Index(items)
    for least in (0.2, 0.5, 0.9):
        for _ in range(60):
            terms = rng.sample(range(len(ix.term)), rng.randint(1, 40))
            want = {}
            for t in terms:
                for d, x in zip(ix.docs[t], ix.shares[t]):
                    want[d] = want.get(d, 0) + x
            assert {d for d, _ in ix.wand(terms, least)} == {d for d, x in want.items() if x >= least - 1e-9}


def test_decontamination(spark, docs, empty):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = bench.orderBy("item_id").collect()
    rng = random.Random(4)
    noise = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    planted = []
    for i, r in enumerate(rows):
        w = r.text.split()
        if i % 3 == 1 and len(w) > 14:
            w[len(w) // 3] = "changed"
        planted.append((i, f"{noise[i % 60]} {' '.join(w)} {noise[(i + 7) % 60]}"))
    half = [(100 + i, f"{noise[i]} {' '.join(r.text.split()[: len(r.text.split()) // 3])}") for i, r in enumerate(rows[:20])]
    df = spark.createDataFrame(planted + half, "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(df, bench).collect()}
    assert all(rows[i].item_id in got[i].item_ids for i, _ in planted)
    assert all(rows[i].item_id not in got[100 + i].item_ids for i in range(20))
    odd = bench.unionByName(spark.createDataFrame([(None, None), (999, ""), (998, "xyzzy plugh")], "item_id long, text string"))
    assert decontaminate.decontaminate(docs, odd).count() == docs.count() and not decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count()
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_parts_of_the_index_find_what_one_finds(spark, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = bench.orderBy("item_id").collect()
    half = [(i, f"{r.text[: len(r.text) * (5 + i % 6) // 10]} and {rows[-i].text}") for i, r in enumerate(rows)]
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in half] + [(None, None), (7, "")], "doc_id long, text string"))
    one = sorted(map(tuple, decontaminate.decontaminate(df, bench).collect()), key=repr)
    total = sum(len(r.text.encode()) for r in rows)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", total // 4 + 1)
    assert [end for _, end in decontaminate._indexes(bench, "test")] == [False] * 3 + [True]
    four = sorted(map(tuple, decontaminate.decontaminate(df, bench).collect()), key=repr)
    assert [x[:3] + x[4:] for x in one] == [x[:3] + x[4:] for x in four] and np.allclose([x[3] for x in one], [x[3] for x in four])
    assert sum(x[4] for x in one) > len(rows)
    clean = sorted((r.doc_id or -1) for r in decontaminate.without_leaks(df, bench).collect())
    assert clean == sorted((x[0] or -1) for x in one if not x[4])


def test_decisions_by_brute_force(spark):
    """BM25 of every window against every item, then the overlap: what the index and its bounds must find."""
    import math
    from collections import Counter

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()[:60]
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in bench]
    ix = decontaminate.Index(items)
    split = {i: decontaminate.words(t) for i, t in items}
    n, mean = len(items), sum(map(len, split.values())) / len(items)
    df = Counter(t for w in split.values() for t in set(w))

    def weights(w):
        c = Counter(w)
        norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(w) / mean)
        return {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (decontaminate.K1 + 1) / (f + norm) for t, f in c.items()}

    for _ in range(40):
        text = " ".join(" ".join(t.split()[: rng.randint(1, 60)]) if rng.random() < 0.7 else prose(rng, 30) for _, t in rng.sample(items, 5))
        w, step, want = decontaminate.words(text), ix.longest, {}
        for b in range(0, max(len(w) - step, 1), step):
            window = w[b : b + 2 * step]
            for k, (i, own, answer) in enumerate(ix.items):
                x = weights(own)
                share = sum(v for t, v in x.items() if t in set(window)) / sum(x.values())
                if share >= decontaminate.RETRIEVE - 1e-9 and min(ix.overlap(k, window)) >= decontaminate.OVERLAP:
                    want[i] = max(want.get(i, 0), share)
        got = ix.search(text, decontaminate.RETRIEVE, decontaminate.OVERLAP)
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)


def test_short_answers_apart_from_their_question():
    item = "Which river flows through the old town of Bern in Switzerland?\nAare"
    q, noise = item.split("\n")[0], "some words that no item has " * 3
    ix = decontaminate.Index([(1, item), (2, "What is the third planet counted from the sun outwards? the blue Earth"), (3, "why? because the sky scatters the short blue waves of light")])
    find = lambda text: set(ix.search(text, decontaminate.RETRIEVE, decontaminate.OVERLAP))
    assert find(f"{noise}{q} Answer: Aare. {noise}") == {1} and find(f"Aare, they said. {q}") == {1} and find(f"{q} (a) Rhine (b) Aare") == {1}
    assert find(f"{noise}{q} {noise}") == set() and find(f"{q} Rhine") == set()
    assert find("What is the third planet counted from the sun outwards? Answer: the blue Earth") == {2}
    assert find("What is the third planet counted from the sun outwards? the Earth is blue") == set()
    assert find("Why, one asks, because the sky scatters the short blue waves of light") == {3}


# ---- 8


def test_token_counts(docs, empty, texts):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = SentencePieceProcessor(model_file=path)
    tok = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    c = token_counts.counter(path)
    for t in [t for t in texts if t and len(t) < 20_000] + ["  a\x1cb \x85 c", "x▁y ▁z", "<s> <0x41>", "​　é"]:
        assert c.text(t) == len(tok.encode(t, add_special_tokens=False).ids)
    rng = random.Random(2)
    for _ in range(300):  # unknown characters in runs, with and without pieces for their bytes
        t = "".join(rng.choice(["a", "the", "漢", "𝔛", "é", "\u0378", "🙂", "z", " "]) for _ in range(rng.randint(1, 14)))
        assert c.text(t) == len(tok.encode(t, add_special_tokens=False).ids)
    bare = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("ab", -1.5), ("b", -1.0), ("▁a", -2.5), ("<0xC3>", -3.0), ("<0xA9>", -3.0)], unk_id=0, byte_fallback=True))
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    own = token_counts.CountingViterbi([("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("ab", -1.5), ("b", -1.0), ("▁a", -2.5), ("<0xC3>", -3.0), ("<0xA9>", -3.0)], 0)
    for _ in range(500):
        t = "".join(rng.choice("ab xé漢") for _ in range(rng.randint(1, 12)))
        assert own.text(t) == len(bare.encode(t, add_special_tokens=False).ids), t
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    assert all(got[i].n_tokens == c.text(t) for i, t in enumerate(texts)) and token_counts.token_counts(empty, path).count() == 0


# ---- 9


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_the_radius():
    import itertools

    for r in (1, 2, 3):
        masks = [int(m) for m in simhash.covering_masks(r, 24)]
        assert len(masks) == 2 ** (r + 1) - 1
        for bits in itertools.combinations(range(24), r):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_simhash(spark, docs, empty, texts):
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == docs.count()
    named = {r.doc_id: r for r in got if r.doc_id is not None}
    fps = [slow_fingerprint(t) for t in texts]
    want = classes([(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(texts)))
    for i in range(len(texts)):
        assert (named[i].fingerprint, named[i].component_id) == (f"{fps[i]:016x}", want[i])
    assert simhash.simhash_groups(empty).count() == 0


def test_one_row_of_each_group(spark, docs, empty, texts):
    a, b, c = ("one fine day in a small town " * 3, "quite another story of ships at sea " * 3, "numbers and figures are told here by the dozen " * 3)
    rows = [(1, a, "x"), (1, a, "x"), (2, b, "y"), (2, c, "z"), (0, b, "w"), (None, c, "n"), (None, "x y z", "o"), (None, "x y z", "o")]
    got = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _gone_id string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, a, "x"), (2, c, "z"), (0, b, "w"), (None, "x y z", "o")], key=repr)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and simhash.without_near_duplicates(empty).count() == 0
    every = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in every]
    root = classes([(i, j) for i in range(len(every)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(every)))
    best = {}
    for i, r in enumerate(every):
        k = (r.doc_id is None, r.doc_id or 0)
        best[root[i]] = min(best.get(root[i], (True, 1 << 60)), k)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(best.values())


def test_hot_fingerprints_are_joined_where_they_lie(spark):
    text = "a text that a third of all rows share word for word"
    rows = [(i, text if i % 3 else f"text number {i} has words of its own: {i * i} and {i * 7}") for i in range(3000)]
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 3000 and all(got[i] == 1 for i, t in rows if t == text)


def test_near_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 6)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(5)]
    fp = list(dict.fromkeys(b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for b in base for _ in range(60)))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fp)]
    edges = [(r.src, r.dst) for r in simhash.near_links(spark.createDataFrame(signed, "id long, fp long")).collect()]
    assert all((fp[a] ^ fp[b]).bit_count() <= 3 for a, b in edges)
    assert classes(edges, range(len(fp))) == classes([(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3], range(len(fp)))


# ---- 10


def test_hashes_of_grams_agree():
    words = ["été", "a", "toxicity", "🙂漢字", "x" * 30]
    own = toxicity._table({g: float(i) for i, g in enumerate({g for w in words for g in toxicity.grams(w)})}, False)
    rest = toxicity._table({g[:-1]: 1.0 for w in words for g in toxicity.grams(w)}, True)
    joined, at, size, whole, context, first = toxicity.hashed_grams(words)
    assert [joined[e - n + 1 : e + 1] for e, n in zip(at, size)] == [g for w in words for g in toxicity.grams(w)]
    assert not np.isnan(toxicity._look_up(own, whole)).any() and not np.isnan(toxicity._look_up(rest, context)).any()
    assert len(first) == len(words) and np.isnan(toxicity._look_up(own, np.array([12345], np.uint64))).all()


def test_discounts():
    n = [1000, 300, 150, 90]
    y = 1000 / 1600
    assert toxicity.discounts(n) == pytest.approx((1 - 2 * y * 300 / 1000, 2 - 3 * y * 150 / 300, 3 - 4 * y * 90 / 150))
    assert toxicity.discounts([5, 0, 0, 0]) == (0.75, 0.75, 0.75)
    for n in ([1, 100, 1, 1], [100, 1, 100, 1], [1, 1, 1, 100]):
        d = toxicity.discounts(n)
        assert 0 < d[0] < 1 and d[0] <= d[1] < 2 and d[1] <= d[2] < 3


def test_ratios_by_direct_kneser_ney(spark):
    """Every gram's and context's log ratio against the textbook recursion over dictionaries."""
    import math
    from collections import Counter

    rng = random.Random(3)
    corpus = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    classes_of = [[w for w in corpus[:250] if rng.random() < 0.7], [w for w in corpus[150:300] if rng.random() < 0.5]]
    df = spark.createDataFrame([(w,) for w in corpus], "text string")
    own = [Counter(g for w in ws for g in toxicity.grams(w)) for ws in classes_of]
    counts = spark.createDataFrame([(g, g[:-1], own[0][g], own[1][g]) for g in own[0].keys() | own[1].keys()], "gram string, ctx string, n0 long, n1 long")
    about, ratio = toxicity._ratios(counts, toxicity._continuations(df, "test"), "test")

    def discount(values):
        d = toxicity.discounts([sum(v == k for v in values) for k in (1, 2, 3, 4)])
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    whole = {g for w in corpus for g in toxicity.grams(w)}
    levels, top = {}, Counter(dict.fromkeys(whole, 1))
    for k in range(toxicity.ORDER - 1, 0, -1):  # in how many longer grams each ends
        shorter = Counter(g[-k:] if len(g) > k else g for g in top)
        levels[k], top = {g: c for g, c in shorter.items() if len(g) == k}, shorter

    def shared(g):
        if not g:
            return toxicity.UNSEEN
        table = levels[len(g)]
        if g not in table:
            return None
        d, mates = discount(table.values()), [c for x, c in table.items() if x[:-1] == g[:-1]]
        low = shared(g[1:]) if len(g) > 1 else toxicity.UNSEEN
        return (table[g] - d(table[g]) + sum(map(d, mates)) * (toxicity.UNSEEN if low is None else low)) / sum(mates)

    ds = [discount(c.values()) for c in own]

    def free(y, ctx):
        mates = [c for x, c in own[y].items() if x[:-1] == ctx]
        return sum(map(ds[y], mates)) / sum(mates) if mates else 1.0

    def p(y, g):
        total, low = sum(c for x, c in own[y].items() if x[:-1] == g[:-1]), shared(g[1:])
        low = toxicity.UNSEEN if low is None else low
        return ((own[y][g] - ds[y](own[y][g])) / total if total else 0.0) + free(y, g[:-1]) * low

    got = {r.gram: r.x for r in ratio.collect()}
    assert set(got) == own[0].keys() | own[1].keys()
    for g, x in got.items():
        assert x == pytest.approx(math.log(p(1, g) / p(0, g)), abs=1e-9)
    for r in about.collect():
        assert r.x == pytest.approx(math.log(free(1, r.ctx) / free(0, r.ctx)), abs=1e-9)


def test_toxicity(spark, docs, empty):
    rng = random.Random(5)
    clean = [f"w{rng.randrange(300)}" for _ in range(4000)]
    rows, marks = [], []
    for i in range(1200):
        w = rng.sample(clean, 40)
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(40)] = rng.choice(["snarlish", "snarlen", "grumpdolt", "grumpface"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    for i, bad in marks:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(got[i].score >= 0.3)
    held = [(got[i].predicted, bad) for i, bad in marks if got[i].held_out]
    assert sum(p == b for p, b in held) >= 0.99 * len(held)
    swapped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(df, swapped).collect()}
    assert all(again[i] == pytest.approx(got[i].score) for i, _ in marks)  # held-out labels change nothing
    odd = toxicity.score(docs, labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, toxic int"))).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty, labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(df.limit(30), labels.limit(0)).collect())


def test_toxicity_keeps_class_shares_beyond_the_sample(spark, monkeypatch):
    """Texts that tell nothing score the share of toxic rows, also where the sample takes as many of either class."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(8)), int(rng.random() < 0.1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 200)
    got = toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).toPandas()
    print("SHARE", got.score.mean(), got.predicted.mean())
    assert 0.05 < got.score.mean() < 0.2 and got.predicted.mean() < 0.05
    x = np.random.default_rng(1).standard_normal((400, 3))
    y = (x[:, 0] > 1).astype(float)
    assert np.allclose(toxicity.logistic(x, y, weight=1 + y), toxicity.logistic(np.vstack([x, x[y > 0]]), np.append(y, y[y > 0])), atol=1e-4)


def test_toxicity_by_rare_words(spark):
    """Held-out texts whose one toxic word was seen one to three times in training, against ordinary words as rare."""
    rng = random.Random(12)
    made = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    ids: dict[bool, list[int]] = {True: [], False: []}
    for i in range(20000):
        ids[zlib.crc32(str(i).encode()) % 4 == 2].append(i)
    train, held = iter(ids[False]), iter(ids[True])
    rows, asked = [], []
    for k in range(300):
        word, bad = made(), int(k % 3 == 0)
        for i in [next(train) for _ in range(1 + k % 4 % 3)] + [next(held)]:
            rows.append((i, " ".join([*(f"w{rng.randrange(200)}" for _ in range(6)), word]), bad))
        asked.append((i, bad))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert all(got[i].held_out for i, _ in asked)
    found, wrong = (sum(got[i].predicted for i, bad in asked if bad == y) for y in (1, 0))
    print("RARE", found, wrong)
    assert found >= 60 and wrong <= 60
