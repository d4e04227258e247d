"""The chemistry kernel and encoders against published small results."""

import pytest
from pyspark.sql import functions as F

from bagforge.functions import chem
from bagforge.operators import encode, selection
from bagforge.sources import records, writers

CAFFEINE = "Cn1cnc2c1c(=O)n(C)c(=O)n2C"


def test_types_of_caffeine():
    m = chem.parse(CAFFEINE)
    assert sorted(chem.pi_types(m)) == sorted("C1 1N3 1C3 1O1 1C3 1C3 1N2 1C2 1N3 C1 1N3 C1 1C3 1O1".split())
    assert max(map(max, chem.distances(m))) == 6 and len(m.bonds) == 15


@pytest.mark.parametrize("smiles", [CAFFEINE, "COC(=O)C1C(OC(=O)c2ccccc2)CC2CCC1N2C", "C[N+](=O)[O-]", "c1ccc2[nH]ccc2c1", "[Na+].[Cl-]", "N#CC(F)(Cl)Br", "C1CC1.C%10CC%10", "OS(=O)(=O)O"])
def test_writing_keeps_the_graph(smiles):
    m = chem.parse(smiles)
    for seed in (None, 1, 2):
        again = chem.parse(chem.write(m, seed))
        assert sorted(chem.pi_types(m)) == sorted(chem.pi_types(again))
        assert chem.formula(chem.all_elements(m)) == chem.formula(chem.all_elements(again))


@pytest.mark.parametrize("bad", ["", "C(", "C1CC", "C)C", "Xx", "C$$"])
def test_what_is_no_smiles(bad):
    with pytest.raises(ValueError):
        chem.parse(bad)


def test_atom_pair_counts(spark):
    mols = spark.createDataFrame([(0, "caffeine", CAFFEINE), (1, "bad", "C(")], "idx long, name string, smiles string")
    typed = encode.typed(mols).cache()
    assert [r.name for r in typed.where("error is not null").collect()] == ["bad"]
    assert encode.atom_pairs(typed).agg(F.sum("cnt")).first()[0] == 14 * 15 // 2
    assert encode.atom_pairs(typed, self_pairs=False).agg(F.sum("cnt")).first()[0] == 14 * 13 // 2
    assert encode.atom_pairs(typed, max_dist=1).agg(F.sum("cnt")).first()[0] == 14 + 15


def test_domain_of_alcohols(spark):
    mols = spark.createDataFrame([(0, "methanol", "CO"), (1, "ethanol", "CCO")], "idx long, name string, smiles string")
    p = encode.atom_pairs(encode.typed(mols, "five"))
    fp = p.select(F.col("idx").alias("mol_id"), F.concat_ws("-", "lo", "dist", "hi").alias("feat_id"), "cnt")
    box = selection.box(fp)
    assert {r.max_cnt for r in box.collect()} == {1} and box.count() == 7 and box.where("feat_id = '(6,1,3,1,0)-0-(6,1,3,1,0)'").count() == 1
    assert selection.inside(mols.withColumnRenamed("idx", "mol_id"), fp, box).count() == 2
    a, b = selection.box(fp.where("mol_id = 0")), selection.box(fp.where("mol_id = 1"))
    assert sorted(map(tuple, selection.box_union(a, b).collect())) == sorted(map(tuple, box.collect()))


def test_scaffold_scans_and_fragments():
    m = chem.parse("CCc1ccccc1")
    assert len(chem.scaffold(m).atoms) == 6 and chem.scaffold(chem.parse("CCO")).atoms == []
    assert len(chem.wildcard_scan(m)) == 8 and len(chem.fluorine_scan(m)) == 7 and len(chem.analogue_scan(m)) == 40
    parts = chem.fragments(chem.parse("CCOC(=O)CCN"), 2, 1234)
    assert len(parts) == 3 and sum(len(a) for _, a in parts) == 4
    made = chem.assemble(parts, 7)
    assert made is None or len(chem.components(made)) == 1
    assert chem.peptide_chain(chem.parse("NCC(=O)NCC(=O)NCC(=O)NCC(=O)O")) == 3
    assert len(chem.largest_part(chem.parse("[Na+].CCO")).atoms) == 3


def test_packed_types():
    assert chem.simple_types(chem.parse("CO")) == [63013, 83011]
    with pytest.raises(ValueError):
        chem.packed([6, 12])


def test_records(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CO\tmethanol\nCCO\tethanol\r\n")
    got = records.smiles(records.lines(spark, str(tmp_path / "a.smi"))).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(0, "methanol", "CO"), (1, "ethanol", "CCO")]
    atom = "%10.4f%10.4f%10.4f %-3s 0  0"
    sdf = "w\n\n\n  3  2  0\n" + "\n".join(atom % x for x in [(0, 0, 0, "O"), (1, 0, 0, "H"), (0, 1, 0, "H")]) + "\n  1  2  1\n  1  3  1\nM  END\n> <T>\nv\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text(sdf * 2)
    r = records.sdf(spark, str(tmp_path / "a.sdf"))
    assert r.count() == 2 and [x.T for x in records.sdf_tags(r, ["T"]).collect()] == ["v", "v"]
    mols = records.sdf_3d(r).cache()
    assert mols.first().elements == [8, 1, 1] and mols.first().bonds == [[1, 2], [], []]
    d = encode.diameters(records.atoms_of(mols)).first().diameter
    assert d == pytest.approx(2**0.5)
    w = encode.radial_layers(records.atoms_of(mols).where("mol_id = 0"), 3.0, 0.5).where("atom = 0").collect()
    assert sum(x.w for x in w) == pytest.approx(2.0)
    assert writers.sdf_3d_lines(mols).count() == 2 * (1 + 3 + 2)
    (tmp_path / "p.ph4").write_text("2:m1\nARO 0 0 1\nHBD 1 2 3\n1:m2\nHYD 1 1 1\n")
    assert [(x.name, x.family, x.z) for x in records.ph4(records.lines(spark, str(tmp_path / "p.ph4"))).orderBy("mol", "z").collect()] == [("m1", "ARO", 1.0), ("m1", "HBD", 3.0), ("m2", "HYD", 1.0)]
    (tmp_path / "e.enc").write_text("#radius=0:1\n#m\n0_C1:1 2\n0_C1:1 3\n#n\n0_O1:1 1\n")
    assert {(x.name, x.feat, x.cnt) for x in records.encoded(records.lines(spark, str(tmp_path / "e.enc"))).collect()} == {("m", "0_C1:1", 3), ("n", "0_O1:1", 1)}
    (tmp_path / "m.txt").write_text("a,1.5,[0:2;3:1]\nactive_b,0.0,[]\nnonsense\n")
    fp = records.fingerprints(records.lines(spark, str(tmp_path / "m.txt")), strict=False).cache()
    assert [x.value for x in writers.fingerprint_lines(fp).collect()] == ["a,1.5,[0:2;3:1]", "active_b,0.0,[]"]
    assert [x.value for x in writers.liblinear_lines(fp).collect()] == ["-1 1:2 4:1", "+1"]
    assert [x.value for x in writers.dense_lines(fp, 4).collect()] == ["0 1 2 3 4", "1.5 2 0 0 1", "0.0 0 0 0 0"]


def test_stream_filter(spark, tmp_path):
    from bagforge.streaming import stateless

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a,1,[0:2]\nb,1,[0:3]\nc,1,[7:1]\nd,1,[]\n")
    domain = spark.createDataFrame([(0, 2)], "feat_id int, max_cnt int")
    out = stateless.within_box(stateless.fingerprints(spark.readStream.text(str(tmp_path / "in"))), domain)
    q = out.writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.name for r in spark.table("kept").collect()) == ["a", "d"]


@pytest.mark.parametrize("smiles,deep", [("CC(C)C", "CCC)C"), ("c1ccccc1", "cccccc6"), ("CC(=O)Oc1ccccc1", "CC=O)Occcccc6"), ("C1CC1C(F)(Cl)Br", "CCC3CF)Cl)Br"), ("O=C", "O=C")])
def test_deep_smiles(smiles, deep):
    assert chem.deep(smiles) == deep
    a, b = chem.parse(smiles), chem.parse(chem.undeep(deep))
    assert sorted(chem.pi_types(a)) == sorted(chem.pi_types(b))


def test_formula_numbers():
    assert chem.formula_number("C6H12O6") == 3**6 * 2**12 * 5**6 and chem.number_formula(chem.formula_number("CH3CH2OH")) == "C2H6O"
    with pytest.raises(ValueError):
        chem.number_formula(10007)


def test_linkers_and_torsions():
    m = chem.parse("c1ccccc1CCOCCOCCOc1ccccc1")
    assert sum(a.symbol == "O" for a in chem.peg_free(m).atoms) == 0 and len(chem.peg_free(chem.parse("CCO")).atoms) == 3
    regular, terminal = chem.torsions(chem.parse("CC(O)c1ccccc1"))
    assert len(regular) == 1 and len(terminal) == 2


def test_molecule_operators(spark):
    from bagforge.operators import molecules

    mols = spark.createDataFrame([(0, "a", "[Na+].CCCCOC(=O)c1ccccc1CCCCN"), (1, "b", "C("), (2, "c", "CCO")], "idx long, name string, smiles string")
    got = {r.name: r for r in molecules.desalted(mols).collect()}
    assert got["a"].smiles.count("Na") == 0 and got["b"].error and got["c"].smiles == "CCO"
    good = mols.where("name != 'b'")
    assert molecules.randomised(good, 3, 1).count() == 6
    f = molecules.fragmented(good, 1234, passes=2, weight=60.0).cache()
    assert f.count() > 2 and molecules.assembled(f, 20, 5).count() > 0
    anchors = f.select("name", F.explode("anchors").alias("x")).select("name", "x.src", "x.dst")
    assert molecules.compatible(anchors).count() > 0
    assert molecules.circular(good).groupBy("mol_id").agg(F.sum("cnt").alias("n")).where("mol_id = 2").first().n == 9
    with pytest.raises(NotImplementedError):
        molecules.canonical(good)
    el = spark.createDataFrame([({"C": 2, "H": 6, "O": 1},), ({"Ga": 100},)], "e map<string,int>")
    assert [r.g for r in el.select(encode.godel(F.col("e"), chem.PRIMES).alias("g")).collect()] == [9 * 64 * 5, None]


def test_published_types_file(spark, tmp_path):
    (tmp_path / "t.types").write_text("#atoms:2 methanol\n0 C1\n1 O1\n#bonds:1\n0 1\n#diameter:1\n0 1\n1 0\n")
    t = records.types(spark, str(tmp_path / "t.types"))
    assert {(r.feat, r.cnt) for r in encode.environments(t, [0, 1]).collect()} == {("0_C1:1", 1), ("0_O1:1", 1), ("0_C1:1;1_O1:1", 1), ("0_O1:1;1_C1:1", 1)}


@pytest.mark.parametrize("bad", ["1CC1", "(C)C", "=C", "C(=)C", "C=.C", "C=(O)C", "C.=C"])
def test_bonds_rings_and_branches_need_atoms(bad):
    with pytest.raises(ValueError):
        chem.parse(bad)
    assert chem.readable(bad) is None and chem.readable(None) is None and chem.readable("CCO") is not None


def test_peptide_bonds_in_a_row():
    ring = "C1(=O)NCC(=O)NCC(=O)NC1"
    assert [chem.peptide_chain(chem.parse(s)) for s in ("CCO", "CC(=O)NC", "NCC(=O)NCC(=O)NCC(=O)O", ring)] == [0, 1, 2, 3]
    assert chem.peptide_chain(chem.parse("N" + "CC(=O)N" * 400 + "C")) == 400


def test_unreadable_molecules_stop_no_job(spark):
    from bagforge.operators import encode, molecules

    mols = spark.createDataFrame([(0, "a", "CCCCO"), (1, "b", "C(("), (2, "c", None), (3, "d", "")], "idx long, name string, smiles string")
    assert {r.name: bool(r.error) for r in molecules.rejects(mols).collect()} == {"b": True, "c": True, "d": True}
    made = encode.generate(mols, chem.fluorine_scan)
    some = [made, molecules.randomised(mols, 2, 1), molecules.fragmented(mols, 1, weight=20.0), molecules.torsions(mols)]
    assert [{r.idx for r in df.collect()} for df in some] == [{0}] * 4
    assert {r.mol_id for r in molecules.circular(mols).collect()} == {0}
    assert made.count() == 4 and molecules.one_of_each(made, 7).count() == 1
    assert molecules.one_of_each(made, 7).first() == molecules.one_of_each(made.repartition(3), 7).first()
    known = made.where("name = 'a_000'").select("smiles")
    twice = made.union(made.withColumn("idx", F.col("idx") + 5)).union(made.limit(1).withColumn("smiles", F.lit(None).cast("string")))
    assert sorted((r.idx, r.name) for r in molecules.novel(twice, known).collect()) == [(0, "a_001"), (0, "a_002"), (0, "a_003")]
    assert molecules.novel(twice).count() == 4


def test_windows_of_properties(spark):
    from bagforge.operators import encode, selection

    mols = spark.createDataFrame([(0, "drug", "CC(=O)Oc1ccccc1C(=O)O"), (1, "small", "CCO"), (2, "bad", "C("), (3, "peptide", "N" + "CC(=O)N" * 4 + "C")], "idx long, name string, smiles string")
    p = encode.properties(mols).cache()
    names = lambda df: {r.name for r in df.collect()}
    assert names(selection.drug_like(p, ("cLogP",))) == names(selection.without_aliens(p, ("cLogP",))) == {"drug", "peptide"}
    assert names(selection.with_alien(p, ("cLogP",)).where("alien")) == {"small", "bad"}
    assert names(selection.lead_like(p, ("cLogP",))) == {"drug", "small"}  # the peptide turns at 13 bonds
    assert names(selection.not_peptide(p)) == {"drug", "small"}


def test_graphs_and_centres_in_space(spark):
    from bagforge.operators import encode

    rows = [(0, "m", 1, "O", 0.0, 2.9, 0.0), (0, "m", 0, "C", 0.0, 0.0, 0.0), (0, "m", 2, "C", 4.0, 0.0, 3.0)]
    atoms = spark.createDataFrame(rows, "idx long, name string, atom int, type string, x double, y double, z double")
    g = encode.space_graphs(atoms).first()
    assert g.types == ["C", "O", "C"] and g.dist == [[0, 2, 5], [2, 0, 5], [5, 5, 0]] and g.diameter == 5
    pairs = {(r.lo, r.dist, r.hi): r.cnt for r in encode.atom_pairs(encode.space_graphs(atoms), self_pairs=False).collect()}
    assert pairs == {("C", 2, "O"): 1, ("C", 5, "C"): 1, ("C", 5, "O"): 1}
    places = atoms.withColumnRenamed("idx", "mol_id")
    matches = spark.createDataFrame([(0, "ring", 0), (0, "ring", 2), (0, "ring", 2)], "mol_id long, match string, atom int")
    assert [tuple(r) for r in encode.centres(places, matches).collect()] == [(0, "ring", 2.0, 0.0, 1.5)]


def test_drawing_lines(spark):
    from bagforge.operators import graphs
    from bagforge.sources import writers

    points = spark.createDataFrame([("m", "HBA", 1.0, 2.0, 3.0), ("m", "HBA", 0.5, 0.0, 0.0), ("m", "???", 0.0, 0.0, 0.0)], "mol string, kind string, x double, y double, z double")
    lines = [r.value for r in writers.point_balls(points).orderBy("part", "value").collect()]
    assert lines == [".comment HBA", ".color orange", ".transparency 0.75", ".sphere 0.500 0.000 0.000 1.25", ".sphere 1.000 2.000 3.000 1.25"]
    nodes = spark.createDataFrame([(0, "a", 5.0), (1, "b", 9.0), (2, "c", 7.0), (3, "d", None)], "id long, name string, value double")
    tints = {r.value[1]: r.value.split("#")[1][:6] for r in graphs.dot_nodes(nodes).collect()}
    assert tints == {"0": "ffffff", "1": "ff0000", "2": "ff8080", "3": "ffffff"}
    assert "#ffffff" in graphs.dot_nodes(nodes.limit(1)).first().value
    clusters = spark.createDataFrame([(7, 7, 1), (3, 3, 2), (3, 4, 2), (1, 1, 1)], "center long, member long, size long")
    assert sorted((r.cid, r.center, r.size) for r in graphs.by_density(clusters).collect()) == [(0, 3, 2), (1, 1, 1), (2, 7, 1)]
