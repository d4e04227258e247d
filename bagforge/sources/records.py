"""Readers: lines and multi-line records as DataFrames. Text formats are read by Spark, parsed by column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bags as B
from ..operators.dictionary import numbered
from ..shared import scratch


def lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """(line_no, value): lines, or records ended by a separator, numbered from 0 in file order.

    Compressed files (.gz, .bz2) are read as such. Numbers follow the files' names and places: a first pass counts each
    split's lines, and a line's number is its place in its split after the lines of the splits before. Nothing is
    sorted or shuffled but one row a split (at 128 MB a split, some 25 MB of rows for 100 TB), which is broadcast.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select("value", F.xxhash64("_metadata.file_path").alias("_h"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    rows = rows.withColumn("_i", F.monotonically_increasing_id())
    splits = rows.groupBy("_h", "_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch(splits.select("_h", "_b", (ahead - F.col("_first")).alias("_shift")), "lines")
    return rows.drop("_f").join(F.broadcast(starts), ["_h", "_b"]).select((F.col("_i") + F.col("_shift")).alias("line_no"), "value")


def xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of .xz files, which Spark does not read itself: one task a file, numbered by the files' names and places."""
    import lzma

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content):
                rows = lzma.decompress(content).decode().split("\n")
                rows = rows[:-1] if rows and not rows[-1] else rows
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame({"f": name, "i": range(i, min(i + 10_000, len(rows))), "value": rows[i : i + 10_000]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "f string, i long, value string")
    return numbered(rows, ["f", "i"], "line_no").select("line_no", "value")


def uncommented(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("value").startswith("#"))


def comments(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value").startswith("#"))


def smiles(rows: DataFrame, names: str = "tab") -> DataFrame:
    """(idx, name, smiles) of lines(line_no, value): 'tab' fails without a tab; 'rest' splits at white space, 'second' too but takes only the second word; nameless lines are named by their SMILES."""
    text = F.rtrim(F.col("value"), F.lit("\r"))
    if names == "tab":
        has = F.assert_true(F.instr(text, "\t") > 0, F.concat(F.lit("no tab: "), text))
        rows = rows.where(has.isNull())
        first, name = F.split_part(text, F.lit("\t"), F.lit(1)), F.regexp_extract(text, r"^[^\t]*\t(.*)$", 1)
    else:
        first, name = F.regexp_extract(text, r"^\s*(\S+)", 1), F.trim(F.regexp_extract(text, r"^\s*\S+\s*(.*)$", 1))
    if names == "second":
        name = F.regexp_extract(text, r"^\s*\S+\s+(\S+)", 1)
    return rows.select(F.col("line_no").alias("idx"), F.when(name == "", first).otherwise(name).alias("name"), first.alias("smiles"))


def fingerprints(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(idx, name, value, bag) of `name,value,[k:v;...]` lines; not strict: lines that aren't such are left out."""
    form = r"^([^,]*),([^,]*),(\[.*\])$"
    part = lambda i: F.regexp_extract("value", form, i)
    good = rows if strict else rows.where(F.col("value").rlike(r"^[^,]*,\s*[-+0-9.eE]+,\[(\d+:[1-9]\d*(;\d+:[1-9]\d*)*)?\]$"))
    return good.select(F.col("line_no").alias("idx"), part(1).alias("name"), F.trim(part(2)).cast("double").alias("val"), B.parse(part(3)).alias("bag")).withColumnRenamed("val", "value")


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): SDF records, the last with or without its footer."""
    rows = lines(spark, path, "$$$$\n")
    return rows.where(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0)


def sdf_name(record: Column) -> Column:
    return F.substring_index(record, "\n", 1)


def sdf_tag(record: Column, tag: str, spaces: str = "[ ]+") -> Column:
    """The line after `> <tag>`; empty without one."""
    return F.regexp_extract(record, rf"(?m)^>{spaces}<{tag}>[^\n]*\n([^\n]*)", 1)


def sdf_tags(records: DataFrame, tags: list[str]) -> DataFrame:
    """(line_no, *tags); a tag that only some records have is an error."""
    has = records.agg(*[F.count_if(F.col("value").rlike(rf"(?m)^>[ ]+<{t}>")).alias(f"n{i}") for i, t in enumerate(tags)]).first()
    if len(set(has)) > 1:
        raise ValueError(f"tags occur {dict(zip(tags, has))} times")
    return records.select("line_no", *[sdf_tag(F.col("value"), t).alias(t) for t in tags])


def sdf_strip(rows: DataFrame, tag: str) -> DataFrame:
    """Lines(line_no, value) without lines that end in `<tag>` and the line after each."""
    marks = rows.where(F.col("value").endswith(f"<{tag}>")).select(F.explode(F.array(F.col("line_no"), F.col("line_no") + 1)).alias("line_no"))
    return rows.join(marks, "line_no", "left_anti")


ATOMS_3D = "line_no long, name string, elements array<int>, coords array<struct<x:double,y:double,z:double>>, bonds array<array<int>>"


def sdf_3d(records: DataFrame) -> DataFrame:
    """ATOMS_3D of V2000 records: fixed-width counts, coordinates, bonds from 0 in the direction written."""
    from ..functions.chem import NUMBER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for no, text in zip(b.line_no, b.value):
                rows = text.split("\n")
                n, m = int(rows[3][:3]), int(rows[3][3:6])
                at = [r.split() for r in rows[4 : 4 + n]]
                bonds: list[list[int]] = [[] for _ in range(n)]
                for r in rows[4 + n : 4 + n + m]:
                    bonds[int(r[:3]) - 1].append(int(r[3:6]) - 1)
                out.append((no, rows[0].strip(), [NUMBER.get(a[3], -1) for a in at], [{"x": float(a[0]), "y": float(a[1]), "z": float(a[2])} for a in at], bonds))
            yield pd.DataFrame(out, columns=["line_no", "name", "elements", "coords", "bonds"])

    return records.select("line_no", "value").mapInPandas(run, ATOMS_3D)


def atoms_of(mols: DataFrame) -> DataFrame:
    """(mol_id, atom, anum, x, y, z) of ATOMS_3D rows."""
    return mols.select(F.col("line_no").alias("mol_id"), F.posexplode(F.arrays_zip("elements", "coords")).alias("atom", "a")).select("mol_id", "atom", F.col("a.elements").alias("anum"), "a.coords.x", "a.coords.y", "a.coords.z")


def mol2(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, name, value): TRIPOS records."""
    rows = lines(spark, path, "@<TRIPOS>MOLECULE\n").where(F.trim(F.col("value")) != "")
    return rows.where(~F.col("value").startswith("#")).select("line_no", F.substring_index("value", "\n", 1).alias("name"), "value")


def mol2_atoms(records: DataFrame) -> DataFrame:
    """(mol_id, atom, label, x, y, z, sybyl) of TRIPOS records, atoms from 0."""
    block = F.regexp_extract("value", r"(?s)@<TRIPOS>ATOM\n(.*?)(?:@<TRIPOS>|$)", 1)
    rows = records.select(F.col("line_no").alias("mol_id"), F.explode(F.split(block, "\n")).alias("r")).where(F.trim(F.col("r")) != "")
    f = F.split(F.trim(F.regexp_replace("r", r"\s+", " ")), " ")
    return rows.select("mol_id", (f[0].cast("int") - 1).alias("atom"), f[1].alias("label"), *[f[2 + i].cast("double").alias(c) for i, c in enumerate("xyz")], f[5].alias("sybyl"))


def mol2_bonds(records: DataFrame) -> DataFrame:
    """(mol_id, src, dst, kind), atoms from 0."""
    block = F.regexp_extract("value", r"(?s)@<TRIPOS>BOND\n(.*?)(?:@<TRIPOS>|$)", 1)
    rows = records.select(F.col("line_no").alias("mol_id"), F.explode(F.split(block, "\n")).alias("r")).where(F.trim(F.col("r")) != "")
    f = F.split(F.trim(F.regexp_replace("r", r"\s+", " ")), " ")
    return rows.select("mol_id", (f[1].cast("int") - 1).alias("src"), (f[2].cast("int") - 1).alias("dst"), f[3].alias("kind"))


def headed(rows: DataFrame, header: str) -> DataFrame:
    """Adds head, the number of the header line that a line stands under, and keeps only lines under one.

    Numbers the headers and finds each line's by ranges of line numbers within blocks of 65536 lines, so that no
    window takes all lines into one task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(F.floor(F.col("line_no") / 65536)).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_b", F.floor(F.col("line_no") / 65536)).withColumn("_h", F.last(F.when(F.col("value").rlike(header), F.col("line_no")), ignorenulls=True).over(w))
    ends = own.groupBy("_b").agg(F.max("_h").alias("_e"))
    before = ends.withColumn("_p", F.last("_e", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_p")
    return own.join(F.broadcast(before), "_b").withColumn("head", F.coalesce("_h", "_p")).where("head is not null").drop("_b", "_h", "_p")


def ph4(rows: DataFrame) -> DataFrame:
    """(mol, name, family, x, y, z) of pharmacophore lines: `n:name`, then n lines `FAMILY x y z`."""
    h = headed(rows, r"^\d+:")
    names = h.where("line_no = head").select("head", F.regexp_extract("value", r"^\d+:(.*)$", 1).alias("name"))
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return h.where("line_no != head").join(names, "head").select(F.col("head").alias("mol"), "name", f[0].alias("family"), *[f[1 + i].cast("double").alias(c) for i, c in enumerate("xyz")])


def encoded(rows: DataFrame) -> DataFrame:
    """(idx, name, feat, cnt) of `#name` headers and `feat count` lines; of a feature given twice the last counts; `#radius=` lines are left out."""
    h = headed(rows.where(~F.col("value").startswith("#radius=")), r"^#")
    names = h.where("line_no = head").select("head", F.expr("substring(value, 2)").alias("name"))
    body = h.where("line_no != head").select("head", "line_no", F.regexp_extract("value", r"^(.*) (\d+)$", 1).alias("feat"), F.regexp_extract("value", r"^(.*) (\d+)$", 2).cast("int").alias("c"))
    return body.groupBy("head", "feat").agg(F.max_by("c", "line_no").alias("cnt")).join(names, "head").select(F.col("head").alias("idx"), "name", "feat", "cnt")


def types(spark: SparkSession, path: str) -> DataFrame:
    """Typed graphs (idx, name, types, elements, dist, diameter, error) of `.types` files."""
    from ..operators.encode import TYPED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for no, text in zip(b.line_no, b.value):
                rows = [r for r in text.split("\n") if r.strip()]
                n, name = rows[0].split(maxsplit=1)
                n, types = int(n), []
                types = [r.split()[1] for r in rows[1 : 1 + n]]
                m = int(rows[1 + n].split(":")[1])
                d = 2 + n + m
                out.append((no, name, types, [], [[int(float(x)) for x in r.split()] for r in rows[d + 1 : d + 1 + n]], int(float(rows[d].split(":")[1])), None))
            yield pd.DataFrame(out, columns=["idx", "name", "types", "elements", "dist", "diameter", "error"])

    rows = lines(spark, path, "#atoms:").where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    return rows.mapInPandas(run, TYPED)


def dictionary(rows: DataFrame, dialect: str) -> DataFrame:
    """(feat, feat_id, stat) of dictionary lines: 'id_first' (`id feat n` or `id n feat` for environments) or 'feature_first' (`feat<tab>id[<tab>n]`)."""
    body = uncommented(rows)
    if dialect == "feature_first":
        f = F.split("value", "\t")
        return body.where(F.size(f) >= 2).select(f[0].alias("feat"), f[1].cast("int").alias("feat_id"), F.try_element_at(f, F.lit(3)).cast("long").alias("stat"))
    f = F.split("value", " ")
    return body.select(f[1].alias("feat"), f[0].cast("int").alias("feat_id"), f[2].cast("long").alias("stat"))


def tolerant(rows: DataFrame, column: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose column reads as kind, the others)."""
    x = F.expr(f"try_cast({column} AS {kind})")
    return rows.where(x.isNotNull()).withColumn(column, x), rows.where(x.isNull())
