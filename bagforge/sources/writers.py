"""Sinks: lines of the text formats, as one `value` column for write.text, and keyed or chunked Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bags as B


def fingerprint_lines(mols: DataFrame) -> DataFrame:
    """`name,value,[k:v;...]` of (idx, name, value, bag), in order of idx."""
    return mols.orderBy("idx").select(F.format_string("%s,%.1f,%s", "name", "value", B.show(F.col("bag"))).alias("value"))


def liblinear_lines(mols: DataFrame) -> DataFrame:
    return mols.orderBy("idx").select(B.liblinear(B.is_active(F.col("name")), F.col("bag")).alias("value"))


def dense_lines(mols: DataFrame, n: int) -> DataFrame:
    """A header of feature numbers, then a molecule's value and counts a line."""
    spark = mols.sparkSession
    head = spark.createDataFrame([(-1, " ".join(map(str, range(n + 1))))], "idx long, value string")
    rows = mols.select("idx", F.concat_ws(" ", F.format_string("%.1f", "value"), F.array_join(F.transform(B.dense(F.col("bag"), n), lambda c: c.cast("string")), " ")).alias("value"))
    return head.unionByName(rows).orderBy("idx").select("value")


def dictionary_lines(d: DataFrame, header: str | None = None) -> DataFrame:
    """`id feat n` lines by id, after a header if there is one."""
    rows = d.select("feat_id", F.concat_ws(" ", "feat_id", "feat", "stat").alias("value"))
    if header:
        rows = d.sparkSession.createDataFrame([(-1, header)], "feat_id long, value string").unionByName(rows)
    return rows.orderBy("feat_id").select("value")


def sdf_3d_lines(mols: DataFrame) -> DataFrame:
    """Name, `x y z element` lines and bond lines of 3D molecules, as (line_no, part, i, value) in order."""
    name = mols.select("line_no", F.lit(0).alias("part"), F.lit(0).alias("i"), F.col("name").alias("value"))
    atom = mols.select("line_no", F.lit(1).alias("part"), F.posexplode(F.arrays_zip("coords", "elements")).alias("i", "a"))
    atom = atom.select("line_no", "part", "i", F.format_string("%10.4f%10.4f%10.4f %d", "a.coords.x", "a.coords.y", "a.coords.z", "a.elements").alias("value"))
    bond = mols.select("line_no", F.posexplode("bonds").alias("src", "to")).select("line_no", "src", F.explode("to").alias("dst"))
    bond = bond.select("line_no", F.lit(2).alias("part"), F.col("src").alias("i"), F.format_string("%3d%3d", "src", "dst").alias("value"))
    return name.unionByName(atom).unionByName(bond).orderBy("line_no", "part", "i", "value")


def descriptor_lines(rows: DataFrame, name: str, value: str, columns: list[str]) -> DataFrame:
    """`name,value,[0:d;1:d;...]`."""
    parts = [F.concat(F.lit(f"{i}:"), F.col(c).cast("string")) for i, c in enumerate(columns)]
    return rows.select(F.concat(F.col(name), F.lit(","), F.col(value).cast("string"), F.lit(",["), F.concat_ws(";", *parts), F.lit("]")).alias("value"))


def box_edges(box: DataFrame) -> DataFrame:
    """`.vector` lines of the twelve edges of each box (min_x, max_x, ...)."""
    corner: dict[tuple, tuple[Column, ...]] = {}
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                corner[a, b, c] = tuple(F.col(f"{'max' if s else 'min'}_{d}") for s, d in zip((a, b, c), "xyz"))
    edges = [(p, q) for p in corner for q in corner if p < q and sum(x != y for x, y in zip(p, q)) == 1]
    return box.select(F.explode(F.array(*[F.format_string(".v %.3f %.3f %.3f %.3f %.3f %.3f", *corner[p], *corner[q]) for p, q in edges])).alias("value"))


#: Colour and radius of the balls of each kind of point.
BALLS = {"ARO": ("green", 1.5), "HBD": ("white", 1.25), "HBA": ("orange", 1.25), "POS": ("blue", 1.0), "NEG": ("red", 1.0), "HYD": ("grey", 1.5)}


def point_balls(points: DataFrame) -> DataFrame:
    """(mol, kind, part, value): drawing lines of points(mol, kind, x, y, z), three of heading a kind (part 0 to 2) and then a ball a point (part 3); other kinds have none.

    Order by mol, the kind's place in BALLS, part and value to write them.
    """
    style = F.create_map(*[x for k, (c, r) in BALLS.items() for x in (F.lit(k), F.struct(F.lit(c).alias("colour"), F.lit(r).alias("radius")))])
    known = points.where(F.col("kind").isin(*BALLS)).withColumn("_s", F.element_at(style, F.col("kind")))
    heads = F.array(F.concat(F.lit(".comment "), F.col("kind")), F.concat(F.lit(".color "), F.col("_s.colour")), F.lit(".transparency 0.75"))
    top = known.select("mol", "kind", "_s").distinct().select("mol", "kind", F.posexplode(heads).alias("part", "value"))
    ball = F.format_string(".sphere %.3f %.3f %.3f %.2f", "x", "y", "z", "_s.radius")
    return top.unionByName(known.select("mol", "kind", F.lit(3).alias("part"), ball.alias("value")))


def write_chunks(rows: DataFrame, path: str) -> None:
    """One folder a chunk."""
    rows.write.partitionBy("chunk").parquet(path)


def write_index(fp: DataFrame, path: str, buckets: int = 64) -> None:
    """A search index: bags with their sizes, clustered by feature."""
    from ..operators.bags import sizes

    fp.join(sizes(fp), "mol_id").repartition(buckets, "feat_id").sortWithinPartitions("feat_id", "mol_id").write.parquet(path)
