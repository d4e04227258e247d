"""Embedding near-duplicates: sign hashing by random hyperplanes, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import links
from .common import map_rows, read, scratch, spread_join
from .components import connected_components

SEED = 20240607
#: A pair exactly at the threshold shares no bucket with at most this probability.
MISS = 1e-9


def plan_tables(threshold: float, rows_per_label: int) -> tuple[int, int]:
    """(bits, tables): bits so that unrelated rows rarely meet, then tables until a pair at the threshold is missed with probability MISS."""
    bits = max(6, min(32, math.ceil(math.log2(max(2, rows_per_label))) + 5))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, bits, tables]).standard_normal((dim, bits * tables))


def codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket numbers: the signs on each table's hyperplanes."""
    signs = unit @ hyperplanes(unit.shape[1], bits, tables) >= 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(rows, -1)


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, tag: str = "embeddings") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding array, label).

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least threshold.
    Null, zero, empty, null-holding and non-finite vectors, and rows without a label or vec_id, link with nothing; vectors of
    different lengths do not link. Equal vectors of a label are one node that counts its copies, so a very common
    vector is compared once. n_links comes from counts made in each pair of blocks, a pair counted only in the
    first table where it meets; no pairs leave a block. Lengths don't matter, however large or small: vectors are
    scaled before they are squared. A pair exactly at the threshold links. Extra columns are not used; an empty table
    gives none.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"  # as compact as it came
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), F.col("v")).alias("b"))  # 128 bits
    keyed = scratch(x.where(usable).select("vec_id", F.concat_ws(":", F.size("v"), "label").alias("grp"), "v", key.alias("key")), tag)
    nodes = scratch(keyed.groupBy("grp", "key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"), F.any_value("v").alias("v")), tag)
    biggest = nodes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(threshold, biggest)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for b in batches:
            for size in np.unique(sizes := np.asarray(b.column(2).value_lengths())):
                at = np.flatnonzero(sizes == size)
                part = b.take(pa.array(at))
                c = codes(_unit(_matrix(part.column(2), len(at))), bits, tables)
                yield {"id": np.repeat(part.column(0).to_numpy(), tables), "grp": part.column(1).take(pa.array(np.repeat(np.arange(len(at)), tables))), "t": np.tile(np.arange(tables, dtype=np.int32), len(at)), "code": c.ravel()}

    seats = map_rows(nodes.select("id", "grp", "v"), "id long, grp string, t int, code long", hashed)
    seats = scratch(seats.select("id", F.xxhash64("grp", "t", "code").alias("bucket"), "t"), tag)
    order = ["bucket", "_low", "_high"]
    pairs = links.block_pairs(seats, ["bucket"], "id", tag).join(nodes.select("id", "m", "v"), "id")
    pairs = pairs.repartition(*order).sortWithinPartitions(*order, "_mine", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for t in links.grouped(batches, order):
            ids, m, tab, low, high, mine = (t[c].to_numpy() for c in ("id", "m", "t", "_low", "_high", "_mine"))
            starts = links.starts_of([t[c].to_numpy() for c in order])
            vectors = t["v"].combine_chunks()
            counts = np.zeros(len(ids), np.int64)
            src, dst = [], []

            def met(a: np.ndarray, b: np.ndarray, unit: np.ndarray, c: np.ndarray, at: int) -> None:
                """Rows a and b link; they count if no earlier table had them together."""
                new = ~((c[a] == c[b]) & (np.arange(tables) < tab[at + a][:, None])).any(axis=1)
                new &= (mine[at + a] != mine[at + b]) | (low[at + a] == high[at + a])
                np.add.at(counts, at + a[new], m[at + b[new]])
                np.add.at(counts, at + b[new], m[at + a[new]])

            sizes = np.asarray(vectors.value_lengths())
            runs = np.append(starts[:-1][np.append(True, sizes[starts[1:-1]] != sizes[starts[:-2]])], starts[-1]) if len(starts) > 2 else starts
            for r0, r1 in zip(runs[:-1].tolist(), runs[1:].tolist()):  # one length at a time
                unit = _unit(_matrix(vectors.slice(r0, r1 - r0), r1 - r0))
                c = codes(unit, bits, tables)
                own_starts = starts[(starts >= r0) & (starts <= r1)] - r0
                a, b = links.tiny_pairs(own_starts)
                for i in range(0, len(a), 1 << 16):
                    p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                    hit = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                    p, q = p[hit], q[hit]
                    met(p, q, unit, c, r0)
                    src.append(ids[r0 + p])
                    dst.append(ids[r0 + q])
                for s, e in zip(own_starts[:-1].tolist(), own_starts[1:].tolist()):
                    if e - s <= links.TINY:
                        continue
                    near = unit[s:e] @ unit[s:e].T >= threshold
                    for i in range(e - s):
                        j = i + 1 + np.flatnonzero(near[i, i + 1 :])
                        if len(j):
                            met(np.full(len(j), s + i), s + j, unit, c, r0)
                    for i, got in links.forest(e - s, lambda i, rest: near[i, rest]):
                        src.append(np.full(len(got), ids[r0 + s + i]))
                        dst.append(ids[r0 + s + got])
            some = np.flatnonzero(counts)
            src, dst = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, dst))
            yield {"src": np.concatenate([src, ids[some]]), "dst": np.concatenate([dst, ids[some]]), "n": np.concatenate([np.zeros(len(src), np.int64), counts[some]])}

    found = scratch(map_rows(pairs.select("id", "bucket", "_low", "_high", "_mine", "t", "m", "v"), "src long, dst long, n long", compare), tag)
    degree = found.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("src != dst").select("src", "dst"), tag)
    named = nodes.join(degree, "id", "left").join(comps, nodes.id == comps.node, "left").select(
        "grp", "key", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = spread_join(keyed.select("vec_id", "grp", "key"), scratch(named, tag), ["grp", "key"], "m").select("vec_id", "n_links", "component_id")
    alone = x.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS s, b.vec_id AS t FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS s, vec_id AS t FROM v
  UNION
  SELECT r.s, l.t FROM r JOIN l ON r.t = l.s
), c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT s AS vec_id, count(*) AS n_links FROM l GROUP BY s)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
