"""All pairs of entities by blocks: for bags so full that most pairs share something, where an inverted index makes each pair many times over.

Entities are numbered and cut into blocks; a block is one row with its packed arrays, equal contents once. Each two blocks
meet in one task, which compares them as matrices and gives its pairs in batches, so no pair is shuffled.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import scratch
from .dictionary import numbered

#: Entities of a block, columns of a matrix product and rows of a batch that a task gives: they bound a task's memory.
BLOCK, COLUMNS, BATCH = 2000, 2048, 400_000
WHOLE = ("tinyint", "smallint", "int", "bigint")

Block = dict[str, np.ndarray]


def fits(df: DataFrame, *columns: str) -> bool:
    """Whether the columns are whole numbers, as the matrices need."""
    return all(t in WHOLE for c, t in df.dtypes if c in columns)


def fuller(groups: DataFrame, n: int) -> bool:
    """Whether the groups' (n: members) pairs outnumber those of n entities."""
    pairs = groups.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1))).first()[0] or 0.0
    return pairs > n * (n - 1)


def _packed(rows: DataFrame, order: list[str], pack: Callable[[pa.Table], Block], n: int) -> tuple[DataFrame, int]:
    """(block, data) of rows, numbered in order; and how many blocks there are."""
    count = max(1, -(-n // BLOCK))
    placed = numbered(rows, order, "_k").withColumn("block", F.floor(F.col("_k") / BLOCK).cast("int"))
    schema = "block int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
            data = zlib.compress(pickle.dumps(pack(pa.Table.from_batches(held))), 1)
            return pa.RecordBatch.from_arrays([pa.array([block], "int32"), pa.array([data], "binary")], ["block", "data"])

        held, now = [], None
        for b in batches:
            of = b.column("block").to_numpy(zero_copy_only=False)
            for low, high in _runs(of):
                if now is not None and of[low] != now:
                    yield made(held, now)
                    held = []
                now = int(of[low])
                held.append(b.slice(low, high - low))
        if held:
            yield made(held, now)

    return scratch(placed.repartition(count, "block").sortWithinPartitions("block", "_k").mapInArrow(run, schema), "grid"), count


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _met(blocks: DataFrame, count: int, meet: Callable[[Block, Block | None], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What meet gives of each two blocks, the earlier first, and of each block with itself (then the other is None)."""
    other = blocks.select("block", "data", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("o"))
    keyed = other.select((F.least("block", "o").cast("long") * count + F.greatest("block", "o")).alias("pair"), "block", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for b in batches:
            for pair, block, data in zip(*(b.column(c).to_pylist() for c in ("pair", "block", "data"))):
                i, j = divmod(pair, count)
                if i != j and block == i:
                    first = data
                    continue
                yield from meet(_read(first if i != j else data), _read(data) if i != j else None)

    pairs = min(count * (count + 1) // 2, 2000)
    return keyed.repartition(pairs, "pair").sortWithinPartitions("pair", "block").mapInArrow(run, schema)


def _read(data: bytes) -> Block:
    return pickle.loads(zlib.decompress(data))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) and x.min() >= 0 else x


# ---- bags ---------------------------------------------------------------------------------------------------------


def _pack_bags(t: pa.Table) -> Block:
    """ids, of (each id's place among the distinct bags) and the distinct bags: n features, their places in feats, counts."""
    t = t.combine_chunks()
    flat = np.stack([t.column("bag").combine_chunks().flatten().field(c).to_numpy() for c in ("feat_id", "cnt")], 1)
    ends = np.cumsum(pc.list_value_length(t.column("bag")).to_numpy())
    place: dict[bytes, int] = {}
    of = np.array([place.setdefault(flat[low:high].tobytes(), len(place)) for low, high in zip([0, *ends[:-1].tolist()], ends.tolist())])
    flat = np.frombuffer(b"".join(place), "int64").reshape(-1, 2)
    feats, code = np.unique(flat[:, 0], return_inverse=True)
    return {"ids": t.column("mol_id").to_numpy(), "of": _small(of), "n": _small(np.array([len(b) // 16 for b in place])), "feats": feats, "code": _small(code), "cnt": _small(flat[:, 1])}


def _shared(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of minima of all distinct bags of a and b, and their sizes: a minimum of counts is the number of levels that both reach, so levels of features are columns of a matrix product."""
    ra, rb = (np.repeat(np.arange(len(x["n"])), x["n"]) for x in (a, b))
    sa, sb = (np.bincount(r, x["cnt"], len(x["n"])) for r, x in ((ra, a), (rb, b)))
    total = np.zeros((len(sa), len(sb)))
    both = np.intersect1d(a["feats"], b["feats"])
    side = []
    for x, r in ((a, ra), (b, rb)):
        at = np.minimum(np.searchsorted(both, x["feats"]), max(0, len(both) - 1))
        known = (both[at] == x["feats"]) if len(both) else np.zeros(len(x["feats"]), bool)
        keep = known[x["code"]]
        side.append((r[keep], at[x["code"]][keep], x["cnt"][keep].astype("int64")))
    for low in range(0, len(both), COLUMNS):
        part = []
        for r, f, c in side:
            keep = (f >= low) & (f < low + COLUMNS)
            part.append((r[keep], f[keep] - low, c[keep]))
        tops = [np.zeros(COLUMNS, "int64"), np.zeros(COLUMNS, "int64")]
        for top, (_, f, c) in zip(tops, part):
            np.maximum.at(top, f, c)
        level = np.minimum(*tops)  # beyond this level one side has nothing
        # counts between two levels that occur are alike: a column weighs as much as the levels that it stands for
        done = 0
        marks = np.unique(np.concatenate([np.minimum(c, level[f]) for _, f, c in part]))
        for mark in marks[marks > 0].tolist():
            cols = np.flatnonzero(level > done)
            where = np.full(COLUMNS, -1)
            where[cols] = np.arange(len(cols))
            made = []
            for (r, f, c), rows in zip(part, (len(sa), len(sb))):
                m = np.zeros((rows, len(cols)), "float32")
                keep = (c >= mark) & (where[f] >= 0)
                m[r[keep], where[f[keep]]] = 1
                made.append(m)
            total += (mark - done) * (made[0] @ made[1].T).astype(float)
            done = mark
    return total, sa, sb


def _distances(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all distinct bags, and which share a feature."""
    total, sa, sb = _shared(a, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - total / (sa[:, None] + sb[None, :] - total), total > 0


def _expanded(a: Block, b: Block | None, value: np.ndarray, there: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(smaller id, larger id, value) of all pairs of members whose distinct contents are there; within one block each pair once."""
    same = b is None
    b = a if same else b
    step = max(1, BATCH // max(1, len(b["ids"])))
    for low in range(0, len(a["ids"]), step):
        rows = np.arange(low, min(low + step, len(a["ids"])))
        keep = there[a["of"][rows]][:, b["of"]]
        if same:
            keep &= rows[:, None] < np.arange(len(b["ids"]))[None, :]
        r, c = np.nonzero(keep)
        if len(r):
            x, y = a["ids"][rows[r]], b["ids"][c]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(value[a["of"][rows[r]], b["of"][c]])], names)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x to so many digits, halves up, as SQL's round."""
    v = x * 10.0**digits
    low = np.floor(v)
    return (low + (v - low >= 0.5)) / 10.0**digits


def _bags(fp: DataFrame) -> DataFrame:
    """(mol_id, bag, h): sorted bags and their hashes."""
    kept = fp.select(F.col("mol_id").cast("long").alias("mol_id"), F.col("feat_id").cast("long").alias("feat_id"), F.col("cnt").cast("long").alias("cnt"))
    return kept.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("feat_id", "cnt"))).alias("bag")).withColumn("h", F.xxhash64("bag"))


def full(fp: DataFrame) -> bool:
    """Whether the inverted index would make more pairs than there are pairs of entities."""
    if not fits(fp, "mol_id", "feat_id", "cnt"):
        return False
    return fuller(fp.groupBy("feat_id").agg(F.count(F.lit(1)).alias("n")), fp.select("mol_id").distinct().count())


def distances(fp: DataFrame, digits: int | None = None) -> DataFrame:
    """(src, dst, d), src < dst, for all pairs that share a feature. Equal bags are numbered side by side, so that a block compares them once."""
    rows = scratch(_bags(fp), "grid")
    blocks, count = _packed(rows, ["h", "mol_id"], _pack_bags, rows.count())

    def meet(a: Block, b: Block | None) -> Iterator[pa.RecordBatch]:
        d, there = _distances(a, a if b is None else b)
        yield from _expanded(a, b, d if digits is None else rounded(d, digits), there, ["src", "dst", "d"])

    return _met(blocks, count, meet, "src long, dst long, d double")


def forest_edges(fp: DataFrame) -> DataFrame:
    """(src, dst, d): edges among which are all of the minimum spanning forest, equal weights by (src, dst).

    Of equal bags the one with the smallest id stands for all, the others hang on it: no edge is before theirs. An edge
    that is not in the forest of some of the edges is not in that of all, so each two blocks give their own forest only.
    """
    rows = scratch(_bags(fp), "grid")
    classes = scratch(rows.groupBy("h", "bag").agg(F.min("mol_id").alias("mol_id")), "grid")
    stars = rows.withColumnRenamed("mol_id", "dst").join(classes.withColumnRenamed("mol_id", "src"), ["h", "bag"]).where("src < dst").select("src", "dst", F.lit(0.0).alias("d"))
    blocks, count = _packed(classes, ["mol_id"], _pack_bags, classes.count())

    def meet(a: Block, b: Block | None) -> Iterator[pa.RecordBatch]:
        same = b is None
        b = a if same else b
        d, there = _distances(a, b)
        d[~there] = np.inf
        if same:
            d[np.tril_indices(len(d))] = np.inf
        s, t, w = local_forest(d, same)
        yield pa.RecordBatch.from_arrays([pa.array(a["ids"][s]), pa.array(b["ids"][t]), pa.array(w)], ["src", "dst", "d"])

    return stars.unionByName(_met(blocks, count, meet, "src long, dst long, d double"))


def local_forest(d: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and weights of the minimum spanning forest of the finite edges of d, equal weights by (row, column); same: rows and columns are the same nodes. d is used up."""
    n, m = d.shape
    col = np.arange(m) + (0 if same else n)
    comp = np.arange(n if same else n + m)
    out: list[tuple[np.ndarray, ...]] = []
    while d.size:
        # argmin takes the first: of equal weights the smallest column of a row, the smallest row of a column
        rb, cb = d.argmin(1), d.argmin(0)
        s, t = np.concatenate([np.arange(n), cb]), np.concatenate([rb, np.arange(m)])
        w, c = d[s, t], np.concatenate([comp[:n], comp[col]])
        keep = np.isfinite(w)
        s, t, w, c = s[keep], t[keep], w[keep], c[keep]
        if not len(s):
            break
        order = np.lexsort((t, s, w, c))
        s, t, w, c = s[order], t[order], w[order], c[order]
        best = np.concatenate([[True], c[1:] != c[:-1]])
        edge = np.unique(s[best].astype("int64") * m + t[best])
        s, t = edge // m, edge % m
        out.append((s, t, d[s, t]))
        root = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        for x, y in zip(comp[s].tolist(), comp[col[t]].tolist()):
            if (x := find(x)) != (y := find(y)):
                root[x] = y
        comp = np.array([find(x) for x in comp.tolist()])
        d[comp[:n][:, None] == comp[col][None, :]] = np.inf
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, "float64" if k == 2 else "int64") for k in range(3))


# ---- signatures ---------------------------------------------------------------------------------------------------


def _pack_signatures(t: pa.Table) -> Block:
    t = t.combine_chunks()
    sig = np.array(t.column("signature").to_pylist(), "int64")
    distinct, of = np.unique(sig, axis=0, return_inverse=True)
    return {"ids": t.column("mol_id").to_numpy(), "of": _small(of.reshape(-1)), "sig": distinct}


def agreeing(signatures: DataFrame, bands: int) -> DataFrame:
    """(a_id, b_id, estimate), a_id < b_id, of signatures(mol_id, signature): pairs that agree on all slots of some band."""
    rows = scratch(signatures.select(F.col("mol_id").cast("long").alias("mol_id"), "signature", F.xxhash64("signature").alias("h")), "grid")
    blocks, count = _packed(rows, ["h", "mol_id"], _pack_signatures, rows.count())

    def meet(a: Block, b: Block | None) -> Iterator[pa.RecordBatch]:
        x, y = a["sig"], (a if b is None else b)["sig"]
        k = x.shape[1]
        wide = k // bands
        shape = (len(x), len(y))
        equal, hit = np.zeros(shape, "uint16"), np.zeros(shape, bool)
        for i in range(k):
            code = np.unique(np.concatenate([x[:, i], y[:, i]]), return_inverse=True)[1].astype("uint16")
            e = code[: len(x)][:, None] == code[len(x) :][None, :]
            equal += e
            band = e if i % wide == 0 else band & e
            if i % wide == wide - 1 and i // wide < bands:
                hit |= band
        yield from _expanded(a, b, equal / k, hit, ["a_id", "b_id", "estimate"])

    return _met(blocks, count, meet, "a_id long, b_id long, estimate double")
