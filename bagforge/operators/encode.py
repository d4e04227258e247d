"""From molecules to bags: typed graphs, atom pairs, environments, layers in space."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chem
from ..shared import scratch

#: Atom typing schemes by name.
SCHEMES: dict[str, Callable[[chem.Mol], list]] = {
    "pi": chem.pi_types,
    "five": chem.five_types,
    "daylight": chem.daylight_types,
    "simple": chem.simple_types,
    "neighbours": chem.neighbour_types,
    "element": lambda m: [a.symbol for a in m.atoms],
}
TYPED = "idx long, name string, types array<string>, elements array<string>, dist array<array<int>>, diameter int, error string"


def typed(mols: DataFrame, scheme: str = "pi", hydrogens: bool = False) -> DataFrame:
    """Typed graphs of mols(idx, name, smiles): TYPED; what can't be read has its error and no atoms."""
    types = SCHEMES[scheme]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for idx, name, smiles in zip(b.idx, b.name_, b.smiles):
                try:
                    m = chem.parse(smiles)
                    m = chem.with_hydrogens(m) if hydrogens else m
                    d = chem.distances(m)
                    out.append((idx, name, [str(t) for t in types(m)], [a.symbol for a in m.atoms], d, max(map(max, d)), None))
                except (ValueError, TypeError) as e:
                    out.append((idx, name, [], [], [], 0, str(e)))
            yield pd.DataFrame(out, columns=["idx", "name", "types", "elements", "dist", "diameter", "error"])

    return mols.select("idx", F.col("name").alias("name_"), "smiles").mapInPandas(run, TYPED)


#: Atoms that one Arrow batch of `typed_atoms` holds at most.
ATOM_BATCH = 100_000


def typed_atoms(mols: DataFrame, schemes: list[str]) -> DataFrame:
    """(idx, atom, *schemes): a row per atom of mols(idx, smiles) with its type in each scheme; none of what can't be read.

    One pass makes all schemes, so nothing is joined; a text is typed once a batch, however often it occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("smiles").dictionary_encode()
            counts, flat = [], {s: [] for s in schemes}
            for smiles in texts.dictionary.to_pylist():
                try:
                    m = chem.parse(smiles)
                    made = {s: [str(t) for t in SCHEMES[s](m)] for s in schemes}
                except (ValueError, TypeError):
                    made = {s: [] for s in schemes}
                counts.append(len(made[schemes[0]]))
                for s in schemes:
                    flat[s] += made[s]
            types = [pa.array(flat[s], "string") for s in schemes]
            n = np.array([*counts, 0], "int64")  # the last: no text at all
            first = np.cumsum(n) - n
            code = texts.indices.fill_null(len(counts)).to_numpy(zero_copy_only=False).astype("int64")
            ends = np.cumsum(n[code])
            for low in range(0, int(ends[-1]) if len(ends) else 0, ATOM_BATCH):
                k = np.arange(low, min(low + ATOM_BATCH, int(ends[-1])))
                row = np.searchsorted(ends, k, "right")
                atom = k - (ends - n[code])[row]
                at = pa.array(first[code][row] + atom)
                yield pa.RecordBatch.from_arrays([b.column("idx").take(pa.array(row)), pa.array(atom.astype("int32")), *[t.take(at) for t in types]], ["idx", "atom", *schemes])

    return mols.select("idx", "smiles").mapInArrow(run, "idx long, atom int, " + ", ".join(f"{s} string" for s in schemes))


def properties(mols: DataFrame) -> DataFrame:
    """mols(idx, name, smiles) with what the kernel computes: mass, heavy atoms, charge, rings, rotatable bonds, acceptors, donors, formula; what can't be read has its error and nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for idx, name, smiles in zip(b.idx, b.name_, b.smiles):
                try:
                    m = chem.parse(smiles)
                except (ValueError, TypeError) as e:
                    rows.append((idx, name, *[None] * 10, str(e)))
                    continue
                h = chem.hydrogen_count(m)
                hetero = [i for i, a in enumerate(m.atoms) if a.symbol in ("N", "O")]
                rows.append((idx, name, chem.mass(m), sum(a.symbol != "H" for a in m.atoms), sum(a.charge for a in m.atoms), chem.ring_count(m), len(chem.rotatable_bonds(m)), len(hetero), sum(h[i] > 0 for i in hetero), chem.formula(chem.all_elements(m)), sorted({a.symbol for a in m.atoms}), chem.peptide_chain(m), None))
            yield pd.DataFrame(rows, columns=["idx", "name", "MolW", "HA", "FC", "rings", "RotB", "HBA", "HBD", "formula", "elements", "peptide_bonds", "error"], dtype=object)

    return mols.select("idx", F.col("name").alias("name_"), "smiles").mapInPandas(run, "idx long, name string, MolW double, HA int, FC int, rings int, RotB int, HBA int, HBD int, formula string, elements array<string>, peptide_bonds int, error string")


def generate(mols: DataFrame, how: Callable[[chem.Mol], list[chem.Mol]]) -> DataFrame:
    """(idx, name, smiles) of each distinct molecule that `how` makes of each of mols; nothing of unreadable ones (`molecules.rejects`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for idx, name, smiles in zip(b.idx, b.name_, b.smiles):
                m = chem.readable(smiles)
                made = dict.fromkeys(chem.write(x) for x in how(m)) if m else {}
                rows += [(idx, f"{name}_{k:03d}", s) for k, s in enumerate(made)]
            yield pd.DataFrame(rows, columns=["idx", "name", "smiles"])

    return mols.select("idx", F.col("name").alias("name_"), "smiles").mapInPandas(run, "idx long, name string, smiles string")


def atom_pairs(graphs: DataFrame, self_pairs: bool = True, max_dist: int | None = None) -> DataFrame:
    """(idx, name, lo, dist, hi, cnt): pairs of atoms by their types and the bonds between them.

    self_pairs counts each atom with itself at distance 0. The pairs of a molecule never leave its row's task: they
    are exploded, filtered by distance and counted per molecule.
    """
    i = graphs.select("idx", "name", "types", "dist", F.posexplode("types").alias("i", "ti"))
    j = i.select("idx", "name", "i", "ti", F.element_at("dist", F.col("i") + 1).alias("d"), F.posexplode("types").alias("j", "tj"))
    p = j.where(F.col("i") <= F.col("j") if self_pairs else F.col("i") < F.col("j")).select("idx", "name", F.least("ti", "tj").alias("lo"), F.element_at("d", F.col("j") + 1).alias("dist"), F.greatest("ti", "tj").alias("hi")).where("dist >= 0")
    if max_dist is not None:
        p = p.where(F.col("dist") <= max_dist)
    return p.groupBy("idx", "name", "lo", "dist", "hi").agg(F.count(F.lit(1)).cast("int").alias("cnt"))


def pair_text(reverse: bool = True) -> Column:
    """`lo-dist-hi`."""
    return F.concat_ws("-", "lo", "dist", "hi")


def environments(graphs: DataFrame, radii: list[int]) -> DataFrame:
    """(idx, name, feat, cnt): concentric environments of each atom, an environment only at the first radius that shows it.

    Text: layers `depth_type:n,type:n` joined by `;`, types in order; layers stop at the molecule's diameter.
    """
    top = max(radii)
    i = graphs.select("idx", "name", "types", "dist", "diameter", F.posexplode("types").alias("i", "_t"))
    j = i.select("idx", "name", "diameter", "i", F.explode(F.arrays_zip(F.element_at("dist", F.col("i") + 1).alias("d"), F.col("types").alias("t"))).alias("x"))
    layer = j.where(F.col("x.d").between(0, top)).groupBy("idx", "name", "diameter", "i", F.col("x.d").alias("d"), F.col("x.t").alias("t")).count()
    texts = layer.groupBy("idx", "name", "diameter", "i", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "count"))), lambda s: F.concat_ws(":", s["t"], s["count"])), ",").alias("s"))
    atom = texts.groupBy("idx", "name", "diameter", "i").agg(F.array_sort(F.collect_list(F.struct("d", F.concat_ws("_", "d", "s").alias("s")))).alias("layers"))
    r = F.explode(F.array(*[F.lit(x) for x in sorted(radii)])).alias("r")
    env = atom.select("idx", "name", "diameter", "i", "layers", r)
    reach = F.least("r", "diameter")
    text = F.array_join(F.transform(F.filter("layers", lambda s: s["d"] <= reach), lambda s: s["s"]), ";")
    counted = env.select("idx", "name", "i", "r", text.alias("feat")).groupBy("idx", "name", "feat", "r").count()
    return counted.groupBy("idx", "name", "feat").agg(F.min_by("count", "r").cast("int").alias("cnt"))


def layered_formulas(graphs: DataFrame, radius: int | None = None) -> DataFrame:
    """(idx, name, feat, cnt): for each heavy atom, the formulas of its layers 0 to r joined by commas, for every r.

    graphs carry hydrogens and their elements.
    """
    i = graphs.select("idx", "name", "elements", "dist", F.posexplode("elements").alias("i", "e")).where("e != 'H'")
    j = i.select("idx", "name", "i", F.explode(F.arrays_zip(F.element_at("dist", F.col("i") + 1).alias("d"), F.col("elements").alias("t"))).alias("x")).where("x.d >= 0")
    if radius is not None:
        j = j.where(F.col("x.d") <= radius)
    layer = j.groupBy("idx", "name", "i", F.col("x.d").alias("d"), F.col("x.t").alias("t")).count()
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "count"))), lambda s: F.concat(s["t"], F.when(s["count"] > 1, s["count"].cast("string")).otherwise(""))), "")
    atom = layer.groupBy("idx", "name", "i", "d").agg(one.alias("s")).groupBy("idx", "name", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda s: s["s"]).alias("layers"))
    feat = F.explode(F.transform(F.sequence(F.lit(1), F.size("layers")), lambda n: F.array_join(F.slice("layers", 1, n), ","))).alias("feat")
    return atom.select("idx", "name", feat).groupBy("idx", "name", "feat").agg(F.count(F.lit(1)).cast("int").alias("cnt"))


def bigrams(rows: DataFrame, mol: str, words: Column) -> DataFrame:
    """(mol, first, second, n): consecutive words of each row's array, counted per entity; pairs are made in the row, so nothing is joined."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return rows.select(mol, F.explode(pairs).alias("p")).groupBy(mol, F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.count(F.lit(1)).alias("n"))


#: Elements with a channel of their own in layers in space.
CHANNELS = (1, 6, 7, 8, 9, 15, 16, 17, 35, 53)


def radial_layers(atoms: DataFrame, cutoff: float, step: float) -> DataFrame:
    """(mol_id, atom, bin, channel, w) of atoms(mol_id, atom, anum, x, y, z): others within the cutoff, shared between the two nearest bins."""
    a = atoms.select("mol_id", F.col("atom").alias("atom"), *[F.col(c).alias(f"{c}0") for c in "xyz"])
    b = atoms.select("mol_id", F.col("atom").alias("other"), "anum", "x", "y", "z")
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "xyz"), F.lit(0.0)))
    near = a.join(b, "mol_id").where("atom != other").withColumn("d", d).where(F.col("d") < cutoff)
    at = F.col("d") / step
    low = F.floor(at)
    shares = F.explode(F.array(F.struct(low.alias("bin"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("bin"), (at - low).alias("w")))).alias("s")
    channel = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("anum")) - 1
    return near.select("mol_id", "atom", channel.alias("channel"), shares).where("channel >= 0").groupBy("mol_id", "atom", F.col("s.bin").alias("bin"), "channel").agg(F.sum("s.w").alias("w"))


def space_graphs(atoms: DataFrame) -> DataFrame:
    """(idx, name, types, dist, diameter) of atoms(idx, name, atom, type, x, y, z): distances in whole units, cut, so that `atom_pairs` counts pairs in space.

    A molecule's atoms are in the order of `atom`; diameter is the largest distance.
    """
    one = atoms.groupBy("idx", "name").agg(F.array_sort(F.collect_list(F.struct("atom", F.col("type").cast("string").alias("type"), "x", "y", "z"))).alias("a"))
    far = lambda p, q: F.floor(F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz"), F.lit(0.0)))).cast("int")
    d = one.select("idx", "name", F.col("a.type").alias("types"), F.transform("a", lambda p: F.transform("a", lambda q: far(p, q))).alias("dist"))
    return d.withColumn("diameter", F.array_max(F.transform("dist", F.array_max)))


def centres(atoms: DataFrame, matches: DataFrame) -> DataFrame:
    """(mol_id, match, x, y, z): the mean place of the atoms of each of matches(mol_id, match, atom); an atom named twice counts once."""
    return matches.select("mol_id", "match", "atom").distinct().join(atoms, ["mol_id", "atom"]).groupBy("mol_id", "match").agg(*[F.avg(c).alias(c) for c in "xyz"])


#: Centres of a task and pairs of neighbours that a kernel holds at a time.
CENTRES, ANGLES = 256, 32_768
FARTHEST = 1e9


def angular_layers(atoms: DataFrame, cutoff: float, step: float) -> DataFrame:
    """(mol_id, atom, bin, ca, cb, w), w > 0: angles (radians) between each two neighbours within the cutoff, binned, by the two neighbours' channels.

    Space is cut into cells as wide as the cutoff, so an atom's neighbours are in 27 of them; angles are made as matrices and
    never rows. Atoms at one place have the same layers, neighbours at one place and of one channel the same angles: both are
    made once. Atoms without a place, and neighbours without a channel, count nothing. Names that occur twice in a molecule
    are joined, as their neighbours may be anywhere.
    """
    a = atoms.dropna(subset=["mol_id", "atom", *"xyz"])
    channel = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("anum")) - 1, F.lit(-1)).cast("int")
    a = a.select("mol_id", "atom", channel.alias("channel"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    twice = a.groupBy("mol_id", "atom").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mol_id").distinct()
    if twice.isEmpty():
        return _angles_by_cells(a, cutoff, step)
    twice = scratch(twice, "angles")
    return _angles_by_cells(a.join(twice, "mol_id", "left_anti"), cutoff, step).unionByName(_angles_by_joins(a.join(twice, "mol_id", "left_semi"), cutoff, step))


def _angles_by_joins(a: DataFrame, cutoff: float, step: float) -> DataFrame:
    """angular_layers of a(mol_id, atom, channel, x, y, z), whose names may occur twice: a row for each two neighbours."""
    b = a.select("mol_id", F.col("atom").alias("other"), "channel", *[F.col(c).alias(f"{c}1") for c in "xyz"]).where("channel >= 0")
    vec = a.drop("channel").join(b, "mol_id").where("atom != other").select("mol_id", "atom", "other", "channel", *[(F.col(f"{c}1") - F.col(c)).alias(f"d{c}") for c in "xyz"])
    vec = vec.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))).where((F.col("d") < cutoff) & (F.col("d") > 0))
    left, right = (vec.select("mol_id", "atom", *[F.col(c).alias(f"{c}_{s}") for c in ("other", "channel", "dx", "dy", "dz", "d")]) for s in "ab")
    both = left.join(right, ["mol_id", "atom"]).where("other_a < other_b")
    cos = sum((F.col(f"d{c}_a") * F.col(f"d{c}_b") for c in "xyz"), F.lit(0.0)) / (F.col("d_a") * F.col("d_b"))
    at = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / step
    low = F.floor(at)
    shares = F.explode(F.array(F.struct(low.alias("bin"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("bin"), (at - low).alias("w")))).alias("s")
    ca, cb = F.least("channel_a", "channel_b").cast("long"), F.greatest("channel_a", "channel_b").cast("long")
    return both.select("mol_id", "atom", ca.alias("ca"), cb.alias("cb"), shares).groupBy("mol_id", "atom", F.col("s.bin").alias("bin"), "ca", "cb").agg(F.sum("s.w").alias("w")).where("w > 0")


def _angles_by_cells(a: DataFrame, cutoff: float, step: float) -> DataFrame:
    """angular_layers of a(mol_id, atom, channel, x, y, z), names once in a molecule: a row for each cell and CENTRES of its atoms."""
    wide = cutoff * (1 + 1e-6) or 1.0  # rounding moves no neighbour beyond the next cell
    at = [F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.col(c) / wide))) for c in "xyz"]
    near = F.explode(F.array(*[F.struct(*[(x + o).alias(n) for x, o, n in zip(at, by, "ijk")], F.lit(by == (0, 0, 0)).alias("own")) for by in product((-1, 0, 1), repeat=3)]))
    seen = a.select("*", near.alias("c")).select("mol_id", "c.i", "c.j", "c.k", F.struct("atom", "channel", *"xyz", "c.own").alias("a"))
    cells = seen.groupBy("mol_id", *"ijk").agg(F.collect_list("a").alias("a"), F.count_if("a.own").alias("n")).where("n > 0")
    cells = scratch(cells.withColumn("parts", F.ceil(F.col("n") / CENTRES).cast("int")), "angles")
    tasks = max(1, min(cells.agg(F.sum("parts")).first()[0] or 0, 2000))
    parts = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(tasks, "mol_id", *"ijk", "part").select("mol_id", "a", "part", "parts")
    kind = dict(a.dtypes)
    names = ["mol_id", "atom", "bin", "ca", "cb", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                mol, rows = b.column("mol_id").slice(r, 1), b.column("a").slice(r, 1).flatten()
                part, parts = (b.column(c)[r].as_py() for c in ("part", "parts"))
                for which, found in _angles(rows, cutoff, step, part, parts):
                    n = len(which)
                    yield pa.RecordBatch.from_arrays([mol.take(pa.array(np.zeros(n, "int32"))), rows.field("atom").take(pa.array(which)), *map(pa.array, found)], names)

    return parts.mapInArrow(run, f"mol_id {kind['mol_id']}, atom {kind['atom']}, bin long, ca long, cb long, w double")


def _angles(rows: pa.StructArray, cutoff: float, step: float, part: int, parts: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(places in rows of atoms, [bin, ca, cb, w]) of every parts-th place of a cell: rows(channel, x, y, z, own) are the cell's own atoms and those about it."""
    channel = rows.field("channel").to_numpy()
    own = rows.field("own").to_numpy(zero_copy_only=False)
    xyz = np.stack([rows.field(c).to_numpy() for c in "xyz"], 1)
    known = channel >= 0
    kinds, m = np.unique(np.column_stack([channel[known], xyz[known]]), axis=0, return_counts=True)  # by channel, then place
    centres, of = np.unique(xyz[own], axis=0, return_inverse=True)
    order = np.argsort(of.reshape(-1), kind="stable")
    members = np.split(np.flatnonzero(own)[order], np.cumsum(np.bincount(of.reshape(-1), minlength=len(centres)))[:-1])
    held = kinds[:, 0].astype("int64")
    bins, n = int(np.pi / step) + 3, len(CHANNELS)
    for c in range(part, len(centres), parts):
        with np.errstate(invalid="ignore", over="ignore"):
            v = kinds[:, 1:] - centres[c]
            d = np.sqrt(v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1] + v[:, 2] * v[:, 2])
        near = (d > 0) & (d < cutoff)
        w = _angle_sums(*np.ascontiguousarray(v[near].T), d[near], held[near], m[near].astype(float), step, bins, n).reshape(-1)
        at = np.flatnonzero(w > 0)
        if len(at):
            made = [at % bins, at // bins // n, at // bins % n, w[at]]
            for low in range(0, len(members[c]), CENTRES):
                some = members[c][low : low + CENTRES]
                yield np.repeat(some, len(at)), [np.tile(x, len(some)) for x in made]


def _angle_sums(x: np.ndarray, y: np.ndarray, z: np.ndarray, d: np.ndarray, channel: np.ndarray, m: np.ndarray, step: float, bins: int, n: int) -> np.ndarray:
    """Shares by (smaller channel, larger channel, bin) of all pairs of neighbours in order of channel, each of them m times there. The operations are those of the SQL, so that rounding near 0 is too."""
    out = np.zeros((n * n, bins))
    cuts = [*np.flatnonzero(np.diff(channel, prepend=-1)).tolist(), len(channel)]
    for low, high in zip(cuts, cuts[1:]):
        r = low
        while r < high:
            e = min(high, r + max(1, ANGLES // (len(x) - r)))
            a, b = slice(r, e), slice(r, None)
            cos = np.multiply.outer(x[a], x[b])
            cos += np.multiply.outer(y[a], y[b])
            cos += np.multiply.outer(z[a], z[b])
            with np.errstate(invalid="ignore", divide="ignore"):
                cos /= np.multiply.outer(d[a], d[b])
            t = np.arccos(np.maximum(np.fmin(cos, 1.0, out=cos), -1.0, out=cos), out=cos)
            t /= step
            bin_ = t.astype(np.intp)
            t -= bin_
            w = np.multiply.outer(m[a], m[b])
            w[:, : e - r] = np.triu(w[:, : e - r], 1)
            w[np.arange(e - r), np.arange(e - r)] = m[a] * (m[a] - 1) / 2
            t *= w
            w -= t
            bin_ += channel[b] * bins
            bin_, size, first = bin_.reshape(-1), n * bins, int(channel[r]) * n
            out[first : first + n] += np.bincount(bin_, w.reshape(-1), size).reshape(n, bins)
            out[first : first + n, 1:] += np.bincount(bin_, t.reshape(-1), size).reshape(n, bins)[:, :-1]
            r = e
    return out


def diameters(atoms: DataFrame) -> DataFrame:
    """(mol_id, diameter): largest distance between two atoms."""
    b = atoms.select("mol_id", *[F.col(c).alias(f"{c}1") for c in "xyz"])
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}1")) * (F.col(c) - F.col(f"{c}1")) for c in "xyz"), F.lit(0.0)))
    return atoms.join(b, "mol_id").groupBy("mol_id").agg(F.max(d).alias("diameter"))


def box_of(atoms: DataFrame, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One row per mol_id: least, largest and mean of each coordinate, the extents' product as volume."""
    aggs = [f(c).alias(f"{n}_{c}") for c in dims for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    volume = F.lit(1.0)
    for c in dims:
        volume = volume * (F.col(f"max_{c}") - F.col(f"min_{c}"))
    return atoms.groupBy("mol_id").agg(*aggs).withColumn("volume", volume)


def godel(elements: Column, primes: dict[str, int]) -> Column:
    """Product over elements (map symbol -> count) of prime^count, null where it passes 38 digits."""
    table = F.create_map(*[F.lit(x) for kv in primes.items() for x in kv])
    factors = F.flatten(F.transform(F.map_entries(elements), lambda e: F.array_repeat(F.element_at(table, e["key"]), e["value"])))
    logs = F.aggregate(factors, F.lit(0.0), lambda s, p: s + F.log10(p))
    product = F.aggregate(factors, F.lit(1).cast("decimal(38,0)"), lambda s, p: (s * p).cast("decimal(38,0)"))
    return F.when(logs < 37.9, product)
