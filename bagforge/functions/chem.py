"""A small chemistry kernel: SMILES to graphs, hydrogens, rings, distances, atom types, and graphs back to SMILES.

It trusts the aromatic flags of the input and writes SMILES that are valid but not canonical.
"""

from __future__ import annotations

import random
import re
from collections import Counter, deque
from dataclasses import dataclass, field

#: Elements by atomic number, from 1.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: i + 1 for i, s in enumerate(SYMBOLS)} | {"*": 0}
#: Usual valences.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
#: Average atomic masses of the common elements.
MASSES = {"H": 1.008, "B": 10.812, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.99, "Mg": 24.305, "Si": 28.086, "P": 30.974, "S": 32.067, "Cl": 35.453, "K": 39.098, "Ca": 40.078, "Fe": 55.845, "Zn": 65.39, "Se": 78.96, "Br": 79.904, "I": 126.904}
#: Letters of bond orders in SMILES.
ORDERS = {"-": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5, "/": 1.0, "\\": 1.0, "~": 1.0}

_TOKEN = re.compile(r"\[(?P<iso>\d*)(?P<sym>\*|[A-Z][a-z]?|[a-z][a-z]?)(?P<chi>@{0,2}[A-Z0-9]*?)(?P<h>H\d*)?(?P<q>[+-]+\d*)?(?::(?P<map>\d+))?\]|(?P<org>Cl|Br|[BCNOPSFI*]|[bcnops])|(?P<bond>[-=#$:/\\~])|(?P<ring>%\d\d|\d)|(?P<open>\()|(?P<close>\))|(?P<dot>\.)")


@dataclass
class Atom:
    symbol: str
    aromatic: bool = False
    charge: int = 0
    hydrogens: int = 0
    bracket: bool = False
    isotope: int = 0
    chiral: str = ""


@dataclass
class Mol:
    """Heavy atoms (and explicit hydrogens) with bonds {(i, j): order}, i < j."""

    atoms: list[Atom] = field(default_factory=list)
    bonds: dict[tuple[int, int], float] = field(default_factory=dict)
    stereo: set[tuple[int, int]] = field(default_factory=set)

    def neighbours(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.atoms]
        for i, j in self.bonds:
            out[i].append(j)
            out[j].append(i)
        return out

    def order(self, i: int, j: int) -> float:
        return self.bonds[min(i, j), max(i, j)]

    def copy(self) -> Mol:
        return Mol([Atom(**vars(a)) for a in self.atoms], dict(self.bonds), set(self.stereo))


def parse(smiles: str) -> Mol:
    """The graph of a SMILES text; raises ValueError where it isn't one."""
    m, stack, last, bond, rings, at = Mol(), [], -1, "", {}, 0
    while at < len(smiles):
        t = _TOKEN.match(smiles, at)
        if not t:
            raise ValueError(f"not SMILES at {at}: {smiles}")
        at = t.end()
        if t["sym"] or t["org"]:
            raw = t["sym"] or t["org"]
            symbol = raw[0].upper() + raw[1:]
            if symbol not in NUMBER:
                raise ValueError(f"no element {raw}: {smiles}")
            h = t["h"]
            m.atoms.append(Atom(symbol, raw[0].islower(), _charge(t["q"]), (int(h[1:] or 1) if h else 0), bool(t["sym"]), int(t["iso"] or 0), t["chi"] or ""))
            if last >= 0:
                _join(m, last, len(m.atoms) - 1, bond)
            last, bond = len(m.atoms) - 1, ""
        elif t["bond"]:
            if bond or last < 0:
                raise ValueError(f"a bond without its atom at {at}: {smiles}")
            bond = t["bond"]
        elif t["ring"]:
            n = int(t["ring"].lstrip("%"))
            if last < 0:
                raise ValueError(f"a ring without its atom at {at}: {smiles}")
            if n in rings:
                other, earlier = rings.pop(n)
                _join(m, other, last, bond or earlier)
            else:
                rings[n] = (last, bond)
            bond = ""
        elif bond:
            raise ValueError(f"a bond to nothing at {at}: {smiles}")
        elif t["open"]:
            if last < 0:
                raise ValueError(f"a branch without its atom at {at}: {smiles}")
            stack.append(last)
        elif t["close"]:
            if not stack:
                raise ValueError(f"unbalanced: {smiles}")
            last = stack.pop()
        else:
            last = -1
    if rings or stack or bond or not m.atoms:
        raise ValueError(f"unfinished: {smiles}")
    for i, a in enumerate(m.atoms):
        if not a.bracket and a.symbol != "*":
            a.hydrogens = implicit_hydrogens(m, i)
    return m


def readable(smiles: str | None) -> Mol | None:
    """The graph of a text, or nothing where the text has none."""
    try:
        return parse(smiles)
    except (ValueError, KeyError, TypeError):
        return None


def _charge(q: str | None) -> int:
    if not q:
        return 0
    sign = 1 if q[0] == "+" else -1
    digits = q.lstrip("+-")
    return sign * (int(digits) if digits else len(q))


def _join(m: Mol, i: int, j: int, bond: str) -> None:
    if i == j or (min(i, j), max(i, j)) in m.bonds:
        raise ValueError("an atom joined to itself or twice")
    order = ORDERS[bond] if bond else 1.5 if m.atoms[i].aromatic and m.atoms[j].aromatic else 1.0
    m.bonds[min(i, j), max(i, j)] = order
    if bond in ("/", "\\"):
        m.stereo.add((min(i, j), max(i, j)))


def implicit_hydrogens(m: Mol, i: int) -> int:
    a = m.atoms[i]
    orders = [o for (x, y), o in m.bonds.items() if i in (x, y)]
    used = sum(1.0 if o == 1.5 else o for o in orders)
    if a.aromatic:
        used += 1 if a.symbol in ("C", "B", "N", "P") and all(o <= 1.5 for o in orders) and (a.symbol == "C" or len(orders) < 3) else 0
    for v in VALENCES.get(a.symbol, ()):
        if v >= used:
            return int(v - used) if not (a.aromatic and a.symbol != "C") else 0
    return 0


def with_hydrogens(m: Mol) -> Mol:
    """All hydrogens as atoms, after the others."""
    out = m.copy()
    for i, a in enumerate(m.atoms):
        out.atoms[i].hydrogens = 0
        for _ in range(a.hydrogens):
            out.atoms.append(Atom("H"))
            out.bonds[i, len(out.atoms) - 1] = 1.0
    return out


def distances(m: Mol) -> list[list[int]]:
    """Bonds between each two atoms; -1 where there is no path."""
    near, out = m.neighbours(), []
    for s in range(len(m.atoms)):
        d = [-1] * len(m.atoms)
        d[s], todo = 0, deque([s])
        while todo:
            i = todo.popleft()
            for j in near[i]:
                if d[j] < 0:
                    d[j] = d[i] + 1
                    todo.append(j)
        out.append(d)
    return out


def ring_bonds(m: Mol) -> set[tuple[int, int]]:
    """Bonds on a cycle: those that are no bridges."""
    near, seen, low, out, clock = m.neighbours(), {}, {}, set(m.bonds), 0
    for root in range(len(m.atoms)):
        if root in seen:
            continue
        stack = [(root, -1, iter(near[root]))]
        seen[root] = low[root] = clock
        clock += 1
        while stack:
            i, parent, rest = stack[-1]
            for j in rest:
                if j == parent:
                    continue
                if j in seen:
                    low[i] = min(low[i], seen[j])
                else:
                    seen[j] = low[j] = clock
                    clock += 1
                    stack.append((j, i, iter(near[j])))
                    break
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[i])
                    if low[i] > seen[parent]:
                        out.discard((min(i, parent), max(i, parent)))
    return out


def ring_atoms(m: Mol) -> set[int]:
    return {i for b in ring_bonds(m) for i in b}


def ring_count(m: Mol) -> int:
    """Independent cycles."""
    return len(m.bonds) - len(m.atoms) + len(components(m))


def components(m: Mol) -> list[list[int]]:
    near, seen, out = m.neighbours(), set(), []
    for s in range(len(m.atoms)):
        if s in seen:
            continue
        part, todo = [], [s]
        seen.add(s)
        while todo:
            i = todo.pop()
            part.append(i)
            for j in near[i]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append(sorted(part))
    return out


def pi_electrons(m: Mol, i: int) -> int:
    if m.atoms[i].aromatic:
        return 1
    orders = [o for (x, y), o in m.bonds.items() if i in (x, y)]
    return int(sum(orders) - len(orders))


def heavy_degree(m: Mol) -> list[int]:
    return [sum(m.atoms[j].symbol != "H" for j in n) for n in m.neighbours()]


def hydrogen_count(m: Mol) -> list[int]:
    return [a.hydrogens + sum(m.atoms[j].symbol == "H" for j in n) for a, n in zip(m.atoms, m.neighbours())]


def pi_types(m: Mol) -> list[str]:
    """`[pi]Symbol heavy-neighbours [charge]` of each atom."""
    out = []
    for i, (a, n) in enumerate(zip(m.atoms, heavy_degree(m))):
        pi = pi_electrons(m, i)
        sign = "" if not a.charge else "-" if a.charge == -1 else "+" if a.charge == 1 else f"{a.charge:+d}"
        out.append(f"{pi or ''}{a.symbol}{n}{sign}")
    return out


def valence(m: Mol, i: int) -> int:
    orders = [o for (x, y), o in m.bonds.items() if i in (x, y)]
    fused = sum(o == 1.5 for o in orders)
    return m.atoms[i].hydrogens + int(sum(o for o in orders if o != 1.5)) + (fused + (1 if fused and m.atoms[i].symbol in ("C", "B") else 1 if fused == 2 and m.atoms[i].symbol in ("N", "P") and not m.atoms[i].hydrogens and len(orders) == 2 else 0))


def five_types(m: Mol) -> list[str]:
    """`(number,heavy neighbours,hydrogens,valence to heavy atoms,charge)` of each atom."""
    h = hydrogen_count(m)
    return [f"({NUMBER[a.symbol]},{n},{h[i]},{valence(m, i) - h[i]},{a.charge})" for i, (a, n) in enumerate(zip(m.atoms, heavy_degree(m)))]


def daylight_types(m: Mol) -> list[str]:
    """`(number,heavy neighbours,hydrogens,valence to heavy atoms,charge,in a ring)` of each heavy atom; hydrogens have none."""
    h, ring = hydrogen_count(m), ring_atoms(m)
    return ["" if a.symbol == "H" else f"({NUMBER[a.symbol]},{n},{h[i]},{valence(m, i) - h[i]},{a.charge},{int(i in ring)})" for i, (a, n) in enumerate(zip(m.atoms, heavy_degree(m)))]


def _ring_kind(m: Mol) -> list[int]:
    on = ring_atoms(m)
    return [0 if i not in on else 2 if a.aromatic else 1 for i, a in enumerate(m.atoms)]


def simple_types(m: Mol) -> list[int]:
    """(number, charge + 3, ring kind, heavy neighbours, hydrogens) in decimal digits, three for the number."""
    h, ring = hydrogen_count(m), _ring_kind(m)
    return [packed([NUMBER[a.symbol], a.charge + 3, ring[i], n, h[i]]) for i, (a, n) in enumerate(zip(m.atoms, heavy_degree(m)))]


def neighbour_types(m: Mol) -> list[int]:
    """Number, charge + 3, ring kind and neighbours by element (other, C, H, N, O, P, S, F, Cl, Br, I) in decimal digits."""
    h, ring, near, out = hydrogen_count(m), _ring_kind(m), m.neighbours(), []
    kinds = ("C", "N", "O", "P", "S", "F", "Cl", "Br", "I")
    for i, a in enumerate(m.atoms):
        c = Counter(m.atoms[j].symbol for j in near[i] if m.atoms[j].symbol != "H")
        other = sum(n for s, n in c.items() if s not in kinds)
        out.append(packed([NUMBER[a.symbol], a.charge + 3, ring[i], other, c["C"], h[i], *(c[s] for s in kinds[1:])]))
    return out


def packed(values: list[int]) -> int:
    """The first value followed by one decimal digit for each other; ValueError where one needs more."""
    if any(not 0 <= v <= 9 for v in values[1:]):
        raise ValueError(f"a value beyond one digit: {values}")
    return int("".join(map(str, values)))


def formula(elements: list[str]) -> str:
    """Element counts, alphabetical, 1 left out."""
    return "".join(f"{e}{n if n > 1 else ''}" for e, n in sorted(Counter(elements).items()))


def all_elements(m: Mol) -> list[str]:
    return [a.symbol for a in m.atoms] + ["H"] * sum(a.hydrogens for a in m.atoms)


def mass(m: Mol) -> float:
    return sum(MASSES.get(e, float("nan")) for e in all_elements(m))


def rotatable_bonds(m: Mol) -> list[tuple[int, int]]:
    """Single bonds off rings between heavy atoms that each have another heavy neighbour."""
    ring, degree = ring_bonds(m), heavy_degree(m)
    return [(i, j) for (i, j), o in m.bonds.items() if o == 1.0 and (i, j) not in ring and "H" not in (m.atoms[i].symbol, m.atoms[j].symbol) and min(degree[i], degree[j]) > 1]


def cuttable_bonds(m: Mol) -> list[tuple[int, int]]:
    """Single bonds off rings without stereo at the bond or its ends."""
    ring = ring_bonds(m)
    marked = {i for i, a in enumerate(m.atoms) if a.chiral} | {i for b in m.stereo for i in b}
    return [(i, j) for (i, j), o in m.bonds.items() if o == 1.0 and (i, j) not in ring and i not in marked and j not in marked and "H" not in (m.atoms[i].symbol, m.atoms[j].symbol)]


def write(m: Mol, seed: int | None = None) -> str:
    """A SMILES text of the graph; a seed reorders it."""
    order = list(range(len(m.atoms)))
    if seed is not None:
        random.Random(seed).shuffle(order)
    rank = {a: k for k, a in enumerate(order)}
    near = [sorted(n, key=rank.__getitem__) for n in m.neighbours()]
    done: set[int] = set()
    parts = []
    for root in order:
        if root not in done:
            parts.append(_write_from(m, root, near, done))
    return ".".join(parts)


def _write_from(m: Mol, root: int, near: list[list[int]], done: set[int]) -> str:
    tree: dict[int, list[int]] = {}
    closures: dict[int, list[tuple[int, int]]] = {}
    seen, count, stack = {root}, 0, [(root, -1, iter(near[root]))]
    closed = set()
    while stack:
        i, parent, rest = stack[-1]
        for j in rest:
            b = (min(i, j), max(i, j))
            if j == parent or b in closed:
                continue
            if j in seen:
                closed.add(b)
                count += 1
                closures.setdefault(i, []).append((count, j))
                closures.setdefault(j, []).append((count, i))
            else:
                seen.add(j)
                tree.setdefault(i, []).append(j)
                stack.append((j, i, iter(near[j])))
                break
        else:
            stack.pop()
    done |= seen
    out: list[str] = []
    todo: list = [(root, -1)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        i, parent = x
        if parent >= 0:
            out.append(_bond_text(m, parent, i))
        out.append(_atom_text(m, i))
        for n, j in closures.get(i, []):
            out.append((_bond_text(m, i, j) if i < j else "") + (str(n) if n < 10 else f"%{n}"))
        below = tree.get(i, [])
        for k, j in reversed(list(enumerate(below))):
            todo += [(j, i)] if k == len(below) - 1 else [")", (j, i), "("]
    return "".join(out)


def _bond_text(m: Mol, i: int, j: int) -> str:
    o, aromatic = m.order(i, j), m.atoms[i].aromatic and m.atoms[j].aromatic
    return {1.0: "-" if aromatic else "", 1.5: "" if aromatic else ":", 2.0: "=", 3.0: "#", 4.0: "$"}[o]


def _atom_text(m: Mol, i: int) -> str:
    a = m.atoms[i]
    text = a.symbol.lower() if a.aromatic else a.symbol
    plain = a.symbol in VALENCES and not a.charge and not a.isotope and a.hydrogens == implicit_hydrogens(m, i) or a.symbol == "*" and not a.hydrogens and not a.isotope
    if plain:
        return text
    h = "" if not a.hydrogens else "H" if a.hydrogens == 1 else f"H{a.hydrogens}"
    q = "" if not a.charge else ("+" if a.charge > 0 else "-") + (str(abs(a.charge)) if abs(a.charge) > 1 else "")
    return f"[{a.isotope or ''}{text}{h}{q}]"


def part(m: Mol, keep: list[int]) -> Mol:
    """The graph of some atoms, renumbered in their order."""
    at = {a: k for k, a in enumerate(keep)}
    bonds = {(min(at[i], at[j]), max(at[i], at[j])): o for (i, j), o in m.bonds.items() if i in at and j in at}
    return Mol([Atom(**vars(m.atoms[a])) for a in keep], bonds, {(min(at[i], at[j]), max(at[i], at[j])) for i, j in m.stereo if i in at and j in at})


def largest_part(m: Mol) -> Mol:
    """The component of most heavy atoms, the first of equals: a simple desalting."""
    return part(m, max(components(m), key=lambda c: sum(m.atoms[i].symbol != "H" for i in c)))


def scaffold(m: Mol) -> Mol:
    """All heavy atoms carbon, all bonds single, atoms of one neighbour pruned until none is left; empty without rings."""
    m = part(m, [i for i, a in enumerate(m.atoms) if a.symbol != "H"])
    m = Mol([Atom("C") for _ in m.atoms], dict.fromkeys(m.bonds, 1.0))
    while True:
        keep = [i for i, n in enumerate(m.neighbours()) if len(n) > 1]
        if len(keep) == len(m.atoms):
            break
        m = part(m, keep)
    for i, a in enumerate(m.atoms):
        a.hydrogens = implicit_hydrogens(m, i)
    return m


def wildcard_scan(m: Mol) -> list[Mol]:
    """Each atom in turn replaced by a wildcard."""
    out = []
    for i in range(len(m.atoms)):
        x = m.copy()
        x.atoms[i] = Atom("*")
        out.append(x)
    return out


def substitute(m: Mol, i: int, symbols: list[str]) -> Mol:
    """One hydrogen of atom i gives way to a chain of single-bonded atoms."""
    x = m.copy()
    x.atoms[i].hydrogens -= 1
    for s in symbols:
        x.atoms.append(Atom(s))
        x.bonds[i, len(x.atoms) - 1] = 1.0
        i = len(x.atoms) - 1
    for k in range(len(m.atoms), len(x.atoms)):
        x.atoms[k].hydrogens = implicit_hydrogens(x, k)
    return x


def fluorine_scan(m: Mol, hetero: bool = False) -> list[Mol]:
    """Each carbon (with hetero: each heavy atom) that has a hydrogen, fluorinated."""
    return [substitute(m, i, ["F"]) for i, a in enumerate(m.atoms) if a.hydrogens and (a.symbol == "C" or hetero)]


def analogue_scan(m: Mol, chains: tuple[tuple[str, ...], ...] = (("C",), ("F",), ("Cl",), ("O",), ("N",), ("O", "C"), ("Br",), ("S",))) -> list[Mol]:
    """Each aromatic CH with each of some substituents."""
    return [substitute(m, i, list(c)) for i, a in enumerate(m.atoms) if a.aromatic and a.symbol == "C" and a.hydrogens for c in chains]


def peptide_chain(m: Mol) -> int:
    """Most consecutive amide bonds of a backbone: C(=O)-N-C-C(=O)-N..."""
    near = m.neighbours()
    acyl = {i for i, a in enumerate(m.atoms) if a.symbol == "C" and not a.aromatic and any(m.atoms[j].symbol == "O" and m.order(i, j) == 2.0 for j in near[i])}
    amide = {(c, n) for c in acyl for n in near[c] if m.atoms[n].symbol == "N" and m.order(c, n) == 1.0}
    following = {(c, n): [(c2, n2) for a in near[n] if a != c and m.atoms[a].symbol == "C" and a not in acyl for c2 in near[a] if c2 in acyl for n2 in near[c2] if (c2, n2) in amide and n2 != n] for c, n in amide}
    firsts = amide - {x for b in amide for x in following[b]}
    best, met = 0, set()

    def walk(starts: set) -> None:
        nonlocal best
        todo = [(b, frozenset([b])) for b in starts]
        while todo:
            b, path = todo.pop()
            met.add(b)
            best = max(best, len(path))
            todo += [(x, path | {x}) for x in following[b] if x not in path]

    walk(firsts)
    walk(amide - met)  # cycles, which have no first
    return best


def fragments(m: Mol, cuts: int, seed: int) -> list[tuple[Mol, list[tuple[int, str, str]]]]:
    """Parts after cutting `cuts` shuffled cuttable bonds, with anchors (atom, its type, the lost neighbour's type)."""
    types, free = pi_types(m), cuttable_bonds(m)
    random.Random(seed).shuffle(free)
    x, lost = m.copy(), []
    for i, j in free[:cuts]:
        del x.bonds[i, j]
        lost += [(i, types[i], types[j]), (j, types[j], types[i])]
    out = []
    for c in components(x):
        at = {a: k for k, a in enumerate(c)}
        out.append((part(x, c), [(at[i], s, d) for i, s, d in lost if i in at]))
    return out


def assemble(parts: list[tuple[Mol, list[tuple[int, str, str]]]], seed: int, most: int = 50) -> Mol | None:
    """A random molecule from fragments whose anchors fit (types of both sides exchanged); None beyond `most` of them."""
    rng = random.Random(seed)
    by: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for k, (_, anchors) in enumerate(parts):
        for a, (_, s, d) in enumerate(anchors):
            by.setdefault((s, d), []).append((k, a))
    first = parts[rng.randrange(len(parts))]
    out, todo, used = first[0].copy(), list(first[1]), 1
    while todo:
        i, s, d = todo.pop()
        fits = by.get((d, s))
        if not fits or used >= most:
            return None
        k, a = fits[rng.randrange(len(fits))]
        used += 1
        piece, anchors = parts[k]
        shift = len(out.atoms)
        out.atoms += [Atom(**vars(x)) for x in piece.atoms]
        out.bonds |= {(u + shift, v + shift): o for (u, v), o in piece.bonds.items()}
        out.bonds[i, anchors[a][0] + shift] = 1.0
        todo += [(u + shift, p, q) for n, (u, p, q) in enumerate(anchors) if n != a]
    return out


def cuts_for(m: Mol, weight: float = 150.0) -> int:
    """How many cuts give fragments of about the weight."""
    return max(0, min(len(cuttable_bonds(m)), round(mass(m) / weight) - 1))


#: The prime of each element in a formula's number.
PRIMES = {
    "H": 2, "C": 3, "O": 5, "N": 7, "F": 11, "S": 13, "Cl": 17, "Br": 19, "P": 23, "I": 29, "Na": 31, "B": 37, "Si": 41, "Se": 43, "K": 47, "Li": 53, "As": 59, "Te": 61,
    "Zn": 67, "Ca": 71, "Mg": 73, "Al": 79, "Ag": 83, "Sr": 89, "Rb": 97, "Ba": 101, "Cs": 103, "At": 107, "Bi": 109, "Xe": 113, "Ra": 127, "Kr": 131, "Be": 137, "He": 139, "Ga": 149,
}


def formula_counts(text: str) -> dict[str, int]:
    """Element counts of a formula, or of a condensed one such as CH3CH2OH."""
    out: Counter = Counter()
    for symbol, n in re.findall(r"([A-Z][a-z]?)(\d*)", text):
        out[symbol] += int(n or 1)
    return dict(out)


def formula_number(text: str) -> int:
    """Product of the elements' primes; any size."""
    out = 1
    for symbol, n in formula_counts(text).items():
        out *= PRIMES[symbol] ** n
    return out


def number_formula(number: int) -> str:
    """The formula of such a product."""
    elements = []
    for symbol, p in PRIMES.items():
        while number % p == 0:
            elements.append(symbol)
            number //= p
    if number != 1:
        raise ValueError("not the number of a formula")
    return formula(elements)


def circular_features(m: Mol, radius: int = 2, bits: int = 2048) -> dict[int, int]:
    """Counts of hashed neighbourhoods of each atom up to a radius, folded; in the manner of extended-connectivity features."""
    import zlib

    h, near = hydrogen_count(m), m.neighbours()
    ring = ring_atoms(m)
    code = [zlib.crc32(repr((a.symbol, len(near[i]), h[i], a.charge, i in ring, a.aromatic)).encode()) for i, a in enumerate(m.atoms)]
    out: Counter = Counter(c % bits for c in code)
    for _ in range(radius):
        code = [zlib.crc32(repr((code[i], sorted((m.order(i, j), code[j]) for j in near[i]))).encode()) for i in range(len(m.atoms))]
        out.update(c % bits for c in code)
    return dict(out)


def peg_free(m: Mol, longest: int = 10, shortest: int = 2) -> Mol:
    """Without the atoms of all chains of the longest number of CH2-CH2-O units off rings that occurs, from `shortest` up; else unchanged."""
    near, ring = m.neighbours(), ring_atoms(m)

    def fits(i: int, symbol: str) -> bool:
        a = m.atoms[i]
        return a.symbol == symbol and not a.aromatic and i not in ring and (a.hydrogens, len(near[i])) == ((2, 2) if symbol == "C" else (0, 2)) and all(m.order(i, j) == 1.0 for j in near[i])

    def chains(units: int) -> list[list[int]]:
        found: list[list[int]] = []
        for start in range(len(m.atoms)):
            stack = [[start]] if fits(start, "C") else []
            while stack:
                path = stack.pop()
                if len(path) == 3 * units:
                    found.append(path)
                    continue
                want = "O" if len(path) % 3 == 2 else "C"
                stack += [[*path, j] for j in near[path[-1]] if j not in path and fits(j, want)]
        return found

    for units in range(longest, shortest - 1, -1):
        gone = {i for path in chains(units) for i in path}
        if gone:
            return part(m, [i for i in range(len(m.atoms)) if i not in gone])
    return m


def torsions(m: Mol) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Single bonds off rings between heavy atoms: those with no hydrogen-bearing terminal end, and those with one."""
    ring, degree, h = ring_bonds(m), heavy_degree(m), hydrogen_count(m)
    regular, terminal = [], []
    for (i, j), o in m.bonds.items():
        if o != 1.0 or (i, j) in ring or "H" in (m.atoms[i].symbol, m.atoms[j].symbol):
            continue
        ends = [k for k in (i, j) if degree[k] == 1]
        if any(h[k] for k in ends):
            terminal.append((i, j))
        elif not ends:
            regular.append((i, j))
    return regular, terminal


def deep(smiles: str) -> str:
    """DeepSMILES: a branch's end as one `)` for each atom to step back, a ring's end as the ring's size.

    ValueError where a ring closes onto an atom of a finished branch.
    """
    out: list[str] = []
    path: list[int] = []
    marks: list[int] = []
    opened: dict[int, tuple[int, int, str]] = {}
    at, count, bond = 0, 0, ""
    while at < len(smiles):
        t = _TOKEN.match(smiles, at)
        if not t:
            raise ValueError(f"not SMILES at {at}: {smiles}")
        at = t.end()
        if t["sym"] or t["org"]:
            out.append(bond + t[0])
            bond = ""
            path.append(count)
            count += 1
        elif t["bond"]:
            bond = t[0]
        elif t["ring"]:
            n = int(t["ring"].lstrip("%"))
            if n in opened:
                atom, _, earlier = opened.pop(n)
                if atom not in path:
                    raise ValueError(f"a ring closes onto a finished branch: {smiles}")
                size = len(path) - path.index(atom)
                out.append((bond or earlier) + (str(size) if size < 10 else f"%{size}" if size < 100 else f"%({size})"))
            else:
                opened[n] = (path[-1], count, bond)
            bond = ""
        elif t["open"]:
            marks.append(len(path))
        elif t["close"]:
            back = marks.pop()
            out.append(")" * (len(path) - back))
            del path[back:]
        else:
            out.append(".")
            path = []
    return "".join(out)


def undeep(text: str) -> str:
    """A SMILES of a DeepSMILES text."""
    m, path, bond, at = Mol(), [], "", 0
    size = re.compile(r"%\((\d+)\)|%(\d\d)|(\d)")
    while at < len(text):
        r = size.match(text, at)
        if r:
            n = int(r[1] or r[2] or r[3])
            _join(m, path[-n], path[-1], bond)
            bond, at = "", r.end()
            continue
        t = _TOKEN.match(text, at)
        if not t:
            raise ValueError(f"not DeepSMILES at {at}: {text}")
        at = t.end()
        if t["sym"] or t["org"]:
            raw = t["sym"] or t["org"]
            h = t["h"]
            m.atoms.append(Atom(raw[0].upper() + raw[1:], raw[0].islower(), _charge(t["q"]), int(h[1:] or 1) if h else 0, bool(t["sym"]), int(t["iso"] or 0), t["chi"] or ""))
            if path:
                _join(m, path[-1], len(m.atoms) - 1, bond)
            path.append(len(m.atoms) - 1)
            bond = ""
        elif t["bond"]:
            bond = t[0]
        elif t["close"]:
            path.pop()
        else:
            path = []
    for i, a in enumerate(m.atoms):
        if not a.bracket and a.symbol != "*":
            a.hydrogens = implicit_hydrogens(m, i)
    return write(m)
