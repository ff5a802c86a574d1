"""SMILES reading: grammar, valence, kekulisation and aromaticity.

``parse_smiles`` returns a :class:`Molecule` or ``None`` for unreadable input
(broken brackets, open rings, impossible valences, rings that cannot be
kekulised, aromatic atoms outside rings, empty text).  Both aromatic and
alternating-bond spellings of a ring end in the same perceived form.
Direction marks (``/`` and ``\\``) at both ends of a double bond tell which
neighbours lie on the same side; marks that contradict each other tell nothing.
"""

from __future__ import annotations

import re

# Standard atomic weights (abridged), by symbol.
WEIGHTS = {
    "H": 1.008, "He": 4.003, "Li": 6.94, "Be": 9.012, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999,
    "F": 18.998, "Ne": 20.18, "Na": 22.99, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06,
    "Cl": 35.45, "Ar": 39.948, "K": 39.098, "Ca": 40.078, "Ti": 47.867, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845,
    "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.63, "As": 74.922, "Se": 78.971,
    "Br": 79.904, "Kr": 83.798, "Ag": 107.868, "Cd": 112.414, "Sn": 118.71, "Sb": 121.76, "Te": 127.6, "I": 126.904,
    "Pt": 195.084, "Au": 196.967, "Hg": 200.592, "Pb": 207.2, "Bi": 208.98,
}

# Usual valences of neutral atoms.
VALENCES = {
    "B": (3,), "C": (4,), "N": (3,), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,),
    "I": (1,), "H": (1,), "Si": (4,), "Se": (2, 4, 6), "As": (3, 5),
}
# Charged main-group atoms take the valences of the neighbour with as many electrons.
_ISO = {"B": {-1: "C"}, "C": {1: "B", -1: "N"}, "N": {1: "C", -1: "O"}, "O": {1: "N", -1: "F"}, "S": {1: "P", -1: "Cl"}, "P": {1: "Si"}}

_AROMATIC = {"b": "B", "c": "C", "n": "N", "o": "O", "p": "P", "s": "S", "se": "Se", "as": "As"}
_UP = {"/": 1, "\\": -1}
#: Double bonds in rings of fewer atoms have one form only.
FREE_RING = 8
_BONDS = {"-": 1, "=": 2, "#": 3, "$": 4, ":": 5, "/": 1, "\\": 1}
_TOKEN = re.compile(r"(\[[^\[\]]*\])|(Br|Cl|[BCNOPSFI])|([bcnops])|([-=#$:/\\])|([()])|(%\d\d|\d)|(\.)")
_BRACKET = re.compile(r"(\d+)?([A-Z][a-z]?|se|as|[bcnops])(@@|@)?(?:(H)(\d)?)?(\+{1,3}|-{1,3}|[+-]\d)?(?::\d+)?")


class Molecule:
    """Atoms as parallel lists; ``nbr[i]`` maps neighbour to bond order (4 kekulised single/double/triple: 1, 2, 3)."""

    __slots__ = ("sym", "charge", "iso", "hs", "nbr", "arom", "chir", "order", "arom_bonds", "rings", "up", "sides")

    def __init__(self):
        self.sym, self.charge, self.iso, self.hs = [], [], [], []
        self.nbr: list[dict[int, int]] = []
        self.arom: list[bool] = []
        self.chir: list[int] = []  # 0 none, 1 '@', 2 '@@'
        self.order: list[list[int]] = []  # neighbours in reading order, -1 for the hydrogen in brackets
        self.arom_bonds: set[tuple[int, int]] = set()
        self.rings: list[list[int]] = []
        self.up: dict[tuple[int, int], int] = {}  # marked bonds, both ways: 1 if the second atom lies above the first
        self.sides: dict[tuple[int, int], tuple[int, int, bool]] = {}  # double bond a < b: neighbour of a, of b, on one side?

    def mark(self, i: int, j: int, up: int) -> None:
        self.up[i, j], self.up[j, i] = up, -up

    def __len__(self):
        return len(self.sym)


def _read(s: str):
    """Atoms and bonds as written; None if the text breaks the grammar."""
    m = Molecule()
    lower: list[bool] = []
    fixed_h: list[int | None] = []
    prev, bond, stack, opened = -1, 0, [], {}
    up = 0
    after_open = False
    pos = 0
    for t in _TOKEN.finditer(s):
        if t.start() != pos:
            return None
        pos = t.end()
        kind, text = t.lastindex, t.group()
        if kind <= 3:
            iso = chir = charge = 0
            hs = None
            has_h = False
            if kind == 1:
                b = _BRACKET.fullmatch(text, 1, len(text) - 1)
                if b is None:
                    return None
                sym = b[2]
                if sym in _AROMATIC:
                    arom, sym = True, _AROMATIC[sym]
                else:
                    arom = False
                    if sym not in WEIGHTS:
                        return None
                iso = int(b[1]) if b[1] else 0
                chir = len(b[3]) if b[3] else 0
                hs = (int(b[5]) if b[5] else 1) if b[4] else 0
                has_h = hs > 0
                if b[6]:
                    c = b[6]
                    charge = int(c) if len(c) > 1 and c[1].isdigit() else (len(c) if c[0] == "+" else -len(c))
            elif kind == 2:
                sym, arom = text, False
            else:
                sym, arom = _AROMATIC[text], True
            i = len(m.sym)
            m.sym.append(sym)
            m.charge.append(charge)
            m.iso.append(iso)
            m.chir.append(chir)
            m.nbr.append({})
            m.order.append([])
            lower.append(arom)
            fixed_h.append(hs)
            if prev >= 0:
                order = bond or (5 if arom and lower[prev] else 1)
                m.nbr[i][prev] = m.nbr[prev][i] = order
                m.order[i].append(prev)
                m.order[prev].append(i)
                if up:
                    m.mark(prev, i, up)
                    up = 0
            elif bond:
                return None
            if has_h:
                m.order[i].append(-1)
            prev, bond, after_open = i, 0, False
        elif kind == 4:
            if bond or prev < 0:
                return None
            bond = _BONDS[text]
            up = _UP.get(text, 0)
        elif kind == 5:
            if text == "(":
                if prev < 0 or bond or after_open:
                    return None
                stack.append(prev)
                after_open = True
            else:
                if not stack or bond or after_open:
                    return None
                prev = stack.pop()
        elif kind == 6:
            if prev < 0 or after_open:
                return None
            n = int(text[1:]) if text[0] == "%" else int(text)
            if n in opened:
                j, b0, slot, up0 = opened.pop(n)
                if j == prev or j in m.nbr[prev] or (b0 and bond and b0 != bond):
                    return None
                order = b0 or bond or (5 if lower[j] and lower[prev] else 1)
                m.nbr[prev][j] = m.nbr[j][prev] = order
                m.order[prev].append(j)
                m.order[j][slot] = prev
                if up or up0:
                    m.mark(prev, j, up or -up0)
            else:
                opened[n] = (prev, bond, len(m.order[prev]), up)
                m.order[prev].append(-2)
            bond = up = 0
        else:
            if prev < 0 or bond or stack:
                return None
            prev = -1
    if pos != len(s) or not m.sym or stack or opened or bond or prev < 0:
        return None
    return m, lower, fixed_h


def _allowed(sym: str, charge: int) -> tuple[int, ...] | None:
    if charge:
        sym = _ISO.get(sym, {}).get(charge, "")
    return VALENCES.get(sym)


def find_rings(nbr: list[dict[int, int]]) -> list[list[int]]:
    """A smallest ring through each ring-closing bond of a spanning forest (enough rings to cover all ring bonds)."""
    n = len(nbr)
    degree = [len(x) for x in nbr]
    alive = [True] * n
    todo = [i for i in range(n) if degree[i] <= 1]
    while todo:
        i = todo.pop()
        if not alive[i]:
            continue
        alive[i] = False
        for j in nbr[i]:
            if alive[j]:
                degree[j] -= 1
                if degree[j] == 1:
                    todo.append(j)
    core = [i for i in range(n) if alive[i] and degree[i] > 1]
    if not core:
        return []
    wanted = sum(degree[i] for i in core) // 2 - len(core)
    seen, comps = set(), 0
    for i in core:
        if i not in seen:
            comps += 1
            seen.add(i)
            st = [i]
            while st:
                for y in nbr[st.pop()]:
                    if alive[y] and y not in seen:
                        seen.add(y)
                        st.append(y)
    wanted += comps
    # Candidate rings: a shortest cycle through each edge, in order of size, kept if independent over GF(2).
    edge_id: dict[tuple[int, int], int] = {}
    for i in core:
        for j in nbr[i]:
            if alive[j] and i < j:
                edge_id[i, j] = len(edge_id)
    found: dict[int, list[int]] = {}
    for (a, b) in edge_id:
        parents = {a: -1}
        queue = [a]
        for x in queue:
            if x == b:
                break
            for y in nbr[x]:
                if alive[y] and y not in parents and not (x == a and y == b):
                    parents[y] = x
                    queue.append(y)
        if b not in parents:
            continue
        ring, x = [], b
        while x >= 0:
            ring.append(x)
            x = parents[x]
        mask = 0
        for k, x in enumerate(ring):
            y = ring[k - 1]
            mask |= 1 << edge_id[(x, y) if x < y else (y, x)]
        found.setdefault(mask, ring)
    rings, basis = [], []
    for mask, ring in sorted(found.items(), key=lambda p: len(p[1])):
        v = mask
        for w in basis:
            v = min(v, v ^ w)
        if v:
            basis.append(v)
            rings.append(ring)
            if len(rings) == wanted:
                break
    return rings


def _kekulise(m: Molecule, lower: list[bool], fixed_h: list[int | None], in_ring: set[int]) -> bool:
    """Give aromatic bonds the orders 1 and 2 by matching the atoms that need a double bond."""
    need: dict[int, list[int]] = {}
    for i, low in enumerate(lower):
        if not low:
            continue
        if i not in in_ring:
            return False
        allowed = _allowed(m.sym[i], m.charge[i])
        if allowed is None:
            return False
        used = sum(1 if o == 5 else o for o in m.nbr[i].values()) + (fixed_h[i] or 0)
        # Open valence left for a double bond; a ring atom such as [nH], o or s has none.
        if fixed_h[i] is None:
            top = allowed[0]
        else:
            top = next((a for a in allowed if a >= used), allowed[-1])
        if top - used >= 1:
            need[i] = []
    for i in need:
        need[i] = [j for j, o in m.nbr[i].items() if o == 5 and j in need]
    match = _matching(need)
    if len(match) < len(need):
        return False
    for i in range(len(m)):
        for j, o in m.nbr[i].items():
            if o == 5:
                m.nbr[i][j] = 2 if match.get(i) == j else 1
    return True


def _matching(links: dict[int, list[int]]) -> dict[int, int]:
    """A largest matching of a graph, both ways; odd cycles are shrunk to their base, so no search is cut short."""
    match: dict[int, int] = {}
    for i, near in links.items():  # a greedy start leaves few atoms
        if i not in match:
            j = next((j for j in near if j not in match), None)
            if j is not None:
                match[i], match[j] = j, i

    def grow(root: int) -> bool:
        base = {i: i for i in links}
        before: dict[int, int] = {}
        even = {root}
        queue = [root]

        def trunk(i: int):
            """Bases from an even atom to the root."""
            while True:
                i = base[i]
                yield i
                if i == root:
                    return
                i = before[match[i]]

        def shrink(i: int, j: int, top: int, inside: set[int]) -> None:
            while base[i] != top:
                inside |= {base[i], base[match[i]]}
                before[i] = j
                j = match[i]
                i = before[j]

        for x in queue:
            for y in links[x]:
                if base[x] == base[y] or match.get(x) == y:
                    continue
                if y in even:
                    own = set(trunk(x))
                    top = next(i for i in trunk(y) if i in own)
                    inside: set[int] = set()
                    shrink(x, y, top, inside)
                    shrink(y, x, top, inside)
                    for i in links:
                        if base[i] in inside:
                            base[i] = top
                            if i not in even:
                                even.add(i)
                                queue.append(i)
                elif y not in before:
                    before[y] = x
                    if y not in match:
                        while y is not None:
                            x = before[y]
                            following = match.get(x)
                            match[x], match[y] = y, x
                            y = following
                        return True
                    even.add(match[y])
                    queue.append(match[y])
        return False

    for i in links:
        if i not in match:
            grow(i)
    return match


def _find_sides(m: Molecule) -> None:
    """Which marked neighbours of each double bond lie on one side; double bonds in small rings have one form only."""
    small = {(min(r[k], r[k - 1]), max(r[k], r[k - 1])) for r in m.rings if len(r) < FREE_RING for k in range(len(r))}
    for a in range(len(m)):
        for b, o in m.nbr[a].items():
            if o != 2 or a > b or (a, b) in small or (a, b) in m.arom_bonds:
                continue
            ends = []
            for end, other in ((a, b), (b, a)):
                marked = [(m.up[end, j], j) for j in m.nbr[end] if j != other and (end, j) in m.up]
                if marked and len({u for u, _ in marked}) == len(marked) and len(m.nbr[end]) + m.hs[end] <= 3:
                    ends.append(marked[0])
            if len(ends) == 2:
                m.sides[a, b] = (ends[0][1], ends[1][1], ends[0][0] == ends[1][0])


def _perceive(m: Molecule) -> None:
    """Hueckel 4n+2 over rings of five to seven atoms and over pairs of fused rings."""
    n = len(m)
    m.arom = [False] * n
    rings = [r for r in m.rings if 5 <= len(r) <= 7]
    if not rings:
        return
    ring_atoms = {i for r in m.rings for i in r}
    ring_bonds = {(min(r[k], r[k - 1]), max(r[k], r[k - 1])) for r in m.rings for k in range(len(r))}
    gives: dict[int, int | None] = {}
    for i in ring_atoms:
        sym, nb = m.sym[i], m.nbr[i]
        doubles = [j for j, o in nb.items() if o == 2]
        value = None
        if any(o == 3 for o in nb.values()) or len(doubles) > 1:
            value = None
        elif doubles:
            j = doubles[0]
            if (min(i, j), max(i, j)) in ring_bonds:
                value = 1
            elif sym == "C" and m.sym[j] in ("O", "N", "S"):
                value = 0
        elif sym in ("N", "P", "As") and m.charge[i] <= 0 and len(nb) + m.hs[i] <= 3:
            value = 2
        elif sym in ("O", "S", "Se") and m.charge[i] == 0 and len(nb) == 2:
            value = 2
        elif sym == "C" and m.charge[i] == -1:
            value = 2
        elif sym in ("C", "B") and (m.charge[i] == 1 or sym == "B"):
            value = 0
        gives[i] = value
    ok = [r for r in rings if all(gives[i] is not None for i in r)]
    done: list[set[tuple[int, int]]] = []
    bonds_of = [{(min(r[k], r[k - 1]), max(r[k], r[k - 1])) for k in range(len(r))} for r in ok]
    hits = [sum(gives[i] for i in r) % 4 == 2 for r in ok]
    for r, b, hit in zip(ok, bonds_of, hits):
        if hit:
            done.append(b)
    for x in range(len(ok)):
        for y in range(x + 1, len(ok)):
            if not (hits[x] and hits[y]) and len(bonds_of[x] & bonds_of[y]) == 1:
                atoms = set(ok[x]) | set(ok[y])
                if sum(gives[i] for i in atoms) % 4 == 2:
                    done.append(bonds_of[x] ^ bonds_of[y])
    for b in done:
        m.arom_bonds |= b
        for i, j in b:
            m.arom[i] = m.arom[j] = True


def _fold_hydrogens(m: Molecule, fixed_h: list[int | None], lower: list[bool]) -> tuple[Molecule, list[int | None], list[bool]]:
    """Move explicit [H] atoms into the hydrogen count of their one heavy neighbour."""
    drop = [
        i for i in range(len(m))
        if m.sym[i] == "H" and not m.iso[i] and not m.charge[i] and len(m.nbr[i]) == 1 and m.sym[next(iter(m.nbr[i]))] != "H"
    ]
    if not drop or len(drop) == len(m):
        return m, fixed_h, lower
    gone = set(drop)
    for i in drop:
        j = next(iter(m.nbr[i]))
        if fixed_h[j] is not None:
            fixed_h[j] += 1
        m.order[j] = [-1 if x == i else x for x in m.order[j]]
        del m.nbr[j][i]
        if (j, i) in m.up:  # what lies beside the hydrogen lies on the other side
            for x, o in m.nbr[j].items():
                if o == 1 and (j, x) not in m.up:
                    m.mark(j, x, -m.up[j, i])
    keep = [i for i in range(len(m)) if i not in gone]
    new = {x: k for k, x in enumerate(keep)} | {-1: -1}
    r = Molecule()
    for i in keep:
        r.sym.append(m.sym[i])
        r.charge.append(m.charge[i])
        r.iso.append(m.iso[i])
        r.chir.append(m.chir[i])
        r.nbr.append({new[j]: o for j, o in m.nbr[i].items()})
        r.order.append([new[j] for j in m.order[i]])
    r.up = {(new[i], new[j]): u for (i, j), u in m.up.items() if i in new and j in new}
    return r, [fixed_h[i] for i in keep], [lower[i] for i in keep]


def parse_smiles(s: str | None) -> Molecule | None:
    """The molecule a SMILES text describes, or None if it describes none."""
    if not s:
        return None
    read = _read(s)
    if read is None:
        return None
    m, lower, fixed_h = read
    if "H" in m.sym:
        m, fixed_h, lower = _fold_hydrogens(m, fixed_h, lower)
    m.rings = find_rings(m.nbr)
    if True in lower:
        in_ring = {i for r in m.rings for i in r}
        # A bond between aromatic atoms of different rings, written without sign, is a single bond.
        pairs = {(r[k], r[k - 1]) for r in m.rings for k in range(len(r))}
        for i in range(len(m)):
            for j, o in m.nbr[i].items():
                if o == 5 and (i, j) not in pairs and (j, i) not in pairs:
                    m.nbr[i][j] = 1
        if not _kekulise(m, lower, fixed_h, in_ring):
            return None
    elif any(o == 5 for x in m.nbr for o in x.values()):
        return None
    for i in range(len(m)):
        used = sum(m.nbr[i].values())
        allowed = _allowed(m.sym[i], m.charge[i])
        if fixed_h[i] is None:
            h = next((a - used for a in allowed if a >= used), None)
            if h is None:
                return None
            m.hs.append(h)
        else:
            m.hs.append(fixed_h[i])
            if allowed is not None and used + fixed_h[i] > max(allowed):
                return None
    _perceive(m)
    if m.up:
        _find_sides(m)
    return m
