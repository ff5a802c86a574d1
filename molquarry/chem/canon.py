"""Canonical ranking and writing of molecules.

Atoms are ranked by refining invariants over neighbours (ties are split one at
a time), mirror forms and the sides of double bonds take part in the
refinement, and a depth-first walk in rank order writes the text.  Two readable spellings of one molecule give the
same text.
"""

from __future__ import annotations

from .parse import Molecule, parse_smiles

_ORGANIC = {"B": (3,), "C": (4,), "N": (3,), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}


def _dense(keys: list) -> list[int]:
    ids = {k: r for r, k in enumerate(sorted(set(keys)))}
    return [ids[k] for k in keys]


def _odd(perm: list[int]) -> bool:
    """Whether a list of distinct numbers is an odd permutation of its sorted order."""
    odd = False
    for i in range(len(perm)):
        for j in range(i + 1, len(perm)):
            if perm[i] > perm[j]:
                odd = not odd
    return odd


def _refine(rank: list[int], links: list[list[tuple[int, int]]]) -> list[int]:
    n = len(rank)
    classes = len(set(rank))
    while True:
        # Neighbour and bond kind in one number.
        keys = [(r, *sorted([8 * rank[j] + o for j, o in row])) for r, row in zip(rank, links)]
        ids = {k: r for r, k in enumerate(sorted(set(keys)))}
        new = [ids[k] for k in keys]
        count = len(ids)
        if count == classes or count == n:
            return new
        rank, classes = new, count


def _parities(m: Molecule, rank: list[int]) -> dict[int, int]:
    """Mirror sign of each centre whose neighbours are told apart by rank: 1 or 2."""
    out = {}
    for i, c in enumerate(m.chir):
        if c:
            seen = [rank[j] if j >= 0 else -1 for j in m.order[i]]
            if len(seen) == 3 and m.hs[i] == 0:
                continue
            if len(seen) in (3, 4) and len(set(seen)) == len(seen):
                out[i] = 3 - c if _odd(seen) else c
    return out


def _sides(m: Molecule, rank: list[int]) -> dict[tuple[int, int], int]:
    """Form of each double bond whose ends' neighbours are told apart by rank: 1 if the highest lie on one side, else 2."""
    out = {}
    for (a, b), (x, y, same) in m.sides.items():
        tops = (_top(m, rank, a, b), _top(m, rank, b, a))
        if None not in tops:
            out[a, b] = 1 if same ^ (tops[0] != x) ^ (tops[1] != y) else 2
    return out


def _top(m: Molecule, rank: list[int], end: int, other: int) -> int | None:
    """The neighbour of highest rank at one end of a double bond; None if the two there are alike."""
    near = [j for j in m.nbr[end] if j != other]
    if len({rank[j] for j in near}) < len(near):
        return None
    return max(near, key=rank.__getitem__, default=None)


def classes(m: Molecule) -> tuple[list[int], dict, list[list[tuple[int, int]]]]:
    """Ranks that atoms alike share, the mirror signs and sides that count, and the neighbours with bond kinds."""
    n = len(m)
    links = []
    for i in range(n):
        row = []
        for j, o in m.nbr[i].items():
            row.append((j, 5 if ((i, j) if i < j else (j, i)) in m.arom_bonds else o))
        links.append(row)
    rank = _dense([(m.sym[i], len(m.nbr[i]), m.hs[i], m.charge[i], m.iso[i], m.arom[i]) for i in range(n)])
    rank = _refine(rank, links)
    signs: dict = {}
    if any(m.chir) or m.sides:
        while True:
            new = _parities(m, rank) | _sides(m, rank)
            if new == signs or len(new) < len(signs):
                break
            signs = new
            own = [[signs.get(i, 0)] for i in range(n)]
            for key, v in signs.items():
                if isinstance(key, tuple):
                    own[key[0]].append(v)
                    own[key[1]].append(v)
            rank = _refine(_dense([(rank[i], own[i][0], *sorted(own[i][1:])) for i in range(n)]), links)
    return rank, signs, links


def ranks(m: Molecule) -> tuple[list[int], dict]:
    """A distinct canonical rank for each atom, and the mirror signs (by atom) and sides (by double bond) that count."""
    n = len(m)
    rank, signs, links = classes(m)
    while len(set(rank)) < n:
        members: dict[int, list[int]] = {}
        for i, r in enumerate(rank):
            members.setdefault(r, []).append(i)
        low = min(r for r, v in members.items() if len(v) > 1)
        first = members[low][0]
        rank = [2 * r for r in rank]
        rank[first] -= 1
        rank = _refine(_dense(rank), links)
    return rank, signs


def _marked(m: Molecule, rank: list[int], signs: dict) -> dict[tuple[int, int], list]:
    """Marks of the single bonds beside double bonds: bond (low, high) -> [1 or -1, its group]; a group's marks turn together."""
    ties: dict[tuple[int, int], list[tuple[tuple[int, int], int]]] = {}

    def tie(a: int, x: int, b: int, y: int, way: int) -> None:
        """Neighbours x of a and y of b lie on one side (1) or on two (-1)."""
        p, q = ((a, x) if a < x else (x, a)), ((b, y) if b < y else (y, b))
        way *= (1 if a < x else -1) * (1 if b < y else -1)
        ties.setdefault(p, []).append((q, way))
        ties.setdefault(q, []).append((p, way))

    doubles = [k for k in signs if isinstance(k, tuple)]
    for a, b in doubles:
        tie(a, _top(m, rank, a, b), b, _top(m, rank, b, a), 1 if signs[a, b] == 1 else -1)
    for a, b in doubles:  # both neighbours of an end, if the other is marked for a double bond of its own
        for end, other in ((a, b), (b, a)):
            near = [j for j in m.nbr[end] if j != other]
            if len(near) == 2 and all(((end, j) if end < j else (j, end)) in ties for j in near):
                tie(end, near[0], end, near[1], -1)
    out: dict[tuple[int, int], list] = {}
    for start in ties:
        if start not in out:
            group = [0]  # what turns the group's marks, set when the first of them is written
            out[start] = [1, group]
            todo = [start]
            for p in todo:
                for q, way in ties[p]:
                    if q not in out:
                        out[q] = [out[p][0] * way, group]
                        todo.append(q)
    return out


def _atom(m: Molecule, i: int, mark: str) -> str:
    sym = m.sym[i].lower() if m.arom[i] else m.sym[i]
    if not mark and not m.charge[i] and not m.iso[i] and m.sym[i] in _ORGANIC:
        used = sum(m.nbr[i].values())
        implied = next((a - used for a in _ORGANIC[m.sym[i]] if a >= used), None)
        if implied == m.hs[i] and not (m.arom[i] and m.sym[i] != "C" and m.hs[i]):
            return sym
    h = "" if not m.hs[i] else "H" if m.hs[i] == 1 else f"H{m.hs[i]}"
    c = m.charge[i]
    sign = "" if not c else ("+" if c > 0 else "-") + (str(abs(c)) if abs(c) > 1 else "")
    return f"[{m.iso[i] or ''}{sym}{mark}{h}{sign}]"


def write_smiles(m: Molecule, rank: list[int], signs: dict) -> str:
    """Text of the molecule, walked from the lowest rank; the first mark of a group of double bonds is ``/``."""
    n = len(m)
    neighbours = [sorted(m.nbr[i], key=rank.__getitem__) for i in range(n)]
    seen = [False] * n
    parts = []
    marks = _marked(m, rank, signs) if m.sides else {}

    def bond(i: int, j: int) -> str:
        e = (i, j) if i < j else (j, i)
        if e in m.arom_bonds:
            return ""
        if e in marks:
            up, group = marks[e]
            up = up if i < j else -up
            group[0] = group[0] or up
            return "/" if up == group[0] else "\\"
        o = m.nbr[i][j]
        return ("", "-" if m.arom[i] and m.arom[j] else "", "=", "#", "$")[o]

    for start in sorted(range(n), key=rank.__getitem__):
        if seen[start]:
            continue
        # First walk: tree children and ring bonds of each atom.
        children: dict[int, list[int]] = {}
        closes: dict[int, list[tuple[int, int]]] = {}  # atom -> (other end, ring bond id) in order
        ring_no: dict[tuple[int, int], int] = {}
        state = {start: 0}
        parent = {start: -1}
        order = [start]
        seen[start] = True
        stack = [(start, iter(neighbours[start]))]
        children[start] = []
        while stack:
            i, it = stack[-1]
            for j in it:
                if j == parent[i]:
                    continue
                e = (i, j) if i < j else (j, i)
                if seen[j]:
                    if e not in ring_no:
                        ring_no[e] = len(ring_no)
                        closes.setdefault(j, []).append((i, ring_no[e]))
                        closes.setdefault(i, []).append((j, ring_no[e]))
                    continue
                seen[j] = True
                parent[j] = i
                children[j] = []
                children[i].append(j)
                order.append(j)
                stack.append((j, iter(neighbours[j])))
                break
            else:
                stack.pop()
        del state
        # Second walk: text.
        out: list[str] = []
        digits: dict[int, int] = {}
        free: list[int] = []
        high = 0
        todo: list = [start]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if isinstance(x, tuple):
                out.append(x[2] + bond(x[0], x[1]))
                continue
            i = x
            ends = sorted(closes.get(i, ()), key=lambda p: (p[1] not in digits, rank[p[0]]))
            mark = ""
            if i in signs:
                around = [rank[parent[i]]] if parent[i] >= 0 else []
                if m.hs[i]:
                    around.append(-1)
                around += [rank[j] for j, _ in ends] + [rank[j] for j in children[i]]
                sign = 3 - signs[i] if _odd(around) else signs[i]
                mark = "@" * sign
            text = _atom(m, i, mark)
            freed = []
            for j, k in ends:
                if k in digits:
                    d = digits.pop(k)
                    freed.append(d)
                    text += f"%{d}" if d > 9 else str(d)
                else:
                    if free:
                        free.sort()
                        d = free.pop(0)
                    else:
                        high += 1
                        d = high
                    digits[k] = d
                    text += bond(i, j) + (f"%{d}" if d > 9 else str(d))
            free += freed
            out.append(text)
            kids = children[i]
            if kids:
                todo += [kids[-1], (i, kids[-1], "")]
                for j in reversed(kids[:-1]):
                    todo += [")", j, (i, j, "(")]
        parts.append("".join(out))
    return ".".join(sorted(parts))


def canonical_smiles(s: str | None) -> str | None:
    """The one text for all spellings of a molecule; None for unreadable text."""
    m = parse_smiles(s)
    if m is None:
        return None
    rank, signs = ranks(m)
    return write_smiles(m, rank, signs)
