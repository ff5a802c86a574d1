"""Molecular properties from the parsed graph.

Definitions are those of the published methods: Hill-order formulas, Ertl's
polar surface of nitrogen and oxygen, Wildman and Crippen's atom contributions,
Lipinski's and Veber's rules, Bemis-Murcko frameworks.  QED and
assay-interference alerts need pattern catalogues that are not built here:
they are ``None`` and named in ``UNSUPPORTED``.
"""

from __future__ import annotations

from collections import Counter

from .canon import classes, ranks, write_smiles
from .parse import WEIGHTS, Molecule, parse_smiles

UNSUPPORTED = ("qed", "pains_alert")

# Polar surface contributions (hydrogens, charge, aromatic, single, double, triple bonds, in a ring of three).
_POLAR_N = {
    (0, 0, 0, 3, 0, 0, False): 3.24, (0, 0, 0, 1, 1, 0, False): 12.36, (0, 0, 0, 0, 0, 1, False): 23.79,
    (0, 0, 0, 1, 2, 0, False): 11.68, (0, 0, 0, 0, 1, 1, False): 13.60, (0, 0, 0, 3, 0, 0, True): 3.01,
    (1, 0, 0, 2, 0, 0, False): 12.03, (1, 0, 0, 2, 0, 0, True): 21.94, (1, 0, 0, 0, 1, 0, False): 23.85,
    (2, 0, 0, 1, 0, 0, False): 26.02, (0, 1, 0, 4, 0, 0, False): 0.0, (0, 1, 0, 2, 1, 0, False): 3.01,
    (0, 1, 0, 1, 0, 1, False): 4.36, (1, 1, 0, 3, 0, 0, False): 4.44, (1, 1, 0, 1, 1, 0, False): 13.97,
    (2, 1, 0, 2, 0, 0, False): 16.61, (2, 1, 0, 0, 1, 0, False): 25.59, (3, 1, 0, 1, 0, 0, False): 27.64,
    (0, 0, 2, 0, 0, 0, False): 12.89, (0, 0, 3, 0, 0, 0, False): 4.41, (0, 0, 2, 1, 0, 0, False): 4.93,
    (0, 0, 2, 0, 1, 0, False): 8.39, (1, 0, 2, 0, 0, 0, False): 15.79, (0, 1, 3, 0, 0, 0, False): 4.10,
    (0, 1, 2, 1, 0, 0, False): 3.88, (1, 1, 2, 0, 0, 0, False): 14.14,
}
_POLAR_O = {
    (0, 0, 0, 2, 0, 0, False): 9.23, (0, 0, 0, 2, 0, 0, True): 12.53, (0, 0, 0, 0, 1, 0, False): 17.07,
    (1, 0, 0, 1, 0, 0, False): 20.23, (0, -1, 0, 1, 0, 0, False): 23.06, (0, 0, 2, 0, 0, 0, False): 13.14,
}

# logP contributions of atom types.
_LOGP = {
    "C1": 0.1441, "C2": 0.0, "C3": -0.2035, "C4": -0.2051, "C5": -0.2783, "C6": 0.1551, "C7": 0.0017, "C8": 0.08452,
    "C9": -0.1444, "C10": -0.0516, "C11": 0.1193, "C12": -0.0967, "C13": -0.5443, "C14": 0.0, "C15": 0.245,
    "C16": 0.198, "C17": 0.0, "C18": 0.1581, "C19": 0.2955, "C20": 0.2713, "C21": 0.136, "C22": 0.1839, "C23": 0.5437,
    "C24": 0.1893, "C25": -0.8186, "C26": 0.264, "C27": 0.2148, "CS": 0.08129,
    "H1": 0.123, "H2": -0.2677, "H3": 0.2142, "H4": 0.298,
    "N1": -1.019, "N2": -0.7096, "N3": -1.027, "N4": -0.5188, "N5": 0.08387, "N6": 0.1836, "N7": -0.3187,
    "N8": -0.4458, "N9": 0.01508, "N10": -1.95, "N11": -0.3239, "N12": -1.119, "N13": -0.3396, "N14": 0.2887, "NS": -0.4806,
    "O1": 0.1552, "O2": -0.2893, "O3": -0.0684, "O4": -0.4195, "O5": 0.0335, "O6": -0.3339, "O7": -1.189, "O8": 0.1788,
    "O9": -0.1526, "O10": 0.1129, "O11": 0.4833, "O12": -1.326, "OS": -0.1188,
    "F": 0.4202, "Cl": 0.6895, "Br": 0.8456, "I": 0.8857, "Hal": -2.996, "P": 0.8612, "S1": 0.6482, "S2": -0.0024, "S3": 0.6237,
    "Me1": -0.3808, "Me2": -0.0025,
}

_HALOGENS = ("F", "Cl", "Br", "I")


def _aromatic_bond(m: Molecule, i: int, j: int) -> bool:
    return ((i, j) if i < j else (j, i)) in m.arom_bonds


def formula(m: Molecule) -> str:
    """Hill order: carbon, hydrogen, then the rest by symbol; the charge at the end."""
    n = Counter(m.sym)
    if h := sum(m.hs):
        n["H"] += h
    first = [s for s in ("C", "H") if "C" in n and s in n]
    text = "".join(s + (str(n[s]) if n[s] > 1 else "") for s in [*first, *sorted(s for s in n if s not in first)])
    charge = sum(m.charge)
    return text if not charge else text + ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "")


def weight(m: Molecule) -> float:
    return sum(WEIGHTS[s] for s in m.sym) + WEIGHTS["H"] * sum(m.hs)


def polar_surface(m: Molecule) -> float:
    small = {i for r in m.rings if len(r) == 3 for i in r}
    total = 0.0
    for i, s in enumerate(m.sym):
        if s not in ("N", "O"):
            continue
        kinds = Counter("a" if _aromatic_bond(m, i, j) else o for j, o in m.nbr[i].items())
        key = (m.hs[i], m.charge[i], kinds["a"], kinds[1], kinds[2], kinds[3], i in small)
        table = _POLAR_N if s == "N" else _POLAR_O
        value = table.get(key, table.get((*key[:6], False)))
        if value is None:
            base, step = (30.5, 8.2) if s == "N" else (28.5, 8.6)
            value = max(0.0, base - step * len(m.nbr[i]) + 1.5 * m.hs[i])
        total += value
    return total


def donors(m: Molecule) -> int:
    """Nitrogen with hydrogen (neutral of valence 3, cation of valence 4, aromatic NH), OH and SH."""
    n = 0
    for i, s in enumerate(m.sym):
        h = m.hs[i]
        if s == "N" and h and (m.arom[i] and m.charge[i] == 0 and h == 1 or not m.arom[i] and sum(m.nbr[i].values()) + h == 3 + m.charge[i]):
            n += 1
        elif s in ("O", "S") and h == 1 and m.charge[i] == 0 and not m.arom[i]:
            n += 1
    return n


def _acid_like(m: Molecule, j: int, ring_bonds: set | None = None) -> bool:
    """Whether an atom has a double bond to O, N, P or S (outside rings, if ring bonds are given)."""
    for k, o in m.nbr[j].items():
        if o == 2 and m.sym[k] in ("O", "N", "P", "S") and not _aromatic_bond(m, j, k):
            if ring_bonds is None or ((j, k) if j < k else (k, j)) not in ring_bonds:
                return True
    return False


def acceptors(m: Molecule) -> int:
    """Oxygen and sulfur of valence 2 (OH and SH not of acids), their anions, amines that are no amides, aromatic N without H, O and S."""
    ring_bonds = {(min(r[k], r[k - 1]), max(r[k], r[k - 1])) for r in m.rings for k in range(len(r))}
    n = 0
    for i, s in enumerate(m.sym):
        valence = sum(m.nbr[i].values()) + m.hs[i]
        if s in ("O", "S"):
            if m.arom[i]:
                n += m.charge[i] == 0
            elif m.charge[i] == -1:
                n += 1
            elif valence == 2 and m.hs[i] == 0:
                n += 1
            elif valence == 2 and m.hs[i] == 1 and m.nbr[i]:
                n += not _acid_like(m, next(iter(m.nbr[i])))
        elif s == "N":
            if m.arom[i]:
                n += m.hs[i] == 0 and m.charge[i] == 0
            elif valence == 3:
                n += not any(o == 1 and _acid_like(m, j, ring_bonds) for j, o in m.nbr[i].items())
    return n


def rotatable(m: Molecule) -> int:
    """Single bonds outside rings between atoms that are no ends and bear no triple bond."""
    ring_bonds = {(min(r[k], r[k - 1]), max(r[k], r[k - 1])) for r in m.rings for k in range(len(r))}
    free = [len(x) > 1 and 3 not in x.values() for x in m.nbr]
    return sum(
        1 for i in range(len(m)) for j, o in m.nbr[i].items()
        if i < j and o == 1 and free[i] and free[j] and (i, j) not in ring_bonds and (i, j) not in m.arom_bonds
    )


def stereocentres(m: Molecule) -> int:
    """Tetrahedral carbons with four different substituents, marked or not."""
    rank, _, _ = classes(m)
    n = 0
    for i, s in enumerate(m.sym):
        if s == "C" and not m.arom[i] and m.hs[i] <= 1 and len(m.nbr[i]) + m.hs[i] == 4 and set(m.nbr[i].values()) == {1}:
            n += len({rank[j] for j in m.nbr[i]}) == len(m.nbr[i])
    return n


def _carbon_type(m: Molecule, i: int) -> str:
    nb = m.nbr[i]
    hs = m.hs[i]
    hetero = [j for j in nb if m.sym[j] != "C"]
    aromatic = [j for j in nb if m.arom[j]]
    if m.arom[i]:
        ring = [j for j in nb if _aromatic_bond(m, i, j)]
        out = [j for j in nb if j not in ring]
        if hs:
            return "C18"
        if len(ring) == 3:
            return "C19"
        if not out:
            return "C18"
        j = out[0]
        s = m.sym[j]
        if nb[j] == 2:
            return "C25"
        if s in _HALOGENS:
            return {"F": "C14", "Cl": "C15", "Br": "C16", "I": "C17"}[s]
        if m.arom[j]:
            return "C20"
        if s == "C":
            return "C21"
        if s == "N":
            return "C22"
        if s == "O":
            return "C23"
        if s == "S":
            return "C24"
        return "C13"
    orders = list(nb.values())
    if 3 in orders:
        return "C7"
    if 2 in orders:
        doubles = [j for j, o in nb.items() if o == 2]
        if any(m.sym[j] != "C" for j in doubles):
            return "C5"
        return "C26" if aromatic else "C6"
    if hetero:
        if aromatic:
            return "C9" if hs == 3 else "C10" if hs == 2 else "C11" if hs == 1 else "C12"
        strong = any(m.sym[j] in ("N", "O", "P", "S", "F", "Cl", "Br", "I") for j in hetero)
        if not strong:
            return "C27"
        return "C3" if hs >= 2 else "C4"
    if aromatic:
        return {3: "C8", 2: "C10", 1: "C11", 0: "C12"}[min(hs, 3)]
    return "C1" if hs >= 2 else "C2"


def _hydrogen_type(m: Molecule, i: int) -> str:
    s = m.sym[i]
    if s == "C":
        return "H1"
    if s == "O":
        for j in m.nbr[i]:
            if m.sym[j] == "C" and any(o == 2 and k != i and m.sym[k] in ("C", "N", "O", "S") and not m.arom[j] for k, o in m.nbr[j].items()):
                return "H4"
            if m.sym[j] in ("O", "S"):
                return "H4"
        return "H2"
    if s == "N":
        return "H3"
    return "H2" if s == "S" else "H1"


def _nitrogen_type(m: Molecule, i: int) -> str:
    nb, hs = m.nbr[i], m.hs[i]
    if m.arom[i]:
        return "N12" if m.charge[i] > 0 else "N11"
    if m.charge[i] > 0:
        return "N13" if 2 in nb.values() or 3 in nb.values() else "N10" if hs else "N13"
    if 3 in nb.values():
        return "N9"
    if 2 in nb.values():
        return "N5" if hs else "N6"
    aryl = any(m.arom[j] for j in nb)
    if hs >= 2:
        return "N3" if aryl else "N1"
    if hs == 1:
        return "N4" if aryl else "N2"
    return "N8" if aryl else "N7"


def _oxygen_type(m: Molecule, i: int) -> str:
    if m.arom[i]:
        return "O1"
    nb = m.nbr[i]
    if m.charge[i] < 0:
        j = next(iter(nb), None)
        if j is not None and m.sym[j] in ("N", "S"):
            return "O5" if m.sym[j] == "N" else "O6"
        return "O12" if j is not None and _acid_like(m, j) else "O7"
    if m.hs[i]:
        return "O2"
    if 2 in nb.values():
        j = next(iter(nb))
        s = m.sym[j]
        if s == "N":
            return "O5"
        if s == "S":
            return "O6"
        if s == "C":
            if m.arom[j]:
                return "O8"
            others = [k for k in m.nbr[j] if k != i]
            if any(m.arom[k] for k in others):
                return "O10"
            if sum(m.sym[k] != "C" for k in others) >= 2:
                return "O11"
            return "O9"
        return "OS"
    return "O4" if any(m.arom[j] for j in nb) else "O3"


def log_p(m: Molecule) -> float:
    total = 0.0
    for i, s in enumerate(m.sym):
        if s == "C":
            total += _LOGP[_carbon_type(m, i)]
        elif s == "N":
            total += _LOGP[_nitrogen_type(m, i)]
        elif s == "O":
            total += _LOGP[_oxygen_type(m, i)]
        elif s == "S":
            total += _LOGP["S3" if m.arom[i] else "S2" if m.charge[i] else "S1"]
        elif s in _HALOGENS:
            total += _LOGP["Hal" if m.charge[i] else s]
        elif s == "P":
            total += _LOGP["P"]
        elif s != "H":
            total += _LOGP["Me2"]
        if m.hs[i]:
            total += m.hs[i] * _LOGP[_hydrogen_type(m, i)]
    return total


def scaffold(m: Molecule) -> str:
    """Rings, the chains between them, and atoms doubly bonded to either; empty for molecules without rings."""
    if not m.rings:
        return ""
    alive = set(range(len(m)))
    while True:
        ends = [i for i in alive if sum(j in alive for j in m.nbr[i]) <= 1]
        if not ends:
            break
        alive -= set(ends)
    keep = set(alive)
    for i in alive:
        keep |= {j for j, o in m.nbr[i].items() if o == 2 and j not in alive}
    order = sorted(keep)
    new = {x: k for k, x in enumerate(order)}
    r = Molecule()
    for i in order:
        gone = sum(o for j, o in m.nbr[i].items() if j not in keep)
        r.sym.append(m.sym[i])
        r.charge.append(m.charge[i])
        r.iso.append(m.iso[i])
        r.hs.append(m.hs[i] + gone)
        r.chir.append(0)
        r.arom.append(m.arom[i])
        r.nbr.append({new[j]: o for j, o in m.nbr[i].items() if j in keep})
        r.order.append([new[j] for j in m.nbr[i] if j in keep])
    r.arom_bonds = {(min(new[i], new[j]), max(new[i], new[j])) for i, j in m.arom_bonds if i in keep and j in keep}
    rank, signs = ranks(r)
    return write_smiles(r, rank, signs)


def properties(s: str | None) -> dict:
    """All properties of a SMILES; of unreadable text only ``validity`` (false)."""
    m = parse_smiles(s)
    if m is None:
        return {"validity": False}
    rank, signs = ranks(m)
    mw, logp, hbd, hba, tpsa = weight(m), log_p(m), donors(m), acceptors(m), polar_surface(m)
    rot = rotatable(m)
    return {
        "validity": True, "mw": round(mw, 4), "logp": round(logp, 4), "tpsa": round(tpsa, 4), "hbd": hbd, "hba": hba,
        "ring_count": len(m.rings), "lipinski": (mw > 500) + (logp > 5) + (hbd > 5) + (hba > 10) <= 1,
        "canonical": write_smiles(m, rank, signs), "formula": formula(m), "num_stereocenters": stereocentres(m),
        "veber": rot <= 10 and tpsa <= 140, "heavy_atoms": len(m), "rotatable": rot, "scaffold": scaffold(m),
        "qed": None, "pains_alert": None,
    }
