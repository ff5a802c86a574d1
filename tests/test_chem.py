import itertools
import random

import pytest

from molquarry.chem import canonical_smiles, parse_smiles
from molquarry.chem.canon import _parities, _sides, ranks, write_smiles
from molquarry.chem.parse import _matching, find_rings
from molquarry.chem.props import properties

ASPIRIN = "CC(=O)Oc1ccccc1C(=O)O"


@pytest.mark.parametrize(
    ("a", "b"),
    [
        (ASPIRIN, "OC(=O)c1ccccc1OC(C)=O"),
        ("CC(C)=O", "C(C)(C)=O"),
        ("C1=CC=CC=C1", "c1ccccc1"),
        ("C1(CC=C)=NC=C(C(=O)NC)C=C1OCc1ccccc1", "c1(CC=C)ncc(C(=O)NC)cc1OCc3ccccc3"),
        ("c1ccc2[nH]ccc2c1", "C1=CC=C2NC=CC2=C1"),
        ("N[C@@H](C)C(=O)O", "OC(=O)[C@H](C)N"),
        ("C(-[F])(-[F])-F", "FC(F)F"),
        ("C%10CCCC%10", "C1CCCC1"),
        ("[H]C([H])([H])O", "CO"),
        ("CC.O", "O.CC"),
        ("F/C=C/F", "F\\C=C\\F"),
        ("[H]/C(F)=C/F", "F\\C=C/F"),
        ("C(/F)=C/F", "F/C=C\\F"),
        ("F/C=C/C=C\\F", "F\\C=C\\C=C/F"),
        ("C/C=N/O", "O/N=C/C"),
        ("C1CC/C=C/CC1", "C1CCC=CCC1"),
        ("F/C(F)=C/F", "FC(F)=CF"),
    ],
)
def test_spellings_of_one_molecule(a, b):
    assert canonical_smiles(a) == canonical_smiles(b) is not None


@pytest.mark.parametrize(("a", "b"), [("N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O"), ("CCO", "COC"), ("CC(C)=O", "CCO"), ("[13CH4]", "C"), ("F/C=C/F", "F/C=C\\F"), ("CC=CC", "C/C=C/C"), ("C/C=N\\O", "O/N=C/C")])
def test_different_molecules(a, b):
    assert canonical_smiles(a) != canonical_smiles(b)


@pytest.mark.parametrize(
    "text",
    ["", None, "not_a_smiles", "C1CC", "c1cccc1", "CC(C)(C)(C)C", "n/a", "cc", "C(", "C)", "C((C))C", "cc(3)", "@C", "C]", "C[O", "=C", "C=", "[Xx]", "C11", "()"],
)
def test_unreadable(text):
    assert parse_smiles(text) is None


def test_centre_without_four_different_neighbours_is_none():
    assert canonical_smiles("C[C@H](C)O") == canonical_smiles("CC(C)O")


@pytest.mark.parametrize(
    "text",
    [
        ASPIRIN, "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "COCC(=O)N[C@H](C)C(=O)N[C@@H](CCC(=O)O)C(=O)N[C@@H](C)C(=O)O",
        "c1(NC(=O)CSc3ccc(C)cc3)ccc2nc(C(F)(F)F)cc(OCc3ccccc3)c2c1", "C1CC2CCC1CC2", "C[N+](C)(C)CC([O-])=O", "C[C@@H]1CC[C@H](C)O1", "c1ccc-2c(c1)-c1ccccc12",
        "C/C(Cl)=C/C=C\\C(F)=N/O", "C(/F)=C1/CCCO1", "O[C@H](/C=C/C)/C=C\\C", "F/C=C/[C@@H](C)CC/C(Br)=C(/C)Cl",
    ],
)
def test_any_order_of_atoms_gives_one_text(text):
    m = parse_smiles(text)
    want = canonical_smiles(text)
    _, signs = ranks(m)
    rng = random.Random(4)
    for _ in range(60):
        order = list(range(len(m)))
        rng.shuffle(order)
        # The signs of the written order, of the centres and double bonds that count.
        own = {k: v for k, v in (_parities(m, order) | _sides(m, order)).items() if k in signs}
        assert canonical_smiles(write_smiles(m, order, own)) == want
    assert canonical_smiles(want) == want


def test_matching_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(2, 7)
        edges = [(i, j) for i in range(n) for j in range(i) if rng.random() < 0.4]
        links = {i: [a + b - i for a, b in edges if i in (a, b)] for i in range(n)}
        best = max(k for k in range(n // 2 + 1) if any(len({x for e in c for x in e}) == 2 * k for c in itertools.combinations(edges, k)))
        match = _matching(links)
        assert len(match) == 2 * best and all(match[match[i]] == i and match[i] in links[i] for i in match)


def test_large_aromatic_systems_are_read():
    # Rows of fused rings, and odd cycles that a search by alternating paths alone may miss.
    assert parse_smiles("c1ccc2" + "cc3" * 0 + "cc3cc4cc5cc6cc7ccccc7cc6cc5cc4cc3cc2c1") is not None
    assert parse_smiles("c1cc2ccc3cccc4ccc(c1)c2c34") is not None


def test_centres_beside_double_bonds_of_either_form():
    assert properties("O[C@H](/C=C/C)/C=C\\C")["num_stereocenters"] == 1
    assert properties("OC(/C=C/C)/C=C/C")["num_stereocenters"] == 0


def test_rings():
    assert len(find_rings(parse_smiles("C1CC2CCC1CC2").nbr)) == 2
    assert len(find_rings(parse_smiles("c1ccc2ccccc2c1").nbr)) == 2
    assert find_rings(parse_smiles("CCCC").nbr) == []


def test_vectors():
    p = properties(ASPIRIN)
    assert abs(p["mw"] - 180.16) <= 0.1 and p["hbd"] == 1 and p["ring_count"] == 1 and p["lipinski"] and p["validity"]
    assert p["formula"] == "C9H8O4" and p["veber"] and abs(p["logp"] - 1.3101) < 1e-3 and abs(p["tpsa"] - 63.6) < 0.01
    assert p["scaffold"] == "c1ccccc1" and p["heavy_atoms"] == 13
    assert properties("CCO")["mw"] == 46.069 and properties("CCO")["scaffold"] == ""
    assert properties("not_a_smiles") == {"validity": False}
    assert p["qed"] is None and p["pains_alert"] is None


def test_stereocentres_and_scaffold():
    assert properties("N[C@@H](C)C(=O)O")["num_stereocenters"] == 1
    assert properties("CC(O)C(N)C")["num_stereocenters"] == 2
    assert properties("O=C1CCCCC1CC")["scaffold"] == "C1CCC(CC1)=O"
    assert properties("CCc1ccccc1CCc1ccncc1")["scaffold"] == canonical_smiles("c1ccccc1CCc1ccncc1")
