"""Problems 1 and 2 against brute force on the smallest tables, and edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from molquarry.chem import canonical_smiles
from molquarry.llm import overlap, queries, terms

SCHEMA = (
    "row_id bigint, split string, source string, kind string, question string, smiles string, prop string, "
    "pairs array<struct<smiles:string,prop:string>>, answer string, clarify_text string, name string, ingested_at int, extra int"
)
FIELDS = [f.split()[0] for f in re.sub(r"<.*?>>", "", SCHEMA).split(", ")]


def qa(spark, *rows):
    full = [{"ingested_at": 1, "split": "train", "row_id": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in full], SCHEMA)


@pytest.fixture(scope="module")
def dicts(spark):
    names = spark.createDataFrame([("aceton", "CC(C)=O"), ("propanon", "C(C)(C)=O")], "name string, smiles string")
    controls = spark.createDataFrame([(1, "ref one", "CCO")], "pos bigint, name string, smiles string")
    return names, controls


def pairs(df, dicts):
    return {tuple(r) for r in overlap.found_pairs(overlap.normalised(df, *dicts)).collect()}


def test_cases_of_every_kind(spark, dicts):
    two = lambda a, b: [(a, "mw"), (b, "logp")]
    df = qa(
        spark,
        {"kind": "single", "smiles": "OCC", "prop": "MW", "question": "a"}, {"kind": "Single ", "split": "val", "smiles": '"CCO"', "prop": " mw", "question": "z"},
        {"kind": "single", "split": "test", "smiles": "CCO", "prop": "logp"}, {"kind": "error", "smiles": "CC( ", "prop": "mw"},
        {"kind": "error", "split": "val", "smiles": " CC(", "prop": "mw"}, {"kind": "multi", "pairs": two("CCO", "C")},
        {"kind": "multi", "split": "test", "pairs": two("CCO", "C")[::-1]}, {"kind": "multi", "split": "test", "pairs": two("C", "CCO")},
        {"kind": "chain", "name": "Aceton", "prop": "mw"}, {"kind": "chain", "split": "val", "name": "propanon ", "prop": "mw"},
        {"kind": "chain", "name": "who-knows", "prop": "mw"}, {"kind": "chain", "split": "val", "name": "WHO KNOWS", "prop": "mw"},
        {"kind": "no_tool", "question": "What is 10000 plus 472?"}, {"kind": "no-tool", "split": "val", "question": "Hi, waht is 10000 plus 472 . Thanks"},
        {"kind": "no_tool", "split": "val", "question": "What is 10000 plus 473?"}, {"kind": "no_tool", "split": "val", "question": "What is 10000 minus 472?"},
        {"kind": "clarify", "question": "About sample 9 tell me the ring count"}, {"kind": "clarify", "split": "test", "question": "ABOUT SMPLE 9, TELL ME THE RING COUNT!"},
        {"kind": "clarify", "split": "test", "question": "About sample 9 tell me the donor count"}, {"kind": "refuse", "smiles": "CCO", "prop": "mw", "split": "val"},
        {"kind": None, "smiles": "CCO", "prop": "mw", "split": "val"}, {"kind": "single", "smiles": None, "prop": "mw", "split": "val"},
        {"kind": "single", "smiles": "CCO", "prop": None, "split": "val"}, {"kind": "single", "smiles": "n/a", "prop": "mw"}, {"kind": "single", "smiles": "n/a", "prop": "mw", "split": "val"},
        {"kind": "clarify", "question": None}, {"kind": "clarify", "question": " ?! ", "split": "val"}, {"kind": "no_tool", "question": "", "split": "val"},
        {"kind": "single", "split": None, "smiles": "CCO", "prop": "mw"},
    )
    again = df.where("row_id in (0, 1)").withColumn("ingested_at", F.lit(2))
    want = {(0, 1), (3, 4), (5, 6), (8, 9), (10, 11), (12, 13), (16, 17)}
    assert pairs(df.unionByName(again), dicts) == want


def test_empty_and_one_sided(spark, dicts):
    assert pairs(qa(spark, {"kind": "single"}).where("false"), dicts) == set()
    assert pairs(qa(spark, {"kind": "single", "smiles": "C", "prop": "mw"}), dicts) == set()


def test_hot_copies_and_long_texts(spark, dicts):
    same = [{"kind": "no_tool", "question": "Count to 5"}] * 300 + [{"kind": "no_tool", "split": "val", "question": "count to 5!"}] * 3
    long = "word " * 20000 + "1"
    rows = [*same, {"kind": "no_tool", "question": long}, {"kind": "no_tool", "split": "val", "question": long.replace("word word", "wrod word", 1)}]
    assert len(pairs(qa(spark, *rows), dicts)) == 901


def test_whole_tables_against_brute_force(spark, small):
    rows = [r.asDict(recursive=True) for r in spark.read.parquet(f"{small}/qa_v3.parquet").collect()]
    fold = lambda s: "".join(chr(ord(x) - 0xFEE0) if 0xFF01 <= ord(x) <= 0xFF5E else x for x in s if x not in "​﻿⁠‌‍")
    term = lambda s: None if s is None else re.sub(r"[\s_\-]+", " ", fold(s).lower()).strip() or None
    mol = lambda s: None if s is None else canonical_smiles(re.sub(r"\s", "", fold(s)).strip("\"'<>`"))
    names = {}
    for t in ("controls", "name_dict"):
        names |= {term(r["name"]): mol(r["smiles"]) for r in spark.read.parquet(f"{small}/{t}.parquet").collect()}
    sides, asked = defaultdict(lambda: (set(), set())), defaultdict(lambda: (set(), set()))
    for r in rows:
        k, p, key = term(r["kind"]), term(r["prop"]), None
        if k == "single" and mol(r["smiles"]) and p:
            key = (k, mol(r["smiles"]), p)
        elif k == "error" and r["smiles"] and p:
            key = (k, re.sub(r"\s", "", r["smiles"]), p)
        elif k == "multi" and r["pairs"]:
            key = (k, frozenset((mol(x["smiles"]), term(x["prop"])) for x in r["pairs"]))
        elif k == "chain" and r["name"] and p:
            key = (k, names.get(term(r["name"])) or term(r["name"]), p)
        if key:
            sides[key][r["split"] != "train"].add(r["row_id"])
        elif k in ("no tool", "clarify"):
            q = " ".join(re.findall(r"\w+", fold(r["question"]).lower()))
            for _ in range(3):
                q = re.sub(r"^(hi|hello|q|ok so|quick one|please|one more thing) | (thx|thanks|thank you in advance)$", "", q)
            asked[k, tuple(re.findall(r"\d+", q))][r["split"] != "train"].add((r["row_id"], q))
    want = {(min(a, b), max(a, b)) for t, e in sides.values() for a in t for b in e}
    for t, e in asked.values():
        want |= {(min(a, b), max(a, b)) for a, x in t for b, y in e if overlap.slips(x.replace(" ", ""), y.replace(" ", "")) is not None}
    assert {tuple(r) for r in queries.p1_found(spark, small).collect()} == want


def test_slips_that_leave_no_chunk(spark, dicts):
    rng = random.Random(8)

    def slip(q):
        i = rng.randrange(len(q) - 1)
        return rng.choice((q[:i] + q[i + 1 :], q[:i] + rng.choice("abcxyz") + q[i:], q[:i] + rng.choice("abcxyz") + q[i + 1 :], q[:i] + q[i + 1] + q[i] + q[i + 2 :]))

    asked = []
    for n in range(300):
        head = rng.choice(("what is", "work out", "give me", "sum"))
        asked += [(n, "train", f"{slip(head)} {n} plus 1"), (n, rng.choice(("val", "test")), f"{slip(head)} {n} {slip('plus')} 1")]
    rows = [{"kind": "no_tool", "split": s, "question": q} for _, s, q in asked]
    bare = lambda q: re.sub(r"\s", "", q)
    numbers = lambda q: re.findall(r"\d+", q)
    want = {
        (i, i + 1) for i in range(0, len(asked), 2)
        if numbers(asked[i][2]) == numbers(asked[i + 1][2]) and overlap.slips(bare(asked[i][2]), bare(asked[i + 1][2])) is not None
    }
    assert len(want) > 50 and pairs(qa(spark, *rows), dicts) == want


def test_piece_keys_meet_within_two_slips():
    rng = random.Random(9)
    met = 0
    for _ in range(20000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(2):
            i = rng.randint(0, len(b))
            match rng.randrange(4):
                case 0:
                    b[i:i] = rng.choice("abc")
                case 1:
                    del b[i : i + 1]
                case 2:
                    b[i : i + 1] = rng.choice("abc")
                case _:
                    b[i : i + 2] = b[i : i + 2][::-1]
        b = "".join(b)
        if overlap.slips(a, b) is not None:
            met += 1
            assert set(overlap.piece_keys(a)) & set(overlap.probe_keys(b)), (a, b)
    assert met > 15000


def test_chunks_rebuild_the_text_and_resync():
    rng = random.Random(1)
    for n in (0, 1, 3, 50, 500):
        t = "".join(rng.choice("abcdefgh ") for _ in range(n))
        assert "".join(overlap.chunks(t)) == t
    a = "".join(rng.choice("abcdefgh ") for _ in range(400))
    kept = Counter(overlap.chunks(a)) & Counter(overlap.chunks(a[:200] + "Z" + a[200:]))
    assert sum(len(c) * n for c, n in kept.items()) > 350


def test_slips_against_all_neighbours():
    def near(t):
        out = {t}
        for i in range(len(t) + 1):
            out |= {t[:i] + c + t[i:] for c in "abc"} | {t[:i] + c + t[i + 1 :] for c in "abc"} | {t[:i] + t[i + 1 :], t[:i] + t[i : i + 2][::-1] + t[i + 2 :]}
        return out

    rng = random.Random(3)
    for _ in range(600):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) if rng.random() < 0.3 else rng.choice(sorted(near(rng.choice(sorted(near(a))))))
        one, two = near(a), {z for y in near(a) for z in near(y)}
        assert overlap.slips(a, b) == (0 if a == b else 1 if b in one else 2 if b in two else None), (a, b)
    long = "".join(rng.choice("abc") for _ in range(50000))
    assert overlap.slips(long, long[1:] + "x") == 2 and overlap.slips("a" + long, long[::-1] + "b") is None


def test_report_counts(spark, dicts):
    df = qa(spark, {"kind": "single", "smiles": "C", "prop": "mw"}, {"kind": "single", "split": "val", "smiles": "C", "prop": "mw", "source": "s"}, {"kind": "x", "split": "val", "source": "s"})
    r = overlap.overlap_report(df, overlap.normalised(df, *dicts)).collect()
    assert [(x["split"], x["source"], x["records"], x["overlapping"], x["same"]) for x in r] == [("val", "s", 2, 1, 1)]


def test_term_counts(spark):
    df = qa(
        spark, {"prop": "MW", "kind": "single", "pairs": [("C", "m_w"), ("C", "mw"), ("C", None)], "name": "A-b"}, {"prop": "mw", "kind": " ", "name": "a b"},
        {"prop": None, "kind": None, "name": None}, {"row_id": None, "prop": "mw"},
    )
    again = df.where("row_id = 0").withColumn("ingested_at", F.lit(9))
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["last_record"], r["mark"]) for r in terms.term_counts(df.unionByName(again), 2, 0.5).collect()}
    assert got == {
        ("prop", "mw"): (3, 2, 1, "common"), ("prop", "m w"): (1, 1, 0, "rare"), ("kind", "single"): (1, 1, 0, "rare"), ("name", "a b"): (2, 2, 1, "common"),
    }
    assert terms.term_counts(df.where("false")).count() == 0


def test_term_counts_in_small_batches(spark):
    rng = random.Random(5)
    rows = [{"kind": rng.choice("ab"), "prop": rng.choice("abc"), "pairs": [("C", rng.choice("abcd")) for _ in range(rng.randint(0, 3))]} for _ in range(500)]
    want = defaultdict(Counter)
    for i, r in enumerate(rows):
        for t in [r["prop"], *(p for _, p in r["pairs"])]:
            want[t][i] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_counts(qa(spark, *rows), salts=3).where("field = 'prop'").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {t: (sum(c.values()), len(c)) for t, c in want.items()}


@pytest.mark.parametrize("low, high", [(8, 12), (13, 20), (21, 30), (31, 60), (61, 120)])
def test_every_pair_within_two_slips_is_found_at_any_length(spark, dicts, low, high):
    """One slip on each side of questions of some length; recall is one."""
    rng = random.Random(low)

    def slip(q):
        i = rng.randrange(len(q) - 1)
        return rng.choice((q[:i] + q[i + 1 :], q[:i] + rng.choice("abcxyz") + q[i:], q[:i] + rng.choice("abcxyz") + q[i + 1 :], q[:i] + q[i + 1] + q[i] + q[i + 2 :]))

    rows = []
    for n in range(150):
        base = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(low, high) - 4))
        rows += [{"kind": "clarify", "split": s, "question": f"{slip(base)} {n}"} for s in ("train", "val")]
    got = pairs(qa(spark, *rows), dicts)
    assert got >= {(i, i + 1) for i in range(0, len(rows), 2)}


def test_classes_count_copies_and_links(spark, dicts):
    ask = lambda q, s, n=1: [{"kind": "no_tool", "split": s, "question": q}] * n
    df = qa(spark, *ask("add 1 and 22", "train", 3), *ask("add 1 and 22!", "val", 2), *ask("ad 1 and 22", "test"), *ask("take 1 from 22", "val"))
    got = {r["row_id"]: (r["copies"], r["links"]) for r in overlap.overlap_classes(overlap.normalised(df, *dicts)).collect()}
    assert got == {0: (2, 1), 1: (2, 1), 2: (2, 1), 3: (3, 0), 4: (3, 0), 5: (0, 1)}


def test_grid_of_a_hot_digest_loses_nothing(spark, dicts, monkeypatch):
    """Many classes with one template and no number meet in blocks."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    rows = [{"kind": "clarify", "split": s, "question": f"which molecule do you mean by {w}"} for w in words for s in ("train", "val")]
    want = pairs(qa(spark, *rows), dicts)
    monkeypatch.setattr(overlap, "GRID", 7)
    assert pairs(qa(spark, *rows), dicts) == want >= {(i, i + 1) for i in range(0, len(rows), 2)}
