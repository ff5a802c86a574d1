"""Problems 3 and 4."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from molquarry.llm import groups, queries, quotas


def union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(6)
    names = [f"n{i:03d}" for i in range(120)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(90)] + [(names[i], names[i + 1]) for i in range(30, 70)]
    df = spark.createDataFrame([*links, ("n000", None), (None, None)], "a string, b string")
    got = {r["node"]: r["root"] for r in groups.components(df).collect()}
    assert got == {x: r for x, r in union_find([p for p in links if p[0] != p[1]]).items()}
    assert groups.components(df.where("false")).count() == 0


REC = "row_id bigint, kind string, question string, smiles string, pairs array<struct<smiles:string,prop:string>>, name string, pos int"


@pytest.fixture(scope="module")
def tables(spark):
    mols = spark.createDataFrame([(10, "CCO"), (11, "CCN"), (12, "c1ccccc1C")], "pos bigint, smiles string")
    names = spark.createDataFrame([("tolu", "Cc1ccccc1")], "name string, smiles string")
    controls = spark.createDataFrame([(1, "ref-x", "CCCl")], "pos bigint, name string, smiles string")
    return mols, names, controls


def test_related_records(spark, tables):
    rows = [
        (1, "single", "q", "OCC", None, None), (2, "multi", "q", None, [("CCO", "mw"), ("CCN", "mw")], None), (3, "single", "q", "NCC", None, None),
        (4, "chain", "q", None, None, " TOLU"), (5, "single", "What of Cc1ccccc1?", None, None, None), (6, "chain", "q", None, None, "Ref X"),
        (7, "x", "q", "CCCl", None, "unknown"), (8, "error", "q", "CC(", None, None), (9, "single", "q", "CCCCC", None, None), (10, "y", "q", "CCCCC", None, None),
        (11, "no_tool", "I am ON it", None, None, None), (12, None, None, None, None, None), (13, "single", "see Cc1ccccc1", "", None, None), (13, "single", "see Cc1ccccc1", "", None, None),
        (None, "single", "q", "OCC", None, None), (14, "single", "q", "CCF", None, None),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], REC)
    got = {r["row_id"]: r["group_pos"] for r in groups.related(df, *tables).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 12, 5: 12, 6: 1, 7: 1, 9: None, 10: None}
    assert groups.related(df.where("false"), *tables).count() == 0


@pytest.mark.parametrize(
    "text, spelled",
    [
        ("What does CCO weigh?", "CCO"), ("Is CCCCCCCCO greasy", "CCCCCCCCO"), ("the mass of 'CC=O', please", "CC=O"), ("c1ccccc1C!", "Cc1ccccc1"), ("mw for C(N)O.", "OCN"),
        ("weigh ClCCCl today", "C(Cl)CCl"), ("logP of C#N?", "N#C"),
    ],
)
def test_molecules_written_in_questions(spark, tables, text, spelled):
    df = spark.createDataFrame([(1, "clarify", text, None, None, None, 0), (2, "single", None, spelled, None, None, 0)], REC)
    assert {r["row_id"] for r in groups.related(df, *tables).collect()} == {1, 2}


def test_ordinary_words_are_no_molecules(spark, tables):
    texts = ["can I have it", "I am ON it, NO?", "COIN B OF IN", "see [1] or [C] and [N]", "10 % of 5 mg (C)", "In CO and Co", "BOSON SPIN FOCUS", "sample C has no name"]
    df = spark.createDataFrame([(i, "clarify", t, None, None, None, 0) for i, t in enumerate(texts * 2)], REC)
    assert groups.related(df, *tables).count() == 0


def test_hot_keys_are_dealt_out_and_lose_nothing(spark, tables, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "chain", "q", None, None, " TOLU", 0) for i in range(60)]
    rows += [(100 + i, "multi", "q", None, [("CCO", "mw"), ("C" * rng.randint(3, 30), "mw")], None, 0) for i in range(120)]
    df = spark.createDataFrame(rows, REC)
    want = {(r["row_id"], r["group_pos"]) for r in groups.related(df, *tables).collect()}
    assert len(want) == 180
    monkeypatch.setattr("molquarry.runtime.HOT_LEAST", 2)
    assert {(r["row_id"], r["group_pos"]) for r in groups.related(df, *tables).collect()} == want


def test_split_keeps_groups_and_shares(spark, small):
    split = {r["row_id"]: r["new_split"] for r in queries.p3_split(spark, small).collect()}
    total = Counter(split.values())
    n = sum(total.values())
    assert n == spark.read.parquet(f"{small}/qa_v3.parquet").select("row_id").distinct().count()
    assert abs(total["train"] / n - 0.8) < 0.01 and abs(total["val"] / n - 0.1) < 0.01
    args = [spark.read.parquet(f"{small}/{t}.parquet") for t in ("qa_v3", "name_dict", "controls")]
    of = defaultdict(set)
    for r in groups.references(*args)[0].collect():
        of[r["node"]].add(split[r["row_id"]])
    assert all(len(s) == 1 for s in of.values())


def test_sizes_are_chosen_optimally():
    rng = random.Random(9)
    for _ in range(150):
        sizes = Counter(rng.choice([1, 2, 3, 7, 20]) for _ in range(rng.randint(1, 9)))
        items = list(sizes.elements())
        got = groups.choose_sizes(dict(sizes), [0.8, 0.1, 0.1])
        assert sum((Counter(x) for x in got), Counter()) == sizes
        target = round(0.8 * sum(items))
        best = min(abs(sum(c) - target) for k in range(len(items) + 1) for c in itertools.combinations(items, k))
        assert abs(sum(s * k for s, k in got[0].items()) - target) == best
    sizes = {1: 900, 2: 300, 9: 40, 3000: 1}
    for part in (groups.choose_sizes(sizes, [0.8, 0.1, 0.1], bits=64), groups.choose_sizes(sizes, [0.8, 0.1, 0.1])):
        total = [sum(s * k for s, k in p.items()) for p in part]
        assert sum(total) == 4860 and abs(total[0] - 3888) <= 1 and abs(total[1] - 486) <= 1
    assert groups.choose_sizes({}, [0.8, 0.1, 0.1]) == [{}, {}, {}]


def test_controlled_rounding_keeps_margins():
    rng = random.Random(12)
    for _ in range(200):
        cells = {(r, c): rng.choice([0.0, 1.0, rng.random() * 5]) for r in range(rng.randint(1, 5)) for c in range(rng.randint(1, 5))}
        whole = quotas.controlled_rounding(cells)
        near = lambda n, x: n in (int(x + 1e-9), -int(-(x - 1e-9) // 1))
        assert all(near(whole[k], v) for k, v in cells.items())
        for side in (0, 1):
            for m in {k[side] for k in cells}:
                assert near(sum(n for k, n in whole.items() if k[side] == m), sum(v for k, v in cells.items() if k[side] == m))
        assert abs(sum(whole.values()) - sum(cells.values())) <= 0.5 + 1e-6
    assert quotas.controlled_rounding({}) == {}


@pytest.fixture
def plan(spark):
    rows = [(i, "Single" if i < 60 else "chain" if i < 90 else None, "mw" if i % 2 else "LOGP ") for i in range(100)]
    df = spark.createDataFrame(rows + [rows[0]] * 3, "row_id bigint, kind string, prop string")
    plans = spark.createDataFrame([(1, 50), (2, 30), (3, 10)], "plan_id int, sample_rows bigint")
    targets = spark.createDataFrame(
        [(1, 1, "single", None, 0.5, 1), (2, 1, "chain", None, 0.5, 40), (3, 2, None, "mw", 0.9, 1), (4, 2, None, "none", 0.1, 1), (5, 3, "single", "mw", 0.55, 0), (6, 3, "chain", "logp", 0.45, 0), (7, 3, None, None, None, 2)],
        "target_id int, plan_id int, kind string, prop string, share double, min_rows bigint",
    )
    return df, plans, targets


def test_plans(spark, plan):
    df, plans, targets = plan
    report = quotas.plan_report(df, plans, targets)
    got = {r["target_id"]: (r["available"], r["needed"], r["quota"], r["unmet"]) for r in report.collect()}
    assert got[1][0] == 60 and got[2] == (30, 40, 30, True) and got[3] == (50, 27, 30, False) and got[4] == (0, 3, 0, True)
    assert got[5][1] == 6 and got[6][1] == 5 and got[7][3] is True
    sample = quotas.draw_sample(df, plans, targets).collect()
    assert Counter(r["target_id"] for r in sample) == {t: q for t, (_, _, q, _) in got.items() if q}
    assert len({(r["plan_id"], r["row_id"]) for r in sample}) == len(sample)
    term_of = {r["row_id"]: ((r["kind"] or "").lower().strip(), r["prop"].lower().strip()) for r in df.collect()}
    wanted = {t[0]: t for t in targets.collect()}
    for r in sample:
        kind, prop = term_of[r["row_id"]]
        assert wanted[r["target_id"]]["kind"] in (None, kind) and wanted[r["target_id"]]["prop"] in (None, prop)
    assert quotas.draw_sample(df, plans, targets).exceptAll(quotas.draw_sample(df.repartition(7), plans, targets)).count() == 0
    empty = quotas.plan_report(df.where("false"), plans, targets)
    assert all(r["quota"] == 0 and r["unmet"] == (r["needed"] > 0) for r in empty.collect())


def test_overlapping_targets_draw_no_record_twice(spark):
    rows = [(i, "single" if i < 60 else "chain", "mw" if i % 2 else "logp") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id bigint, kind string, prop string")
    plans = spark.createDataFrame([(1, 90), (2, 40), (3, 100)], "plan_id int, sample_rows bigint")
    targets = spark.createDataFrame(
        [(1, 1, "single", None, 0.5, 0), (2, 1, None, "mw", 0.5, 0), (3, 2, "single", None, 0.5, 0), (4, 2, "Single", None, 0.5, 0), (5, 3, "single", None, 0.5, 0), (6, 3, None, "mw", 0.3, 0), (7, 3, "chain", "mw", 0.2, 0)],
        "target_id int, plan_id int, kind string, prop string, share double, min_rows bigint",
    )
    report = {r["target_id"]: r for r in quotas.plan_report(df, plans, targets).collect()}
    sample = quotas.draw_sample(df, plans, targets).collect()
    assert len({(r["plan_id"], r["row_id"]) for r in sample}) == len(sample)
    assert Counter(r["target_id"] for r in sample) == {t: r["quota"] for t, r in report.items() if r["quota"]}
    # 80 records are single or mw, 30 of them both: all are drawn, and no more than there are.
    assert sum(report[t]["quota"] for t in (1, 2)) == 80 and report[3]["quota"] == report[4]["quota"] == 20
    assert not any(r["unmet"] for r in report.values())


def test_found_against_brute_force(spark, small):
    records = [r.asDict() for r in spark.read.parquet(f"{small}/qa_v3.parquet").select("row_id", "kind", "prop").distinct().collect()]
    fold = lambda s: "".join(chr(ord(x) - 0xFEE0) if 0xFF01 <= ord(x) <= 0xFF5E else x for x in s if x not in "​﻿⁠‌‍")
    term = lambda s: None if s is None else re.sub(r"[\s_\-]+", " ", fold(s).lower()).strip() or None
    rows = {r["row_id"]: (term(r["kind"]), term(r["prop"])) for r in records}.values()
    plans = {r["plan_id"]: r["sample_rows"] for r in spark.read.parquet(f"{small}/sample_plans.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{small}/sample_targets.parquet").collect():
        k, p = term(r["kind"]), term(r["prop"])
        n = sum((k is None or a == k) and (p is None or b == p) for a, b in rows)
        if n < max(r["min_rows"], int(r["share"] * plans[r["plan_id"]] + 0.5)):
            want.add((r["plan_id"], r["target_id"]))
    assert {tuple(r) for r in queries.p4_found(spark, small).collect()} == want
