import random

import pytest
from pyspark.sql import functions as F

from molquarry import catalog as C
from molquarry.functions import protocol as P
from molquarry.functions.scoring import score
from molquarry.operators import episodes as E
from molquarry.operators import fanout as R
from molquarry.operators import metrics as A
from molquarry.operators import molecules as M
from molquarry.operators import names as J
from molquarry.operators import traces as T
from molquarry.plans import build, evaluate
from molquarry.runtime import draw

EXPECTED = "array<struct<smiles:string,prop:string,vtype:string,tol:double,truth:string>>"


def call(smiles, prop):
    return f'<tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": {{"smiles": "{smiles}", "property": "{prop}"}}}}</tool_call>'


def look(name):
    return f'<tool_call>{{"name": "{C.NAME_TOOL}", "arguments": {{"name": "{name}"}}}}</tool_call>'


MW = ("CCO", "mw", "float", 0.1, "46.069")
HBD = ("CCO", "hbd", "int", None, "1")
CASES = [
    # kind, name, expected, turns, (correct, tool_valid) by version 3
    ("single", None, [MW], [call("CCO", "mw"), "46.07"], (True, True)),
    ("single", None, [MW], ["46.07"], (True, False)),
    ("single", None, [MW], [call("CC", "mw"), "30.07"], (False, False)),
    ("single", None, [MW], [call("CCO", "mw")] * 7, (False, True)),
    ("multi", None, [MW, HBD], [call("CCO", "mw"), call("CCO", "hbd"), "mw=46.069, hbd=1"], (True, True)),
    ("multi", None, [MW, HBD], [call("CCO", "mw"), "mw=46.069, hbd=1"], (True, False)),
    ("no_tool", None, [], ["42"], (True, True)),
    ("no_tool", None, [], [call("C", "mw"), "42"], (False, False)),
    ("clarify", None, [], ["Please provide the SMILES."], (True, True)),
    ("clarify", None, [], ["It is 12."], (False, True)),
    ("error", None, [], [call("CC(", "mw"), "That is invalid."], (True, True)),
    ("error", None, [], ["That is invalid."], (False, False)),
    ("chain", "Ethanol", [MW], [look(" ethanol "), call("CCO", "mw"), "46.069"], (True, True)),
    ("chain", "Ethanol", [MW], [call("CCO", "mw"), look("ETHANOL"), "46.069"], (True, True)),
    ("chain", "Ethanol", [MW], [call("CCO", "mw"), "46.069"], (False, False)),
    ("chain", "Ethanol", [MW], [look("water"), call("CCO", "mw"), "46.069"], (False, False)),
    ("single", None, [MW], [], (False, False)),
]


def test_episodes_by_kind(spark):
    eps = spark.createDataFrame([(i, k, n, e) for i, (k, n, e, _, _) in enumerate(CASES)], f"episode int, kind string, name string, expected {EXPECTED}")
    turns = spark.createDataFrame([(i, j, t) for i, c in enumerate(CASES) for j, t in enumerate(c[3])], "episode int, turn int, text string")
    got = {r["episode"]: (r["correct"], r["tool_valid"]) for r in E.score_by_kind(eps, turns).collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}


def test_first_format(spark):
    v1 = lambda s, p: f'TOOL_CALL: {{"smiles": "{s}", "property": "{p}"}}'
    cases = [
        ([MW], [v1("CCO", "mw"), "FINAL: 46.07"], (True, True)), ([MW], ["I think 46"], (False, False)),
        ([HBD], [v1("CCCO", "hbd"), "FINAL: 1"], (True, False)), ([MW], [v1("CC", "mw"), "FINAL: 30.07"], (False, False)),
        ([MW], [v1("CCO", "mw"), "no marker"], (False, True)),
    ]
    eps = spark.createDataFrame([(i, "single", e) for i, (e, _, _) in enumerate(cases)], f"episode int, kind string, expected {EXPECTED}")
    turns = spark.createDataFrame([(i, j, t) for i, c in enumerate(cases) for j, t in enumerate(c[1])], "episode int, turn int, text string")
    rows = E.score_one_call(eps, turns).collect()
    assert {r["episode"]: (r["correct"], r["tool_valid"]) for r in rows} == {i: c[2] for i, c in enumerate(cases)}
    assert {r["episode"]: r["strict_correct"] for r in rows}[2] is False
    rows = E.score_general(eps, turns).collect()
    assert {r["episode"]: (r["correct"], r["tool_valid"]) for r in rows} == {i: c[2] for i, c in enumerate(cases)}


def test_played_equals_the_loop(spark):
    rng = random.Random(8)
    scripts = {i: [rng.choice([call("C", "mw"), look("x"), "answer", "<tool_call>{</tool_call>"]) for _ in range(rng.randint(0, 9))] for i in range(200)}
    turns = spark.createDataFrame([(i, j, t) for i, s in scripts.items() for j, t in enumerate(s)], "episode int, turn int, text string")
    got = {r["episode"]: (len(r["calls"]), r["final"]) for r in E.played(turns, P.parse_native_call(F.col("text")), F.col("text")).collect()}
    for i, s in scripts.items():
        n, final = 0, None
        for t in s[: C.MAX_TURNS]:
            if evaluate.Toolbox(str).read(t) is None:
                final = t
                break
            n += 1
        assert got.get(i, (0, None)) == (n, final)


def greedy(sizes, train=0.8, val=0.1):
    total, placed, out = sum(sizes), 0, []
    for s in sizes:
        out.append("train" if placed < train * total else "val" if placed < (train + val) * total else "test")
        placed += s
    return out


def test_group_split_fills_greedily(spark):
    rng = random.Random(2)
    rows = [(f"g{g}", i) for g in range(60) for i in range(rng.choice([1, 1, 2, 5, 40]))]
    df = spark.createDataFrame(rows, "g string, i int")
    got = {r["g"]: r["split"] for r in M.group_split(df, "g", 3).select("g", "split").distinct().collect()}
    keys = {r["g"]: r["k"] for r in df.select("g", draw(3, F.lit("group"), "g").alias("k")).distinct().collect()}
    order = sorted(keys, key=lambda g: (keys[g], g))
    assert [got[g] for g in order] == greedy([sum(r[0] == g for r in rows) for g in order])
    assert M.group_split(df.where("g = 'x'"), "g").count() == 0
    assert [r["split"] for r in M.group_split(spark.createDataFrame([(None, 1)], "g string, i int"), "g").collect()] == ["train"]


def test_leaks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "test"), (None, "val"), (None, "train")], "k string, split string")
    assert {(r["split_a"], r["split_b"]): r["shared"] for r in M.split_overlaps(df, "k").collect()} == {("test", "train"): 0, ("test", "val"): 0, ("train", "val"): 1}


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), (None, 0, "z")], "k string, pos int, v string")
    assert [tuple(r) for r in M.first_wins(df, "k", "pos", 5).orderBy("pos").collect()] == [("a", 1, "y"), ("b", 2, None)]
    assert M.first_wins(df, "k", "pos", 1).count() == 1


def test_names(spark):
    d = spark.createDataFrame([("acetone", "CC(C)=O"), ("zinc x", "C"), ("b", "N"), ("a", "O")], "name string, smiles string")
    asked = spark.createDataFrame([(" Acetone ",), ("nope",), (None,)], "name string")
    assert [r["resolved"] for r in J.resolve(asked, d).orderBy(F.col("name").isNull(), "name").collect()] == ["CC(C)=O", None, None]
    assert [r["name"] for r in J.unresolved(asked, d).collect()] == ["nope"]
    assert {r["name"]: r["split"] for r in R.name_splits(d).collect()} == {"a": "train", "acetone": "val", "b": "test", "zinc x": "train"}


def test_fanout_rates_and_repeats(spark):
    mols = spark.range(2000).select(F.col("id").alias("key"), F.lit("CCO").alias("smiles"), F.lit("train").alias("split"))
    assert abs(R.error_rows(mols, 1).count() / 2000 - 0.15) < 0.03 and abs(R.multi_rows(mols, 1).count() / 2000 - 0.4) < 0.04
    assert R.single_rows(mols, C.ALL_PROPERTIES, 1).count() == 28000
    bank = R.bank_rows(mols)
    assert bank.where("split = 'train'").count() == 12 * 4 and bank.where("split = 'val'").count() == 12
    names = spark.createDataFrame([(f"n{i}", "train") for i in range(800)], "name string, split string")
    assert R.chain_rows(names, mols, 1).count() == 800 * 2  # 2.5 rounds to even
    bad = R.corrupt_rows(mols, 1).select("smiles").distinct().collect()
    assert all(len(r["smiles"]) == 3 for r in bad)
    assert R.arithmetic_rows(mols, 1).where("cast(answer as int) between 2 and 100").count() == 2000


def test_rewards(spark):
    msg = T.message
    c = T.call_message(C.COMPUTE_TOOL, smiles=F.lit("C"), property=F.lit("hbd"))
    n = T.call_message(C.NAME_TOOL, name=F.lit("x"))
    cases = [
        ("single", [c, msg("assistant", "1")], 1.0), ("single", [msg("assistant", "1")], 0.7), ("chain", [msg("assistant", "2")], -0.6),
        ("chain", [n, c, c, msg("assistant", "1")], 0.9), ("single", [c], 0.0), ("single", [c, msg("assistant", "")], 0.0),
        ("single", [c, msg("assistant", "1"), msg("tool", "x"), msg("assistant", "9")], 0.0),
    ]
    for kind, messages, want in cases:
        got = spark.range(1).select(T.reward(F.array(*messages), F.lit(kind), F.lit("int"), F.lit(None).cast("double"), F.lit("1")).alias("r")).first()["r"]
        assert abs(got - want) < 1e-9, (kind, want)


def test_trace_lengths_and_unknown_kind(spark):
    q, name, answer = F.lit("q"), F.lit("Ethanol"), F.lit("an")
    one, two = [(F.lit("CCO"), F.lit(p), F.lit(v)) for p, v in (("mw", "46.069"), ("hbd", "1"))]
    steps = lambda k: T.steps_of(one, two) if k == "multi" else T.steps_of(one)
    size = lambda k, v=3: len(spark.range(1).select(T.native_trace(F.lit(k), q, steps(k), name, F.lit("CCO"), answer, answer, v).alias("m")).first()["m"])
    assert [size(k) for k in ("single", "multi", "chain", "error", "no_tool", "clarify")] == [5, 7, 7, 5, 3, 3]
    with pytest.raises(Exception, match="unknown kind"):
        size("chain", 2)


def test_gold_answers_score(spark):
    from molquarry.functions.features import features_of, rendered

    smiles = ["CC(=O)Oc1ccccc1C(=O)O", "CCO", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "C1CC1"]
    rows = features_of(spark.createDataFrame([(s,) for s in smiles], "spelling string")).select(F.struct("*").alias("features"))
    rows = rows.select(F.explode(rendered()).alias("prop", "text"))
    types = {p: (t, tol) for p, t, tol in C.PROPERTIES}
    for r in rows.collect():
        t, tol = types[r["prop"]]
        assert spark.range(1).select(score(F.lit(t), F.lit(tol).cast("double"), F.lit(r["text"]), F.lit(r["text"])).alias("s")).first()["s"]


def test_metrics_and_report(spark):
    rows = spark.createDataFrame([("mw", True, True), ("mw", False, True), ("a", True, False)], "k string, correct boolean, tool_valid boolean")
    text = A.markdown(A.metrics(rows, "k"), "base")
    assert text.splitlines()[4:] == ["| _all | 3 | 0.667 | 0.667 |", "| a | 1 | 1.000 | 0.000 |", "| mw | 2 | 0.500 | 1.000 |"]


def test_scripted_model_end_to_end(spark):
    questions = spark.createDataFrame([(1, "mw of CCO"), (2, "hello"), (3, "mw of Ethanol")], "episode int, question string")

    look_up, compute = look("Ethanol"), call("CCO", "mw")

    def agent(messages):
        asked = next(m["content"] for m in messages if m["role"] == "user")
        told = [m["content"] for m in messages if m["role"] == "tool"]
        if "Ethanol" in asked and not told:
            return look_up
        if "mw" in asked and len(told) < (2 if "Ethanol" in asked else 1):
            return compute
        return told[-1] if told else "hi"

    turns = evaluate.transcripts(questions, agent, {"ethanol": "CCO"})
    got = {(r["episode"], r["turn"]): r["text"] for r in turns.collect()}
    assert got[1, 1] == '{"result": 46.069}' and got[2, 0] == "hi" and got[3, 2] == '{"result": 46.069}' and (2, 1) not in got


def test_build_is_sound(spark, small):
    from molquarry.runtime import read

    mols = build.molecules(read(spark, small, "raw_molecules"), position="raw_id")
    dictionary = read(spark, small, "name_dict")
    rows = build.rows_v3(mols, dictionary)
    build.assert_sound(mols, rows, dictionary)
    assert mols.count() > 20 and rows.where("kind = 'single'").count() == 14 * mols.count()
    assert build.rows_v1(mols).where("prop <> 'validity'").count() == 8 * mols.count()


def test_whole_evaluation_of_gold_transcripts_of_all_kinds(spark):
    rows = spark.createDataFrame(
        [
            (1, "single", "q", "CCO", "mw", None, None, None, None), (2, "multi", "q", None, None, [("CCO", "hbd"), ("CCN", "mw"), ("C", "mw")], None, None, None),
            (3, "chain", "q", None, "mw", None, "Aceton ", None, None), (4, "chain", "q", None, "mw", None, "nobody", None, None), (5, "error", "q", "CC(", "mw", None, None, None, None),
            (6, "no_tool", "q", None, None, None, None, "4", None), (7, "clarify", "q", None, None, None, None, None, "Which molecule?"), (8, "single", "q", "CC(", "mw", None, None, None, None),
            (9, "single", "q", "OC/C=C/C", "canonical", None, None, None, None), (10, "multi", "q", None, None, [], None, None, None),
        ],
        "episode int, kind string, question string, smiles string, prop string, pairs array<struct<smiles:string,prop:string>>, name string, answer string, clarify_text string",
    )
    names = spark.createDataFrame([("aceton", "CC(C)=O")], "name string, smiles string")
    turns = evaluate.gold_turns(rows, names)
    said = {}
    for r in turns.orderBy("episode", "turn").collect():
        said.setdefault(r["episode"], []).append(r["text"])
    # The loop: a scripted model that says the gold turns reads and ends them as they were written.
    for i, script in said.items():
        left = iter(script)
        assert evaluate.converse([], lambda _: next(left), lambda n: None) == script, i
    assert len(said[2]) == 4 and [evaluate.Toolbox(str).read(t)[1]["smiles"] for t in said[2][:3]] == ["CCO", "CCN", "C"]
    got = {r["episode"]: (r["correct"], r["tool_valid"]) for r in evaluate.evaluate(rows, turns, names).collect()}
    good = (True, True)
    assert {i: got[i] for i in (1, 2, 3, 5, 6, 7, 9)} == dict.fromkeys((1, 2, 3, 5, 6, 7, 9), good)
    assert not got[4][0] and not got[8][0]


def test_tools_answer_and_raise():
    box = evaluate.Toolbox({"aceton": "CC(C)=O"}.get)
    assert box.run(C.COMPUTE_TOOL, {"smiles": "CCO", "property": "hbd"}) == '{"result": 1}'
    assert box.run(C.COMPUTE_TOOL, {"smiles": "CC(", "property": "mw"}) == '{"error": "invalid molecule"}'
    assert box.run(C.NAME_TOOL, {"name": "aceton"}) == '{"result": "CC(C)=O"}' and box.run(C.NAME_TOOL, {"name": "x"}) == '{"error": "unknown name"}'
    with pytest.raises(ValueError, match="unknown property"):
        box.run(C.COMPUTE_TOOL, {"smiles": "CCO", "property": "MW"})
    with pytest.raises(ValueError, match="unknown tool"):
        box.run("other", {})
    assert [t["function"]["name"] for t in evaluate.tool_schemas(2)] == [C.COMPUTE_TOOL] and len(evaluate.tool_schemas()) == 2


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from molquarry.runtime import cut

    conf = SimpleNamespace(get=lambda k: None)
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="yarn")))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut(df)
