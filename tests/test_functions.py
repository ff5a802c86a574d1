import json
import math
import re

import pytest
from pyspark.sql import functions as F

from molquarry import catalog as C
from molquarry.catalog import ALL_PROPERTIES, COMPUTE_TOOL, FALSE_WORDS, NAME_TOOL, TRUE_WORDS, V1_PROPERTIES
from molquarry.functions import protocol as P
from molquarry.functions import scoring
from molquarry.functions.features import python_float
from molquarry.functions.ranking import lowest, ranked
from molquarry.functions.text import plain_smiles, term
from molquarry.plans.evaluate import Toolbox
from molquarry.runtime import draw


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_terms(spark):
    got = column(spark, ["No_Tool", " no-tool\t", "ｎｏ＿ｔｏｏｌ", "no​tool", "no  tool", "", " ", None, "no\xa0tool", "n﻿o tool"], term)
    assert got == ["no tool", "no tool", "no tool", "notool", "no tool", None, None, None, "no tool", "no tool"]


def test_plain_smiles(spark):
    got = column(spark, [' "CC(=O)O" ', "<CCO>", "Ｃ（＝Ｏ）", "C⁠C O\r\n", "", None, "''"], plain_smiles)
    assert got == ["CC(=O)O", "CCO", "C(=O)", "CCO", None, None, None]


V1 = [
    'TOOL_CALL: {"smiles": "C", "property": "mw"}', 'x TOOL_CALL:\n{"property": " MW ", "smiles": "C(=O)"} y', "TOOL_CALL: {bad}", "nothing",
    'TOOL_CALL: {"smiles": "C"}', 'TOOL_CALL: {"a": {"smiles": "C"}}', 'TOOL_CALL: {"smiles": "C", "property": "qed"}', "", None,
    'TOOL_CALL: [1]', 'TOOL_CALL: {"smiles": "C\\"D", "property": "hbd"} TOOL_CALL: {"smiles": "N", "property": "mw"}',
]


def test_v1_calls(spark):
    def twin(t):
        m = re.search(r"TOOL_CALL:\s*(\{.*?\})", t or "", re.S)
        try:
            d = json.loads(m[1]) if m else None
        except ValueError:
            return None
        if not isinstance(d, dict) or "smiles" not in d or "property" not in d:
            return None
        p = str(d["property"]).strip().lower()
        return (d["smiles"], p) if p in V1_PROPERTIES else None

    got = column(spark, V1, P.parse_v1_call)
    assert [None if g is None else (g["smiles"], g["prop"]) for g in got] == [twin(t) for t in V1]


def native(tool, **args):
    return "<tool_call>" + json.dumps({"name": tool, "arguments": args}) + "</tool_call>"


NATIVE = [
    native(COMPUTE_TOOL, smiles="C", property="QED "), native(NAME_TOOL, name="Acetone"), native("other", smiles="C"), native(COMPUTE_TOOL, smiles="C"),
    native(COMPUTE_TOOL, property="mw"), "<tool_call>{</tool_call>", "no", None, "a <tool_call>\n" + json.dumps({"name": NAME_TOOL, "arguments": {"name": "x", "more": {"y": 1}}}) + "\n</tool_call> b",
    '<tool_call>{"name": "' + COMPUTE_TOOL + '", "arguments": [1]}</tool_call>', '<tool_call>{"name": "' + NAME_TOOL + '", "arguments": "{\\"name\\": \\"x\\"}"}</tool_call>',
    native(NAME_TOOL, name="x").replace("</", " {}</"), native(NAME_TOOL, name="x").replace("</", ", {}</"), native(NAME_TOOL, name="x").replace("</", "] [{}</"),
    native(NAME_TOOL, name="x").replace("</", "} {}</"), native(NAME_TOOL, name=None), native(COMPUTE_TOOL, smiles=True, property="mw"), native(COMPUTE_TOOL, smiles=5, property="mw"),
    native(NAME_TOOL, name="é\n\"q\""), native(COMPUTE_TOOL, smiles="C", property=None), "<tool_call>[{}]</tool_call>", native(COMPUTE_TOOL, smiles="C", property="hue"),
]


def read_call(turn):
    got = Toolbox(lambda n: None).read(turn)
    return got and {"tool": got[0], "smiles": got[1].get("smiles"), "prop": got[1].get("property"), "name": got[1].get("name")}


def test_native_calls(spark):
    got = column(spark, NATIVE, lambda c: P.parse_native_call(c, 3))
    assert [None if g is None else g.asDict() for g in got] == [read_call(t or "") for t in NATIVE]
    two = column(spark, NATIVE, lambda c: P.parse_native_call(c, 2))
    assert two[0] is not None and two[1] is None
    broken = column(spark, NATIVE, P.is_broken_call)
    assert [bool(b) for b in broken] == ["<tool_call>" in (t or "") and read_call(t or "") is None for t in NATIVE]


def test_json_strings(spark):
    texts = ["plain", 'a"b\\c', "tab\t nl\n \r \b \f", "é ü 漢", "\U0001f600", "\x00\x1f\x7f", "", "/"]
    assert column(spark, texts, P.json_string) == [json.dumps(t) for t in texts]


def test_unknown_property_is_an_error(spark):
    rows = spark.createDataFrame([("mw",), (None,)], "p string")
    assert [r[0] and r[0].asDict() for r in rows.select(C.metadata(F.col("p"))).collect()] == [{"vtype": "float", "tol": 0.1}, None]
    assert spark.range(1).select(C.metadata(F.lit("hue"), "null")).first()[0] is None
    with pytest.raises(Exception, match="unknown property: hue"):
        spark.range(1).select(C.metadata(F.lit("hue"))).collect()


def test_finals_and_tokens(spark):
    texts = ["FINAL: 3", "FINAL:\n\n  4 g \nmore", "a FINAL: b c \n", "FINAL:", "none", "x\nFINAL: y=1,z:2", None]
    want = [(m[1].strip() if (m := re.search(r"FINAL:\s*(.+?)\s*$", t or "", re.S | re.M)) else None) for t in texts]
    assert column(spark, texts, P.parse_final) == want
    said = ["a, b;c:d=e  f", "", "x y z", "=1="]
    assert column(spark, said, P.tokens) == [[t for t in re.split(r"[\s,;:=]+", s) if t] for s in said]


NUMBERS = ["1", "1.0", " 2 ", "-3.5e2", "1_000", "1__0", "1d", "1f", "0x1", "nan", "inf", "-Infinity", ".5", "5.", ".", "", "abc", "+7", "1e400", "٣"]


def test_numbers_as_python_reads_them(spark):
    def twin(f, t):
        try:
            return f(t)
        except ValueError:
            return None

    ascii_only = [t for t in NUMBERS if t.isascii()]
    got = column(spark, ascii_only, scoring.as_float)
    for t, g in zip(ascii_only, got):
        w = twin(float, t)
        assert (g is None) == (w is None) and (w is None or g == w or (math.isnan(g) and math.isnan(w))), t
    assert column(spark, ascii_only, scoring.as_int) == [twin(int, t) for t in ascii_only]
    words = [*TRUE_WORDS, *FALSE_WORDS, " TRUE ", "maybe", ""]
    assert column(spark, words, scoring.as_bool)[:10] == [True] * 5 + [False] * 5


@pytest.mark.parametrize(
    ("vtype", "tol", "told", "truth", "want"),
    [
        ("float", 0.1, "180.16", "180.159", True), ("float", 0.1, "181.0", "180.159", False), ("float", 0.1, "nan", "1.0", False),
        ("float", 0.1, "inf", "1.0", False), ("int", None, "1", "1", True), ("int", None, "1.0", "1", False), ("bool", None, "true", "True", True),
        ("bool", None, "false", "False", True), ("bool", None, "dunno", "True", False), ("str_exact", None, "c9h8o4", "C9H8O4", True),
        ("str_exact", None, "C9H9O4", "C9H8O4", False), ("float", 0.1, "1", None, False), ("other", None, "1", "1", False),
    ],
)
def test_scores(spark, vtype, tol, told, truth, want):
    row = spark.range(1).select(scoring.score(F.lit(vtype), F.lit(tol).cast("double"), F.lit(told), F.lit(truth).cast("string")).alias("s")).first()
    assert row["s"] is want


def test_coverage(spark):
    cover = lambda said, truth: spark.range(1).select(scoring.final_covers(F.lit("float"), F.lit(0.1), F.lit(said), F.lit(truth)).alias("s")).first()["s"]
    assert cover("mw=180.16, logp=1.19", "180.2") and cover("1.19", "1.2") and not cover("none", "1.0")


def test_floats_print_as_in_python(spark):
    values = [0.0, 1.0, -1.5, 46.069, 1e-05, 0.0001, 123456789.0, 1e15, 1e16, 1e22, -3e-7, 12345678.5, 0.00123, 100.0, float("nan")]
    assert column(spark, values, python_float, "double") == [str(v) for v in values]


def test_exact_ranks_in_hot_groups(spark):
    rows = [("hot" if i % 3 else None, i) for i in range(3000)] + [("cold", 5000)]
    df = spark.createDataFrame(rows, "g string, id bigint").withColumn("key", draw(1, "id") % 50)
    df = df.withColumn("key", F.col("key") * 80000000)
    want = {}
    for g in ("hot", None, "cold"):
        part = sorted((r["key"], r["id"]) for r in df.collect() if r["g"] == g)
        want |= {i: n + 1 for n, (_, i) in enumerate(part)}
    assert {r["id"]: r["rank"] for r in ranked(df, ["g"], "key", "id").collect()} == want
    for q in (0, 1, 700, 5000):
        kept = {r["id"] for r in lowest(df.withColumn("q", F.lit(q)), ["g"], "key", "id", "q").collect()}
        assert kept == {i for i, n in want.items() if n <= q}


def test_catalog():
    assert len(ALL_PROPERTIES) == 14 and len(V1_PROPERTIES) == 9


def test_clean_spellings_end_where_the_text_ends(spark):
    """The cheap patterns must not take a line break at the end for the end."""
    assert column(spark, ["mw\n", "mw", "ring_count", "ring--count\r\n", "a-b c"], term) == ["mw", "mw", "ring count", "ring count", "a b c"]
    assert column(spark, ["CCO\n", "CCO", "C C", "<CCO>"], plain_smiles) == ["CCO", "CCO", "CC", "CCO"]
