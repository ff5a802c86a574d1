import json

import pytest
from pyspark.sql import functions as F

from molquarry.operators import fanout as R
from molquarry.operators import metrics as A
from molquarry.plans.build import build
from molquarry.sources import readers
from molquarry.sources.config import BuildConfig
from molquarry.streaming import chat


def test_scans_and_registry(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,smiles\n1,CCO\n2,CCN\n")
    assert [r["smiles"] for r in readers.scan(spark, "csv", str(tmp_path / "m.csv")).collect()] == ["CCO", "CCN"]
    spark.createDataFrame([("C", 1)], "smi string, x int").write.parquet(str(tmp_path / "p"))
    assert readers.scan(spark, "parquet", str(tmp_path / "p"), "smi").columns == ["smiles"]
    with pytest.raises(ValueError, match="unknown source"):
        readers.scan(spark, "ftp", "x")
    readers.register_source("one", lambda s, p, c: s.createDataFrame([("C",)], "smiles string"))
    assert readers.scan(spark, "one", "").count() == 1


def test_fetch_once(tmp_path):
    path, calls = str(tmp_path / "f"), []

    def fetch(p):
        calls.append(p)
        open(p, "w").close()

    readers.fetched(path, fetch)
    readers.fetched(path, fetch)
    assert calls == [path]


def test_rows_round_trip(spark, tmp_path):
    mols = spark.createDataFrame([(1, "CCO", "train"), (2, "CCN", "val")], "key int, smiles string, split string")
    rows = R.multi_rows(mols, 1, rate=1.0).unionByName(R.single_rows(mols, ("mw",), 1))
    readers.write_rows(rows, str(tmp_path / "d"))
    back = readers.read_rows(spark, str(tmp_path / "d"), "train")
    multi = back.where("kind = 'multi'").first()
    assert back.count() == 2 and [p["smiles"] for p in multi["pairs"]] == ["CCO", "CCO"] and multi["smiles"] is None
    line = json.loads(next((tmp_path / "d" / "split=val").glob("part*.json")).read_text().splitlines()[0])
    assert "kind" in line and "question" in line


def test_v1_rows_with_mixed_answers(spark, tmp_path):
    (tmp_path / "v1.jsonl").write_text('{"smiles":"C","property":"mw","question":"q","answer":16.043}\n{"smiles":"C","property":"lipinski","question":"q","answer":true}\n')
    assert [r["answer"] for r in readers.read_v1_rows(spark, str(tmp_path / "v1.jsonl")).collect()] == ["16.043", "true"]


def test_dictionaries(spark, tmp_path):
    calls = []

    def fetch(name):
        if name == "boom":
            raise OSError
        return {"acetone": "C(C)(C)=O", "ethanol": "OCC"}.get(name)

    names = spark.createDataFrame([("Acetone",), (" acetone ",), ("Ethanol",), ("boom",), ("none",), (None,)], "name string")
    looked = {r["name"]: r["smiles"] for r in readers.lookup_names(names, fetch).collect()}
    assert looked == {"Acetone": "C(C)(C)=O", " acetone ": "C(C)(C)=O", "Ethanol": "OCC", "boom": None, "none": None, None: None}
    made = readers.build_dictionary(names, fetch, pause=0)
    readers.write_dictionary(made, str(tmp_path / "d.json"))
    assert {r["name"]: r["smiles"] for r in readers.read_dictionary(spark, str(tmp_path / "d.json")).collect()} == {"acetone": "CC(C)=O", "ethanol": "CCO"}
    assert not calls


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("mw", True, True), ("mw", False, False)], "k string, correct boolean, tool_valid boolean")
    readers.write_report(A.metrics(rows, "k"), A.failures(rows, "k", "correct"), str(tmp_path), "t")
    assert json.loads((tmp_path / "eval_t.json").read_text())["_all"] == {"n": 2, "correct": 1, "tool_valid": 1}
    assert (tmp_path / "eval_t.md").read_text().startswith("# Eval: t")


def test_config_and_build(spark, tmp_path):
    assert BuildConfig("full").limit == 10000 and BuildConfig("x").limit == 200 and BuildConfig(n_molecules=5).limit == 5
    (tmp_path / "m.csv").write_text("smiles\nCCO\nOCC\nCC\nnope\nc1ccccc1\n")
    rows = build(spark, BuildConfig(source="csv", path=str(tmp_path / "m.csv"), version=1))
    assert {r["smiles"] for r in rows.where("prop = 'mw'").collect()} == {"CCO", "c1ccccc1"}


def test_streams(spark, tmp_path):
    call = '<tool_call>{"name": "name_to_smiles", "arguments": {"name": "x"}}</tool_call>'
    spark.createDataFrame([(1, 0, call, "2024-01-01 00:00:01"), (1, 1, " done ", "2024-01-01 00:00:02")], "episode int, turn int, text string, at string").withColumn(
        "at", F.to_timestamp("at")
    ).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("episode int, turn int, text string, at timestamp").parquet(str(tmp_path / "t"))
    for name, df, mode in (("finals", chat.stream_finals(stream), "append"), ("calls", chat.stream_calls(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert [tuple(r) for r in spark.sql("select * from finals").collect()] == [(1, 1, "done")]
    assert {r["tool"]: r["n"] for r in spark.sql("select * from calls").collect()} == {"name_to_smiles": 1, "answer": 1}


def test_chat_keeps_history(spark, tmp_path):
    spark.createDataFrame([("s", 1, "hi"), ("s", 2, "again"), ("s", 3, "/reset"), ("s", 4, "new")], "session string, at int, question string").write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("session string, at int, question string").parquet(str(tmp_path / "c"))
    out = chat.chat(stream, lambda m: f" {len(m)} ", lambda n: None)
    q = out.writeStream.format("memory").queryName("chat").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r["question"]: r["answer"] for r in spark.sql("select * from chat").collect()} == {"hi": "2", "again": "4", "new": "2"}
