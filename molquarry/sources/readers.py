"""Sources and sinks: molecule scans, question rows as JSON lines, name dictionaries, reports."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import markdown
from ..operators.names import name_key
from ..runtime import python_map

#: Question rows on disk: one explicit wide schema for every kind.
ROW_SCHEMA = (
    "kind string, question string, smiles string, prop string, pairs array<array<string>>, name string, answer string, clarify_text string"
)
#: Rows of the first version name the property ``property`` and carry a typed answer, read as text.
V1_ROW_SCHEMA = "smiles string, property string, question string, answer string"


def scan_csv(spark: SparkSession, path: str, column: str = "smiles") -> DataFrame:
    """Molecules of a CSV file with a header; other columns are not read.

    The schema is the header's names as strings, so no pass infers types.
    """
    return spark.read.option("header", True).option("inferSchema", False).csv(path).select(F.col(column).alias("smiles"))


def scan_parquet(spark: SparkSession, path: str, column: str = "smiles") -> DataFrame:
    """Molecules of a Parquet table; one column is read."""
    return spark.read.parquet(path).select(F.col(column).alias("smiles"))


def scan_json(spark: SparkSession, path: str, column: str = "smiles") -> DataFrame:
    """Molecules of JSON lines."""
    return spark.read.schema(f"`{column}` string").json(path).select(F.col(column).alias("smiles"))


SOURCES: dict[str, Callable[..., DataFrame]] = {"csv": scan_csv, "parquet": scan_parquet, "json": scan_json}


def register_source(name: str, reader: Callable[..., DataFrame]) -> None:
    """Add a source by name; ``reader(spark, path, column)`` gives a column ``smiles``."""
    SOURCES[name] = reader


def scan(spark: SparkSession, source: str, path: str, column: str = "smiles") -> DataFrame:
    """Molecules of a registered source; an unknown one is a ``ValueError``."""
    if source not in SOURCES:
        raise ValueError(f"unknown source: {source}")
    return SOURCES[source](spark, path, column)


def fetched(path: str, fetch: Callable[[str], None]) -> str:
    """A staged file: ``fetch(path)`` writes it where it is missing."""
    if not os.path.exists(path):
        fetch(path)
    return path


def write_rows(rows: DataFrame, path: str) -> None:
    """JSON lines in one folder per split, replacing what was there."""
    pairs = F.when(
        F.col("prop2").isNotNull(), F.array(F.array("smiles", "prop"), F.array("smiles", "prop2"))
    ) if "prop2" in rows.columns else F.col("pairs")
    multi = F.col("kind") == "multi"
    out = rows.withColumn("pairs", pairs)
    out = out.withColumn("smiles", F.when(~multi, F.col("smiles"))).withColumn("prop", F.when(~multi, F.col("prop")))
    columns = ["split", "kind", "question", "smiles", "prop", "pairs", "name", "answer", "clarify_text"]
    out.select(*columns).write.partitionBy("split").mode("overwrite").json(path)


def read_rows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Question rows of all splits or one; ``pairs`` as structs ``(smiles, prop)``."""
    where = f"{path}/split={split}" if split else path
    rows = spark.read.schema(ROW_SCHEMA).json(where)
    rows = rows.withColumn("pairs", F.transform("pairs", lambda p: F.struct(p[0].alias("smiles"), p[1].alias("prop"))))
    return rows.withColumn("split", F.lit(split)) if split else rows


def read_v1_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first version, ``property`` renamed to ``prop``."""
    return spark.read.schema(V1_ROW_SCHEMA).json(path).withColumnRenamed("property", "prop")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of names and SMILES as ``(name, smiles)``.

    The object is one document, so one task reads it; names are exploded there.
    """
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>")
    return text.select(F.explode(entries).alias("name", "smiles"))


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """A dictionary as one JSON object with sorted names; for dictionaries that fit one file."""
    rows = dictionary.orderBy("name").toPandas()
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dict(zip(rows["name"], rows["smiles"])), f, indent=1, ensure_ascii=True)


def lookup_names(names: DataFrame, fetch: Callable[[str], str | None], pause: float = 0.0, partitions: int = 4) -> DataFrame:
    """``(name, smiles)`` by a remote look-up: each distinct key once, misses null, errors are misses.

    ``partitions`` bounds the calls at a time and ``pause`` is kept after each.
    """
    keys = names.select(name_key(F.col("name")).alias("key")).where("key is not null").distinct().repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, str | None] = {}
        for pdf in batches:
            for k in pdf["key"]:
                if k not in memo:
                    try:
                        memo[k] = fetch(k)
                    except Exception:  # noqa: BLE001 a failed call counts as a miss
                        memo[k] = None
                    if pause:
                        time.sleep(pause)
            yield pd.DataFrame({"key": pdf["key"], "smiles": [memo[k] for k in pdf["key"]]}, dtype="object")

    found = python_map(keys, run, "key string, smiles string")
    return names.join(found, name_key(F.col("name")) == F.col("key"), "left").select("name", "smiles")


def build_dictionary(names: DataFrame, fetch: Callable[[str], str | None], pause: float = 0.2) -> DataFrame:
    """``(name, smiles)`` with canonical SMILES, lower-case names once each, misses left out."""
    from ..functions.molecules import molecules_of
    from ..functions.text import plain_smiles

    found = lookup_names(names, fetch, pause).where("smiles is not null")
    found = found.select(name_key(F.col("name")).alias("name"), plain_smiles("smiles").alias("spelling"))
    return found.join(molecules_of(found), "spelling").groupBy("name").agg(F.min("molecule").alias("smiles"))


def write_report(table: DataFrame, wrong: DataFrame, folder: str, tag: str) -> str:
    """``eval_<tag>.md`` and ``.json`` from the metric table, failures as JSON lines; returns the Markdown."""
    os.makedirs(folder, exist_ok=True)
    text = markdown(table, tag)
    with open(f"{folder}/eval_{tag}.md", "w", encoding="utf-8") as f:
        f.write(text)
    with open(f"{folder}/eval_{tag}.json", "w", encoding="utf-8") as f:
        json.dump({r["key"]: {k: r[k] for k in ("n", "correct", "tool_valid")} for r in table.collect()}, f, indent=2)
    wrong.write.mode("overwrite").json(f"{folder}/eval_{tag}_fails")
    return text
