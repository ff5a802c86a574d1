"""Episodes from a model: a pluggable text generator, tool answers, transcripts, reports."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..chem.props import properties
from ..functions.features import features_of, rendered
from ..functions.molecules import molecules_of
from ..functions.protocol import NATIVE_CALL, json_string, parse_native_call, strip, tokens
from ..operators import episodes as E
from ..operators import names as J
from ..operators import traces as T
from ..operators.metrics import head
from ..runtime import cut, python_map, ship, width
from ..sources.readers import read_rows

class Toolbox:
    """The tools a model may call: those declared in the catalogue, each with a function over its arguments.

    Reading a call, answering it and writing both into a conversation all go by
    the declaration, as the column parser does.
    """

    def __init__(self, resolve: Callable[[str], str | None], version: int = 3):
        self.wants = C.tools(version)
        self.functions = {C.COMPUTE_TOOL: lambda smiles, property: properties(smiles).get(property), C.NAME_TOOL: lambda name: resolve(name)}

    def read(self, turn: str) -> tuple[str, dict[str, str]] | None:
        """Tool and arguments of the first call in a turn; None where there is none that can be run."""
        found = re.search(NATIVE_CALL, turn)
        doc = _json_object(found[1]) if found else None
        tool = doc.get("name") if doc else None
        wants = self.wants.get(tool) if isinstance(tool, str) else None
        if wants is None or not isinstance(doc.get("arguments"), dict):
            return None
        values = {}
        for key, allowed in wants.items():
            if key not in doc["arguments"]:
                return None
            text = str(doc["arguments"][key])
            values[key] = text if allowed is None else next((a for a in allowed if a == text.strip().lower()), None)
        return None if None in values.values() else (tool, values)

    def run(self, tool: str, arguments: dict[str, str]) -> str:
        """What a tool says: a JSON object with its result or its error.  An unknown tool or property is a ValueError."""
        if tool not in self.wants:
            raise ValueError(f"unknown tool: {tool}")
        for key, allowed in self.wants[tool].items():
            if allowed is not None and arguments[key] not in allowed:
                raise ValueError(f"unknown {key}: {arguments[key]}")
        value = self.functions[tool](**arguments)
        return json.dumps({"error": C.TOOL_ERRORS[tool]} if value is None else {"result": value})


def _json_object(text: str) -> dict | None:
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def register_tools(spark: SparkSession, names: dict[str, str] | None = None, version: int = 3) -> list[str]:
    """Register the tools as SQL functions over their arguments, returning JSON texts; gives their names.

    A property that is not in the catalogue raises, as calls come with the
    catalogue's own spelling here.  ``names`` is the dictionary of the name
    tool; it travels with the function, so pass a bounded one.
    """
    ship(spark)
    table = {k.strip().lower(): v for k, v in (names or {}).items()}
    box = Toolbox(lambda n: table.get(n.strip().lower()), version)
    for tool, wants in box.wants.items():
        keys = list(wants)

        def rows(columns: Sequence[pd.Series], tool: str = tool, keys: list[str] = keys) -> pd.Series:
            return pd.Series([None if None in args else box.run(tool, dict(zip(keys, args))) for args in zip(*columns)], dtype=object)

        if len(keys) == 1:
            spark.udf.register(tool, F.pandas_udf(lambda a, rows=rows: rows([a]), "string"))
        else:
            spark.udf.register(tool, F.pandas_udf(lambda a, b, rows=rows: rows([a, b]), "string"))
    return list(box.wants)


def tool_schemas(version: int = 3) -> list[dict]:
    """The tools' declarations as JSON schemas for a chat template."""

    def kind(allowed: tuple[str, ...] | None) -> dict:
        return {"type": "string"} | ({"enum": list(allowed)} if allowed else {})

    return [
        {"type": "function", "function": {"name": tool, "description": C.TOOL_TEXTS[tool], "parameters": {
            "type": "object", "properties": {k: kind(a) for k, a in wants.items()}, "required": list(wants)}}}
        for tool, wants in C.tools(version).items()
    ]


def converse(messages: list[dict], generate: Callable[[list[dict]], str], resolve: Callable[[str], str | None], most: int = C.MAX_TURNS) -> list[str]:
    """One question played to its end: the model's turns; ``messages`` is extended with them and the tools' answers."""
    box = Toolbox(resolve)
    said: list[str] = []
    while len(said) < most:
        said.append(generate(messages))
        call = box.read(said[-1])
        if call is None:
            messages.append({"role": "assistant", "content": said[-1]})
            return said
        tool, arguments = call
        messages += [
            {"role": "assistant", "tool_calls": [{"function": {"name": tool, "arguments": arguments}}]},
            {"role": "tool", "content": box.run(tool, arguments)},
        ]
    return said


def transcripts(
    questions: DataFrame, generate: Callable[[list[dict]], str], names: dict[str, str] | None = None, system: str = C.SYSTEM_PROMPT
) -> DataFrame:
    """``(episode, turn, text)`` of a model on ``questions (episode, question)``.

    ``generate(messages) -> text`` is called in the workers, rows of a
    partition one after the other.  ``names`` is the dictionary for the name
    tool and travels with the task; pass a bounded one.
    """
    table = {k.strip().lower(): v for k, v in (names or {}).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for episode, question in zip(pdf["episode"], pdf["question"]):
                start = [{"role": "system", "content": system}, {"role": "user", "content": question}]
                turns = converse(start, generate, lambda n: table.get(n.strip().lower()))
                out += [(episode, i, t) for i, t in enumerate(turns)]
            yield pd.DataFrame(out, columns=["episode", "turn", "text"])

    kind = questions.schema["episode"].dataType.simpleString()
    rows = questions.select("episode", "question").repartition(width(questions.sparkSession), F.xxhash64("episode"))
    return python_map(rows, run, f"episode {kind}, turn int, text string")


def values_of(pairs: DataFrame) -> DataFrame:
    """``(smiles, prop, value)`` of distinct pairs, values as Python prints them; pairs without a value are left out."""
    table = features_of(pairs.select(F.col("smiles").alias("spelling"))).select("spelling", F.struct("*").alias("features"))
    flat = table.select(F.col("spelling").alias("smiles"), F.explode(rendered()).alias("prop", "value"))
    return flat.join(pairs.select("smiles", "prop").distinct(), ["smiles", "prop"], "left_semi")


def scoring_args(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Episodes ``(episode, kind, name, expected)`` of question rows, truths from the kernel.

    ``rows`` has ``episode, kind, smiles, prop, pairs, name``.  Each distinct
    molecule is computed once; a pair without a value has a null truth, which
    nothing matches.  A property that is not in the catalogue is an error.
    """
    pairs = J.resolve(rows, dictionary).select("episode", F.posexplode(E.expected_pairs()).alias("i", "e"))
    pairs = pairs.select("episode", "i", "e.smiles", "e.prop")
    meta = C.metadata(F.col("prop"))
    truth = pairs.join(values_of(pairs), ["smiles", "prop"], "left").select(
        "episode", F.struct("i", "smiles", "prop", meta["vtype"].alias("vtype"), meta["tol"].alias("tol"), F.col("value").alias("truth")).alias("e")
    )
    packed = truth.groupBy("episode").agg(F.sort_array(F.collect_list("e")).alias("es"))
    bare = F.transform("es", lambda e: F.struct(*[e[k].alias(k) for k in ("smiles", "prop", "vtype", "tol", "truth")]))
    empty = F.array().cast("array<struct<smiles:string,prop:string,vtype:string,tol:double,truth:string>>")
    return rows.select("episode", "kind", "name").join(packed.select("episode", bare.alias("expected")), "episode", "left").withColumn(
        "expected", F.coalesce("expected", empty)
    )


def canonical_words(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``(episode, words)``: canonical SMILES of the answers and their words, of episodes that expect a structure."""
    asked = episodes.where(F.exists("expected", lambda e: e["vtype"] == "str")).select("episode")
    said = turns.where(F.col("turn") < C.MAX_TURNS).join(asked, "episode", "left_semi").where(parse_native_call(F.col("text")).isNull())
    text = strip(F.col("text"))
    words = said.select("episode", F.explode(F.array_distinct(F.concat(F.array(text), tokens(text)))).alias("spelling")).distinct()
    known = words.join(molecules_of(words), "spelling")
    return known.groupBy("episode").agg(F.map_from_entries(F.collect_list(F.struct("spelling", "molecule"))).alias("words"))


def evaluate(rows: DataFrame, turns: DataFrame, dictionary: DataFrame, version: int = 3) -> DataFrame:
    """Results ``(episode, kind, name, n_calls, final, correct, tool_valid)`` of transcripts of question rows."""
    # Written once: scoring and the canonical words both read it, and behind it lies the kernel.
    episodes = cut(scoring_args(rows, dictionary))
    scored = E.score_by_kind(episodes, turns, version, canonical_words(episodes, turns))
    return scored.drop("expected")


def traces(rows: DataFrame, dictionary: DataFrame, version: int = 3) -> DataFrame:
    """``(episode, kind, messages)``: the gold traces of question rows ``(episode, kind, question, smiles, prop, pairs, name, answer, clarify_text)``."""
    rows = J.resolve(rows, dictionary)
    asked = F.when(F.col("kind") == "error", F.array(F.struct("smiles", "prop"))).otherwise(E.expected_pairs())
    pairs = rows.select("episode", F.posexplode(asked).alias("i", "e")).select("episode", "i", "e.smiles", "e.prop")
    valued = pairs.join(values_of(pairs.where("smiles is not null and prop is not null")), ["smiles", "prop"], "left")
    steps = valued.groupBy("episode").agg(F.sort_array(F.collect_list(F.struct("i", "smiles", "prop", "value"))).alias("steps"))
    bare = F.transform("steps", lambda e: F.struct(e["smiles"].alias("smiles"), e["prop"].alias("prop"), e["value"].alias("value")))
    base = rows.join(steps.select("episode", bare.alias("steps")), "episode", "left")
    c = F.col
    messages = T.native_trace(c("kind"), c("question"), c("steps"), c("name"), c("resolved"), c("answer"), c("clarify_text"), version)
    return base.select("episode", "kind", messages.alias("messages"))


def load_traces(spark: SparkSession, path: str, dictionary: DataFrame, version: int = 3, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """JSON-lines question rows as a trainer's table ``(messages, tools)`` in file order, and the number of rows by kind.

    ``tools`` is the JSON text of the tool declarations.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    # Written once: the trace and the counts must see the same numbers of lines.
    rows = cut(head(read_rows(spark, path).withColumn("episode", place), "episode", limit))
    table = traces(rows, dictionary, version).orderBy("episode")
    tools = F.lit(json.dumps(tool_schemas(version)))
    return table.select("messages", tools.alias("tools")), rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def gold_turns(rows: DataFrame, dictionary: DataFrame, version: int = 3) -> DataFrame:
    """The turns of the gold traces of question rows, ``(episode, turn, text)``, as a model would write them."""
    own = F.filter("messages", lambda m: m["role"] == "assistant")
    call = lambda m: m["tool_calls"][0]
    written = lambda m: F.array_join(F.transform(F.map_entries(call(m)["arguments"]), lambda a: F.concat(json_string(a["key"]), F.lit(": "), F.coalesce(json_string(a["value"]), F.lit("null")))), ", ")
    text = F.transform(own, lambda m: F.when(m["content"].isNotNull(), m["content"]).otherwise(
        F.concat(F.lit('<tool_call>{"name": "'), call(m)["name"], F.lit('", "arguments": {'), written(m), F.lit("}}</tool_call>"))))
    return traces(rows, dictionary, version).select("episode", F.posexplode(text).alias("turn", "text"))
