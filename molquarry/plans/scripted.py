"""Closed-form molecules and scripted agents: transcripts whose scores are known without a kernel.

Straight chains of one to nine carbons with a hydroxyl, an amine or nothing at
the end, made from ``part``; agents that answer well, call the wrong molecule,
talk without calling, get the value wrong, or spell the property oddly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.features import features_of, rendered
from ..functions.protocol import compute_call_text, v1_call_text
from ..runtime import cut, draw

SEED = 3
PROPS_V1 = ("mw", "hbd", "ring_count", "validity")
PROPS_NATIVE = ("mw", "formula", "hbd", "ring_count", "validity")


def chain_molecules(part: DataFrame) -> DataFrame:
    """``(key, smiles)``."""
    tail = F.element_at(F.array(F.lit(""), F.lit("O"), F.lit("N")), (F.col("p_size") % 3 + 1).cast("int"))
    smiles = F.concat(F.repeat(F.lit("C"), (F.col("p_partkey") % 9 + 1).cast("int")), tail)
    return part.select(F.col("p_partkey").alias("key"), smiles.alias("smiles"))


def labelled(rows: DataFrame, smiles: str, prop: str, out: str) -> DataFrame:
    """Add the rendered value of each row's property; each distinct SMILES is computed once."""
    return labelled_all(rows, (smiles, prop, out))


def labelled_all(rows: DataFrame, *labels: tuple[str, str, str]) -> DataFrame:
    """Add several rendered values ``(smiles, prop, out)``; the kernel runs once over all spellings and its table is written once."""
    columns = list(dict.fromkeys(s for s, _, _ in labels))
    spellings = rows.select(F.explode(F.array(*columns)).alias("spelling"))
    table = features_of(spellings).select("spelling", F.struct("*").alias("features")).select("spelling", rendered().alias("values"))
    if len(labels) > 1:
        table = cut(table)
    for c in columns:
        rows = rows.join(table.select(F.col("spelling").alias(c), F.col("values").alias(f"_{c}")), c, "left")
    return rows.withColumns({out: F.col(f"_{s}")[F.col(p)] for s, p, out in labels}).drop(*[f"_{c}" for c in columns])


def _expected(*pairs: tuple[str, str, str]) -> F.Column:
    """``array<struct<smiles, prop, vtype, tol, truth>>`` from columns (smiles, prop, truth)."""
    meta = {p: C.metadata(F.col(p)) for _, p, _ in pairs}
    return F.array(*[
        F.struct(F.col(s).alias("smiles"), F.col(p).alias("prop"), meta[p]["vtype"].alias("vtype"), meta[p]["tol"].alias("tol"), F.col(t).alias("truth"))
        for s, p, t in pairs
    ])


def one_call_episodes(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes and turns of the first format, one call each."""
    base = chain_molecules(part).withColumn("prop", F.explode(F.array(*[F.lit(p) for p in PROPS_V1])))
    base = base.withColumn("episode", F.concat_ws("-", "key", "prop")).withColumn("act", draw(SEED, F.lit("agent"), "key", "prop") % 8)
    base = base.withColumn("called", F.when(F.col("act") == 4, F.concat("smiles", F.lit("C"))).otherwise(F.col("smiles")))
    # Written once: episodes and turns both hang off it.
    base = cut(labelled_all(base, ("smiles", "prop", "truth"), ("called", "prop", "told")))
    spelled = F.when(F.col("act") == 7, F.concat(F.lit("  "), F.upper("prop"), F.lit(" "))).otherwise(F.col("prop"))
    first = F.when(F.col("act") == 5, F.lit("I am sure I know this one.")).otherwise(F.concat(F.lit("Let me see.\n"), v1_call_text(F.col("called"), spelled), F.lit(" done")))
    said = F.when(F.col("act") == 6, F.lit("12345")).otherwise(F.col("told"))
    second = F.concat(F.lit("FINAL:  "), said, F.lit(" \nbye"))
    turns = base.select("episode", F.posexplode(F.array(first, second)).alias("turn", "text"))
    episodes = base.select("episode", "key", "prop", F.lit("single").alias("kind"), _expected(("smiles", "prop", "truth")).alias("expected"))
    return episodes, turns


def kind_episodes(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes and turns of the native format over all six kinds."""
    base = chain_molecules(part)
    kinds = F.array(*[F.lit(k) for k in ("single", "multi", "no_tool", "clarify", "error", "chain")])
    base = base.withColumn("kind", F.element_at(kinds, (F.col("key") % 6 + 1).cast("int"))).withColumn("act", draw(SEED, F.lit("kinds"), "key") % 6)
    base = base.withColumns({"episode": F.col("key"), "prop": F.lit("mw"), "prop2": F.lit("hbd"), "name": F.concat(F.lit("Chain "), "smiles")})
    base = base.withColumn("asked", F.when(F.col("kind") == "error", F.concat("smiles", F.lit("(("))).otherwise(F.col("smiles")))
    # Written once: episodes and turns both hang off it.
    base = cut(labelled_all(base, ("smiles", "prop", "truth"), ("smiles", "prop2", "truth2")))
    call = compute_call_text(F.col("asked"), F.col("prop"))
    call2 = compute_call_text(F.col("smiles"), F.col("prop2"))
    look = F.concat(F.lit(f'<tool_call>{{"name": "{C.NAME_TOOL}", "arguments": {{"name": "'), F.upper("name"), F.lit('  "}}</tool_call>'))
    value = F.when(F.col("act") == 1, F.lit("0.001")).otherwise(F.col("truth"))
    none = F.array().cast("array<string>")
    acts = (
        F.when(F.col("kind") == "single", F.array(call, F.concat(F.lit("It is "), value, F.lit(" g/mol"))))
        .when(F.col("kind") == "multi", F.array(call, call2, F.concat(F.lit("mw="), value, F.lit(", hbd="), F.col("truth2"))))
        .when(F.col("kind") == "no_tool", F.array(F.lit("Forty-two.")))
        .when(F.col("kind") == "clarify", F.array(F.when(F.col("act") == 1, F.lit("Fine.")).otherwise(F.lit("Which molecule do you mean?"))))
        .when(F.col("kind") == "error", F.array(call, F.when(F.col("act") == 1, F.lit("It is 12.")).otherwise(F.lit("Sorry, I cannot do that."))))
        .otherwise(F.array(look, call, F.concat(F.lit("value: "), value)))
    )
    texts = (
        F.when(F.col("act") == 2, F.array(F.lit("I would say 3.")))
        .when(F.col("act") == 3, F.concat(F.array_repeat(call, 6), acts))
        .when(F.col("act") == 4, F.concat(F.array(call), F.slice(acts, 2, 9), none))
        .otherwise(acts)
    )
    turns = base.select("episode", F.posexplode(texts).alias("turn", "text"))
    single = _expected(("smiles", "prop", "truth"))
    expected = (
        F.when(F.col("kind").isin("single", "chain"), single)
        .when(F.col("kind") == "multi", _expected(("smiles", "prop", "truth"), ("smiles", "prop2", "truth2")))
        .otherwise(F.slice(single, 1, 0))
    )
    return base.select("episode", "kind", "name", expected.alias("expected")), turns


def bench_episodes(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes of the hard benchmark's three kinds in the first format, with the gold answer of those that need no tool."""
    kinds = F.array(*[F.lit(k) for k in ("paraphrase", "multi", "no_tool")])
    base = chain_molecules(part).join(part.select(F.col("p_partkey").alias("key"), F.lower("p_brand").alias("answer")), "key")
    base = base.withColumn("kind", F.element_at(kinds, (F.col("key") % 3 + 1).cast("int"))).withColumn("act", draw(SEED, F.lit("bench"), "key") % 4)
    base = base.withColumns({"episode": F.col("key"), "prop": F.lit("hbd"), "prop2": F.lit("ring_count")})
    base = cut(labelled_all(base, ("smiles", "prop", "truth"), ("smiles", "prop2", "truth2")))
    call, call2 = v1_call_text(F.col("smiles"), F.col("prop")), v1_call_text(F.col("smiles"), F.col("prop2"))
    told = F.when(F.col("act") == 1, F.lit("77")).otherwise(F.col("truth"))
    spoken = F.when(F.col("act") == 1, F.lit("I do not know")).otherwise(F.concat(F.lit("It is "), F.upper("answer"), F.lit(" of course")))
    texts = (
        F.when(F.col("act") == 2, F.array(F.lit("no marker here")))
        .when(F.col("kind") == "no_tool", F.when(F.col("act") == 3, F.array(call, F.concat(F.lit("FINAL: "), spoken))).otherwise(F.array(F.concat(F.lit("FINAL: "), spoken))))
        .when(F.col("kind") == "multi", F.array(call, call2, F.concat(F.lit("FINAL: hbd="), told, F.lit(", ring_count="), F.col("truth2"))))
        .otherwise(F.array(call, F.concat(F.lit("FINAL: "), told)))
    )
    turns = base.select("episode", F.posexplode(texts).alias("turn", "text"))
    single = _expected(("smiles", "prop", "truth"))
    expected = (
        F.when(F.col("kind") == "multi", _expected(("smiles", "prop", "truth"), ("smiles", "prop2", "truth2")))
        .when(F.col("kind") == "paraphrase", single).otherwise(F.slice(single, 1, 0))
    )
    return base.select("episode", "kind", "answer", expected.alias("expected")), turns
