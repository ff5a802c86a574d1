"""Training traces, tool messages, prompts and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.protocol import json_string, tool_result, v1_call_text
from ..functions.scoring import final_covers

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:map<string,string>>>>"


def message(role: str, content: Column | str) -> Column:
    """A message without calls."""
    c = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), c.alias("content"), F.lit(None).alias("tool_calls")).cast(MESSAGE)


def call_message(tool: str, **arguments: Column) -> Column:
    """An assistant message with one call."""
    pairs = F.create_map(*[x for k, v in arguments.items() for x in (F.lit(k), v)])
    call = F.struct(F.lit(tool).alias("name"), pairs.alias("arguments"))
    return F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), F.array(call).alias("tool_calls")).cast(MESSAGE)


def prompt(question: Column, system: str = C.SYSTEM_PROMPT) -> Column:
    """System and user message."""
    return F.array(message("system", system), message("user", question))


def _json_value(prop: Column, value: Column) -> Column:
    """A rendered value as JSON: numbers and truth values bare, texts quoted."""
    return (
        F.when(prop.isin("canonical", "formula"), json_string(value))
        .when(prop.isin("lipinski", "validity", "veber", "pains_alert"), F.lower(value)).otherwise(value)
    )


def compute_result(prop: Column, value: Column) -> Column:
    """Tool message of a property call; an error where there is no value."""
    return message("tool", tool_result(value, _json_value(prop, value), C.TOOL_ERRORS[C.COMPUTE_TOOL]))


def name_result(smiles: Column) -> Column:
    """Tool message of a name look-up; an error where the name is unknown."""
    return message("tool", tool_result(smiles, json_string(smiles), C.TOOL_ERRORS[C.NAME_TOOL]))


def v1_trace(question: Column, smiles: Column, prop: Column, value: Column) -> Column:
    """Five messages: system, question, call, result, final; a missing value is printed ``None``."""
    shown = F.coalesce(value, F.lit("None"))
    return F.array(
        message("system", C.SYSTEM_PROMPT), message("user", question), message("assistant", v1_call_text(smiles, prop)),
        message("user", F.concat(F.lit("TOOL_RESULT: "), shown)), message("assistant", F.concat(F.lit("FINAL: "), shown)),
    )


def native_trace(
    kind: Column, question: Column, steps: Column, name: Column, resolved: Column, answer: Column, clarify: Column, version: int = 3,
) -> Column:
    """Messages of a row by kind: single and error 5, multi 3 and two a pair, chain 7 (version 3), no_tool and clarify 3.

    ``steps`` is ``array<struct<smiles, prop, value>>``: what is computed, one
    pair or, for multi, all of them, each with its own SMILES.  An unknown kind
    is an error.
    """
    start = prompt(question)
    called = F.flatten(F.transform(steps, lambda e: F.array(
        call_message(C.COMPUTE_TOOL, smiles=e["smiles"], property=e["prop"]), compute_result(e["prop"], e["value"]))))
    shown = F.transform(steps, lambda e: F.coalesce(e["value"], F.lit("None")))
    line = F.array_join(F.transform(steps, lambda e: F.concat(e["prop"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), ", ")

    def say(c: Column | str) -> Column:
        return F.array(message("assistant", c))

    out = (
        F.when(kind == "single", F.concat(start, called, say(F.get(shown, F.lit(0)))))
        .when(kind == "multi", F.concat(start, called, say(line)))
        .when(kind == "no_tool", F.concat(start, say(answer)))
        .when(kind == "clarify", F.concat(start, say(clarify)))
        .when(kind == "error", F.concat(start, called, say(C.ERROR_TEXT)))
    )
    if version >= 3:
        look = F.array(call_message(C.NAME_TOOL, name=name), name_result(resolved))
        out = out.when(kind == "chain", F.concat(start, look, called, say(F.get(shown, F.lit(0)))))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(kind, F.lit("null")))).cast(f"array<{MESSAGE}>"))


def steps_of(*pairs: tuple[Column, Column, Column]) -> Column:
    """``array<struct<smiles, prop, value>>`` from columns."""
    return F.array(*[F.struct(s.alias("smiles"), p.alias("prop"), v.alias("value")) for s, p, v in pairs])


def grpo_prompts(rows: DataFrame, kinds: tuple[str, ...] = ("chain", "single"), system: str = C.SYSTEM_PROMPT) -> DataFrame:
    """``(prompt, kind, smiles, prop, name)`` of single and resolvable chain rows.

    ``rows`` has ``resolved``, the SMILES of ``name``; chain rows without are
    dropped, the name of single rows is empty.
    """
    chain = F.col("kind") == "chain"
    some = rows.where(F.col("kind").isin(*kinds) & F.col("kind").isin("chain", "single")).where(~chain | F.col("resolved").isNotNull())
    return some.select(
        prompt(F.col("question"), system).alias("prompt"), "kind", F.when(chain, F.col("resolved")).otherwise(F.col("smiles")).alias("smiles"),
        "prop", F.when(chain, F.col("name")).otherwise("").alias("name"),
    )


def call_names(messages: Column) -> Column:
    """Names of all calls in an episode, in order."""
    return F.flatten(F.transform(messages, lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["name"]), F.array().cast("array<string>"))))


def last_answer(messages: Column) -> Column:
    """Content of the last assistant message that has any, or null."""
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & (F.coalesce(m["content"], F.lit("")) != ""))
    return F.get(said, F.size(said) - 1)["content"]


def reward(messages: Column, kind: Column, vtype: Column, tol: Column, truth: Column) -> Column:
    """0 without answer; else 1 if it covers the truth, less penalties for missing and surplus calls."""
    final, calls = last_answer(messages), call_names(messages)
    return reward_of(final, calls, kind, vtype, tol, truth)


def reward_of(final: Column, calls: Column, kind: Column, vtype: Column, tol: Column, truth: Column) -> Column:
    """The reward from an answer and the names of the calls."""
    chain = kind == "chain"
    miss = F.lit(C.MISSING_CALL_PENALTY)
    penalty = (
        F.when(chain & ~F.array_contains(calls, C.NAME_TOOL), miss).otherwise(0.0)
        + F.when(~F.array_contains(calls, C.COMPUTE_TOOL), miss).otherwise(0.0)
        + F.lit(C.EXTRA_CALL_PENALTY) * F.greatest(F.lit(0), F.size(calls) - F.when(chain, 2).otherwise(1))
    )
    right = F.when(final_covers(vtype, tol, final, truth), 1.0).otherwise(0.0)
    return F.when(final.isNull(), 0.0).otherwise(right - penalty)
