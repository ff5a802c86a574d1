"""Scoring of recorded tool-calling episodes, without a loop.

``turns`` is ``(episode, turn, text)`` with turns from 0; ``episodes`` has one
row per episode: ``episode, kind, expected, name`` where ``expected`` is
``array<struct<smiles, prop, vtype, tol, truth>>``, truths as Python prints
them.  What a tool answered never changes a score once the turns are fixed, so
an episode is one aggregate over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.protocol import contains_any, parse_final, parse_native_call, parse_v1_call, strip
from ..functions.scoring import final_covers, score
from .names import name_key


def played(turns: DataFrame, call: Column, final: Column, most: int = C.MAX_TURNS) -> DataFrame:
    """``(episode, calls, final)``: calls up to the first turn without one, and what that turn answers.

    Turns from ``most`` on are not played; an episode that only calls has no
    answer.  Aggregated from short arrays of at most ``most`` turns, which
    partial aggregation builds before the shuffle.
    """
    rows = turns.where(F.col("turn") < most).select("episode", F.struct("turn", call.alias("call"), final.alias("final")).alias("t"))
    packed = rows.groupBy("episode").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    first = F.array_min(F.transform(F.filter("ts", lambda t: t["call"].isNull()), lambda t: t["turn"]))
    packed = packed.withColumn("stop", first)
    kept = F.filter("ts", lambda t: t["call"].isNotNull() & (F.col("stop").isNull() | (t["turn"] < F.col("stop"))))
    answer = F.filter("ts", lambda t: t["turn"] == F.col("stop"))
    return packed.select("episode", F.transform(kept, lambda t: t["call"]).alias("calls"), F.get(answer, F.lit(0))["final"].alias("final"))


def _called(calls: Column, expected: Column) -> Column:
    """Every expected pair is among the calls (exact texts); true for none expected."""
    return F.forall(
        expected, lambda e: F.exists(calls, lambda c: F.coalesce((c["smiles"] == e["smiles"]) & (c["prop"] == e["prop"]), F.lit(False)))
    )


def _covered(final: Column, expected: Column, canonical: Column | None = None) -> Column:
    return F.forall(expected, lambda e: final_covers(e["vtype"], e["tol"], final, e["truth"], canonical))


def _joined(episodes: DataFrame, plays: DataFrame) -> DataFrame:
    return episodes.join(plays, "episode", "left").withColumn("calls", F.coalesce("calls", F.array()))


def score_one_call(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """First format, one call: turn 0 must call, turn 1 answers.

    ``tool_valid``: the call names the expected molecule and property.
    ``correct`` compares the answer with the row's truth whatever was called;
    ``strict_correct`` asks for both.
    """
    two = turns.where("turn < 2").groupBy("episode").agg(
        F.max(F.when(F.col("turn") == 0, F.struct(parse_v1_call(F.col("text")).alias("call")))).alias("c"),
        F.max(F.when(F.col("turn") == 1, parse_final(F.col("text")))).alias("said"),
    )
    rows = episodes.join(two, "episode", "left")
    call, e = F.col("c.call"), F.get("expected", F.lit(0))
    final = F.when(call.isNotNull(), F.col("said"))
    valid = F.coalesce((call["smiles"] == e["smiles"]) & (call["prop"] == e["prop"]), F.lit(False))
    right = F.coalesce(score(e["vtype"], e["tol"], final, e["truth"]), F.lit(False))
    return rows.select(*episodes.columns, final.alias("final"), right.alias("correct"), valid.alias("tool_valid"), (right & valid).alias("strict_correct"))


def score_general(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """First format, any number of calls; ``kind`` 'no_tool' expects none.

    ``correct``: the answer covers every expected pair, for 'no_tool' there is
    an answer and no call.  Where ``episodes`` has a column ``answer``, the
    lower-cased answer of a 'no_tool' episode must also contain it (a null one
    is contained in nothing).
    """
    plays = played(turns, parse_v1_call(F.col("text")), parse_final(F.col("text")))
    rows = _joined(episodes, plays)
    none = F.size("calls") == 0
    has = F.size("expected") > 0
    valid = F.when(has, _called(F.col("calls"), F.col("expected"))).otherwise(none)
    answered = F.col("final").isNotNull()
    said = F.lower(strip(F.col("final"))).contains(F.col("answer")) if "answer" in episodes.columns else F.lit(True)
    right = F.when(F.col("kind") == "no_tool", answered & none & said).otherwise(answered & _covered(F.col("final"), F.col("expected")))
    return rows.select(*episodes.columns, F.size("calls").alias("n_calls"), "final", F.coalesce(right, F.lit(False)).alias("correct"), valid.alias("tool_valid"))


def expected_pairs(resolved: str = "resolved") -> Column:
    """The pairs ``(smiles, prop)`` a row's answer must cover, by kind; empty where nothing is computed."""
    pair = lambda s: F.array(F.struct(F.col(s).alias("smiles"), F.col("prop").alias("prop")))
    none = F.slice(pair("smiles"), 1, 0)
    return (
        F.when(F.col("kind") == "single", pair("smiles")).when(F.col("kind") == "chain", pair(resolved))
        .when(F.col("kind") == "multi", F.coalesce("pairs", none)).otherwise(none)
    )


def score_by_kind(episodes: DataFrame, turns: DataFrame, version: int = 3, canonical: DataFrame | None = None) -> DataFrame:
    """Native format, by kind; version 2 has five kinds, version 3 'chain' too.

    no_tool: an answer without call; clarify: it also asks back; error: a
    property call (version 2: any call) and a report of failure; chain: the
    property call, a look-up of the right name (in any order) and the value;
    single and multi: every expected value in the answer.  ``canonical
    (episode, words)`` maps the words of answers to canonical SMILES for
    expected structures; without it they compare as texts.
    """
    plays = played(turns, parse_native_call(F.col("text"), version), strip(F.col("text")))
    rows = _joined(episodes, plays)
    words = None
    if canonical is not None:
        rows = rows.join(canonical, "episode", "left")
        words = F.col("words")
    final, calls, expected, kind = F.col("final"), F.col("calls"), F.col("expected"), F.col("kind")
    computed = F.filter(calls, lambda c: c["tool"] == C.COMPUTE_TOOL)
    looked = F.filter(calls, lambda c: c["tool"] == C.NAME_TOOL)
    none = F.size(calls) == 0
    answered = final.isNotNull()
    matched = F.when(F.size(expected) > 0, _called(computed, expected)).otherwise(none)
    named = F.coalesce(F.exists(looked, lambda c: name_key(c["name"]) == name_key(F.col("name"))), F.lit(False))
    valid = (
        F.when(kind.isin("no_tool", "clarify"), none).when(kind == "error", F.size(computed) >= 1)
        .when(kind == "chain", matched & named).otherwise(matched)
    )
    covered = answered & _covered(final, expected, words)
    right = (
        F.when(kind == "no_tool", answered & none)
        .when(kind == "clarify", answered & none & contains_any(final, C.CLARIFY_WORDS[version]))
        .when(kind == "error", answered & valid & contains_any(final, C.ERROR_WORDS[version]))
        .when(kind == "chain", valid & covered).otherwise(covered)
    )
    return rows.select(*episodes.columns, F.size(calls).alias("n_calls"), "final", F.coalesce(right, F.lit(False)).alias("correct"), valid.alias("tool_valid"))
