"""Streaming extensions: transcripts scored as they arrive, chat sessions with carried history."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import catalog as C
from ..functions.protocol import parse_native_call, strip
from ..plans.evaluate import converse
from ..runtime import ship


def stream_calls(turns: DataFrame, event_time: str = "at", delay: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Calls and answers per tool and time window of a stream of turns ``(episode, turn, text, at)``.

    Late turns are taken up to the watermark's delay.
    """
    call = parse_native_call(F.col("text"))
    rows = turns.withWatermark(event_time, delay).withColumn("tool", F.coalesce(call["tool"], F.lit("answer")))
    return rows.groupBy(F.window(event_time, window), "tool").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "tool", "n"
    )


def stream_finals(turns: DataFrame) -> DataFrame:
    """``(episode, turn, final)``: turns of a stream that are answers and not calls; stateless."""
    return turns.where(parse_native_call(F.col("text")).isNull()).select("episode", "turn", strip(F.col("text")).alias("final"))


def chat(
    questions: DataFrame, generate: Callable[[list[dict]], str], resolve: Callable[[str], str | None], system: str = C.SYSTEM_PROMPT,
    idle_ms: int | None = None,
) -> DataFrame:
    """``(session, question, answer, calls)`` for a stream ``(session, at, question)``; history is kept per session.

    ``/reset`` forgets it.  With ``idle_ms`` a session idle that long is dropped;
    Spark then runs batches without new data as well.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = json.loads(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for question in rows["question"]:
            if question is None or question.strip() == "/reset":
                history = []
                continue
            messages = [{"role": "system", "content": system}, *history, {"role": "user", "content": question}]
            turns = converse(messages, generate, resolve)
            history = messages[1:]
            out.append((key[0], question, turns[-1].strip() if turns else None, len(turns) - 1))
        state.update((json.dumps(history),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "question", "answer", "calls"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    ship(questions.sparkSession)
    return questions.groupBy("session").applyInPandasWithState(
        step, "session string, question string, answer string, calls int", "history string", "append", timeout
    )
