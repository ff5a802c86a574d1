"""Roll-ups of episode results, histograms, and report text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(results: DataFrame, key: str) -> DataFrame:
    """``(key, n, correct, tool_valid, accuracy, valid_rate)`` by key and over all (key ``_all``)."""
    sums = [
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).cast("bigint").alias("correct"),
        F.sum(F.col("tool_valid").cast("int")).cast("bigint").alias("tool_valid"),
    ]
    one = results.withColumn("_key", F.coalesce(F.col(key), F.lit("")))
    rolled = one.rollup("_key").agg(F.grouping("_key").alias("_all"), *sums)
    label = F.when(F.col("_all") == 1, "_all").otherwise(F.col("_key"))
    return rolled.select(
        label.alias("key"), "n", "correct", "tool_valid",
        F.round(F.col("correct") / F.col("n"), 3).alias("accuracy"), F.round(F.col("tool_valid") / F.col("n"), 3).alias("valid_rate"),
    )


def report_order(table: DataFrame) -> DataFrame:
    """``_all`` first, then keys in binary order."""
    return table.orderBy(F.col("key") != "_all", "key")


def failures(results: DataFrame, order: str, *columns: str, limit: int = 0) -> DataFrame:
    """Wrong episodes, the first ``limit`` by ``order`` (0: all)."""
    wrong = results.where(~F.col("correct")).select(order, *columns)
    return wrong.orderBy(order).limit(limit) if limit else wrong


def head(df: DataFrame, order: str, limit: int = 0) -> DataFrame:
    """The first ``limit`` rows by ``order`` (0: all)."""
    return df.orderBy(order).limit(limit) if limit else df


def kind_histogram(rows: DataFrame) -> DataFrame:
    """``(split, kind, n)``."""
    return rows.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n"))


def kind_fractions(rows: DataFrame) -> DataFrame:
    """``(kind, n, fraction)``; the total is one row and broadcast."""
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("kind", "n", (F.col("n") / F.col("total")).alias("fraction"))


def exposure(fractions: DataFrame, steps: list[int], batch: int) -> DataFrame:
    """``(step, kind, seen)``: rows of each kind seen up to a step, halves rounded to even."""
    at = fractions.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    return at.select("step", "kind", F.bround(F.col("step") * batch * F.col("fraction"), 0).cast("bigint").alias("seen"))


def calls_histogram(episodes: DataFrame, messages: str = "messages") -> DataFrame:
    """``(calls, n)``: how many assistant messages of an episode carry calls."""
    with_calls = F.size(F.filter(messages, lambda m: (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)))
    return episodes.groupBy(with_calls.cast("int").alias("calls")).agg(F.count(F.lit(1)).alias("n"))


def split_summary(rows: DataFrame) -> DataFrame:
    """``(split, molecules, rows)``."""
    return rows.groupBy("split").agg(F.countDistinct("smiles").alias("molecules"), F.count(F.lit(1)).alias("rows"))


def composition(rows: DataFrame) -> DataFrame:
    """One row of counts: all, paraphrase, multi and no_tool rows."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("paraphrase", "multi", "no_tool")],
    )


def markdown(table: DataFrame, tag: str, head: str = "property") -> str:
    """The metric table as Markdown, ``_all`` first; one row per key reaches the driver."""
    # The report's heading and columns.
    lines = [f"# Eval: {tag}", "", f"| {head} | n | accuracy | tool-valid |", "|---|---|---|---|"]
    for r in report_order(table).collect():
        lines.append(f"| {r['key']} | {r['n']} | {r['accuracy']:.3f} | {r['valid_rate']:.3f} |")
    return "\n".join(lines) + "\n"
