"""Filters, dedupe and group-aware splitting of molecules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import draw


def accepted(features: str = "features", low: int = 3, high: int = 60, drug_like: bool = False) -> Column:
    """A readable molecule of ``low`` to ``high`` heavy atoms, within the drug-like window if asked."""
    f = lambda k: F.col(f"{features}.{k}")
    ok = f("validity") & f("heavy_atoms").between(low, high)
    if drug_like:
        ok = ok & f("mw").between(150, 500) & (f("logp") <= 5) & (f("hbd") <= 5) & (f("hba") <= 10)
    return F.coalesce(ok, F.lit(False))


def first_wins(df: DataFrame, key: str, position: str, limit: int = 0) -> DataFrame:
    """One row per ``key``, the one of lowest ``position``; the first ``limit`` rows by position (0: all).

    ``min_by`` over the packed row aggregates before the shuffle, and a limit
    ordered by position keeps ``limit`` rows a partition.
    """
    rest = [c for c in df.columns if c != key]
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_row")).select(key, "_row.*")
    one = one.select(*df.columns)
    return one.orderBy(position).limit(limit) if limit else one


def prefix_sums(groups: DataFrame, key: str, tie: str, size: str, name: str = "before", bits: int = 10) -> DataFrame:
    """Add the sum of ``size`` over all rows before each by ``(key, tie)``; ``key`` is a BIGINT in [0, 2^32).

    A global running sum in two levels: over at most ``2^bits`` buckets of the
    key, then inside each bucket, so that no task sorts all groups.
    """
    cut = groups.withColumn("_bucket", F.shiftright(F.col(key), 32 - bits))
    sums = cut.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    # At most 2^bits rows in one task.
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(F.broadcast(sums), "_bucket")  # at most 2^bits rows
        .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_bucket", "_offset", "_inside")
    )


def group_split(df: DataFrame, group: str, seed: int = 0, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Add ``split``: whole groups in hashed order fill train up to its share, then val, the rest is test.

    A group belongs to the split that was not yet full before it, so the last
    group of a split may overshoot.  A null group counts as the empty one.
    """
    keyed = df.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("")))
    sizes = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")).withColumn("_key", draw(seed, F.lit("group"), "_group"))
    placed = prefix_sums(sizes, "_key", "_group", "_size", "_before")
    total = sizes.agg(F.sum("_size").alias("_total"))
    split = (
        F.when(F.col("_before") < F.lit(train) * F.col("_total"), "train")
        .when(F.col("_before") < F.lit(train + val) * F.col("_total"), "val").otherwise("test")
    )
    # One row with one number: broadcast is bounded.
    names = placed.join(F.broadcast(total)).select("_group", split.alias("split"))
    return keyed.join(names, "_group").drop("_group")


def split_overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``(split_a, split_b, shared)`` for the three pairs of splits: keys found in both; all zero if nothing leaks."""
    sides = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(split).alias("s"))
    pairs = [("test", "train"), ("test", "val"), ("train", "val")]
    counts = sides.agg(*[
        F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}|{b}") for a, b in pairs
    ])
    stacked = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
    return counts.selectExpr(f"stack(3, {stacked}) as (split_a, split_b, shared)")


def bank_split(df: DataFrame, position: str) -> DataFrame:
    """Add ``split`` by position modulo three: train, val, test."""
    k = F.col(position) % 3
    return df.withColumn("split", F.when(k == 0, "train").when(k == 1, "val").otherwise("test"))
