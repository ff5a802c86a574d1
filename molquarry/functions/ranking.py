"""Exact ranks inside groups of any size.

A window over one hot group sorts all its rows in one task.  Here the rows of a
group are cut into buckets of a random key first; bucket counts give each
bucket's offset and only rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, group: list[str], key: str, bits: int) -> DataFrame:
    """``key`` is a BIGINT in [0, 2^32); ``bits`` leading bits name the bucket."""
    return df.withColumn("_bucket", F.shiftright(F.col(key), 32 - bits))


def ranked(df: DataFrame, group: list[str], key: str, tie: str, name: str = "rank", bits: int = 10) -> DataFrame:
    """Add ``name``: the 1-based rank by ``(key, tie)`` inside ``group``, for groups of any size."""
    cut = _buckets(df, group, key, bits)
    counts = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(key, tie)
    renamed = offsets.select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_bucket").alias("_o_bucket"), "_before")
    numbered = cut.withColumn("_inside", F.row_number().over(inside))
    on = F.col("_bucket") == F.col("_o_bucket")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    return (
        numbered.join(renamed, on)
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before", "_o_bucket", *[f"_o_{g}" for g in group])
    )


def lowest(df: DataFrame, group: list[str], key: str, tie: str, quota: str, bits: int = 10) -> DataFrame:
    """Keep in each group the ``quota`` rows (a column, the same in all rows of a group) of lowest ``(key, tie)``.

    Buckets wholly below the quota pass without a sort; only the one bucket in
    which the quota ends is ranked.
    """
    cut = _buckets(df, group, key, bits)
    counts = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_bucket")
    sums = counts.select(
        *[F.col(g).alias(f"_o_{g}") for g in group], F.col("_bucket").alias("_o_bucket"),
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.col("_n").alias("_in"),
    )
    on = F.col("_bucket") == F.col("_o_bucket")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    placed = cut.join(sums, on).where(F.col("_before") < F.col(quota))
    extra = ["_bucket", "_o_bucket", "_before", "_in", *[f"_o_{g}" for g in group]]
    whole = placed.where(F.col("_before") + F.col("_in") <= F.col(quota)).drop(*extra)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(key, tie))
    edge = placed.where(F.col("_before") + F.col("_in") > F.col(quota)).withColumn("_r", rank)
    edge = edge.where(F.col("_r") + F.col("_before") <= F.col(quota)).drop("_r", *extra)
    return whole.unionByName(edge)
