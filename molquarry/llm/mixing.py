"""Mixing sources to target weights (problem 6), by Pareto order sampling.

Each target of a mix wants weight x total tokens of a source.  A source with
fewer tokens than that is first taken whole as often as it fits (at most
``max_repeat`` times); the rest is sampled: each document has an inclusion
probability that rises with its size, and documents are ordered by random odds
over inclusion odds.  The head of that order whose tokens come nearest to the
rest is taken, so the token size of the sample is fixed.

Scale: one pass tokenizes; sums and size histograms are aggregated before any
shuffle.  The order is cut into buckets of its key: buckets wholly inside the
head pass without a sort, only the bucket in which it ends is sorted, so a
source with a third of all documents is no single task.

Defined results: null and empty texts have no tokens and are never drawn; a
null source belongs to no target; a target with weight 0 draws nothing; a
source that is absent leaves its target unmet; repeated rows of one ``doc_id``
are drawn one by one, numbered by ``copy``; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, draw, ship
from .tokens import TOKENIZER, token_sizes

#: Inclusion probability rises with the size to this power.
SIZE_POWER = 0.5


def plan_mix(sizes: DataFrame, mixes: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target takes of its source, from ``sizes (source, tokens)``.

    ``(mix_id, source, weight, max_repeat, wanted, pool, copies, rest, unmet)``:
    ``copies`` whole copies and ``rest`` tokens of a sample; ``unmet`` where the
    wanted tokens exceed ``max_repeat`` times the pool.
    """
    pool = sizes.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("pool"))
    wanted = targets.join(mixes, "mix_id").select(
        "mix_id", "source", "weight", "max_repeat", (F.col("weight") * F.col("total_tokens")).alias("wanted")
    )
    plan = wanted.join(pool, "source", "left").withColumn("pool", F.coalesce("pool", F.lit(0)))
    fits = F.when(F.col("pool") > 0, F.floor(F.col("wanted") / F.col("pool"))).otherwise(0)
    plan = plan.withColumn("copies", F.least(fits, F.col("max_repeat")))
    rest = F.when(F.col("copies") < F.col("max_repeat"), F.col("wanted") - F.col("copies") * F.col("pool")).otherwise(0.0)
    return plan.withColumn("rest", F.when(F.col("pool") > 0, rest).otherwise(0.0)).withColumn(
        "unmet", F.col("wanted") > F.col("max_repeat") * F.col("pool")
    )


def _scale(pdf: pd.DataFrame) -> pd.DataFrame:
    """The factor at which the inclusion probabilities give the wanted tokens, from one source's size histogram."""
    s = pdf["tokens"].to_numpy(float)
    n = pdf["n"].to_numpy(float)
    rest = float(pdf["rest"].iloc[0])
    w = s**SIZE_POWER
    low, high = 0.0, 1.0 / w.min()
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float((np.minimum(1.0, mid * w) * s * n).sum()) < rest else (low, mid)
    return pd.DataFrame({"mix_id": [pdf["mix_id"].iloc[0]], "source": [pdf["source"].iloc[0]], "scale": [high]})


def sample_mix(documents: DataFrame, mixes: DataFrame, targets: DataFrame, seed: int = 23, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """``(mix_id, source, doc_id, copy, tokens, copies)`` of all documents taken, and the plan."""
    ship(documents.sparkSession)
    sizes = token_sizes(documents, "doc_id", "source", path=path).where("source is not null and tokens > 0")
    sizes = cut(sizes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "tokens")) - 1))
    plan = cut(plan_mix(sizes, mixes, targets))
    histogram = sizes.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    scales = (
        plan.where("rest > 0").select("mix_id", "source", "rest").join(histogram, "source")
        .groupBy("mix_id", "source").applyInPandas(_scale, "mix_id int, source string, scale double")
    )
    # One row a target of the given mixes: broadcast is bounded, and a source with a third of all documents is no single task.
    goals = plan.where("rest > 0").select("mix_id", "source", "rest").join(scales, ["mix_id", "source"])
    pi = F.least(F.lit(1.0), F.col("scale") * F.pow("tokens", F.lit(SIZE_POWER)))
    u = (draw(seed, "mix_id", "doc_id", "copy") + 0.5) / F.lit(4294967296.0)
    # Random odds over inclusion odds, mapped from [0, inf) to [0, 2^32); certain documents come first.
    ratio = F.when(pi >= 1.0, F.lit(0.0)).otherwise((u / (1 - u)) / (pi / (1 - pi)))
    key = F.least(F.floor(ratio / (1 + ratio) * F.lit(4294967296.0)), F.lit(4294967295)).cast("bigint")
    drawn = sizes.join(F.broadcast(cut(goals)), "source").withColumn("key", key).withColumn("bucket", F.shiftright("key", 22))
    drawn = drawn.select("mix_id", "source", "doc_id", "copy", "tokens", "rest", "key", "bucket")
    by_bucket = drawn.groupBy("mix_id", "source", "rest", "bucket").agg(F.sum("tokens").alias("inside"))
    upto = Window.partitionBy("mix_id", "source").orderBy("bucket")
    by_bucket = by_bucket.withColumn("before", F.sum("inside").over(upto) - F.col("inside"))
    # The bucket in which each target's head ends, again a row a target; what lies behind it leaves before any shuffle.
    ends = by_bucket.where("before < rest").groupBy("mix_id", "source").agg(F.max_by(F.struct("bucket", "before", "inside"), "bucket").alias("end"))
    placed = drawn.join(F.broadcast(cut(ends)), ["mix_id", "source"]).where(F.col("bucket") <= F.col("end.bucket"))
    columns = ["mix_id", "source", "doc_id", "copy"]
    ends_inside = (F.col("bucket") == F.col("end.bucket")) & (F.col("end.before") + F.col("end.inside") > F.col("rest"))
    whole = placed.where(~ends_inside).select(*columns, "tokens")
    order = Window.partitionBy("mix_id", "source").orderBy("key", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(ends_inside).withColumn("sum", F.col("end.before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    edge = edge.where(F.col("sum") + F.col("tokens") / 2 <= F.col("rest")).select(*columns, "tokens")
    extra = whole.unionByName(edge).withColumn("extra", F.lit(1))
    certain = F.broadcast(plan.where("copies > 0").select("mix_id", "source", "copies"))
    copied = sizes.join(certain, "source").select(*columns, "tokens", F.col("copies").cast("int").alias("extra"))
    return copied.unionByName(extra).groupBy(*columns, "tokens").agg(F.sum("extra").cast("int").alias("copies")), plan


def mix_report(taken: DataFrame, plan: DataFrame) -> DataFrame:
    """Wanted and actual tokens and shares of each target, the most copies of a document, and whether it is unmet.

    ``unmet`` is read off the sample: it holds every document of the source as
    often as allowed and its tokens are still fewer than wanted.
    """
    sums = taken.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("actual"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("documents")
    )
    rows = plan.drop("unmet").join(sums, ["mix_id", "source"], "left").fillna({"actual": 0, "most_copies": 0, "documents": 0})
    used_up = F.col("actual") == F.col("pool") * F.col("max_repeat")
    mix = Window.partitionBy("mix_id")
    return rows.select(
        "mix_id", "source", "weight", F.round("wanted").cast("bigint").alias("wanted"), "pool", "actual", "documents", "most_copies",
        (used_up & (F.col("wanted") > F.col("actual"))).alias("unmet"),
        F.round(F.col("actual") / F.greatest(F.sum("actual").over(mix), F.lit(1)), 6).alias("actual_share"),
    )
