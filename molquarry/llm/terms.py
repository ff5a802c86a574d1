"""Frequency of every distinct term (problem 2), by last-seen counters.

Tokens ``(field, term, record, place)`` are hash-partitioned by term and a salt
of the record, and ordered by record and place inside a partition.  One pass
then keeps per term its occurrences, records and the last record seen; no set
of records is kept.  Since a record has one salt, the counters of a term's
salts add up.

Scale: the one shuffle of the tokens spreads a term that holds a third of all
rows over ``salts`` partitions (64, or as many as the session shuffles into);
the second one moves at most ``salts`` counter rows a term.

Defined results: null fields and spellings with nothing visible in them are no
occurrence; deliveries of a record count once (a token is known by its record
and place); rows without ``row_id`` are no records; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import term
from ..runtime import python_map, width

#: A term found in fewer records is too rare, in a greater share of all records too common.
LEAST_RECORDS = 5
MOST_SHARE = 0.08
#: Salts of a term at least.
SALTS = 64


def tokens(records: DataFrame) -> DataFrame:
    """``(field, term, row_id, place)``: ``prop`` (also inside ``pairs``), ``kind`` and ``name`` of each delivery."""
    one = lambda field, c: F.array(F.struct(F.lit(field).alias("field"), term(c).alias("term"), F.lit(0).alias("place")))
    # By the field and not by the structs, so that the scan leaves the molecules of the pairs out.
    inside = F.transform("pairs.prop", lambda p, i: F.struct(F.lit("prop").alias("field"), term(p).alias("term"), (i + 1).alias("place")))
    every = F.concat(one("prop", "prop"), one("kind", "kind"), one("name", "name"), F.coalesce(inside, F.array().cast(
        "array<struct<field:string,term:string,place:int>>")))
    return (
        records.where("row_id is not null").select("row_id", F.explode(every).alias("t"))
        .select("t.field", "t.term", "row_id", "t.place").where("term is not null")
    )


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Last-seen counters over rows sorted by field, term, record and place, batch by batch."""
    now = None  # [field, term, occurrences, records, last record, last place]
    for pdf in batches:
        if not len(pdf):
            continue
        field, word = pdf["field"].to_numpy(), pdf["term"].to_numpy()
        row, place = pdf["row_id"].to_numpy(), pdf["place"].to_numpy()
        new_term = np.ones(len(pdf), bool)
        new_row = np.ones(len(pdf), bool)
        new_place = np.ones(len(pdf), bool)
        new_term[1:] = (field[1:] != field[:-1]) | (word[1:] != word[:-1])
        new_row[1:] = new_term[1:] | (row[1:] != row[:-1])
        new_place[1:] = new_row[1:] | (place[1:] != place[:-1])
        if now is not None and now[0] == field[0] and now[1] == word[0]:
            new_term[0] = False
            new_row[0] = row[0] != now[4]
            new_place[0] = new_row[0] or place[0] != now[5]
        starts = np.flatnonzero(new_term)
        edges = np.concatenate(([0], starts[starts > 0])) if len(starts) else np.array([0])
        occurrences = np.add.reduceat(new_place.astype(np.int64), edges)
        rows = np.add.reduceat(new_row.astype(np.int64), edges)
        out = []
        for k, at in enumerate(edges):
            if k or new_term[0]:
                if now is not None:
                    out.append(now[:5])
                now = [field[at], word[at], 0, 0, 0, 0]
            now[2] += int(occurrences[k])
            now[3] += int(rows[k])
            last = (edges[k + 1] if k + 1 < len(edges) else len(pdf)) - 1
            now[4], now[5] = int(row[last]), int(place[last])
        if out:
            yield pd.DataFrame(out, columns=["field", "term", "occurrences", "records", "last_record"])
    if now is not None:
        yield pd.DataFrame([now[:5]], columns=["field", "term", "occurrences", "records", "last_record"])


def term_counts(
    records: DataFrame, least_records: int = LEAST_RECORDS, most_share: float = MOST_SHARE, salts: int | None = None
) -> DataFrame:
    """``(field, term, occurrences, records, last_record, mark)``; ``mark`` is 'rare', 'common' or null."""
    spark = records.sparkSession
    salts = salts or max(SALTS, width(spark))
    ordered = (
        tokens(records).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
        .repartition(width(spark), "field", "term", "salt")
        .sortWithinPartitions("field", "term", "row_id", "place")
        .select("field", "term", "row_id", "place")
    )
    seen = python_map(ordered, _count, "field string, term string, occurrences bigint, records bigint, last_record bigint")
    sums = seen.groupBy("field", "term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.max("last_record").alias("last_record")
    )
    total = records.where("row_id is not null").agg(F.countDistinct("row_id").alias("total"))
    mark = F.when(F.col("records") < least_records, "rare").when(F.col("records") > F.lit(most_share) * F.col("total"), "common")
    # One row with one number: broadcast is bounded.
    return sums.join(F.broadcast(total)).withColumn("mark", mark).drop("total")
