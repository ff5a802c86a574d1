"""Extra columns named like the operators' own change nothing."""

import pytest
from pyspark.sql import functions as F

from molquarry.llm import groups, mixing, overlap, packing, quotas, stuffing, terms

OWN = (
    "spelling", "molecule", "anchor", "class_id", "chunk", "digest", "size", "sides", "total", "field", "term", "place", "salt", "mark", "root", "node", "key",
    "rank", "first", "other", "n", "kind_term", "prop_term", "name_term", "group_pos", "new_split", "quota", "available", "needed", "tokens", "piece", "block",
    "slot", "copy", "capacity", "bucket", "before", "inside", "pool", "copies", "rest", "scale", "chars", "covered", "a", "b", "df", "s", "_bucket", "_n",
)


@pytest.fixture(scope="module")
def tables(spark, small):
    def plain(t):
        return spark.read.parquet(f"{small}/{t}.parquet")

    def noisy(t):
        df = plain(t)
        return df.withColumns({c: F.lit("noise") for c in OWN if c not in df.columns})

    return plain, noisy


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_question_operators(tables):
    plain, noisy = tables
    args = ("qa_v3", "name_dict", "controls")
    found = [overlap.found_pairs(overlap.normalised(*map(t, args))) for t in tables]
    assert same(*found)
    assert same(*[terms.term_counts(t("qa_v3")) for t in tables])
    assert same(*[groups.related(*(t(x) for x in ("qa_v3", "molecules", "name_dict", "controls"))) for t in tables])
    assert same(*[quotas.plan_report(*(t(x) for x in ("qa_v3", "sample_plans", "sample_targets"))) for t in tables])


def test_text_operators(tables):
    _, noisy = tables
    docs = [t("documents") for t in tables]
    capacity = [tables[0]("containers"), noisy("containers")]
    assert same(*[packing.pack_documents(d, c) for d, c in zip(docs, capacity)])
    assert same(*[mixing.sample_mix(d, t("mixes"), t("mix_targets"))[0] for d, t in zip(docs, tables)])
    assert same(*[stuffing.stuffed_pages(d) for d in docs])
