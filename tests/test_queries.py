"""Every core query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from molquarry import queries as core


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda x: None if x is None or x is __import__("pandas").NA or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted((tuple(map(show, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, small, db, name):
    got, want = core.queries()[name](spark, small).toPandas(), db.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_other_queries_run(spark, small, name):
    assert core.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first()["key"] == "_all"


def test_core_does_not_import_the_subpackage():
    import re
    from pathlib import Path

    for f in Path(core.__file__).parent.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(from|import) .*\bllm\b", f.read_text()), f
