"""Every query of the engine with an oracle against DuckDB on the smallest data."""

import os

import duckdb
import pytest

from tidewatch.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == list(catalog.DATASET)
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir(SF)


def test_queries_without_the_corpus_part(monkeypatch):
    """Missing, or without a library that it needs, it costs its own queries only."""
    import sys

    import __spark_entry__ as e

    for name in ("tidewatch.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES)
