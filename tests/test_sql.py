"""Every query against its SQL."""

import math

import duckdb
import pytest

from veilscan import queries as core

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    def show(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return f"{float(v):.9g}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)

    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    got, want = core.queries()[name](spark, SF).toPandas(), duck.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_rows(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries()) and set(core.queries()) <= set(e.queries())
