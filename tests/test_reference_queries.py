"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

from postloom.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return list(df.columns), sorted(tuple(str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    assert rows(Q.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(Q.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_rows_without_errors(spark, sf, name):
    got = Q.QUERIES[name](spark, sf)
    bad = got.where("error is not null")
    assert got.count() > 0 and bad.count() == (got.where("error.code = 'EmptyInput'").count())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(Q.QUERIES) <= set(e.queries())
