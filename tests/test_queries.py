"""Every query with an SQL twin gives the same rows in DuckDB."""

import duckdb
import pytest

from lexmill import queries as Q

TABLES = "documents pages benchmark labels conversations embeddings".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(str(None if v != v else v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, duck, data, name):
    mine = Q.QUERIES[name](spark, data).toPandas()
    theirs = duck.execute(Q.ORACLE[name]).df()
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).limit(5).toPandas() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
