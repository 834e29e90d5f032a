"""Every registered query against its SQL, and those without SQL for a stable schema."""

import duckdb
import pandas as pd
import pytest

from seine import queries

queries.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if hasattr(value, "item"):
        return plain(value.item())
    return str(value)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, data, con, name):
    found = rows(queries.QUERIES[name](spark, data).toPandas())
    assert found == rows(con.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_gives_rows(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
