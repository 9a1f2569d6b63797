"""Every query runs; those with SQL give the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def _key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


def _close(a, b):
    """Equal, but for the last of six digits: sums may come in another order."""
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1.01e-6
    return a == b


def test_contract_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    expected = sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=_key)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    assert len(got) == len(expected)
    assert all(_close(a, b) for g, w in zip(got, expected) for a, b in zip(g, w))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert len(QUERIES[name](spark, SF).limit(1).collect()) == 1


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["id", "label", "pred"] and df.count() > 0
