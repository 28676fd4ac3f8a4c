"""Every registered query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from fleetlens.plans.fixtures import TABLES
from fleetlens.plans.registry import oracle_sql, queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def tidy(value):
    return round(value, 9) if isinstance(value, float) else str(value) if value is not None and not isinstance(value, bool | int) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cursor = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, expected = rows(df.columns, df.collect()), rows(columns, cursor.fetchall())
    assert got == expected, [x for x in zip(got, expected) if x[0] != x[1]][:2]
    assert got or name.startswith("rule_")
