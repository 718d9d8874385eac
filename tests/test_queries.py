import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def shown(rows):
    return sorted(str([None if isinstance(v, float) and math.isnan(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, tables, name):
    frame = plans.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = frame.select(columns).collect()
    assert len(set(columns)) == len(columns)
    if name in plans.ORACLE_SQL:
        want = tables.sql(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
        assert shown(rows) == shown(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())
