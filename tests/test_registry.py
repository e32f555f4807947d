"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as registry  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def test_entry(spark):
    assert registry.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, db, name):
    frame = QUERIES[name](spark, folder)
    columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        assert got
        return
    cursor = db.execute(ORACLES[name])
    wanted_columns, wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == wanted_columns
    assert got == wanted
