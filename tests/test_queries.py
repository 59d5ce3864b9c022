"""Every registered query on the smallest tables, beside its SQL in DuckDB."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as spark_entry  # noqa: E402
from check_oracle import compare  # noqa: E402

SF = Path("/root/testdata/sf0.001")
QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for f in sorted(SF.glob("*.parquet")):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(SF))
    if name in SQL:
        problem, _ = compare(df, con, SQL[name])
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
