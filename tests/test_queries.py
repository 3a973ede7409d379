"""Every query with SQL agrees with it on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tracklake.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_agrees_with_sql(spark, duck, tmp_path, name):
    queries.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    mine = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df()
    theirs = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine, sorted(mine.columns)) == rows(theirs, sorted(mine.columns))
