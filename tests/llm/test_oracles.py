"""Queries of this subpackage that SQL can express, against an independent engine on the smallest tables."""

import os

import duckdb
import pytest

from basalt.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("BASALT_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "conversations"):
        engine.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = engine.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
