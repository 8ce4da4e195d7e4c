"""Every registered query against its SQL on an independent engine, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from basalt.plans.all import OPERATORS
from basalt.session import TABLES

SF = os.environ.get("BASALT_TEST_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, op in OPERATORS.items() if op.oracle))
def test_query_matches_its_sql(spark, duck, name):
    op = OPERATORS[name]
    df = op.run(spark, SF)
    got = table(df.columns, df.collect())
    result = duck.execute(op.oracle)
    want = table([d[0] for d in result.description], result.fetchall())
    assert got == want
