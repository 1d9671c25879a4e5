"""Every query with SQL against DuckDB on the small tables, and every other one for rows."""

import glob
import math
import os

import duckdb
import pytest

from quartzframe.plans import oracle
from quartzframe.plans import queries as plans

SF = "/root/testdata/sf0.001"
SQL = oracle.sql()
ROWS_ONLY = sorted(set(plans.queries()) - set(SQL) - {"ml_cv"})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)[:19] if hasattr(value, "isoformat") else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    result = duck.execute(SQL[name])
    want = table([c[0] for c in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
