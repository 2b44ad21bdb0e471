"""Every query with SQL gives the same rows on the smallest tables; the others run; none needs the llm subpackage."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from granary import queries as core

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return f"{v:.6g}" if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1e5 else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if sql := core.oracle_sql().get(name):
        r = duck.sql(sql)
        order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
        assert [r.columns[i] for i in order] == columns
        assert got == sorted(tuple(plain(row[i]) for i in order) for row in r.fetchall())
