"""Every core query against its SQL on the smallest tables, where these are at hand."""

import math
from pathlib import Path

import duckdb
import pytest

from giurispark.plans import registry

BASE = Path("/root/testdata/sf0.001")
SQL = registry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1e9 else str(v) if v is not None else None


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in BASE.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not BASE.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(BASE))
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is not None, x or "") for x in r)
    got = sorted((tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    assert got == sorted((tuple(map(norm, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
