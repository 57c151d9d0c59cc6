"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from foliospark import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted([tuple(map(same, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()], key=repr)
    if name not in q.SQL:
        assert rows
        return
    made = duck.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({q.SQL[name].strip()})").fetchall()
    assert rows == sorted([tuple(map(same, r)) for r in made], key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["a", "b", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
