"""Every registered relational query against its SQL twin."""

import math
from pathlib import Path

import duckdb
import pytest
from cargolens.plans import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, bool | str | bytes) or v is None:
        return repr(v)
    return str(v)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([plain(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLES:
        got.collect()
        return
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert bag(got.collect(), got.columns) == bag(want.fetchall(), columns)
