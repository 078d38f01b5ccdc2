"""Every registered query with a DuckDB form, side by side at the smallest scale."""

import os

import duckdb
import numpy as np
import pytest

from flowlens.plans import flow_queries, registry, report_queries  # noqa: F401

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    out = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(out.columns) == sorted(names)
    mine, theirs = rows(out.columns, [tuple(r) for r in out.collect()]), rows(names, got.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 3e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_queries_without_sql_form(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        if name[0] not in "m":
            assert registry.QUERIES[name](spark, SF).count() > 0, name
