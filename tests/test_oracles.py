"""Every query with SQL gives the rows that the SQL gives."""

from __future__ import annotations

import math

import pytest

from cutloom import plans
from cutloom.registry import QUERIES, SQL

plans.load()


def same(a: object, b: object) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda t: tuple((x is None, round(x, 4) if isinstance(x, float) else x) for x in t)
    left = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    right = sorted(want.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
