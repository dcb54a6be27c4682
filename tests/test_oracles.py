"""Every query that SQL can express equals it on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandwise.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def plain(rows):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    there = [c[0] for c in cursor.description]
    assert sorted(there) == cols
    want = [tuple(dict(zip(there, r, strict=True))[c] for c in cols) for r in cursor.fetchall()]
    assert plain(df.select(*cols).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
