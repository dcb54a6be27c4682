"""The SQL of the corpus queries, run beside them on the same tables."""

import duckdb
import pytest

from strandwise.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    with duckdb.connect() as db:
        for table in ("documents", "benchmark", "pages"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = db.sql(queries.oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
