"""Each query with SQL gives the rows that its SQL gives."""

import duckdb
import pytest

from factloom.llm.registry import oracle_sql, queries

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    got = queries()[name](spark, PATH)
    columns = ", ".join(got.columns)
    want = con.sql(f"SELECT {columns} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
