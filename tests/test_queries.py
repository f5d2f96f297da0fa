"""Each registered query gives the rows of its SQL, and isn't vacuous."""

import duckdb
import pytest

from factloom.plans import registry

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations benchmark".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, PATH)
    rows = got.collect()
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(con.sql(sql).columns) == sorted(got.columns)
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
