"""The queries that SQL can tell, against DuckDB."""

import duckdb
import pytest

from tidemark.llm.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
