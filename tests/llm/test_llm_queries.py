"""The queries with SQL give the rows of that SQL."""

import duckdb
import pytest

from folioscope.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    got = df.select(*want.columns)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    assert {c: kinds[str(t)] for c, t in zip(want.columns, want.types, strict=True)} == dict(got.dtypes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
