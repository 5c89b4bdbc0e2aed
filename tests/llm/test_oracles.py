"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from fixturelake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours = queries.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(queries.ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    text = lambda df: sorted(tuple("-" if str(v) in ("None", "<NA>", "nan") else str(v) for v in r) for r in df[columns].convert_dtypes().itertuples(index=False))
    assert text(ours) == text(theirs)
