import duckdb
import pandas as pd
import pytest

from millrace.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(Q.ORACLES[name]).df()
    found = Q.QUERIES[name](spark, SF).toPandas()
    clean = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v)
    rows = lambda frame: sorted(tuple(str(clean(v)) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))
    assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_covers_its_table(spark, name):
    table, key = ("pages", "page_id") if name == "op7_language" else ("documents", "doc_id")
    ids = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    found = Q.QUERIES[name](spark, SF).select(key)
    assert found.distinct().count() == ids.count() and ids.join(found, key, "left_anti").count() == 0
