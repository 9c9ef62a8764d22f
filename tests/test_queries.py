import duckdb
import pytest

import __spark_entry__
from millrace.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(str(clean(v)) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)
    else:
        assert len(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
