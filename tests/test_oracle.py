"""Every query with SQL gives DuckDB's rows on the smallest tables; every other query runs."""

import math
import os

import duckdb
import pytest

from rankdiag.operators import suite

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or str(v) == "<NA>" or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return bool(v) if isinstance(v, bool) else round(float(v), 5) if isinstance(v, (int, float)) else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, con, name):
    got = suite.QUERIES[name](spark, SF).toPandas()
    if name in suite.SQL:
        assert rows(got) == rows(con.sql(suite.SQL[name]).df())
