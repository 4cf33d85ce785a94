"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from rankdiag.llm import suite

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    assert sorted({int(k[2:].split("_")[0]) for k in suite.QUERIES}) == list(range(1, 14)) and len(suite.QUERIES) == 13
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = suite.QUERIES[name](spark, SF).toPandas(), c.sql(suite.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda f: sorted(tuple(None if v != v else v for v in r) for r in f[cols].astype(object).itertuples(index=False))
    key = lambda r: str(r)
    assert sorted(map(str, rows(got)), key=key) == sorted(map(str, rows(want)), key=key)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= left, name
        left = docs.count()
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert 0 < mix.count() <= left and mix.where("taken > 2 * size").count() == 0
