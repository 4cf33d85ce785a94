"""Exact quantiles against Spark's percentile and against sorted values."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankdiag.operators import quantiles as q
from rankdiag.operators.quantiles import quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def expected(values, p):
    x = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not x:
        return None
    at = p * (len(x) - 1)
    a, b = x[math.floor(at)], x[math.ceil(at)]
    return a if a == b or math.isnan(a) else (1 - (at - math.floor(at))) * a + (at - math.floor(at)) * b


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12)))


def check(spark, rows, by):
    df = spark.createDataFrame(rows, "g string, h int, a double, b double").repartition(5)
    got = {tuple(r[c] for c in by): r for r in quantiles(df, ["a", "b"], PROBS, by).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(tuple(dict(zip("gh", r[:2], strict=True))[c] for c in by), []).append(r)
    assert set(got) == set(groups)
    for k, part in groups.items():
        for i, c in ((2, "a"), (3, "b")):
            want = [expected([r[i] for r in part], p) for p in PROBS]
            have = got[k][c] if got[k][c] is not None else [None] * len(PROBS)
            assert all(map(same, have, want)), (k, c, have, want)


def test_groups_columns_and_nulls(spark):
    r = random.Random(1)
    rows = [(r.choice(("x", "y", None)), r.choice((1, None)), r.choice((None, 0.0, r.gauss(0, 1e6), r.random())), float(r.randint(0, 3))) for _ in range(3000)]
    check(spark, rows, ["g"])
    check(spark, rows, [])
    check(spark, rows + [("z", 9, None, None)], ["g", "h"])


def test_neighbouring_doubles_and_extremes(spark):
    """Values that differ in their last bits, beyond any histogram; the largest, the least and what is not finite."""
    one = [1.0]
    for _ in range(5000):
        one.append(math.nextafter(one[-1], 2))
    rows = [("n", 1, v, -v) for v in one]
    rows += [("e", 1, v, w) for v, w in ((1.7e308, 5e-324), (-1.7e308, 1e-323), (0.0, 0.0), (1.0, -5e-324), (float("inf"), 1.0), (float("-inf"), 2.0), (float("nan"), float("nan")))] * 70
    check(spark, rows, ["g"])


def test_many_intervals_are_merged(spark, monkeypatch):
    monkeypatch.setattr(q, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(q, "BINS", 4)
    r = random.Random(3)
    check(spark, [(r.choice("abc"), 1, r.paretovariate(0.5), r.random()) for _ in range(900)], ["g"])


def test_as_percentile(spark):
    df = spark.range(20000).select((F.col("id") % 7).alias("g"), (F.rand(5) * 1e4).alias("v")).cache()
    want = {r["g"]: r["w"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("w")).collect()}
    got = {r["g"]: r["v"] for r in quantiles(df, ["v"], PROBS, ["g"]).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-14) for k in want)
    assert quantiles(df.limit(0), ["v"], PROBS, ["g"]).count() == 0
    assert quantiles(df.limit(0), ["v"], PROBS).first()["v"] is None
