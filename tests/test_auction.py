"""The auction against the exact solver, and groups that go to it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankdiag.operators import assoc, auction


def points(r, n, kind):
    p = r.normal(size=(n, 2)) * 10
    return np.round(p) if kind == "ties" else p * 0 if kind == "one" else p


@pytest.mark.parametrize("kind", ["plain", "ties", "one"])
@pytest.mark.parametrize("n,m", [(1, 1), (1, 6), (2, 2), (9, 9), (15, 40), (60, 60), (80, 95)])
def test_auction(n, m, kind):
    r = np.random.default_rng(n + m)
    a, b = points(r, n, kind), points(r, m, kind)
    held, gap = auction.auction(a, b)
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    assert len(set(held)) == n and held.min() >= 0
    assert abs(d[np.arange(n), held].sum() - d[np.arange(n), assoc.solve(d)].sum()) < 1e-6 and -1e-9 < gap < 1e-6


def test_bids_on_executors_are_the_same(spark, monkeypatch):
    r = np.random.default_rng(2)
    a, b, price = r.normal(size=(300, 2)), r.normal(size=(310, 2)), r.random(310)
    here = auction.best_two(a, b, price)
    monkeypatch.setattr(auction, "SPREAD_PAIRS", 0)
    monkeypatch.setattr(auction, "BLOCK_PAIRS", 9000)
    assert all(np.array_equal(x, y) for x, y in zip(here, auction.spread(spark)(a, b, price), strict=True))
    assert len(auction.auction(np.zeros((0, 2)), b)[0]) == 0


def test_large_groups_cost_the_same(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = lambda n, names: [(f"l{i % 2}" if i % 5 else None, i % 3, i, names[i % len(names)], float(x), float(y)) for i, (x, y) in enumerate(r.normal(size=(n, 2)) * 3)]
    schema = "log_id string, timestamp_ns long, id long, name string, x double, y double"
    a, b = spark.createDataFrame(rows(150, ["BUS", "DOG", "SIGN"]), schema).cache(), spark.createDataFrame(rows(170, ["TRUCK", "SIGN"]), schema).cache()
    for x, y in ((a, b), (b, a)):
        every = assoc.associate_then_filter(x, y, 1e9).collect()
        near = assoc.associate_then_filter(x, y, 2.0).collect()
        monkeypatch.setattr(assoc, "LARGE_PAIRS", 20)
        got = assoc.associate_then_filter(x, y, 1e9).collect()
        total = lambda f: {k: (sum((r["log_id"], r["timestamp_ns"]) == k for r in f), round(sum(r["distance"] for r in f if (r["log_id"], r["timestamp_ns"]) == k), 5)) for k in {(r["log_id"], r["timestamp_ns"]) for r in f}}
        assert total(got) == total(every)
        assert {(r["cand"], r["gt"]) for r in assoc.associate_then_filter(x, y, 2.0).collect()} == {(r["cand"], r["gt"]) for r in near}
        monkeypatch.setattr(assoc, "LARGEST_POINTS", 3)
        with pytest.raises(ValueError):
            assoc.associate_then_filter(x, y, 2.0)
        monkeypatch.undo()
    assert assoc.associate_then_filter(a.where(F.lit(False)), b, 2.0).count() == 0
