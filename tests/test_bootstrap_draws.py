"""The paired bootstrap's draws: shared by a group's differences, and the same whatever the number of groups in a batch."""

import hashlib

import numpy as np
import pytest

from rankdiag.operators import ranking


@pytest.mark.parametrize("groups", [1, 64, 65, 129])
def test_draws_by_hand(spark, groups):
    rows = [("l", "p", i, k, float(i * 7 % 5) - (k == "x")) for i in range(groups) for k in ("x", None)]
    diffs = spark.createDataFrame(rows, "log_id string, prompt string, timestamp_ns long, kind string, difference double").coalesce(1)
    got = {r["kind"]: r for r in ranking.paired_bootstrap(diffs.where("kind = 'x'"), 50, by=["kind"]).collect()}
    digest = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:12], 16)
    a = [1 + digest(f"a|0|{s}") % (ranking.PRIME - 1) for s in range(50)]
    b = [digest(f"b|0|{s}") % ranking.PRIME for s in range(50)]
    h = [digest(f"l|p|{i}") % ranking.PRIME for i in range(groups)]
    w = np.array([[sum((x * k + y) % ranking.PRIME >= e for e in ranking.POISSON) for k in h] for x, y in zip(a, b, strict=True)], float)
    d = np.array([r[4] for r in rows if r[3] == "x"])
    with np.errstate(invalid="ignore"):
        m = (w @ d) / w.sum(1)
    m = m[np.isfinite(m)]
    assert got["x"]["groups"] == groups and abs(got["x"]["low"] - np.quantile(m, 0.025)) < 1e-5 and abs(got["x"]["high"] - np.quantile(m, 0.975)) < 1e-5


def test_seeds_are_compared_without_a_join(spark):
    rows = [(s, "test", m, "l", "p", i, float(i % 3) + (m == "a"), None if i == 2 else 1.0) for s in (0, 1) for m in ("a", "b", "c") for i in range(5)]
    metrics = spark.createDataFrame(rows, "seed long, split string, model string, log_id string, prompt string, timestamp_ns long, u double, v double")
    got = ranking.compare_seeds(metrics, ["a"], ["b", "c"], ["u", "v"], samples=20)
    told = {(r["baseline"], r["metric"], r["seed"]): (r["groups"], r["mean_difference"]) for r in got.collect()}
    assert told == {(x, m, s): ((5, 1.0) if m == "u" else (4, 0.0)) for x in "bc" for m in "uv" for s in (0, 1)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # that of means and intervals
