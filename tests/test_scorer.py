"""Training over all groups on the executors, against a replay on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankdiag.operators import scorer


def rows(spark, mode, n=240):
    r = np.random.default_rng(3)
    made = []
    for i in range(n):
        g = int(r.integers(0, 14))
        label = [0, 1, 2, None][int(r.integers(0, 4))] if g < 12 else (1 if g == 12 else None)
        made.append((f"l{g % 3}", None if g == 5 else "p", g, label, r.normal(size=5).tolist(), int(r.integers(0, 3)), int(r.integers(0, 4)), r.normal(size=7).tolist(), r.normal(size=6).tolist()))
    return spark.createDataFrame(made, "log_id string, prompt string, timestamp_ns long, label int, candidate array<double>, category int, prompt_id int, image array<double>, text array<double>")


def replay(df, w, epochs, steps, rate, seed):
    group = ["log_id", "prompt", "timestamp_ns"]
    told = df.withColumn("h", F.xxhash64(*group))
    for e in range(epochs):
        told = told.withColumn(f"s{e}", F.pmod(F.xxhash64("h", F.lit(seed), F.lit(e)), F.lit(steps)))
    groups = {}
    for r in told.collect():
        if r["label"] is not None:
            groups.setdefault(tuple(r[c] for c in group), []).append(r)
    groups = [g for g in groups.values() if 0 < sum(r["label"] == 0 for r in g) < len(g)]
    w = {k: a.copy() for k, a in w.items()}
    by, losses = scorer._AdamW(w, rate, 1e-4), []
    arr = lambda g, c: np.array([r[c] for r in g])
    for e in range(epochs):
        means = []
        for s in range(steps):
            own = [g for g in groups if g[0][f"s{e}"] == s]
            if own:
                got = []
                for g in own:
                    more = {"category": arr(g, "category")}
                    if "image" in w:
                        more |= {"image": arr(g, "image")} | ({"prompt": arr(g, "prompt_id")} if "prompt" in w else {"text": arr(g, "text")})
                    got.append(scorer.gradients(arr(g, "candidate"), (arr(g, "label") == 0).astype(float), w, **more))
                by.step({k: np.mean([x[1][k] for x in got], 0) for k in w})
                means.append(np.mean([x[0] for x in got]))
        losses.append(np.mean(means))
    return w, losses


@pytest.mark.parametrize("mode,steps,sums", [("candidate_only", 1, 64), ("task_id", 5, 64), ("pooled_pe", 3, 2)])
def test_training_over_groups(spark, mode, steps, sums, monkeypatch):
    monkeypatch.setattr(scorer, "SUMS", sums)
    df = rows(spark, mode).repartition(5).cache()
    first = scorer.start(5, 3, mode, 4, 7, 6)
    w, losses = scorer.train_rows(df, first, epochs=3, steps=steps, rate=1e-2, seed=4)
    want, told = replay(df, first, 3, steps, 1e-2, 4)
    assert np.allclose(losses, told, atol=1e-9) and w.keys() == want.keys()
    assert all(np.allclose(w[k], want[k], atol=1e-8) for k in want) and not np.allclose(w["head"], first["head"])


def test_one_group_a_step_is_train_groups(spark):
    """With a single rankable group both take the same steps."""
    df = rows(spark, "candidate_only").where("timestamp_ns in (1, 12, 13)").cache()
    first = scorer.start(5, 3)
    w, losses = scorer.train_rows(df, first, epochs=4, steps=3, rate=1e-2)
    local = df.toPandas()
    want, told = scorer.train_groups(np.array(local["candidate"].tolist()), local["label"].to_numpy(float), local["timestamp_ns"].to_numpy(), 4, 1e-2, weights=first, category=local["category"].to_numpy())
    assert np.allclose(losses, told) and all(np.allclose(w[k], want[k], atol=1e-8) for k in want)


def test_nothing_to_train(spark):
    df = rows(spark, "candidate_only").where("timestamp_ns > 11")
    first = scorer.start(5, 3)
    w, losses = scorer.train_rows(df, first, epochs=1, steps=2)
    assert np.isnan(losses[0]) and all((w[k] == first[k]).all() for k in w)
