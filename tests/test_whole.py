"""The queries read whole tables, whole arrays and whole graphs."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankdiag.operators import audit, diagnosis, export, graph, pool, ranking, suite
from rankdiag.plans.base import GROUP, line_candidates

SF = "/root/testdata/sf0.001"


def test_plan_reads_all_orders(spark):
    rows = duckdb.sql(f"SELECT DISTINCT o_orderpriority || o_orderstatus AS prompt, CAST(o_custkey % 12 AS VARCHAR) AS log FROM '{SF}/orders.parquet'").df()
    logs = rows.groupby("prompt")["log"].agg(set)
    got = {(r["a"], r["b"], r["c"]): r["shared"] for r in suite.QUERIES["triplet_counts"](spark, SF).collect()}
    assert got and all(n == sum(set(t) <= x for x in logs) for t, n in got.items())
    assert sum(got.values()) == sum(len(x) * (len(x) - 1) * (len(x) - 2) // 6 for x in logs)
    used, want = set(), {}
    for t in sorted((t for t in got if got[t] >= 2), key=lambda t: (-got[t], t)):
        if not used & set(t) and len(used) < 9:
            used |= set(t)
            want |= dict(zip(t, ("train", "validation", "test"), strict=True))
    assert {r["log"]: r["split"] for r in suite.QUERIES["three_way_plan"](spark, SF).collect()} == want


def test_box_feature_vectors(spark):
    """Against a projection by numpy with points on the edges that cross the near plane."""
    rows = {}
    for r in suite.QUERIES["box_feature_vector"](spark, SF).orderBy("vec_id", "i").collect():
        rows.setdefault(r["vec_id"], []).append(r["value"])
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    assert len(rows) == len(table)
    for i, e in table:
        x, y, z, yaw = e[0] * 10, e[1] * 10, e[12] * 10, e[13]
        size = [abs(e[k]) + 0.1 for k in (9, 10, 11)]
        sign = [(a, b, c) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)]
        p = np.array([(x + size[0] * a * np.cos(yaw) - size[1] * b * np.sin(yaw), y + size[0] * a * np.sin(yaw) + size[1] * b * np.cos(yaw), z + size[2] * c + 5) for a, b, c in sign])
        seen = [q for q in p if q[2] >= 0.1]
        for k in range(8):
            for m in range(k):
                if np.sum(np.array(sign[k]) != np.array(sign[m])) == 1 and (p[k, 2] >= 0.1) != (p[m, 2] >= 0.1):
                    seen.append(p[k] + (p[m] - p[k]) * (0.1 - p[k, 2]) / (p[m, 2] - p[k, 2]))
        box = None
        if seen:
            u = np.array([(q[0] * 100 / q[2] + 96, q[1] * 100 / q[2] + 60) for q in seen])
            lo, hi = np.maximum(u.min(0), 0), np.minimum(u.max(0), (192, 120))
            if np.prod(np.maximum(hi - lo, 0)) > 1:
                box = [lo[0] / 192, lo[1] / 120, hi[0] / 192, hi[1] / 120]
        want = [*(box or [0] * 4), float(box is not None), np.hypot(x, y) / 50, *[v / 10 for v in size], x / 50, y / 50, z / 50]
        assert np.allclose(rows[i], want, atol=1e-5), i
    assert len({r[4] for r in rows.values()}) == 2  # boxes in view and out of it


def test_zip_takes_every_position(spark):
    got = suite.QUERIES["positional_zip"](spark, SF).toPandas()
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    want = {(i, k, float(v), (i + k) % 3) for i, e in table for k, v in enumerate(e)}
    assert len(got) == len(want) and set(got[["vec_id", "pos", "value", "label"]].itertuples(index=False, name=None)) == want


def test_components_of_long_chains(spark):
    """A path whose least node is at its far end, and a chain of ids in random order."""
    path = [*range(1, 61), 0]
    ids = random.Random(3).sample(range(1000, 100000), 500)
    e = [*zip(path, path[1:]), *zip(ids, ids[1:]), (7000000, 7000000)]
    got = graph.components(spark.createDataFrame(e, "a long, b long")).collect()
    assert len(got) == 61 + 500 + 1
    assert dict(got) == dict.fromkeys(path, 0) | dict.fromkeys(ids, min(ids)) | {7000000: 7000000}
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(e, "a long, b long"), most=2)


def test_random_control_by_seed_and_view(spark):
    c = line_candidates(spark, SF)
    views = {"full": c, "score_matched": ranking.hard_negatives(c, 5000.0), "score_size_matched": ranking.hard_negatives(c, 5000.0, 0.2)}
    got = {(r["view"], r["seed"]): r for r in suite.QUERIES["control_suite_random"](spark, SF).collect()}
    assert got.keys() == {(v, s) for v in views for s in (0, 1)}
    for name, view in views.items():
        groups = [g.sort_values("track_id")["label"].tolist() for _, g in sorted(view.select(*GROUP, "track_id", "label").toPandas().groupby(list(GROUP)), key=lambda x: x[0])]
        for seed in (0, 1):
            ap, top = [], []
            for k, labels in enumerate(groups):
                order = [labels[i] for i in np.random.default_rng(seed + 1009 * k).permutation(len(labels))]
                if 0 in labels and (1 in labels or 2 in labels):
                    at = [i for i, x in enumerate(order) if x == 0]
                    ap.append(np.mean([(n + 1) / (i + 1) for n, i in enumerate(at)]))
                    top.append(order[0] == 0)
            r = got[name, seed]
            assert (r["groups"], r["rankable_groups"], r["control"]) == (len(groups), len(ap), "random")
            assert abs(r["mean_ap"] - np.mean(ap)) < 2e-6 and abs(r["recall_at_1"] - np.mean(top)) < 2e-6


def test_bootstrap_draws_as_many_samples_as_the_reference(spark):
    rows = [("a", "p", i, float(d)) for i, d in enumerate(np.random.default_rng(0).normal(size=40))]
    diffs = spark.createDataFrame(rows, "log_id string, prompt string, timestamp_ns long, difference double")
    assert ranking.paired_bootstrap(diffs).first() == ranking.paired_bootstrap(diffs, samples=10000).first()
    assert ranking.paired_bootstrap(diffs).first() != ranking.paired_bootstrap(diffs, samples=1000).first()


def test_keyed_permutations(spark):
    """Each is a permutation of its whole domain, undone by its inverse, and another for another seed."""
    for bits in (1, 2, 5):
        df = spark.range(4**bits).select("id", *[export.permuted(F.col("id"), s, bits).alias(f"s{s}") for s in (0, 1, 2)])
        df = df.withColumn("back", export.permuted(F.col("s1"), 1, bits, inverse=True))
        got = df.toPandas()
        assert all(sorted(got[f"s{s}"]) == list(range(4**bits)) for s in (0, 1, 2)) and (got["back"] == got["id"]).all()
        assert bits < 5 or (got["s0"] != got["s1"]).mean() > 0.9
    huge = spark.range(2**61, 2**61 + 50).select("id", export.permuted(F.col("id"), 5, 31).alias("p")).withColumn("back", export.permuted(F.col("p"), 5, 31, inverse=True)).toPandas()
    assert (huge["back"] == huge["id"]).all() and huge["p"].between(0, 2**62 - 1).all()
    assert [export.half_bits(n) for n in (0, 1, 2, 4, 5, 16, 17, 2**62)] == [1, 1, 1, 1, 2, 2, 3, 31]


@pytest.mark.parametrize("n", [1, 3, 40, 200])
def test_a_prefix_of_the_keyed_order(spark, n):
    keys = spark.createDataFrame([(f"l{i:03}", "p", i) for i in range(n)], "log_id string, prompt string, timestamp_ns long")
    bits = export.half_bits(n)
    place = {r["id"]: r["p"] for r in spark.range(n).select("id", export.permuted(F.col("id"), 9, bits).alias("p")).collect()}
    want = sorted(place, key=place.get)
    for count in (1, 7, 300):
        got = export.sample_groups_keyed(keys, count, 9).orderBy("place").collect()
        assert [(r["timestamp_ns"], r["place"]) for r in got] == [(g, i) for i, g in enumerate(want[:count])]


def test_the_report_holds_all_parts(spark):
    """Each part's rows come back under its name, key and metric."""
    got = {(r["part"], r["key"], r["metric"]): r["value"] for r in suite.QUERIES["diagnose_split_report"](spark, SF).collect()}
    assert {k[0] for k in got} == set(diagnosis.PARTS)
    flags = suite.QUERIES["diagnose_split"](spark, SF).first()
    assert got["flags", "", "visibility_gap_flag"] == str(flags["visibility_gap_flag"]).lower()
    for r in suite.QUERIES["label_feature_distributions"](spark, SF).collect():
        for m in ("count", "median", "q75"):
            have = got.get(("features", f"{r['feature']}|{r['label_name']}", m))
            assert have is None if r[m] is None else float(have) == float(r[m])


def test_an_empty_table_misses_nothing(spark):
    names = "log_id string, prompt string, timestamp_ns long, track_id string, score double, label int, translation_m array<double>, size array<double>, yaw double, match_status string, projection_status string, image_path string, distance_m double, is_drivable boolean, is_positive boolean, name string, _row_ord long"
    assert audit.inspect_records(spark.createDataFrame([], names)).first()["missing_required"] == 0
    assert audit.forbidden_counts(spark.createDataFrame([(1,)], "x int")).count() == 0


def test_source_pools_by_hand(spark):
    """Objects that are not finite, too far, outside or without a pose go; the observer's row comes for each pose."""
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    ok = ("a", 1, "7", "BUS", [3.0, 4.0, 0.0], [1.0, 1.0, 1.0], eye, 0.5, True)
    change = lambda **k: tuple(k.get(n, v) for n, v in zip("log_id t track name at size rot score roi".split(), ok, strict=True))
    rows = [ok, change(track="1", size=[1.0, 0.0, 1.0]), change(track="2", at=[float("nan"), 0.0, 0.0]), change(track="3", rot=[[float("inf"), 0.0, 0.0], *eye[1:]]), change(track="4", score=None),
            change(track="5", roi=None), change(track="6", at=[80.0, 0.0, 0.0]), change(log_id="b"), change(track="8", at=[1.0, 2.0, 9.0])]
    o = spark.createDataFrame(rows, "log_id string, timestamp_ns long, track_id string, name string, translation_m array<double>, size array<double>, rotation array<array<double>>, score double, roi boolean")
    poses = spark.createDataFrame([("a", 1, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 0.0), ("c", 5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "log_id string, timestamp_ns long, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    got = {(r["log_id"], r["track_id"]): (r["candidate_ordinal"], round(r["distance_m"], 6), r["synthetic_ego"]) for r in pool.build_source_pool(o, poses).collect()}
    assert got == {("a", "7"): (0, round(8**0.5, 6), False), ("a", "8"): (1, 0.0, False), ("a", "ego"): (2, 0.0, True), ("c", "ego"): (0, 0.0, True)}
    chosen = spark.createDataFrame([("a", 8)], "log_id string, track_id long")
    assert {r["track_id"] for r in pool.build_source_pool(o, poses, selected=chosen, ego=False).collect()} == {"8"}


def test_checkpoints_are_cleaned(spark):
    df = graph._checkpoint(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert os.listdir(at)
    graph.clean_checkpoints(spark)
    assert os.listdir(at) == []
    assert graph._checkpoint(spark.range(3).toDF("x")).count() == 3  # the folder itself stays
