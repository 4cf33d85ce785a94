import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankdiag.functions import scalars as fn
from rankdiag.operators import assoc, audit, gated, graph, pool, ranking
from rankdiag.plans.base import CANDIDATE

SCHEMA = "log_id string, prompt string, timestamp_ns long, track_id string, name string, score double, distance_m double, area double, label int"


def cands(spark, rows):
    return spark.createDataFrame([("a", "p", 1, str(i), "n", float(s), 1.0, float(area), label) for i, (s, area, label) in enumerate(rows)], SCHEMA)


def metrics(spark, rows, control="tracker_score"):
    return ranking.group_metrics(ranking.rank(cands(spark, rows), [control])).first()


def test_unknown_candidate_holds_a_rank(spark):
    m = metrics(spark, [(0.99, 1, None), (0.80, 1, 0), (0.10, 1, 1)])
    assert (m["average_precision"], m["labeled_average_precision"], m["unknown_count"]) == (0.5, 1.0, 1)


def test_oracle(spark):
    m = metrics(spark, [(0.9, 1, 2), (0.1, 1, 0)], "oracle")
    assert (m["average_precision"], m["recall_at_1"]) == (1.0, 1)


def test_no_positive_gives_null(spark):
    m = metrics(spark, [(0.9, 1, 2), (0.1, 1, None)])
    assert m["average_precision"] is None and m["recall_at_1"] is None


def test_missing_score_ranks_last(spark):
    m = metrics(spark, [(float("nan"), 1, 0), (-5.0, 1, 1)])
    assert m["average_precision"] == 0.5


def test_hard_negatives(spark):
    c = cands(spark, [(0.50, 100, 0), (0.52, 121, 1), (0.10, 10000, 2), (0.51, 100, None)])
    assert {r["track_id"] for r in ranking.hard_negatives(c, 0.05).collect()} == {"0", "1"}
    assert {r["track_id"] for r in ranking.hard_negatives(c, 0.05, 0.2).collect()} == {"0", "1"}
    assert ranking.hard_negatives(cands(spark, [(0.5, 1, 1)]), 0.05).count() == 0


def hard(spark, rows, *deltas):
    df = spark.createDataFrame([("a", "p", 1, str(i), "n", s, 1.0, area, label) for i, (s, area, label) in enumerate(rows)], SCHEMA)
    return {r["track_id"] for r in ranking.hard_negatives(df, *deltas).collect()}


def test_hard_negatives_keep_positives_without_a_score(spark):
    assert hard(spark, [(0.5, 1.0, 0), (None, 1.0, 0), (float("nan"), 1.0, 0), (0.51, 1.0, 1), (None, 1.0, 2)], 0.05) == {"0", "1", "2", "3"}
    assert hard(spark, [(None, 1.0, 0), (0.5, 1.0, 1)], 0.05) == set()  # no positive to be near to


def test_a_missing_area_is_none(spark):
    assert hard(spark, [(0.5, 0.0, 0), (0.51, None, 1), (0.52, 9.0, 1)], 0.05, 0.2) == {"0", "1"}
    assert hard(spark, [(0.5, None, 0), (0.51, 0.1, 1)], 0.05, 0.2) == {"0", "1"}
    assert hard(spark, [(0.5, 5.0, 0), (None, 100.0, 0), (0.51, 100.0, 1)], 0.05, 0.2) == set()  # only a positive with a score is an anchor


def test_null_names_are_counted_as_one(spark):
    rows = [("a", "p", 1, str(i), n, 0.0, 1.0, 1.0, 0 if n else 1) for i, n in enumerate([None, "x", "x", "x", "y", "y"])]
    got = ranking.rank(spark.createDataFrame(rows, SCHEMA), ["category_frequency"]).collect()
    assert {r["track_id"]: r["rank"] for r in got} == {"1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "0": 6}


def test_groups_with_a_null_key(spark):
    rows = [(None, "p", 1, str(i), "n", float(i), 1.0, 1.0, i % 2) for i in range(4)] + [("a", None, 2, "9", "n", 0.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ranking.rank_random(df, (0,)).collect()
    assert len(got) == 5 and {r["log_id"] for r in got} == {None, "a"}
    order = np.random.default_rng(0).permutation(4)  # nulls come first
    assert {r["track_id"]: r["rank"] for r in got if r["log_id"] is None} == {str(k): i + 1 for i, k in enumerate(order)}
    m = ranking.group_metrics(ranking.rank(df, ["oracle"]))
    assert ranking.paired_differences(m, m, "average_precision").count() == 2


def test_the_seeded_suite_by_brute_force(spark):
    """All controls, views and seeds; ties by numpy's permutation of rows as they come, groups as they first appear."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(400):
        g = int(r.integers(0, 12))
        label = [0, 1, 2, None][int(r.integers(0, 4))]
        score = None if r.random() < 0.1 else float(r.integers(0, 4)) / 10
        rows.append((f"l{9 - g % 3}", ("q", None)[g % 2], g // 6, f"t{i % 7}", ("a", "b", None)[int(r.integers(0, 3))], score, float(r.integers(0, 3)), float(r.integers(0, 4)) * 50, label, i))
    df = spark.createDataFrame(rows, SCHEMA + ", _row_ord long").repartition(5)
    got = {(x["view"], x["control"], x["seed"]): x for x in ranking.seeded_control_suite(df, 0.05, 0.2).collect()}
    groups = {}
    for x in rows:
        groups.setdefault(x[:3], []).append(dict(zip("track name score dist area label".split(), x[3:9], strict=True)))
    freq = {}
    for x in rows:
        freq[x[4]] = freq.get(x[4], 0) + 1

    def part(rows_, delta):
        anchors = [x for x in rows_ if x["label"] == 0 and x["score"] is not None]
        size = lambda x: np.log1p(x["area"])
        near = lambda x: any(abs(x["score"] - a["score"]) <= 0.05 for a in anchors) and (delta is None or any(abs(size(x) - size(a)) <= delta for a in anchors))
        out = [x for x in rows_ if anchors and (x["label"] == 0 or (x["label"] in (1, 2) and x["score"] is not None and near(x)))]
        return out if any(x["label"] == 0 for x in out) and any(x["label"] in (1, 2) for x in out) else []

    key = {"random": lambda x: 0, "oracle": lambda x: x["label"] != 0, "tracker_score": lambda x: -x["score"] if x["score"] is not None else float("inf"), "candidate_distance": lambda x: x["dist"],
           "projected_box_area": lambda x: -x["area"], "category_frequency": lambda x: -freq[x["name"]]}
    for view, f in (("full", lambda g: g), ("score_matched", lambda g: part(g, None)), ("score_size_matched", lambda g: part(g, 0.2))):
        own = [g for g in map(f, groups.values()) if g]
        for seed in (0, 1):
            for control, by in key.items():
                ap, first, n_pos, n_neg = [], [], [], []
                for k, g in enumerate(own):
                    place = {int(i): p for p, i in enumerate(np.random.default_rng(seed + 1009 * k).permutation(len(g)))}
                    labels = [g[i]["label"] for i in sorted(range(len(g)), key=lambda i: (by(g[i]), place[i]))]
                    n_pos.append(labels.count(0))
                    n_neg.append(labels.count(1) + labels.count(2))
                    if n_pos[-1] and n_neg[-1]:
                        at = [i for i, x in enumerate(labels) if x == 0]
                        ap.append(np.mean([(n + 1) / (i + 1) for n, i in enumerate(at)]))
                        first.append(labels[0] == 0)
                x = got.pop((view, control, seed))
                assert (x["groups"], x["rankable_groups"]) == (len(own), len(ap))
                want = [np.mean(v) for v in (ap, first, n_pos, n_neg)]
                assert np.allclose([x["mean_ap"], x["recall_at_1"], x["mean_positives"], x["mean_negatives"]], want, atol=2e-6), (view, control, seed)
    assert not got


def test_rank_does_not_depend_on_partitions(spark):
    c = cands(spark, [(i % 3, i, [0, 1, 2, None][i % 4]) for i in range(40)])
    one, many = (ranking.group_metrics(ranking.rank(c.repartition(k))).orderBy("control").collect() for k in (1, 8))
    assert one == many


@pytest.mark.parametrize("text,want", [("Pedestrian 17 at 12.5m", "pedestrian <num> at <num>m"), (None, ""), ("", ""), ("a17  b", "a17 b")])
def test_template_key(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fn.template_key(df["t"])).first()[0] == want


def test_digest_mod10(spark):
    import hashlib

    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    df = spark.createDataFrame([(x,) for x in h], "h string")
    assert [r[0] for r in df.select(fn.digest_mod10(df["h"])).collect()] == [int(x, 16) % 10 for x in h]


def test_solver_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 3), (3, 3), (4, 5)):
        c = rng.random((n, m))
        got = c[np.arange(n), assoc.solve(c)].sum()
        assert abs(got - min(c[np.arange(n), list(p)].sum() for p in permutations(range(m), n))) < 1e-12


def side(spark, rows, frame=("log", 1)):
    return spark.createDataFrame([(*frame, i, k, float(x), 0.0) for i, k, x in rows], "log_id string, timestamp_ns long, id long, name string, x double, y double")


def test_ambiguous_match(spark):
    got = assoc.associate(side(spark, [(0, "bus", 0), (1, "BOX_TRUCK", 0.1)]), side(spark, [(0, "TRUCK ", 0.05)]), 2.0).collect()
    assert len(got) == 1 and got[0]["ambiguous"]


def test_unique_match_with_alternatives(spark):
    got = assoc.associate(side(spark, [(0, "P", 0), (1, "P", 1.9)]), side(spark, [(0, "P", 0.1), (1, "P", 3.0)]), 2.0).collect()
    assert {(r["cand"], r["gt"]) for r in got} == {(0, 0), (1, 1)}
    assert not any(r["ambiguous"] for r in got) and any(r["multiple_valid_edges"] for r in got)


def test_frames_and_groups_do_not_mix(spark):
    a = side(spark, [(0, "bus", 0)], ("log1", 1)).unionByName(side(spark, [(1, "bus", 0)], ("log2", 9)))
    b = side(spark, [(0, "bus", 0)], ("log2", 9)).unionByName(side(spark, [(1, "bus", 0.1)], ("log2", 1))).unionByName(side(spark, [(2, "ANIMAL", 0)], ("log1", 1)))
    assert [(r["log_id"], r["timestamp_ns"], r["cand"], r["gt"]) for r in assoc.associate(a, b, 2.0).collect()] == [("log2", 9, 1, 0)]
    assert [(r["cand"], r["gt"]) for r in assoc.associate_then_filter(a, b, 2.0).collect()] == [(1, 0)]


def test_post_filter_keeps_groups_apart(spark):
    a = side(spark, [(0, "P", 0), (1, "P", 10), (2, "bus", 0.1), (3, "truck", 50)])
    b = side(spark, [(0, "P", 0.05), (1, "P", 10.1), (2, "bus", 3.0), (3, "BUS", 50.5)])
    pairs = lambda **k: {(r["cand"], r["gt"]) for r in assoc.associate_then_filter(a, b, 2.0, **k).collect()}
    assert pairs() == {(0, 0), (1, 1), (3, 3)} and pairs(taxonomy=False) == {(0, 0), (1, 1)}


def test_ambiguity_by_one_solve_is_that_of_all_solves():
    """Against forbidding each pair and solving again, with many equal distances."""
    rng = np.random.default_rng(5)
    vague = 0
    for _ in range(300):
        n, m = rng.integers(1, 7, 2)
        d = rng.integers(0, 4, (n, m)).astype(float)
        valid = (rng.random((n, m)) < 0.6) & (d <= 2)
        pairs, got = assoc.gated_with_ambiguity(d, valid, 2.0)
        total = sum(d[p] for p in pairs)
        want = set()
        for i, j in pairs:
            other = valid.copy()
            other[i, j] = False
            again = assoc.gated(d, other, 2.0)
            if len(again) == len(pairs) and sum(d[p] for p in again) <= total + 1e-9:
                want.add(i)
        assert got == want
        vague += len(want)
    assert vague > 100


def test_large_frames_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, "P", float(x)) for i, x in enumerate(rng.uniform(0, 60, 80))]
    a, b = side(spark, rows[::2]), side(spark, rows[1::2])
    small = sorted(map(tuple, assoc.associate(a, b, 1.0).collect()))
    monkeypatch.setattr(assoc, "FRAME_EDGES", 1)
    assert sorted(map(tuple, assoc.associate(a, b, 1.0).collect())) == small and len(small) > 10


def test_sensitivity_by_hand(spark):
    a = side(spark, [(0, "P", 0), (1, "P", 5), (2, "P", 9)])
    b = side(spark, [(0, "P", 0.5), (1, "P", 6.5), (2, "P", 9), (3, "P", 9)])
    groups = spark.createDataFrame([("log", 1, "q"), ("log", 1, "r"), ("log", 1, "none")], "log_id string, timestamp_ns long, prompt string")
    wanted = spark.createDataFrame([("log", 1, "q", 1), ("log", 1, "r", 2), ("log", 1, "r", 3)], "log_id string, timestamp_ns long, prompt string, gt long")
    got = {r["threshold"]: r for r in assoc.sensitivity(assoc.edges(a, b, 4.0), groups, wanted).collect()}
    assert (got[1.0]["groups"], got[1.0]["confirmed_recall"], got[1.0]["recall_including_ambiguous"]) == (2, 0.0, 0.5)
    assert (got[2.0]["confirmed_recall"], got[2.0]["recall_including_ambiguous"]) == (0.5, 1.0)
    assert (got[1.0]["assigned"], got[1.0]["ambiguous"], got[1.0]["multiple_valid_edges"]) == (4, 2, 2)
    with pytest.raises(Exception, match="at least one"):
        assoc.matching_range(spark.createDataFrame([], "v double"), "v").collect()


def test_triplets_and_plan(spark):
    pairs = [(p, x) for p in ("p1", "p2") for x in "abc"] + [(p, x) for p in ("p3", "p4") for x in "def"]
    t = graph.disjoint_triplets(spark.createDataFrame(pairs, "prompt string, log string"))
    assert t == [("a", "b", "c"), ("d", "e", "f")]
    assert graph.three_way_plan(t)["train"] == ["a", "d"]
    with pytest.raises(ValueError):
        graph.three_way_plan([("a", "b")])
    assert graph.check_disjoint({"train": ["a", "b"], "val": ["b"], "test": ["c"]}) == ["train/val: b"]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30), (40, 50)], "a long, b long")
    roots = dict(graph.components(e).collect())
    assert set(roots[i] for i in range(21)) == {0} and {roots[i] for i in (30, 40, 50)} == {30}


def test_decisions(spark):
    s = "infrastructure_complete boolean, availability double, projection double, stability double, best_control double, oracle_availability double, oracle_projection double"
    rows = [
        (True, 0.9, 0.95, 0.05, 0.5, None, None),
        (True, 0.5, 0.95, 0.05, 0.5, 0.9, 0.95),
        (False, 0.9, 0.95, 0.05, 0.5, 0.9, 0.95),
        (True, 0.9, 0.95, 0.05, 0.95, 0.9, 0.95),
        (True, 0.9, 0.5, 0.05, 0.5, 0.9, 0.95),
        (True, 0.9, 0.5, 0.05, 0.5, 0.1, 0.95),
    ]
    got = [r["decision"] for r in audit.audit_gate(spark.createDataFrame(rows, s).coalesce(1)).collect()]
    assert got == [audit.GATE_READY, audit.REVIEW, audit.OTHER_SOURCE, audit.BRANCH_STOPPED, audit.ORACLE_ONLY, audit.BRANCH_STOPPED]
    t = spark.createDataFrame([("test", 100, ["control_dominance"]), ("val", 60, [])], "split string, rankable_groups long, reasons array<string>")
    assert audit.decide_report(t).first()["decision"] == audit.REPAIR
    assert audit.decide_report(t.where("split = 'val'")).first()["decision"] == audit.CONTINUES
    assert audit.decide_report(t, 80).first()["decision"] == audit.BRANCH_STOPPED


def test_membership_ignores_order_and_labels(spark):
    p = spark.createDataFrame([("a", i, i * 0.5) for i in range(30)], "log_id string, id long, x double")
    one = pool.membership(p, ["log_id"], ["id", "x"]).first()
    two = pool.membership(p.withColumn("label", p["id"] % 3).repartition(5), ["log_id"], ["id", "x"]).first()
    assert one == two


def test_membership_tells_members_apart(spark):
    """Commas in fields, nulls at different places, members that repeat, and arrays."""
    s = "g int, a string, b string, c string, v array<double>"
    pools = [[("a", "b,c", "d", [1.0])], [("a,b", "c", "d", [1.0])], [("a", None, "c", [1.0])], [("a", "c", None, [1.0])], [("n", "c", "", [1.0])], [(None, "c", "", [1.0])], [("1:a", "", "c", [1.0])], [("1", ":a", "c", [1.0])],
             [("a", "b", "c", [1.0, 2.0])], [("a", "b", "c", [1.0, None])], [("a", "b", "c", [])], [("a", "b", "c", None)], [("a", "b", "c", [12.0])], [("x", "y", "z", None)] * 2, [("x", "y", "z", None)]]
    df = spark.createDataFrame([(g, *m) for g, p in enumerate(pools) for m in p], s).repartition(4)
    got = {r["g"]: (r["digest"], r["members"]) for r in pool.membership(df, ["g"], ["a", "b", "c", "v"]).collect()}
    assert len(set(got.values())) == len(pools) and got[13][1] == 2
    import hashlib

    texts = ["1:x1:y1:zn"] * 2
    lanes = [sum(int(hashlib.sha256(t.encode()).hexdigest()[16 * i : 16 * i + 16], 16) for t in texts) for i in range(4)]
    assert got[13][0] == hashlib.sha256(",".join(map(str, [2, *lanes])).encode()).hexdigest()


def test_empty_group_table(spark):
    g = spark.createDataFrame([], "gt_positive_count long, matched_positive_count long, eligible_positive_count long, projected_positive_count long, unknown_count long, candidate_count long")
    got = audit.coverage(g).first()
    assert len(got) == 18 and got["positive_availability_all_groups"] is None and got["group_count"] == 0 == got["candidate_row_count"]


def test_candidate_columns(spark):
    assert len(CANDIDATE) == len(set(CANDIDATE)) == 9


def test_plan_problems_and_strict_exit(spark):
    g = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train")], "log string, split string")
    p = spark.createDataFrame([("a", "train"), ("b", "train")], "log string, split string")
    assert {(r["log"], r["problem"]) for r in audit.plan_problems(g, p).collect()} == {("b", "mismatched"), ("c", "absent")}
    audit.require_log_disjoint(g)
    with pytest.raises(ValueError):
        audit.require_log_disjoint(g.unionByName(spark.createDataFrame([("a", "test")], "log string, split string")))
    status = lambda n, ok, again: audit.verifier_status(spark.createDataFrame([(n, ok, again)], "record_count long, fixed_frame_ranking_feasible boolean, duplicate_candidate_key_count long")).first()
    assert status(0, False, 0)["status"] == "not_ready" and status(0, False, 0)["exit_code"] == 2
    assert status(1, True, 0)["exit_code"] == 0
    assert status(1, True, 2)["warnings"] == ["duplicate_candidate_key_count"]
    assert audit.forbidden_features(["score", "name", "label"]) == ["label", "name"]


@pytest.mark.parametrize("mode", ["candidate_only", "metadata_only", "task_id", "pooled_pe"])
def test_scorer_gradients_and_training(mode):
    from rankdiag.operators import scorer

    r = np.random.default_rng(0)
    x, y = r.normal(size=(40, 5)), (r.random(40) < 0.5).astype(float)
    more = {"category": r.integers(0, 3, 40)}
    if mode in ("task_id", "pooled_pe"):
        more["image"] = r.normal(size=(40, 7))
        more |= {"prompt": r.integers(0, 4, 40)} if mode == "task_id" else {"text": r.normal(size=(40, 6))}
    w = scorer.start(5, 3, mode, 4, 7, 6)
    _, g = scorer.gradients(x, y, w, **more)
    assert g.keys() == w.keys()
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        up, down = ({n: a.copy() for n, a in w.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        slope = (scorer.gradients(x, y, up, **more)[0] - scorer.gradients(x, y, down, **more)[0]) / 2e-4
        assert abs(slope - g[k][at]) < 1e-4, k
    _, losses = scorer.train(x, y, 100, 1e-2, weights=w, **more)
    assert losses[-1] < losses[0]
    with pytest.raises(ValueError):
        scorer.start(5, mode="other")


def test_label_zip_and_group_problems(spark):
    rows = spark.createDataFrame([("a", str(i)) for i in (2, 10, 1)], "log_id string, track_id string")
    groups = spark.createDataFrame([("a", [0, None, 2], 3)], "log_id string, labels array<int>, candidate_count long")
    got = {r["track_id"]: r["label"] for r in pool.zip_labels(rows, groups, ["log_id"], "track_id").collect()}
    assert got == {"1": 0, "10": None, "2": 2}
    ok = groups.join(pool.membership(rows, ["log_id"], ["track_id"]).select("log_id", "digest"), "log_id")
    assert pool.source_group_problems(rows, ok, ["log_id"], "track_id", ["track_id"]).count() == 0
    from pyspark.sql import functions as F

    bad = pool.source_group_problems(rows, ok.withColumn("digest", F.lit("wrong")), ["log_id"], "track_id", ["track_id"]).first()
    assert bad["problem"] == "digest differs"


def test_box_features(spark):
    from pyspark.sql import functions as F

    s = "box array<double>, w double, h double, d double, size array<double>, t array<double>"
    df = spark.createDataFrame([([0.0, 0.0, 960.0, 600.0], 1920.0, 1200.0, 25.0, [1.0, 2.0, 3.0], [5.0, 0.0, 0.0]), (None, 10.0, 10.0, None, None, None)], s)
    got = [r[0] for r in df.select(fn.box_features(*[F.col(c) for c in ("box", "w", "h", "d", "size", "t")])).collect()]
    assert got[0] == [0, 0, 0.5, 0.5, 1, 0.5, 0.1, 0.2, 0.3, 0.1, 0, 0] and got[1] == [0.0] * 12
    with pytest.raises(Exception, match="positive"):
        df.select(fn.box_features(F.col("box"), F.lit(0.0), F.col("h"), F.col("d"), F.col("size"), F.col("t"))).collect()


def test_taxonomy(spark):
    df = spark.createDataFrame([("box_truck ",), ("LARGE_VEHICLE",), ("Stroller",), ("sign",)], "n string")
    assert [r[0] for r in df.select(fn.taxonomy_group(df["n"])).collect()] == ["VEHICLE", "VEHICLE", "WHEELED_DEVICE", "SIGN"]


def test_baseline_gate(spark):
    rows = [(k, m, *v) for k in (0, 1) for m, v in (("pooled", (0.2, 0.2, 0.05)), ("task_id", (0.1, 0.1, 0.04)), ("metadata", (0.15, 0.1, 0.5)))]
    m = spark.createDataFrame(rows, "seed int, model string, map double, recall_at_1 double, ece double")
    area = spark.createDataFrame([(0.1, 0.1)], "map double, recall_at_1 double")
    ok = audit.baseline_gate(m, area, spark.createDataFrame([(0.95, 1.0)], "front_coverage double, all_coverage double")).first()
    assert len(ok) == 7 and all(ok)
    worse = m.replace(0.2, 0.12, ["map"])
    assert not audit.baseline_gate(worse, area, spark.createDataFrame([(0.95, 0.5)], "front_coverage double, all_coverage double")).first()["map_margin"]


def test_white_space_of_all_kinds(spark):
    df = spark.createDataFrame([("\t find\u00a0it\x0b\n",), (" box_truck\u2003",), ("\n referred ",)], "n string")
    assert df.select(fn.template_key(df["n"])).first()[0] == "find it"
    assert df.select(fn.taxonomy_group(df["n"])).collect()[1][0] == "VEHICLE"
    assert df.select(fn.coerce_label(df["n"])).collect()[2][0] == 0 and df.select(fn.label_text(df["n"])).collect()[1][0] == " box_truck\u2003"


def test_a_null_name_is_no_observer(spark):
    df = spark.createDataFrame([(None, False), ("EGO_VEHICLE", False), ("bus", None), (None, True)], "name string, synthetic_ego boolean")
    assert [r[0] for r in df.select(pool.is_ego()).collect()] == [False, True, False, True]


def test_random_ranks_are_numpys(spark):
    rows = [("a", "p", 2, f"t{i}", 0) for i in range(6)] + [("a", "p", 1, f"t{i}", None) for i in range(4)]
    got = ranking.rank_random(spark.createDataFrame(rows, "log_id string, prompt string, timestamp_ns long, track_id string, label int"), (0, 3)).collect()
    for seed in (0, 3):
        for g, (t, n) in enumerate(((1, 4), (2, 6))):
            order = np.random.default_rng(seed + 1009 * g).permutation(n)
            assert {r["track_id"]: r["rank"] for r in got if r["seed"] == seed and r["timestamp_ns"] == t} == {f"t{k}": i + 1 for i, k in enumerate(order)}


def test_digests_as_python_writes_them(spark):
    import hashlib
    import json

    s = "log_id string, timestamp_ns long, track_id long, candidate_ordinal int, name string, translation_m array<double>, size array<double>, yaw double, tracker_score double, roi_eligible boolean, rotation array<array<double>>, score double"
    rows = [("a", 1, k, i, "bus", [1.5, 1e-5, 0.1], [1.0, 2.0, 3.0], 0.25, 0.5, True, [[1.0, 0.0], [0.0, 1.0]], 1e22) for i, k in enumerate((10, 9, 2))]
    df = spark.createDataFrame(rows, s).repartition(3)
    every = [dict(zip([f.name for f in df.schema], r, strict=True)) for r in rows]
    digest = lambda fields, key, end: hashlib.sha256((json.dumps([{f: r.get(f) for f in fields} for r in sorted(every, key=key)], sort_keys=True, separators=(",", ":")) + end).encode()).hexdigest()
    assert pool.candidate_pool_digest(df, ["log_id", "timestamp_ns"]).first()["digest"] == digest(pool.POOL_FIELDS, lambda r: r["track_id"], "\n")
    for r in every:
        r["track_id"] = str(r["track_id"])
    assert pool.source_pool_digest(df, ["log_id", "timestamp_ns"]).first()["digest"] == digest(pool.SOURCE_FIELDS, lambda r: r["track_id"], "")


def test_template_plan_by_brute_force(spark):
    from difflib import SequenceMatcher
    import hashlib
    import re

    r = np.random.default_rng(2)
    words = ["car", "bus", "person", "crossing", "the", "street", "at", "left", "turning", "fast"]
    prompts = []
    for _ in range(25):
        w = list(r.choice(words, r.integers(4, 12)))
        prompts += [" ".join(w), " ".join([*w[:-1], "s" + w[-1]]), " ".join(w[::-1]), f"{r.integers(99)} " + " ".join(w).upper() + "!"]
    prompts += ["ab", "abc", "a", "", "12", "13"]
    key = lambda p: re.sub(" +", " ", re.sub("[^a-z0-9# ]", " ", re.sub(r"[0-9]+(\.[0-9]+)?", "#", p.lower()))).strip()
    keys = sorted({key(p) for p in prompts})
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            a, b = set(x.split(" ")), set(y.split(" "))
            if len(a & b) / max(1, len(a | b)) >= 0.85 or SequenceMatcher(None, x, y).ratio() >= 0.9:
                u, v = find(x), find(y)
                root[max(u, v)] = min(u, v)
    got = {x["prompt"]: (x["root"], x["split"]) for x in graph.template_plan(spark.createDataFrame([(p,) for p in prompts], "prompt string")).collect()}
    split = lambda k: (m := int(hashlib.sha256(k.encode()).hexdigest(), 16) % 10, "train" if m < 6 else "validation" if m < 8 else "test")[1]
    assert got == {p: (find(key(p)), split(find(key(p)))) for p in prompts}
    assert len({v[0] for v in got.values()}) < len(keys)


def test_export_refuses_what_does_not_fit(spark):
    from pyspark.sql import functions as F

    from rankdiag.operators import export

    index = spark.createDataFrame([("a", 1, "t", 3, "bus", 0.5)], "log_id string, timestamp_ns long, track_id string, label int, name string, score double")
    row = lambda track, name, score: spark.createDataFrame([("a", 1, track, name, score)], "log_id string, timestamp_ns long, track_id string, name string, score double")
    assert export.enrich(row("t", "bus", 0.500005), index).first()["raw_tracker_label"] == 3
    for bad, what in ((row("u", "bus", 0.5), "no tracker row"), (row("t", "car", 0.5), "names differ"), (row("t", "bus", 0.6), "scores differ")):
        with pytest.raises(Exception, match=what):
            export.enrich(bad, index).collect()
    features = spark.createDataFrame([("k", [3.0, 4.0])], "key string, image array<double>")
    assert export.lookup(spark.createDataFrame([("k",)], "key string"), features, "key", "image").first()["image"] == [0.6, 0.8]
    with pytest.raises(Exception, match="no image"):
        export.lookup(spark.createDataFrame([("other",)], "key string"), features, "key", "image").collect()
    with pytest.raises(Exception, match="sizes"):
        export.single_image_size(spark.createDataFrame([(1, 1), (2, 1)], "width int, height int")).collect()
    groups = spark.createDataFrame([("a", "q", 1), ("a", "q", 1)], "log_id string, prompt string, timestamp_ns long").withColumns({"labels": F.array(F.lit(0)), "candidate_count": F.lit(1), "digest": F.lit("x")})
    with pytest.raises(ValueError, match="duplicate"):
        export.checked_groups(row("t", "bus", 0.5), groups, ["log_id", "timestamp_ns"], "track_id", ["track_id"])


def test_sampled_groups_are_numpys(spark):
    from rankdiag.operators import export

    keys = [("a", "p", i) for i in range(30)] + [("b", "p", 3)]
    got = export.sample_groups(spark.createDataFrame(keys, "log_id string, prompt string, timestamp_ns long").repartition(4), 7, 5).orderBy("place").collect()
    want = [sorted(keys)[i] for i in np.random.default_rng(5).permutation(len(keys))[:7]]
    assert [tuple(r)[:3] for r in got] == want


def test_rows_out_of_order_are_a_problem(spark):
    rows = spark.createDataFrame([("a", "2", 0), ("a", "10", 1)], "log_id string, track_id string, _row_ord long")
    groups = spark.createDataFrame([("a", [0, 1], 2)], "log_id string, labels array<int>, candidate_count long").join(pool.membership(rows, ["log_id"], ["track_id"]).select("log_id", "digest"), "log_id")
    assert "order" in pool.source_group_problems(rows, groups, ["log_id"], "track_id", ["track_id"]).first()["problem"]


def test_training_by_groups(spark):
    from rankdiag.operators import scorer

    r = np.random.default_rng(1)
    group, x = np.repeat(np.arange(12), 10), r.normal(size=(120, 4))
    label = np.where(x[:, 0] > 0.5, 0.0, 2.0)
    label[r.random(120) < 0.2] = np.nan
    label[group == 3] = 0.0  # not rankable
    w, losses = scorer.train_groups(x, label, group, 20, 1e-2)
    assert losses[-1] < losses[0] / 2
    again, _ = scorer.train_groups(x[group != 3], label[group != 3], group[group != 3], 20, 1e-2)
    assert all(np.array_equal(w[k], again[k]) for k in w)  # what is not rankable trains nothing
    w = scorer.start(4, 3, "task_id", 5, 2, seed=2)
    rows = [(str(i), x[i].tolist(), i % 3, i % 5, [0.6, 0.8]) for i in range(30)]
    df = spark.createDataFrame(rows, "track_id string, candidate array<double>, category int, prompt_id int, image array<double>").repartition(3)
    got = {y["track_id"]: y["logit"] for y in scorer.score_inputs(df, w, "track_id").collect()}
    want = scorer.forward(x[:30], w, np.arange(30) % 3, prompt=np.arange(30) % 5, image=np.tile([0.6, 0.8], (30, 1)))
    assert all(abs(got[str(i)] - want[i]) < 1e-12 for i in range(30))


def _cloud(spark, n, m, frames, grid, seed=3):
    """Points of n and m boxes a frame; on a grid many distances are equal and many points the same."""
    rng = np.random.default_rng(seed)

    def made(k, first):
        xy = rng.integers(0, 8, (k * frames, 2)).astype(float) if grid else rng.normal(0, 2, (k * frames, 2))
        rows = [(f"log{i % 2}", i % frames // 2, first + i, ("bus", "PEDESTRIAN")[i % 7 == 0], *map(float, xy[i])) for i in range(k * frames)]
        return spark.createDataFrame(rows, "log_id string, timestamp_ns long, id long, name string, x double, y double")

    return made(n, 0), made(m, 100_000)


@pytest.mark.parametrize("grid", [False, True])
def test_points_match_as_edges_do(spark, monkeypatch, grid):
    """Small groups in arrays and large ones by paths give the pairs, distances and ambiguity that matrices of edges give."""
    a, b = _cloud(spark, 25, 22, 4, grid)
    for t in (0.7, 1.0, 3.0):
        e = assoc.edges(a, b, t)
        want = sorted(map(tuple, assoc.match_edges(e, t).collect()))
        found = []
        for listed, matrix in ((10**9, 64), (10**9, 0), (0, 0)):
            monkeypatch.setattr(gated, "LISTED_PAIRS", listed)
            monkeypatch.setattr(gated, "MATRIX_PAIRS", matrix)
            found.append(sorted(map(tuple, assoc.match_points(a, b, [0.4, t], assoc.FRAME).where(F.col("threshold") == t).drop("threshold").collect())))
        for got in found:
            assert len(got) == len(want) > 10 and sum(r[-1] for r in got) == sum(r[-1] for r in want)
            assert abs(sum(r[4] for r in got) - sum(r[4] for r in want)) < 1e-6
            if not grid:  # no other matching is as good
                assert got == want
    monkeypatch.setattr(assoc, "FRAME_EDGES", 1)
    assert len(assoc.match_edges(e, t).collect()) == len(want)


def test_sensitivity_of_points_is_that_of_edges(spark):
    a, b = _cloud(spark, 30, 24, 6, False, 8)
    groups = a.select(*assoc.FRAME).distinct().withColumn("prompt", F.explode(F.array(F.lit("p"), F.lit("q"), F.lit("none"))))
    wanted = b.where("id % 9 < 2").select(*assoc.FRAME, F.when(F.col("id") % 9 == 0, "p").otherwise("q").alias("prompt"), F.col("id").alias("gt"))
    key = lambda rows: sorted(tuple(sorted(r.asDict().items())) for r in rows)
    assert key(assoc.point_sensitivity(a, b, groups, wanted).collect()) == key(assoc.sensitivity(assoc.edges(a, b, 4.0), groups, wanted).collect())
    none = assoc.point_sensitivity(a, b, groups.where("false"), wanted).collect()
    assert sorted((r["threshold"], r["groups"], r["confirmed_recall"], r["assigned"]) for r in none) == [(t, 0, None, 0) for t in (1.0, 2.0, 4.0)]


def test_points_move_once(spark):
    """No exchange carries more rows than there are points, though nearly all pairs are in reach."""
    a, b = _cloud(spark, 400, 380, 1, False)
    got = assoc.match_points(a, b, [1.0, 4.0])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert got.where("threshold = 4").count() == 380


def test_edges_of_many_frames_are_matched_in_arrays(spark, monkeypatch):
    """Frames of a table of edges are no pandas group each; rows are those that a solver gives frame by frame, with null keys, copies of edges and large frames by components."""
    a, b = _cloud(spark, 5 * 30, 4 * 30, 1, False, 5)
    few = lambda t: t.withColumn("timestamp_ns", F.when(F.col("id") % 30 > 0, F.col("id") % 30))
    found = [r for r in few(a).alias("a").join(few(b).alias("b"), F.expr("a.log_id = b.log_id and a.timestamp_ns <=> b.timestamp_ns")).selectExpr("a.log_id", "a.timestamp_ns", "a.id", "b.id", "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))").collect() if r[4] <= 2.5]
    e = spark.createDataFrame(found + found[::3], "log_id string, timestamp_ns long, cand long, gt long, distance double")
    want = []
    for frame in {r[:2] for r in found}:
        of = {(r[2], r[3]): r[4] for r in found if r[:2] == frame}
        cs, gs = (sorted({k[i] for k in of}) for i in (0, 1))
        valid = np.array([[(c, g) in of for g in gs] for c in cs])
        pairs, vague = assoc.gated_with_ambiguity(np.array([[of.get((c, g), 0.0) for g in gs] for c in cs]), valid, 2.5)
        want += [(*frame, cs[i], gs[j], of[cs[i], gs[j]], int(valid[i].sum()), bool(valid[i].sum() > 1), i in vague) for i, j in pairs]
    got = assoc.match_edges(e, 2.5)
    assert len(want) > 50 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(assoc, "FRAME_EDGES", 4)
    known = [w for w in want if w[1] is not None]
    assert sorted(map(tuple, assoc.match_edges(e.where("timestamp_ns is not null"), 2.5).collect()), key=repr) == sorted(known, key=repr)


def test_whole_groups_over_batches():
    """Groups come whole, though batches cut them, and nulls are a group of their own."""
    keys = [None] * 3 + ["a"] * 7 + ["b"] + ["c"] * 12
    t = pa.table({"k": pa.array(keys, pa.string()), "i": list(range(len(keys)))})
    for size in range(1, 25):
        got = [w["i"].to_pylist()[s:e] for w, start in gated._whole(iter(t.to_batches(max_chunksize=size)), ["k"]) for s, e in zip(start, [*start[1:], w.num_rows], strict=True)]
        assert [len(g) for g in got] == [3, 7, 1, 12] and sum(got, []) == list(range(len(keys)))


def test_points_at_one_place():
    """Copies: pairs at no distance, all of them ambiguous but where there is no other; memory is that of the points."""
    p, q = np.zeros((300, 2)), np.concatenate([np.zeros((200, 2)), np.full((50, 2), 9.0)])
    [(held, near, vague)] = gated.solve_points(p, q, [1.0])
    assert (held >= 0).sum() == 200 == vague.sum() and (near == 200).all()
    [(held, near, vague)] = gated.solve_points(q[200:201], q, [1.0])
    assert held[0] >= 200 and near[0] == 50 and vague[0]
    [(held, near, vague)] = gated.solve_points(p[:1], q[199:201], [1.0])
    assert (held[0], near[0], vague[0]) == (0, 1, False)
