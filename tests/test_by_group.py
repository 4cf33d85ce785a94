"""Ranking moves each row once, in tasks whose size does not grow with the table."""

import re

from pyspark.sql import functions as F

from rankdiag.operators import diagnosis, ranking
from rankdiag.plans.base import line_candidates

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"Exchange (\w+)\(", df._jdf.queryExecution().executedPlan().toString())


def exchanges_by(df):
    return re.findall(r"Exchange (\w+\(.*)", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])


def test_rows_move_before_they_are_multiplied_and_tasks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_ROWS", 100)
    cands = line_candidates(spark, SF)
    ranked = ranking.rank(cands, ["tracker_score", "candidate_distance"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert exchanges(ranked) == ["hashpartitioning"] and plan.index("Generate") < plan.index("Exchange")  # the plan reads from its end
    assert ranked.rdd.getNumPartitions() == cands.count() // 100 + 1


def test_views_share_one_order(spark):
    c = ranking.with_frequency(line_candidates(spark, SF))
    seeds = (0, 1)
    keys = ["control", "view", "seed", "log_id", "prompt", "timestamp_ns"]
    rows = lambda df: sorted(map(str, df.select(*keys, *[F.round(m, 9) for m in ranking.METRICS]).collect()))
    got = ranking.view_metrics(ranking.matched(c, 5000.0, 0.2), (*ranking.CONTROLS, "random"), seeds)
    apart = ranking.group_metrics(ranking.rank(ranking.viewed(c, 5000.0, 0.2), (*ranking.CONTROLS, "random"), seeds=seeds, by=["view"]), "view", "seed")
    assert rows(got) == rows(apart)
    assert len(exchanges(got)) == 1 + len(exchanges(c))


def test_diagnosis_writes_no_rows(spark, monkeypatch):
    wide = []
    real = diagnosis._checkpoint
    monkeypatch.setattr(diagnosis, "_checkpoint", lambda df: wide.append(df.columns) or real(df))
    from rankdiag.operators import suite_audit

    suite_audit.diagnosis.diagnose_split(suite_audit._rows(spark, SF), suite_audit._models(spark, SF), 5000.0, 0.2, ["flags"])
    assert not [c for c in wide if "track_id" in c or "area" in c]


def test_a_whole_diagnosis_moves_rows_once(spark, monkeypatch):
    """All parts that need whole groups share one exchange of the candidates, and one of names alone; neither rows nor groups nor features are written."""
    from rankdiag.operators import suite_audit

    plans, wide = [], []
    for module in (diagnosis, ranking):
        monkeypatch.setattr(module, "_checkpoint", lambda df, real=module._checkpoint: (plans.append(df), wide.append(df.columns)) and real(df))
    rows, parts = suite_audit._rows(spark, SF), [p for p in diagnosis.PARTS if p not in ("features", "flags")]
    plans.append(diagnosis.report(diagnosis.diagnose_split(rows, {"pooled": "tracker_score", "task_id": "candidate_distance"}, 5000.0, 0.2, parts)))
    moved = [x for df in plans for x in exchanges_by(df) if "REPARTITION_BY_NUM" in x]
    assert len(moved) == 2 and sum("hashpartitioning(log_id" in x and "prompt" not in x for x in moved) == 1, moved
    diagnosis.label_distributions(rows)
    assert not [c for c in wide if "timestamp_ns" in c or "projected_area_px" in c]


def test_large_logs_are_cut_between_groups(spark, monkeypatch):
    c = line_candidates(spark, SF)
    rows = lambda: sorted(map(str, diagnosis.control_strata(c).collect()))
    whole, cut = rows(), []
    real = ranking.with_counts
    monkeypatch.setattr(ranking, "with_counts", lambda df, counts, on, *how: cut.append(list(on)) or real(df, counts, on, *how))
    monkeypatch.setattr(diagnosis, "LOG_ROWS", 100)
    assert rows() == whole and ["log_id", "name"] in cut
