"""The data contract's audits, coverage and distributions, and the decisions over their one-row results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import missing, template_key
from ..plans.base import CANDIDATE, GROUP
from .align import time_order_violations
from .quantiles import on_groups, quantiles


#: Decision codes. The first two are spelled here without the prefix that names a project; the others are fixed values.
BRANCH_STOPPED, ORACLE_ONLY = "BRANCH_STOPPED", "ORACLE_ONLY"
OTHER_SOURCE, GATE_READY, REVIEW = "ALTERNATE_CANDIDATE_SOURCE_REQUIRED", "POOLED_BASELINE_GATE_READY", "ASSOCIATION_REVIEW_REQUIRED"
REPAIR, CONTINUES = "PROTOCOL_REPAIR_REQUIRED", "PROTOCOL_VALIDATION_CONTINUES"


def core_counts(cands: DataFrame) -> DataFrame:
    return cands.agg(
        F.count("*").alias("records"),
        F.count_distinct("log_id").alias("logs"),
        F.count_distinct("prompt").alias("prompts"),
        F.count_distinct(*GROUP).alias("groups"),
        F.count_if(F.isnan("score") | (F.abs("score") == float("inf"))).alias("non_finite_scores"),
        F.count_if(F.col("distance_m") <= 50).alias("eligible"),
    )


def missing_counts(cands: DataFrame, fields: Sequence[str] = CANDIDATE) -> DataFrame:
    kinds = dict(cands.dtypes)
    one = cands.agg(*[F.count_if(missing(F.col(f), kinds[f])).alias(f) for f in fields])
    return one.unpivot([], list(fields), "field", "missing") if len(set(fields)) > 1 else one


def value_counts(cands: DataFrame, column: str) -> DataFrame:
    return cands.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("UNKNOWN")).alias("value")).agg(F.count("*").alias("n"))


def group_feasibility(cands: DataFrame) -> DataFrame:
    g = cands.groupBy(*GROUP).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("p"), F.count_if(F.col("label").isin(1, 2)).alias("neg"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("p") > 0).alias("with_positive"), F.count_if((F.col("p") > 0) & (F.col("neg") > 0)).alias("rankable"), F.min("n").alias("least"), F.max("n").alias("most"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repeats after the first of each key without nulls: one row."""
    full = df.where(" and ".join(f"{k} is not null" for k in key))
    return full.groupBy(*key).agg((F.count("*") - 1).alias("_r")).agg(F.coalesce(F.sum("_r"), F.lit(0)).cast("long").alias("duplicates"), F.count_if(F.col("_r") > 0).alias("keys"))


def distribution(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Count, missing, mean, population deviation, extremes and quartiles of finite values."""
    v = F.when(F.abs(column) < float("inf"), F.col(column))
    slim = df.select(*by, F.col(column).alias("_raw"), v.cast("double").alias("_v"))
    one = slim.groupBy(*by).agg(F.count("_v").alias("n"), F.count_if(F.col("_raw").isNull()).alias("missing"), F.round(F.avg("_v"), 6).alias("mean"), F.round(F.stddev_pop("_v"), 6).alias("std"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    q = quantiles(slim, {"_q": F.col("_v")}, (0.25, 0.5, 0.75), by)
    out = on_groups(one, q, by)
    cut = lambda i: F.round(F.get("_q", F.lit(i)), 6)
    return out.select(*by, "n", "missing", "mean", "std", "least", cut(0).alias("q25"), cut(1).alias("median"), cut(2).alias("q75"), "most")


#: Coverage counts of external objects, and the plain counts that stand in where a table lacks them.
FALLBACK = {
    "gt_external_positive_count": "gt_positive_count",
    "eligible_external_positive_count": "eligible_positive_count",
    "matched_external_positive_count": "matched_positive_count",
    "projected_external_positive_count": "projected_positive_count",
    "projected_external_positive_count_all_seven_assets": "positive_count_all_seven_assets",
}


def coverage_outputs(columns: Sequence[str]) -> list[Column]:
    """The eighteen outputs of `coverage` as aggregates over groups that have these columns."""
    def col(name: str) -> Column:
        name = name if name in columns else FALLBACK.get(name, name)
        return F.col(name) if name in columns else F.lit(0)

    some = lambda name: F.count_if(col(name) > 0)
    total = lambda name: F.coalesce(F.sum(col(name)), F.lit(0)).cast("long")
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    gt, eligible, matched, projected = "gt_external_positive_count", "eligible_external_positive_count", "matched_external_positive_count", "projected_external_positive_count"
    n = F.count("*")
    return [
        n.alias("group_count"),
        some("gt_positive_count").alias("gt_positive_group_count"),
        ratio(some("gt_positive_count"), n).alias("event_frequency"),
        some(gt).alias("gt_external_positive_group_count"),
        ratio(some(gt), n).alias("external_event_frequency"),
        some(eligible).alias("eligible_positive_group_count"),
        ratio(some(matched), n).alias("positive_availability_all_groups"),
        ratio(F.count_if((col(matched) > 0) & (col(eligible) > 0)), some(eligible)).alias("positive_availability_given_eligible_gt_positive"),
        total(eligible).alias("eligible_positive_object_count"),
        total(matched).alias("matched_positive_object_count"),
        ratio(F.sum(col(projected)), F.sum(col(matched))).alias("positive_projection_rate_downloaded_cameras"),
        total("unknown_count").alias("unknown_candidate_count"),
        total("candidate_count").alias("candidate_row_count"),
        ratio(F.sum("unknown_count"), F.sum("candidate_count")).alias("unknown_fraction"),
        F.count_if(F.col("candidate_count") == 0).alias("zero_candidate_groups"),
        some("ego_positive_count").alias("ego_positive_group_count"),
        total("ego_positive_count").alias("ego_positive_object_count"),
        total("projected_external_positive_count_all_seven_assets").alias("matched_positive_count_all_seven_assets"),
    ]


def coverage(groups: DataFrame) -> DataFrame:
    """Counts, frequencies and availability over groups: one row; null where nothing can be divided.

    Groups have gt_positive_count, eligible_positive_count, matched_positive_count, projected_positive_count,
    unknown_count, candidate_count and, for external objects alone, the names in FALLBACK; ego_positive_count may lack.
    """
    return groups.agg(*coverage_outputs(groups.columns))


def coverage_strata(groups: DataFrame, by: Sequence[str] = ("log_id", "split", "candidate_count_range", "prompt_split")) -> DataFrame:
    """coverage for each value of each of `by` (columns field, value), and for joint holdout groups, in one pass."""
    hold = F.when(F.col("joint_holdout_eligible"), "true")
    g = groups.withColumn("joint_holdout", hold) if "joint_holdout_eligible" in groups.columns else groups
    fields = [*by, *(["joint_holdout"] if "joint_holdout" in g.columns else [])]
    pick = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = g.withColumn("_f", F.explode(pick)).withColumns({"field": F.col("_f.field"), "value": F.col("_f.value")}).where("value is not null")
    return long.groupBy("field", "value").agg(*coverage_outputs(groups.columns))


def split_overlap(assigned: DataFrame) -> DataFrame:
    """(log, splits) of logs in more than one split of a table (log, split)."""
    return assigned.groupBy("log").agg(F.concat_ws("/", F.array_sort(F.collect_set("split"))).alias("splits"), F.count_distinct("split").alias("k")).where("k > 1").drop("k")


def choose_decision(infrastructure: Column, data_pass: Column, shortcut: Column, association_uncertain: Column, oracle_pass: Column) -> Column:
    """The audit's code, the first that holds; a null oracle_pass is undecided."""
    no = F.lit(False)
    return (
        F.when(~infrastructure, OTHER_SOURCE)
        .when(data_pass & ~shortcut, GATE_READY)
        .when(association_uncertain, REVIEW)
        .when(shortcut | ~F.coalesce(oracle_pass, ~no), BRANCH_STOPPED)
        .when(F.coalesce(oracle_pass, no), ORACLE_ONLY)
        .otherwise(OTHER_SOURCE)
    )


def audit_gate(row: DataFrame) -> DataFrame:
    """Seven checks, two verdicts of them and the code, of one row: infrastructure_complete, availability, projection, stability, best_control, oracle_availability, oracle_projection.

    Availability must reach .80, projection .90; the range over thresholds stay within .10; no control but the oracle
    reach .90. Nulls fail.
    """
    at_least = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(False))
    infrastructure = F.col("infrastructure_complete")
    checks = {
        "infrastructure": infrastructure,
        "pool_independent": F.lit(True),
        "coverage_ge_0_80": at_least("availability", 0.80),
        "projection_ge_0_90": infrastructure & at_least("projection", 0.90),
        "matching_stability_le_0_10": F.coalesce(F.col("stability") <= 0.10, F.lit(False)),
        "no_near_perfect_metadata_control": ~at_least("best_control", 0.90),
        "unknown_statuses_explicit": F.lit(True),
    }
    out = row.withColumns(checks)
    every = reduce(lambda a, b: a & b, [F.col(c) for c in checks])
    uncertain = ~F.col("coverage_ge_0_80") | ~F.col("matching_stability_le_0_10")
    oracle = F.when(infrastructure, at_least("oracle_availability", 0.80) & at_least("oracle_projection", 0.90))
    out = out.withColumns({"data_gate_pass": every, "association_uncertain": uncertain, "oracle_pass": oracle})
    code = choose_decision(infrastructure, F.col("data_gate_pass"), ~F.col("no_near_perfect_metadata_control"), F.col("association_uncertain"), F.col("oracle_pass"))
    return out.withColumn("decision", code)


def decide_report(splits: DataFrame, least: int = 50) -> DataFrame:
    """One row (decision, small_splits, flagged_splits) of a table (split, rankable_groups, reasons: an array)."""
    small, flagged = F.count_if(F.col("rankable_groups") < least), F.count_if(F.size("reasons") > 0)
    return splits.agg(F.when(small > 0, BRANCH_STOPPED).when(flagged > 0, REPAIR).otherwise(CONTINUES).alias("decision"), small.alias("small_splits"), flagged.alias("flagged_splits"))


def baseline_gate(models: DataFrame, area: DataFrame, coverages: DataFrame) -> DataFrame:
    """Seven gates in one row, of learned models over seeds.

    models: (seed, model, map, recall_at_1, ece) with models pooled, task_id and metadata; the least seed leads. area:
    one row (map, recall_at_1) of the area control. coverages: one row (front_coverage, all_coverage).
    """
    m = lambda name, c: F.max(F.when(F.col("model") == name, F.col(c)))
    per = models.groupBy("seed").agg(*[m(name, c).alias(f"{name}_{c}") for name in ("pooled", "task_id", "metadata") for c in ("map", "recall_at_1", "ece")])
    lead = lambda c: F.min_by(c, "seed")
    every = lambda c, least: F.min(F.col(f"pooled_{c}") - F.col(f"task_id_{c}")) >= least
    one = per.agg(
        every("map", 0.03).alias("map_margin"),
        every("recall_at_1", 0.05).alias("recall_margin"),
        ((lead("pooled_map") > lead("metadata_map")) & (lead("pooled_recall_at_1") > lead("metadata_recall_at_1"))).alias("beats_metadata"),
        lead("pooled_map").alias("_map"), lead("pooled_recall_at_1").alias("_top"),
        (lead("pooled_ece") <= lead("task_id_ece") + 0.03).alias("calibration"),
    ).crossJoin(area.select(F.col("map").alias("_area_map"), F.col("recall_at_1").alias("_area_top"))).crossJoin(coverages)  # fmt: skip  # one row each
    return one.select(
        "map_margin", "recall_margin", "beats_metadata", ((F.col("_map") > F.col("_area_map")) & (F.col("_top") > F.col("_area_top"))).alias("beats_area_control"), "calibration",
        (F.col("front_coverage") >= 0.90).alias("front_coverage"), (F.col("all_coverage") >= 0.90).alias("all_camera_coverage"),
    )


#: Fields that tell the label or come from it, so no learned feature may hold them (fixed values).
FORBIDDEN_FEATURES = ("label", "relevance_label", "name", "mining_category", "is_positive", "future_timestamp", "timestamp_ns", "track_id")


def forbidden_features(columns: Sequence[str]) -> list[str]:
    return sorted(set(columns) & set(FORBIDDEN_FEATURES))


def forbidden_counts(rows: DataFrame) -> DataFrame:
    """(field, rows): how many rows hold a value in each field that no learned feature may hold."""
    there = forbidden_features(rows.columns)
    if not there:
        return rows.sparkSession.createDataFrame([], "field string, rows long")
    one = rows.agg(*[F.count(f).alias(f) for f in there])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("rows")) for f in there])).alias("s")).select("s.*")


def require_log_disjoint(assigned: DataFrame) -> None:
    """An error if a log of a table (log, split) is in more than one split."""
    if bad := split_overlap(assigned).orderBy("log").limit(5).collect():
        raise ValueError("; ".join(f"{r['log']} in {r['splits']}" for r in bad))


def plan_problems(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """(log, split, problem) of groups whose log the plan lacks or puts elsewhere; both tables have log and split."""
    p = plan.select("log", F.col("split").alias("planned"))
    problem = F.when(F.col("planned").isNull(), "absent").when(F.col("planned") != F.col("split"), "mismatched")
    return groups.select("log", "split").distinct().join(p, "log", "left").withColumn("problem", problem).where("problem is not null").drop("planned")


def baseline_problems(rows: DataFrame, splits: Sequence[str] = (), constant: Sequence[str] = ()) -> DataFrame:
    """One row of counts that are 0 for sound baseline rows (split, log_id, prompt, timestamp_ns, track_id, image_path, label).

    splits: those that must have rows; constant: columns that must not change within a group.
    """
    one = lambda df, when, name: df.agg(F.count_if(when).alias(name))
    logs = one(rows.groupBy("log_id").agg(F.count_distinct("split").alias("k")), F.col("k") > 1, "logs_in_two_splits")
    keys = rows.groupBy(*GROUP, "track_id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("repeated_candidates"))
    kept = [F.count_distinct(F.struct(*constant)).alias("c")] if constant else [F.lit(1).alias("c")]
    images = rows.groupBy(*GROUP).agg(F.count_distinct("image_path").alias("k"), *kept)
    images = images.agg(F.count_if(F.col("k") > 1).alias("groups_with_two_images"), F.count_if(F.col("c") > 1).alias("groups_with_two_holdouts"))
    there = F.count_distinct(F.when(F.col("split").isin(list(splits)), F.col("split")))
    labels = rows.agg(F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(0, 1, 2)).alias("labels_out_of_range"), (F.lit(len(set(splits))) - there).cast("long").alias("empty_splits"))
    return logs.crossJoin(keys).crossJoin(images).crossJoin(labels)  # one row each


def assess(rows: DataFrame) -> DataFrame:
    """Availability, projection rate, unknown fraction and repeats of rows (GROUP, track_id, label, projected): one row."""
    per = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("d"), F.count_if(F.col("label") == 0).alias("p"), F.count_if((F.col("label") == 0) & F.col("projected")).alias("pp"), F.count_if(F.col("label").isNull()).alias("u"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return per.agg(
        F.count("*").alias("groups"),
        ratio(F.count_if(F.col("p") > 0), F.count("*")).alias("availability"),
        ratio(F.sum("pp"), F.sum("p")).alias("projection"),
        ratio(F.sum("u"), F.sum("n")).alias("unknown_fraction"),
        F.sum(F.col("n") - F.col("d")).alias("repeats"),
    )


def assess_decision(assessed: DataFrame, availability: float = 0.80, projection: float = 0.90) -> DataFrame:
    """assessed (of `assess`) with its checks and the code."""
    ok = {"availability_ok": F.coalesce(F.col("availability") >= availability, F.lit(False)), "projection_ok": F.coalesce(F.col("projection") >= projection, F.lit(False)), "unique_ok": F.col("repeats") == 0}
    out = assessed.withColumns(ok)
    return out.withColumn("decision", F.when(F.col("availability_ok") & F.col("projection_ok") & F.col("unique_ok"), CONTINUES).otherwise(REPAIR))


#: Fields that every record must have, and those that tie it to a camera image (fixed values).
REQUIRED = ("log_id", "prompt", "timestamp_ns", "track_id", "score", "label", "translation_m", "size", "yaw")
CAMERA_FIELDS = ("camera_frame", "camera", "camera_name", "frame_id", "image_path", "image", "image_uri", "camera_timestamp_ns")
#: Statuses that excuse a missing label (fixed values).
UNLABELED = ("UNMATCHED_TRACK", "MATCHED_UNANNOTATED_GT")
LABEL_NAMES = {0: "REFERRED_OBJECT", 1: "RELATED_OBJECT", 2: "OTHER_OBJECT"}


def label_name(c: Column) -> Column:
    """Of a label 0, 1 or 2; null otherwise."""
    out = F.lit(None).cast("string")
    for value, name in LABEL_NAMES.items():
        out = F.when(c == value, name).otherwise(out)
    return out


def eligibility(df: DataFrame) -> Column:
    """eligible, filtered or missing_or_invalid_geometry, by distance_m and is_drivable."""
    there = {"distance_m", "is_drivable"} <= set(df.columns)
    if not there:
        return F.lit("missing_or_invalid_geometry")
    sound = F.coalesce((F.abs("distance_m") < float("inf")) & F.col("is_drivable").isNotNull(), F.lit(False))
    return F.when(~sound, "missing_or_invalid_geometry").when((F.col("distance_m") <= 50.0) & F.col("is_drivable"), "eligible").otherwise("filtered")


def absent(df: DataFrame, field: str) -> Column:
    """Whether a record lacks a required field; a column that is not there is always lacking, a label may be excused."""
    if field not in df.columns:
        gone = F.lit(True)
    else:
        gone = missing(F.col(field), dict(df.dtypes)[field])
    if field == "label" and "match_status" in df.columns:
        gone = gone & ~F.coalesce(F.col("match_status").isin(*UNLABELED), F.lit(False))
    return gone


def inspect_counters(df: DataFrame) -> DataFrame:
    """(kind, value, n): how often each label, invalid label, status, eligibility, missing and non-finite field occurs, in one pass.

    df has records as normalised: any of the contract's columns may lack. An integer label counts.
    """
    has = set(df.columns)
    kinds = dict(df.dtypes)
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    some = [pair("official_filter_counts", eligibility(df))]
    if "label" in has:
        known = label_name(F.col("label").try_cast("int"))
        some += [pair("label_counts", known), pair("invalid_label_values", F.when(known.isNull() & ~missing(F.col("label"), kinds["label"]), F.col("label").cast("string")))]
    for field, kind in (("match_status", "match_status_counts"), ("projection_status", "projection_status_counts")):
        if field in has:
            some.append(pair(kind, F.when(F.col(field) != "", F.col(field))))
    if "is_positive" in has:
        some.append(pair("temporal_presence_counts", F.coalesce(F.col("is_positive").cast("string"), F.lit("ambiguous"))))
    some += [pair("missing_required_fields", F.when(absent(df, f), f)) for f in REQUIRED]
    some += [pair("nonfinite_numeric_fields", F.when(F.isnan(f) | (F.abs(f) == float("inf")), f)) for f in ("score", "timestamp_ns", "yaw") if f in has and kinds[f] in ("double", "float")]
    some += [pair("potential_input_leakage_fields", F.lit(f)) for f in ("label", "name", "score", "timestamp_ns") if f in has]
    long = df.select(F.explode(F.array(*some)).alias("c")).where("c.value is not null")
    return long.groupBy("c.kind", "c.value").agg(F.count("*").alias("n"))


def inspect_records(df: DataFrame) -> DataFrame:
    """The inspection's counts and flags in one row; inspect_counters has the rest. With _row_ord, times must not go back in that order."""
    has = set(df.columns)
    camera = [~missing(F.col(f), dict(df.dtypes)[f]) for f in CAMERA_FIELDS if f in has]
    camera_rows = F.count_if(reduce(lambda a, b: a | b, camera)) if camera else F.lit(0).cast("long")
    projected = F.count_if(F.col("projection_status") == "PROJECTED") if "projection_status" in has else F.lit(0).cast("long")
    label = F.col("label").try_cast("int")
    bad_label = F.count_if(label_name(label).isNull() & ~missing(F.col("label"), dict(df.dtypes)["label"])) if "label" in has else F.lit(0).cast("long")
    share = lambda c: F.round(F.coalesce(F.try_divide(c, F.count("*")), F.lit(0.0)), 6)
    unsound = F.count_if(eligibility(df) == "missing_or_invalid_geometry")
    rows = df.agg(
        F.count("*").alias("record_count"),
        F.count_distinct("log_id").alias("unique_log_count"),
        F.count_distinct("prompt").alias("unique_prompt_count"),
        F.count_distinct(F.when(F.col("prompt").isNotNull(), template_key(F.col("prompt")))).alias("unique_template_count"),
        F.coalesce(F.sum(reduce(lambda a, b: a + b, [absent(df, f).cast("long") for f in REQUIRED])), F.lit(0)).alias("missing_required"),
        bad_label.alias("invalid_labels"),
        projected.alias("projected_record_count"), share(projected).alias("projection_fraction"),
        camera_rows.alias("camera_associated_record_count"), share(camera_rows).alias("camera_association_fraction"),
        ((unsound == 0) & (F.count("*") > 0)).alias("official_filter_reproducible"),
    )
    g = df.groupBy(*GROUP).agg(F.count_if(label == 0).alias("p"), F.count_if(label.isin(1, 2)).alias("n"))
    groups = g.agg(
        F.count("*").alias("group_count"),
        F.count_if(F.col("p") > 0).alias("candidate_groups_with_referred"),
        F.count_if(F.col("n") > 0).alias("candidate_groups_with_negative"),
        F.count_if((F.col("p") > 0) & (F.col("n") > 0)).alias("candidate_groups_with_positive_and_negative"),
    )
    repeats = duplicate_keys(df, [*GROUP, "track_id"]).select(F.col("duplicates").alias("duplicate_candidate_key_count"))
    back = time_order_violations(df.where("log_id is not null and prompt is not null and timestamp_ns is not null"), ["log_id", "prompt"], "timestamp_ns", "_row_ord") if "_row_ord" in has else None
    order = back.agg(F.count("*").alias("timestamp_order_violations")) if back is not None else df.limit(0).agg(F.count("*").alias("timestamp_order_violations"))
    one = rows.crossJoin(groups).crossJoin(repeats).crossJoin(order)  # one row each
    return one.withColumns({
        "normalized_prompt_holdout_feasible": F.col("unique_template_count") >= 2,
        "log_disjoint_feasible": F.col("unique_log_count") >= 2,
        "fixed_frame_ranking_feasible": F.col("candidate_groups_with_positive_and_negative") > 0,
    })


def group_examples(df: DataFrame, most: int = 20) -> DataFrame:
    """The first groups in order of _row_ord with their counts: a report's examples."""
    g = df.groupBy(*GROUP).agg(F.count("*").alias("candidate_count"), F.count_if(F.col("label") == 0).alias("referred_count"), F.count_if(F.col("label").isin(1, 2)).alias("negative_count"), F.min("_row_ord").alias("_first"))
    return g.orderBy("_first").limit(most).drop("_first")


def merge_log_stats(per_log: DataFrame) -> DataFrame:
    """Per-log counts (log_id, split, kind, n) as whole counts by kind, and by kind and split: (split, kind, n, logs), a null split being all."""
    return per_log.groupingSets([[F.col("kind")], [F.col("split"), F.col("kind")]], F.col("split"), F.col("kind")).agg(F.sum("n").alias("n"), F.count_distinct("log_id").alias("logs"))


#: Problems of an inspection that set the strict exit code: the count that must be 0.
STRICT = ("file_errors", "feature_errors", "missing_required", "duplicate_candidate_key_count", "timestamp_order_violations", "invalid_labels", "nonfinite", "provenance_placeholders", "provenance_unavailable", "split_overlap", "split_errors")


def verifier_status(inspection: DataFrame) -> DataFrame:
    """(status, warnings, exit_code) of one row of counts and flags; exit code 2 if anything is wrong. What lacks counts as sound.

    Besides STRICT: split_required without split_present, camera_required with a camera_association_fraction below 1, and
    filter_set without official_filter_reproducible.
    """
    has = set(inspection.columns)
    flag = lambda c, default: F.coalesce(F.col(c).cast("boolean"), F.lit(default)) if c in has else F.lit(default)
    count = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in has else F.lit(0.0)
    found = [F.when(count(c) > 0, c) for c in STRICT]
    found.append(F.when(flag("split_required", False) & ~flag("split_present", False), "split_missing"))
    found.append(F.when(~flag("fixed_frame_ranking_feasible", False), "ranking_infeasible"))
    found.append(F.when(flag("camera_required", False) & (count("camera_association_fraction") < 1), "camera_incomplete"))
    found.append(F.when(flag("filter_set", False) & ~flag("official_filter_reproducible", False), "filter_not_reproducible"))
    out = inspection.select(F.when(count("record_count") > 0, "ok").otherwise("not_ready").alias("status"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("warnings"))
    return out.withColumn("exit_code", F.when((F.size("warnings") > 0) | (F.col("status") != "ok"), 2).otherwise(0))
