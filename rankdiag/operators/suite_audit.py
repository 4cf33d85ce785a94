"""Registered queries of the contract's inspection, coverage, diagnosis and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..plans.base import DOCS, GROUP, LINES, document_candidates, line_candidates, table
from . import audit, diagnosis, ranking
from .registry import query
from .suite import _AREA, _FULL, _HARD, _STRIP, _view_sql, ranked_sql

# ---- Inspection: records with planted faults ---------------------------------------------------------------------------

#: Documents as records: some fields null or not finite, some labels out of range, some keys and times out of place.
_RECORDS = """rec AS (SELECT CASE WHEN doc_id % 41 = 0 THEN NULL ELSE source END AS log_id, CASE WHEN doc_id % 43 = 0 THEN '' ELSE lang || ' ' || CAST(doc_id % 3 AS VARCHAR) || ' cars' END AS prompt, CAST(doc_id // 50 + CASE WHEN doc_id % 47 = 0 THEN -3 ELSE 0 END AS BIGINT) AS timestamp_ns,
  CASE WHEN doc_id % 37 = 0 THEN 'same' ELSE CAST(doc_id AS VARCHAR) END AS track_id, CASE WHEN doc_id % 29 = 0 THEN 'nan'::DOUBLE WHEN doc_id % 31 = 0 THEN 'inf'::DOUBLE ELSE CAST(n_chars AS DOUBLE) END AS score,
  CASE WHEN doc_id % 7 < 3 THEN CAST(doc_id % 7 AS INTEGER) WHEN doc_id % 7 = 3 THEN 9 END AS label, [1.0, 2.0, 3.0]::DOUBLE[] AS translation_m, CASE WHEN doc_id % 23 <> 0 THEN [1.0, 1.0, 1.0]::DOUBLE[] END AS size, CASE WHEN doc_id % 19 = 0 THEN 'nan'::DOUBLE ELSE 0.5::DOUBLE END AS yaw,
  CASE WHEN doc_id % 7 > 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'UNMATCHED_TRACK' ELSE 'AMBIGUOUS_MATCH' END ELSE 'MATCHED_ANNOTATED' END AS match_status, CASE doc_id % 3 WHEN 0 THEN 'PROJECTED' WHEN 1 THEN 'OUT_OF_VIEW' ELSE '' END AS projection_status,
  CASE WHEN doc_id % 5 <> 0 THEN 'img' END AS image_path, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 60 AS DOUBLE) END AS distance_m, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 4 <> 0 END AS is_drivable, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_positive,
  lang AS name, doc_id AS _row_ord FROM documents)"""


def _records(spark, d):
    i = F.col("doc_id")
    when = lambda k, value, other: F.when(i % k == 0, value).otherwise(other)
    vector = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    return table(spark, d, "documents").select(
        when(41, None, F.col("source")).alias("log_id"), when(43, "", F.concat_ws(" ", "lang", (i % 3).cast("string"), F.lit("cars"))).alias("prompt"), (F.floor(i / 50) + when(47, -3, 0)).cast("long").alias("timestamp_ns"),
        when(37, "same", i.cast("string")).alias("track_id"), F.when(i % 29 == 0, float("nan")).when(i % 31 == 0, float("inf")).otherwise(F.col("n_chars").cast("double")).alias("score"),
        F.when(i % 7 < 3, (i % 7).cast("int")).when(i % 7 == 3, 9).alias("label"), vector(1, 2, 3).alias("translation_m"), F.when(i % 23 != 0, vector(1, 1, 1)).alias("size"), when(19, float("nan"), 0.5).alias("yaw"),
        F.when(i % 7 > 3, F.when(i % 2 == 0, "UNMATCHED_TRACK").otherwise("AMBIGUOUS_MATCH")).otherwise("MATCHED_ANNOTATED").alias("match_status"), F.when(i % 3 == 0, "PROJECTED").when(i % 3 == 1, "OUT_OF_VIEW").otherwise("").alias("projection_status"),
        F.when(i % 5 != 0, "img").alias("image_path"), F.when(i % 13 != 0, (i % 60).cast("double")).alias("distance_m"), F.when(i % 11 != 0, i % 4 != 0).alias("is_drivable"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("is_positive"),
        F.col("lang").alias("name"), i.alias("_row_ord"),
    )


_EXCUSED = "coalesce(match_status IN ('UNMATCHED_TRACK', 'MATCHED_UNANNOTATED_GT'), false)"
_MISSING = {
    "log_id": "coalesce(log_id, '') = ''", "prompt": "coalesce(prompt, '') = ''", "timestamp_ns": "timestamp_ns IS NULL", "track_id": "coalesce(track_id, '') = ''", "score": "score IS NULL OR isnan(score)",
    "label": f"label IS NULL AND NOT {_EXCUSED}", "translation_m": "translation_m IS NULL", "size": "size IS NULL", "yaw": "yaw IS NULL OR isnan(yaw)",
}
_LABEL_NAME = "CASE label WHEN 0 THEN 'REFERRED_OBJECT' WHEN 1 THEN 'RELATED_OBJECT' WHEN 2 THEN 'OTHER_OBJECT' END"
_ELIGIBLE = "CASE WHEN distance_m IS NULL OR is_drivable IS NULL THEN 'missing_or_invalid_geometry' WHEN distance_m <= 50 AND is_drivable THEN 'eligible' ELSE 'filtered' END"
_COUNTERS = [
    ("official_filter_counts", _ELIGIBLE), ("label_counts", _LABEL_NAME), ("invalid_label_values", f"CASE WHEN {_LABEL_NAME} IS NULL THEN CAST(label AS VARCHAR) END"),
    ("match_status_counts", "nullif(match_status, '')"), ("projection_status_counts", "nullif(projection_status, '')"), ("temporal_presence_counts", "coalesce(CAST(is_positive AS VARCHAR), 'ambiguous')"),
    *[("missing_required_fields", f"CASE WHEN {c} THEN '{f}' END") for f, c in _MISSING.items()],
    *[("nonfinite_numeric_fields", f"CASE WHEN isnan({f}) OR isinf({f}) THEN '{f}' END") for f in ("score", "yaw")],
    *[("potential_input_leakage_fields", f"'{f}'") for f in ("label", "name", "score", "timestamp_ns")],
]


@query("inspect_counters", f"WITH {_RECORDS}, c AS ({' UNION ALL '.join(f'''SELECT '{k}' AS kind, {v} AS value FROM rec''' for k, v in _COUNTERS)}) SELECT kind, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return audit.inspect_counters(_records(spark, d))


@query("inspect_eligibility", f"WITH {_RECORDS} SELECT {_ELIGIBLE} AS status, count(*) AS n FROM rec GROUP BY ALL")
def _(spark, d):
    r = _records(spark, d)
    return r.groupBy(audit.eligibility(r).alias("status")).agg(F.count("*").alias("n"))


_TEMPLATE = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(prompt), {_STRIP}), '[0-9a-f]{{8}}-[0-9a-f-]{{27,}}', '<id>', 'g'), '\\b[0-9]+(?:\\.[0-9]+)?', '<num>', 'g'), '{fn.BLANK}+', ' ', 'g')"
_INSPECTED = f"""{_RECORDS}, g AS (SELECT count(*) FILTER (label = 0) AS p, count(*) FILTER (label IN (1, 2)) AS n FROM rec GROUP BY log_id, prompt, timestamp_ns),
k AS (SELECT count(*) - 1 AS r FROM rec WHERE log_id IS NOT NULL GROUP BY log_id, prompt, timestamp_ns, track_id), o AS (SELECT log_id, prompt, timestamp_ns, min(_row_ord) AS f FROM rec WHERE log_id IS NOT NULL GROUP BY ALL),
v AS (SELECT log_id, prompt, lag(timestamp_ns) OVER (PARTITION BY log_id, prompt ORDER BY f) > timestamp_ns AS back FROM o),
one AS (SELECT count(*) AS record_count, count(DISTINCT log_id) AS unique_log_count, count(DISTINCT prompt) AS unique_prompt_count, count(DISTINCT {_TEMPLATE}) AS unique_template_count,
  CAST(sum({" + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in _MISSING.values())}) AS BIGINT) AS missing_required, count(*) FILTER (label = 9) AS invalid_labels, count(*) FILTER (projection_status = 'PROJECTED') AS projected_record_count,
  round(count(*) FILTER (projection_status = 'PROJECTED') / count(*), 6) AS projection_fraction, count(image_path) AS camera_associated_record_count, round(count(image_path) / count(*), 6) AS camera_association_fraction,
  count(*) FILTER (distance_m IS NULL OR is_drivable IS NULL) = 0 AS official_filter_reproducible FROM rec),
gs AS (SELECT count(*) AS group_count, count(*) FILTER (p > 0) AS candidate_groups_with_referred, count(*) FILTER (n > 0) AS candidate_groups_with_negative, count(*) FILTER (p > 0 AND n > 0) AS candidate_groups_with_positive_and_negative FROM g),
inspection AS (SELECT *, (SELECT CAST(sum(r) AS BIGINT) FROM k) AS duplicate_candidate_key_count, (SELECT count(DISTINCT (log_id, prompt)) FROM v WHERE back) AS timestamp_order_violations,
  unique_template_count >= 2 AS normalized_prompt_holdout_feasible, unique_log_count >= 2 AS log_disjoint_feasible, candidate_groups_with_positive_and_negative > 0 AS fixed_frame_ranking_feasible FROM one, gs)"""


@query("inspect_records", f"WITH {_INSPECTED} SELECT * FROM inspection")
def _(spark, d):
    return audit.inspect_records(_records(spark, d))


@query("inspect_examples", f"WITH {_RECORDS} SELECT log_id, prompt, timestamp_ns, count(*) AS candidate_count, count(*) FILTER (label = 0) AS referred_count, count(*) FILTER (label IN (1, 2)) AS negative_count FROM rec GROUP BY ALL ORDER BY min(_row_ord) LIMIT 20")
def _(spark, d):
    return audit.group_examples(_records(spark, d))


@query("verifier_status", f"""WITH {_INSPECTED}, w AS (SELECT list_filter([CASE WHEN missing_required > 0 THEN 'missing_required' END, CASE WHEN duplicate_candidate_key_count > 0 THEN 'duplicate_candidate_key_count' END, CASE WHEN timestamp_order_violations > 0 THEN 'timestamp_order_violations' END,
  CASE WHEN invalid_labels > 0 THEN 'invalid_labels' END, 'split_missing', CASE WHEN NOT fixed_frame_ranking_feasible THEN 'ranking_infeasible' END, CASE WHEN camera_association_fraction < 1 THEN 'camera_incomplete' END, CASE WHEN NOT official_filter_reproducible THEN 'filter_not_reproducible' END], lambda x: x IS NOT NULL) AS w, record_count FROM inspection)
SELECT CASE WHEN record_count > 0 THEN 'ok' ELSE 'not_ready' END AS status, array_to_string(w, ',') AS warnings, CASE WHEN len(w) > 0 OR record_count = 0 THEN 2 ELSE 0 END AS exit_code FROM w""")
def _(spark, d):
    i = audit.inspect_records(_records(spark, d)).withColumns({"split_required": F.lit(True), "split_present": F.lit(False), "camera_required": F.lit(True), "filter_set": F.lit(True)})
    return audit.verifier_status(i).withColumn("warnings", F.array_join("warnings", ","))


@query("merge_log_stats", """WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS log_id, CAST(l_suppkey % 3 AS VARCHAR) AS split, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT split, kind, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT log_id) AS logs FROM s GROUP BY GROUPING SETS ((kind), (split, kind))""")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("log_id"), (F.col("l_suppkey") % 3).cast("string").alias("split"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    return audit.merge_log_stats(s)


# ---- Coverage ----------------------------------------------------------------------------------------------------------

_GROUPS = f"""{LINES}, g AS (SELECT log_id, prompt, timestamp_ns, count(*) AS candidate_count, count(*) FILTER (label = 0) AS gt_positive_count, count(*) FILTER (label = 0 AND distance_m <= 40) AS eligible_positive_count, count(*) FILTER (label = 0 AND distance_m <= 30) AS matched_positive_count,
  count(*) FILTER (label = 0 AND distance_m <= 30 AND area > 0) AS projected_positive_count, count(*) FILTER (label = 0 AND name <> 'p0') AS gt_external_positive_count, count(*) FILTER (label = 0 AND name <> 'p0' AND distance_m <= 40) AS eligible_external_positive_count,
  count(*) FILTER (label = 0 AND name <> 'p0' AND distance_m <= 30) AS matched_external_positive_count, count(*) FILTER (label = 0 AND name <> 'p0' AND distance_m <= 30 AND area > 0) AS projected_external_positive_count,
  count(*) FILTER (label = 0 AND name <> 'p0' AND distance_m <= 30 AND area > 50) AS projected_external_positive_count_all_seven_assets, count(*) FILTER (label = 0 AND name = 'p0') AS ego_positive_count, count(*) FILTER (label IS NULL) AS unknown_count,
  CAST(timestamp_ns % 3 AS VARCHAR) AS split, CASE WHEN prompt = 'RF' THEN '0' ELSE '1' END AS prompt_split FROM cand GROUP BY ALL),
gg AS (SELECT *, split = prompt_split AS joint_holdout_eligible, CASE WHEN candidate_count = 0 THEN '0' WHEN candidate_count <= 10 THEN '1-10' WHEN candidate_count <= 50 THEN '11-50' WHEN candidate_count <= 100 THEN '51-100' ELSE '101+' END AS candidate_count_range FROM g)"""
_OUT = """count(*) AS group_count, count(*) FILTER (gt_positive_count > 0) AS gt_positive_group_count, round(count(*) FILTER (gt_positive_count > 0) / count(*), 6) AS event_frequency, count(*) FILTER (gt_external_positive_count > 0) AS gt_external_positive_group_count,
  round(count(*) FILTER (gt_external_positive_count > 0) / count(*), 6) AS external_event_frequency, count(*) FILTER (eligible_external_positive_count > 0) AS eligible_positive_group_count, round(count(*) FILTER (matched_external_positive_count > 0) / count(*), 6) AS positive_availability_all_groups,
  round(count(*) FILTER (matched_external_positive_count > 0 AND eligible_external_positive_count > 0) / nullif(count(*) FILTER (eligible_external_positive_count > 0), 0), 6) AS positive_availability_given_eligible_gt_positive, CAST(sum(eligible_external_positive_count) AS BIGINT) AS eligible_positive_object_count,
  CAST(sum(matched_external_positive_count) AS BIGINT) AS matched_positive_object_count, round(sum(projected_external_positive_count) / nullif(sum(matched_external_positive_count), 0), 6) AS positive_projection_rate_downloaded_cameras, CAST(sum(unknown_count) AS BIGINT) AS unknown_candidate_count,
  CAST(sum(candidate_count) AS BIGINT) AS candidate_row_count, round(sum(unknown_count) / nullif(sum(candidate_count), 0), 6) AS unknown_fraction, count(*) FILTER (candidate_count = 0) AS zero_candidate_groups, count(*) FILTER (ego_positive_count > 0) AS ego_positive_group_count,
  CAST(sum(ego_positive_count) AS BIGINT) AS ego_positive_object_count, CAST(sum(projected_external_positive_count_all_seven_assets) AS BIGINT) AS matched_positive_count_all_seven_assets"""


def _groups(spark, d):
    p, ext, dist = F.col("label") == 0, F.col("name") != "p0", F.col("distance_m")
    n = lambda c: F.count_if(c)
    g = line_candidates(spark, d).groupBy(*GROUP).agg(
        F.count("*").alias("candidate_count"), n(p).alias("gt_positive_count"), n(p & (dist <= 40)).alias("eligible_positive_count"), n(p & (dist <= 30)).alias("matched_positive_count"), n(p & (dist <= 30) & (F.col("area") > 0)).alias("projected_positive_count"),
        n(p & ext).alias("gt_external_positive_count"), n(p & ext & (dist <= 40)).alias("eligible_external_positive_count"), n(p & ext & (dist <= 30)).alias("matched_external_positive_count"), n(p & ext & (dist <= 30) & (F.col("area") > 0)).alias("projected_external_positive_count"),
        n(p & ext & (dist <= 30) & (F.col("area") > 50)).alias("projected_external_positive_count_all_seven_assets"), n(p & ~ext).alias("ego_positive_count"), n(F.col("label").isNull()).alias("unknown_count"),
    )
    g = g.withColumns({"split": (F.col("timestamp_ns") % 3).cast("string"), "prompt_split": F.when(F.col("prompt") == "RF", "0").otherwise("1"), "candidate_count_range": fn.count_bin(F.col("candidate_count"))})
    return g.withColumn("joint_holdout_eligible", F.col("split") == F.col("prompt_split"))


@query("coverage_summary", f"WITH {_GROUPS} SELECT {_OUT} FROM gg")
def _(spark, d):
    return audit.coverage(_groups(spark, d))


_FIELDS = {"log_id": "log_id", "split": "split", "candidate_count_range": "candidate_count_range", "prompt_split": "prompt_split", "joint_holdout": "CASE WHEN joint_holdout_eligible THEN 'true' END"}


@query("coverage_strata", f"WITH {_GROUPS} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {v} AS value, {_OUT} FROM gg WHERE {v} IS NOT NULL GROUP BY {v}" for f, v in _FIELDS.items()))
def _(spark, d):
    return audit.coverage_strata(_groups(spark, d))


# ---- Diagnosis ---------------------------------------------------------------------------------------------------------

#: Order lines with boxes, sizes, positions and statuses, some of them missing.
_ROWS = f"""{LINES}, rows AS (SELECT c.*, CASE WHEN distance_m % 7 <> 0 THEN area ELSE 0 END AS projected_area_px, score AS tracker_score, CASE WHEN distance_m % 5 = 0 THEN area / 10 END AS match_distance_m, distance_m / 10 AS size_length_m, CASE WHEN distance_m % 3 = 0 THEN 2.0::DOUBLE END AS size_width_m, 1.5::DOUBLE AS size_height_m,
  score / 1000 AS translation_x_m, -distance_m AS translation_y_m, CAST(NULL AS DOUBLE) AS translation_z_m, CASE WHEN distance_m % 7 <> 0 AND area > 20 THEN 'PROJECTED' ELSE 'OUT_OF_VIEW' END AS projection_status, coalesce({_LABEL_NAME}, 'UNKNOWN') AS label_name FROM cand c)"""


def _rows(spark, d):
    c, dist = line_candidates(spark, d), F.col("distance_m")
    seen = dist % 7 != 0
    return c.withColumns({
        "projected_box": F.when(seen, F.array(F.lit(0.0), F.lit(0.0), F.col("area"), F.lit(1.0))), "match_distance_m": F.when(dist % 5 == 0, F.col("area") / 10),
        "size": F.array(dist / 10, F.when(dist % 3 == 0, 2.0), F.lit(1.5)), "translation_m": F.array(F.col("score") / 1000, -dist), "projection_status": F.when(seen & (F.col("area") > 20), "PROJECTED").otherwise("OUT_OF_VIEW"),
    })


def _feature_sql(f: str) -> str:
    r = lambda x, n: f"round({x}, 6) AS {n}"
    q = lambda x, n: r(f"quantile_cont({f}, {x})", n)
    return f"""SELECT label_name, '{f}' AS feature, count({f}) AS count, count(*) - count({f}) AS missing, {r(f"avg({f})", "mean")}, {r(f"stddev_pop({f})", "std")}, {r(f"min({f})", "min")}, {q(0.25, "q25")}, {q(0.5, "median")}, {q(0.75, "q75")}, {r(f"max({f})", "max")} FROM rows GROUP BY label_name"""


@query("label_feature_distributions", f"WITH {_ROWS} " + " UNION ALL ".join(map(_feature_sql, fn.FEATURES)))
def _(spark, d):
    return diagnosis.label_distributions(_rows(spark, d))


@query("feature_struct", f"WITH {_ROWS} SELECT track_id, {', '.join(f'round({f}, 6) AS {f}' for f in fn.FEATURES)} FROM rows")
def _(spark, d):
    r = diagnosis.with_features(_rows(spark, d))
    return r.select("track_id", *[F.round(f"_f.{f}", 6).alias(f) for f in fn.FEATURES])


_VISIBLE = """vis AS (SELECT round(p, 6) AS referred_visible_rate, round(n, 6) AS negative_visible_rate, round(p - n, 6) AS visibility_gap, positive_rows, negative_rows FROM (SELECT count(*) FILTER (label = 0 AND projection_status = 'PROJECTED') / nullif(count(*) FILTER (label = 0), 0) AS p,
  count(*) FILTER (label IN (1, 2) AND projection_status = 'PROJECTED') / nullif(count(*) FILTER (label IN (1, 2)), 0) AS n, count(*) FILTER (label = 0) AS positive_rows, count(*) FILTER (label IN (1, 2)) AS negative_rows FROM rows))"""


@query("label_visibility", f"WITH {_ROWS}, {_VISIBLE} SELECT * FROM vis")
def _(spark, d):
    return diagnosis.visibility(_rows(spark, d))


@query("group_diagnosis", f"""WITH {DOCS}, g AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS p, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 2) AS b FROM cand GROUP BY log_id, prompt, timestamp_ns)
SELECT count(*) AS groups, count(*) FILTER (p > 0 AND a + b > 0) AS rankable_groups, count(*) FILTER (p > 0) AS positive_groups, round(count(*) FILTER (p > 0) / count(*), 6) AS oracle_coverage, round(count(*) FILTER (p > 0 AND a + b > 0) / count(*), 6) AS rankable_rate,
  round(avg(n), 6) AS mean_candidates, min(n) AS least_candidates, round(quantile_cont(n, 0.25), 6) AS q25_candidates, round(quantile_cont(n, 0.5), 6) AS median_candidates, round(quantile_cont(n, 0.75), 6) AS q75_candidates, max(n) AS most_candidates,
  CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS referred, CAST(sum(a) AS BIGINT) AS related, CAST(sum(b) AS BIGINT) AS other, CAST(sum(n - p - a - b) AS BIGINT) AS unknown, round(sum(n - p - a - b) / sum(n), 6) AS unknown_rate FROM g""")
def _(spark, d):
    return diagnosis.group_summary(document_candidates(spark, d))


_SIZE_BIN = "CASE WHEN {n} BETWEEN 1 AND 64 THEN '1-64' WHEN {n} BETWEEN 65 AND 128 THEN '65-128' WHEN {n} BETWEEN 129 AND 256 THEN '129-256' ELSE '257+' END"


def _strata_sql(field: str, value: str) -> str:
    """Each stratum ranked with the frequencies of its own rows."""
    ranked = ranked_sql()
    ranked = ranked[ranked.index("long AS") :]
    ok = "positive_count > 0 AND negative_count > 0"
    mean = lambda c, n: f"round(avg(CASE WHEN {ok} THEN {c} END), 6) AS {n}"
    return f"""SELECT * FROM (WITH sized AS (SELECT c.*, {_SIZE_BIN.format(n="count(*) OVER (PARTITION BY log_id, prompt, timestamp_ns)")} AS bin FROM cand c), own AS (SELECT *, {value} AS value FROM sized), freq AS (SELECT *, count(*) OVER (PARTITION BY value, name) AS freq FROM own), {ranked},
  v AS (SELECT DISTINCT log_id, prompt, timestamp_ns, value FROM own) SELECT '{field}' AS field, value, control, count(*) AS groups, count(*) FILTER ({ok}) AS rankable_groups, {mean("average_precision", "mean_ap")}, {mean("recall_at_1", "recall_at_1")},
  {mean("labeled_average_precision", "labeled_mean_ap")}, {mean("labeled_recall_at_1", "labeled_recall_at_1")}, round(avg(candidate_count), 6) AS mean_candidates, round(avg(unknown_count), 6) AS mean_unknown FROM met JOIN v USING (log_id, prompt, timestamp_ns) GROUP BY value, control)"""


@query("control_strata", f"WITH {DOCS} " + _strata_sql("log_id", "log_id") + " UNION ALL " + _strata_sql("candidate_count", "bin"))
def _(spark, d):
    return diagnosis.compact(diagnosis.control_strata(document_candidates(spark, d)), "field", "value", "control")


#: Two models over the same candidates: the tracker's score and its distance, as their per-group metrics.
_MODELS = f"{ranked_sql(['tracker_score', 'candidate_distance'])}, models AS (SELECT CASE control WHEN 'tracker_score' THEN 'pooled' ELSE 'task_id' END AS model, * FROM met)"


_MODEL_CONTROLS = {"pooled": "tracker_score", "task_id": "candidate_distance"}


def _models(spark, d):
    m = ranking.group_metrics(ranking.rank(line_candidates(spark, d), list(_MODEL_CONTROLS.values())))
    return m.withColumn("model", F.when(F.col("control") == "tracker_score", "pooled").otherwise("task_id"))


def _learned_sql(field: str, value: str) -> str:
    ok = "positive_count > 0 AND negative_count > 0"
    mean = lambda c, n: f"round(avg(CASE WHEN {ok} THEN {c} END), 6) AS {n}"
    return f"""SELECT model, '{field}' AS field, {value} AS value, count(*) AS groups, count(*) FILTER ({ok}) AS rankable_groups, {mean("average_precision", "mean_ap")}, {mean("recall_at_1", "recall_at_1")}, {mean("labeled_average_precision", "labeled_mean_ap")}, {mean("labeled_recall_at_1", "labeled_recall_at_1")},
  round(avg(candidate_count), 6) AS mean_candidates, round(avg(unknown_count), 6) AS mean_unknown FROM models GROUP BY ALL"""


@query("learned_strata", f"WITH {LINES}, {_MODELS} " + _learned_sql("log_id", "log_id") + " UNION ALL " + _learned_sql("candidate_count", _SIZE_BIN.format(n="candidate_count")))
def _(spark, d):
    return diagnosis.compact(diagnosis.learned_strata(_models(spark, d)), "model", "field", "value")


_PROPERTIES = "m AS (SELECT *, CASE WHEN prompt = 'RF' THEN '0' ELSE '1' END AS prompt_split, (timestamp_ns % 2 = 0) AS joint_holdout_eligible FROM models)"


@query("strata_holdout", f"""WITH {LINES}, {_MODELS}, {_PROPERTIES} SELECT model, prompt_split, joint_holdout_eligible, count(*) AS groups, round(avg(CASE WHEN positive_count > 0 AND negative_count > 0 THEN average_precision END), 6) AS mean_ap
FROM m GROUP BY GROUPING SETS ((model, prompt_split), (model, joint_holdout_eligible))""")
def _(spark, d):
    m = _models(spark, d).withColumns({"prompt_split": F.when(F.col("prompt") == "RF", "0").otherwise("1"), "joint_holdout_eligible": F.col("timestamp_ns") % 2 == 0})
    ok = (F.col("positive_count") > 0) & (F.col("negative_count") > 0)
    c = [F.col(x) for x in ("model", "prompt_split", "joint_holdout_eligible")]
    return m.groupingSets([[c[0], c[1]], [c[0], c[2]]], *c).agg(F.count("*").alias("groups"), F.round(F.avg(F.when(ok, F.col("average_precision"))), 6).alias("mean_ap"))


_SUITE = f"{_HARD.format(delta=5000)}, {_AREA}, {_FULL}, suite AS (" + " UNION ALL ".join(_view_sql(v, s) for v, s in (("full", "cand"), ("score_matched", "near"), ("score_size_matched", "near2"))) + ")"
_FLAGS = f"""{_ROWS}, {_VISIBLE}, {_SUITE}, med AS (SELECT quantile_cont(CASE WHEN label = 0 THEN projected_area_px END, 0.5) AS p, quantile_cont(CASE WHEN label = 1 THEN projected_area_px END, 0.5) AS a, quantile_cont(CASE WHEN label = 2 THEN projected_area_px END, 0.5) AS b FROM rows),
ratio AS (SELECT round(p / nullif(list_avg(list_filter([a, b], lambda x: x > 0)), 0), 6) AS area_ratio FROM med), rival AS (SELECT * FROM suite WHERE control <> 'oracle'),
beaten AS (SELECT coalesce(string_agg(control, ',' ORDER BY control) FILTER (view = 'full' AND mean_ap - {{model}} >= 0.03), '') AS dominant_controls, max(mean_ap) FILTER (view = 'score_size_matched') AS strongest_size_matched, {{model}} AS model_map FROM rival),
f AS (SELECT *, coalesce(visibility_gap >= 0.1, false) AS visibility_gap_flag, coalesce(area_ratio >= 1.5, false) AS area_ratio_flag, dominant_controls <> '' AS control_dominance_flag, coalesce(strongest_size_matched - model_map >= 0.03, false) AS size_matched_flag FROM vis, ratio, beaten),
flags AS (SELECT *, array_to_string(list_filter([CASE WHEN visibility_gap_flag THEN 'visibility_gap' END, CASE WHEN area_ratio_flag THEN 'area_ratio' END, CASE WHEN control_dominance_flag THEN 'control_dominance' END, CASE WHEN size_matched_flag THEN 'size_matched_dominance' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f)"""


def _joined(flags):
    return flags.withColumns({"dominant_controls": F.array_join("dominant_controls", ","), "reasons": F.array_join("reasons", ",")})


@query("shortcut_flags", f"WITH {_FLAGS.format(model='0.2::DOUBLE')} SELECT * FROM flags")
def _(spark, d):
    r = _rows(spark, d)
    return _joined(diagnosis.shortcut_flags(r, ranking.control_suite(r, 5000.0, 0.2), 0.2))


_POOLED = "(SELECT round(avg(CASE WHEN positive_count > 0 AND negative_count > 0 THEN average_precision END), 6) FROM models WHERE model = 'pooled')"


@query("diagnose_split", f"WITH {_FLAGS.format(model=_POOLED).replace('beaten AS', _MODELS + ', beaten AS', 1)} SELECT * FROM flags")
def _(spark, d):
    """The flags of a split's whole diagnosis; its other parts have queries of their own."""
    return _joined(diagnosis.diagnose_split(_rows(spark, d), _MODEL_CONTROLS, 5000.0, 0.2, ["flags"])["flags"])


@query("diagnose_split_report")
def _(spark, d):
    return diagnosis.report(diagnosis.diagnose_split(_rows(spark, d), _MODEL_CONTROLS, 5000.0, 0.2))


@query("split_plan_problems", """WITH plan AS (SELECT n_nationkey AS log, CASE WHEN n_nationkey % 10 < 6 THEN 'train' WHEN n_nationkey % 10 < 8 THEN 'validation' ELSE 'test' END AS planned FROM nation WHERE n_nationkey <> 3),
g AS (SELECT DISTINCT c_nationkey AS log, CASE WHEN c_custkey % 97 = 0 THEN 'test' WHEN c_nationkey % 10 < 6 THEN 'train' WHEN c_nationkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM customer)
SELECT log, split, CASE WHEN planned IS NULL THEN 'absent' ELSE 'mismatched' END AS problem FROM g LEFT JOIN plan USING (log) WHERE planned IS NULL OR planned <> split""")
def _(spark, d):
    s = lambda c: F.when(c % 10 < 6, "train").when(c % 10 < 8, "validation").otherwise("test")
    plan = table(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("log"), s(F.col("n_nationkey")).alias("split"))
    g = table(spark, d, "customer").select(F.col("c_nationkey").alias("log"), F.when(F.col("c_custkey") % 97 == 0, "test").otherwise(s(F.col("c_nationkey"))).alias("split"))
    return audit.plan_problems(g, plan)


# ---- Decisions ---------------------------------------------------------------------------------------------------------


@query("decide_report", f"""WITH {LINES}, g AS (SELECT log_id, timestamp_ns % 2 AS split, bool_or(label = 0) AND bool_or(label IN (1, 2)) AS ok FROM cand GROUP BY log_id, prompt, timestamp_ns),
s AS (SELECT split, count(*) FILTER (ok) AS rankable, CASE WHEN split = 1 THEN 1 ELSE 0 END AS reasons FROM g GROUP BY split)
SELECT CASE WHEN count(*) FILTER (rankable < 50) > 0 THEN 'BRANCH_STOPPED' WHEN count(*) FILTER (reasons > 0) > 0 THEN 'PROTOCOL_REPAIR_REQUIRED' ELSE 'PROTOCOL_VALIDATION_CONTINUES' END AS decision, count(*) FILTER (rankable < 50) AS small_splits, count(*) FILTER (reasons > 0) AS flagged_splits FROM s""")
def _(spark, d):
    c = line_candidates(spark, d)
    n = ranking.rankable(c).groupBy((F.col("timestamp_ns") % 2).alias("split")).agg(F.count("*").alias("rankable_groups"))
    return audit.decide_report(n.withColumn("reasons", F.when(F.col("split") == 1, F.array(F.lit("area_ratio"))).otherwise(F.array())))


#: One case for each mix of inputs, numbered from 0.
_CASES = """case_ AS (SELECT range AS k, range % 2 = 0 AS infrastructure_complete, CASE (range // 2) % 3 WHEN 0 THEN 0.85::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS availability, CASE (range // 6) % 2 WHEN 0 THEN 0.95::DOUBLE ELSE 0.3::DOUBLE END AS projection,
  CASE (range // 12) % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.3::DOUBLE END AS stability, CASE (range // 36) % 2 WHEN 0 THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS best_control, CASE (range // 72) % 2 WHEN 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS oracle_availability, 0.92::DOUBLE AS oracle_projection FROM range(144)),
t AS (SELECT *, true AS pool_independent, coalesce(availability >= 0.8, false) AS coverage_ge_0_80, infrastructure_complete AND projection >= 0.9 AS projection_ge_0_90, coalesce(stability <= 0.1, false) AS matching_stability_le_0_10, best_control < 0.9 AS no_near_perfect_metadata_control, true AS unknown_statuses_explicit FROM case_),
u AS (SELECT *, infrastructure_complete AS infrastructure, infrastructure_complete AND coverage_ge_0_80 AND projection_ge_0_90 AND matching_stability_le_0_10 AND no_near_perfect_metadata_control AS data_gate_pass, NOT coverage_ge_0_80 OR NOT matching_stability_le_0_10 AS association_uncertain,
  CASE WHEN infrastructure_complete THEN oracle_availability >= 0.8 AND oracle_projection >= 0.9 END AS oracle_pass FROM t)"""


def _case(k: Column, step: int, *values) -> Column:
    at = F.floor(k / step) % len(values)
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(at == i, v).otherwise(out)
    return out


@query("audit_gate", f"""WITH {_CASES} SELECT *, CASE WHEN NOT infrastructure_complete THEN 'ALTERNATE_CANDIDATE_SOURCE_REQUIRED' WHEN data_gate_pass AND no_near_perfect_metadata_control THEN 'POOLED_BASELINE_GATE_READY' WHEN association_uncertain THEN 'ASSOCIATION_REVIEW_REQUIRED'
  WHEN NOT no_near_perfect_metadata_control OR oracle_pass = false THEN 'BRANCH_STOPPED' WHEN oracle_pass THEN 'ORACLE_ONLY' ELSE 'ALTERNATE_CANDIDATE_SOURCE_REQUIRED' END AS decision FROM u""")
def _(spark, d):
    k = F.col("k")
    cases = spark.range(144).select(
        F.col("id").alias("k"), (F.col("id") % 2 == 0).alias("infrastructure_complete")).withColumns({
            "availability": _case(k, 2, 0.85, 0.5, None), "projection": _case(k, 6, 0.95, 0.3), "stability": _case(k, 12, 0.05, 0.3, None), "best_control": _case(k, 36, 0.4, 0.95),
            "oracle_availability": _case(k, 72, 0.9, 0.1), "oracle_projection": F.lit(0.92),
    })
    return audit.audit_gate(cases)


_GATE_CONTROLS = ["tracker_score", "projected_box_area"]


@query("audit_gate_by_log", f"""WITH {LINES}, {ranked_sql(_GATE_CONTROLS)}, per AS (SELECT log_id, timestamp_ns, prompt, count(*) FILTER (label = 0) > 0 AS hit, count(*) FILTER (label = 0) AS p, count(*) FILTER (label = 0 AND area > 40) AS pp, count(*) FILTER (label = 0 AND area > 10) AS po, count(*) AS n, count(*) FILTER (label IS NULL) AS u FROM cand GROUP BY ALL),
half AS (SELECT log_id, timestamp_ns % 2 AS h, avg(hit::INT) AS a FROM per GROUP BY ALL), st AS (SELECT log_id, round(max(a) - min(a), 6) AS stability FROM half GROUP BY log_id),
ctl AS (SELECT log_id, control, round(avg(CASE WHEN positive_count > 0 AND negative_count > 0 THEN average_precision END), 6) AS ap FROM met GROUP BY ALL), best AS (SELECT log_id, max(ap) AS best_control FROM ctl GROUP BY log_id),
u0 AS (SELECT log_id, CAST(sum(u) AS DOUBLE) / sum(n) < 0.3::DOUBLE AS infrastructure_complete, round(avg(hit::INT), 6) AS availability, round(CAST(sum(pp) AS DOUBLE) / nullif(sum(p), 0), 6) AS projection, round(avg((hit AND n - p - u > 0)::INT), 6) AS oracle_availability, round(CAST(sum(po) AS DOUBLE) / nullif(sum(p), 0), 6) AS oracle_projection FROM per GROUP BY log_id),
r AS (SELECT *, coalesce(availability >= 0.80, false) AS coverage_ge_0_80, infrastructure_complete AND coalesce(projection >= 0.90, false) AS projection_ge_0_90, coalesce(stability <= 0.10, false) AS matching_stability_le_0_10, NOT coalesce(best_control >= 0.90, false) AS no_near_perfect_metadata_control,
  CASE WHEN infrastructure_complete THEN coalesce(oracle_availability >= 0.80, false) AND coalesce(oracle_projection >= 0.90, false) END AS oracle_pass FROM u0 JOIN st USING (log_id) JOIN best USING (log_id)),
z AS (SELECT *, infrastructure_complete AND coverage_ge_0_80 AND projection_ge_0_90 AND matching_stability_le_0_10 AND no_near_perfect_metadata_control AS data_gate_pass, NOT coverage_ge_0_80 OR NOT matching_stability_le_0_10 AS association_uncertain FROM r)
SELECT log_id, data_gate_pass, association_uncertain, oracle_pass, CASE WHEN NOT infrastructure_complete THEN 'ALTERNATE_CANDIDATE_SOURCE_REQUIRED' WHEN data_gate_pass AND no_near_perfect_metadata_control THEN 'POOLED_BASELINE_GATE_READY' WHEN association_uncertain THEN 'ASSOCIATION_REVIEW_REQUIRED'
  WHEN NOT no_near_perfect_metadata_control OR oracle_pass = false THEN 'BRANCH_STOPPED' WHEN oracle_pass THEN 'ORACLE_ONLY' ELSE 'ALTERNATE_CANDIDATE_SOURCE_REQUIRED' END AS decision FROM z""")
def _(spark, d):
    """The audit's code for each log, from its groups, its controls and its positives with a box of some area."""
    c = line_candidates(spark, d)
    pos, many = F.col("label") == 0, F.count("*")
    per = c.groupBy(*GROUP).agg((F.count_if(pos) > 0).cast("int").alias("hit"), F.count_if(pos).alias("p"), F.count_if(pos & (F.col("area") > 40)).alias("pp"), F.count_if(pos & (F.col("area") > 10)).alias("po"), many.alias("n"), F.count_if(F.col("label").isNull()).alias("u"))
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 6)
    stable = per.groupBy("log_id", (F.col("timestamp_ns") % 2).alias("h")).agg(F.avg("hit").alias("a")).groupBy("log_id").agg(F.round(F.max("a") - F.min("a"), 6).alias("stability"))
    best = ranking.summarize(ranking.group_metrics(ranking.rank(c, _GATE_CONTROLS)), "log_id", "control").groupBy("log_id").agg(F.max("mean_ap").alias("best_control"))
    both = F.col("hit") * (F.col("n") - F.col("p") - F.col("u") > 0).cast("int")
    cases = per.groupBy("log_id").agg((F.sum("u") / F.sum("n") < 0.3).alias("infrastructure_complete"), F.round(F.avg("hit"), 6).alias("availability"), ratio("pp", "p").alias("projection"), F.round(F.avg(both), 6).alias("oracle_availability"), ratio("po", "p").alias("oracle_projection"))
    return audit.audit_gate(cases.join(stable, "log_id").join(best, "log_id")).select("log_id", "data_gate_pass", "association_uncertain", "oracle_pass", "decision")


@query("assess_decision", f"""WITH {LINES}, g AS (SELECT count(*) AS n, count(DISTINCT track_id) AS d, count(*) FILTER (label = 0) AS p, count(*) FILTER (label = 0 AND area > 0) AS pp, count(*) FILTER (label IS NULL) AS u FROM cand GROUP BY log_id, prompt, timestamp_ns),
a AS (SELECT count(*) AS groups, round(count(*) FILTER (p > 0) / count(*), 6) AS availability, round(sum(pp) / nullif(sum(p), 0), 6) AS projection, round(sum(u) / nullif(sum(n), 0), 6) AS unknown_fraction, CAST(sum(n - d) AS BIGINT) AS repeats FROM g),
c AS (SELECT *, coalesce(availability >= 0.8, false) AS availability_ok, coalesce(projection >= 0.9, false) AS projection_ok, repeats = 0 AS unique_ok FROM a) SELECT *, CASE WHEN availability_ok AND projection_ok AND unique_ok THEN 'PROTOCOL_VALIDATION_CONTINUES' ELSE 'PROTOCOL_REPAIR_REQUIRED' END AS decision FROM c""")
def _(spark, d):
    return audit.assess_decision(audit.assess(line_candidates(spark, d).withColumn("projected", F.col("area") > 0)))


_THREE = {"pooled": "tracker_score", "task_id": "projected_box_area", "metadata": "candidate_distance"}


#: Logits of the three models, as functions of a candidate.
_LOGITS = {"pooled": "(score - 40000) / 8000", "task_id": "(area - 120) / 60", "metadata": "(25 - distance_m) / 10"}
_BINS = "CAST(CASE " + " ".join(f"WHEN p < {e!r}::DOUBLE THEN {i}" for i, e in enumerate(ranking.EDGES[1:10])) + " ELSE 9 END AS INTEGER)"


@query("baseline_gate", f"""WITH {LINES}, {ranked_sql(list(_THREE.values()))}, m AS (SELECT timestamp_ns % 2 AS seed, control, round(avg(CASE WHEN positive_count > 0 AND negative_count > 0 THEN average_precision END), 6) AS map, round(avg(CASE WHEN positive_count > 0 AND negative_count > 0 THEN recall_at_1 END), 6) AS top FROM met GROUP BY ALL),
lg AS ({" UNION ALL ".join(f"SELECT timestamp_ns % 2 AS seed, '{n}' AS model, 1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, CAST({x} AS DOUBLE))))) AS p, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0 END AS y FROM cand WHERE label IS NOT NULL" for n, x in _LOGITS.items())}),
bn AS (SELECT seed, model, {_BINS} AS bin, count(*) AS n, abs(sum(p - y)) AS e FROM lg GROUP BY ALL), ec AS (SELECT seed, model, round(sum(e) / sum(n), 6) AS ece FROM bn GROUP BY ALL),
w AS (SELECT seed, {", ".join(f"max(map) FILTER (control = '{c}') AS {n}_map, max(top) FILTER (control = '{c}') AS {n}_top, (SELECT ece FROM ec WHERE ec.seed = m.seed AND model = '{n}') AS {n}_ece" for n, c in _THREE.items())} FROM m GROUP BY seed), l AS (SELECT * FROM w ORDER BY seed LIMIT 1),
a AS (SELECT round(avg(CASE WHEN positive_count > 0 AND negative_count > 0 THEN average_precision END), 6) AS map, round(avg(CASE WHEN positive_count > 0 AND negative_count > 0 THEN recall_at_1 END), 6) AS top FROM met WHERE control = 'projected_box_area'),
f AS (SELECT count(*) FILTER (label = 0 AND area > 0) / count(*) FILTER (label = 0) AS front, count(*) FILTER (label = 0 AND (area > 0 OR distance_m < 49)) / count(*) FILTER (label = 0) AS every FROM cand)
SELECT min(w.pooled_map - w.task_id_map) >= 0.03 AS map_margin, min(w.pooled_top - w.task_id_top) >= 0.05 AS recall_margin, any_value(l.pooled_map > l.metadata_map AND l.pooled_top > l.metadata_top) AS beats_metadata, any_value(l.pooled_map > a.map AND l.pooled_top > a.top) AS beats_area_control,
  any_value(l.pooled_ece <= l.task_id_ece + 0.03::DOUBLE) AS calibration, any_value(round(f.front, 6) >= 0.9) AS front_coverage, any_value(round(f.every, 6) >= 0.9) AS all_camera_coverage FROM w, l, a, f""")
def _(spark, d):
    c = line_candidates(spark, d)
    g = ranking.group_metrics(ranking.rank(c, list(_THREE.values())))
    s = ranking.summarize(g.withColumn("seed", F.col("timestamp_ns") % 2), "seed", "control")
    name = F.lit(None).cast("string")
    for n, control in _THREE.items():
        name = F.when(F.col("control") == control, n).otherwise(name)
    logits = F.array(*[F.struct(F.lit(n).alias("model"), F.expr(x).alias("logit")) for n, x in _LOGITS.items()])
    told = c.select((F.col("timestamp_ns") % 2).alias("seed"), "label", F.explode(logits).alias("l")).select("seed", "label", "l.*")
    models = s.select("seed", name.alias("model"), F.col("mean_ap").alias("map"), "recall_at_1").join(ranking.calibration(told, "logit", "seed", "model").select("seed", "model", "ece"), ["seed", "model"])
    area = ranking.summarize(g.where("control = 'projected_box_area'")).select(F.col("mean_ap").alias("map"), "recall_at_1")
    seen = lambda x: audit.assess(c.withColumn("projected", x)).select("projection")
    front, every = seen(F.col("area") > 0), seen((F.col("area") > 0) | (F.col("distance_m") < 49))
    coverage = front.select(F.col("projection").alias("front_coverage")).crossJoin(every.select(F.col("projection").alias("all_coverage")))  # one row each
    return audit.baseline_gate(models, area, coverage)


# ---- Seeds -------------------------------------------------------------------------------------------------------------

_SEED_MODELS, _SEED_BASELINES = ["tracker_score"], ["candidate_distance", "projected_box_area", "category_frequency"]
_SEED_METRICS = ["average_precision", "recall_at_1", "labeled_average_precision", "labeled_recall_at_1"]


def _seeded(spark, d):
    m = ranking.group_metrics(ranking.rank(line_candidates(spark, d), [*_SEED_MODELS, *_SEED_BASELINES]))
    split = F.when(F.col("prompt") == "RF", "test").otherwise("validation")
    return m.withColumns({"seed": F.col("timestamp_ns") % 2, "split": split, "model": F.col("control"), **{c: F.col(c).cast("double") for c in _SEED_METRICS}})


def _drawn_sql(baselines: list[str], metrics: list[str], samples: int) -> str:
    """mean and ci by seed, split, baseline and metric: one set of weights a resample serves all of them, as groups without positives lack every metric."""
    pairs = [(b, m) for b in baselines for m in metrics]
    weight = " + ".join(f"(u >= {e})::INT" for e in ranking.POISSON)
    told = lambda v: ", ".join(f"{{'baseline': '{b}', 'metric': '{m}', 'v': {v}{i}}}" for i, (b, m) in enumerate(pairs))
    joins = " ".join(f"JOIN seeded q{i} ON q{i}.log_id = p.log_id AND q{i}.prompt = p.prompt AND q{i}.timestamp_ns = p.timestamp_ns AND q{i}.control = '{b}'" for i, b in enumerate(baselines))
    return f"""s AS (SELECT range AS s, 1 + CAST('0x' || substr(sha256('a|0|' || range), 1, 12) AS BIGINT) % {ranking.PRIME - 1} AS a, CAST('0x' || substr(sha256('b|0|' || range), 1, 12) AS BIGINT) % {ranking.PRIME} AS b FROM range({samples})),
diff AS (SELECT p.seed, p.split, {", ".join(f"CAST(p.{m} - q{baselines.index(b)}.{m} AS DOUBLE) AS d{i}" for i, (b, m) in enumerate(pairs))}, CAST('0x' || substr(sha256(p.log_id || '|' || p.prompt || '|' || p.timestamp_ns), 1, 12) AS BIGINT) % {ranking.PRIME} AS h
  FROM seeded p {joins} WHERE p.control = 'tracker_score' AND p.average_precision IS NOT NULL),
w AS (SELECT diff.*, s.s, (s.a * diff.h + s.b) % {ranking.PRIME} AS u FROM diff, s), k AS (SELECT *, {weight} AS k FROM w),
m AS (SELECT seed, split, s, {", ".join(f"sum(k * d{i}) / nullif(sum(k), 0) AS m{i}" for i in range(len(pairs)))} FROM k GROUP BY ALL),
mt AS (SELECT seed, split, unnest([{told('m')}], recursive := true) FROM m), dt AS (SELECT seed, split, unnest([{told('d')}], recursive := true) FROM diff),
ci AS (SELECT seed, split, baseline, metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM mt GROUP BY ALL),
mean AS (SELECT seed, split, baseline, metric, count(*) AS groups, round(avg(v), 6) AS mean_difference FROM dt GROUP BY ALL)"""


_SEEDED = f"{ranked_sql([*_SEED_MODELS, *_SEED_BASELINES])}, seeded AS (SELECT timestamp_ns % 2 AS seed, CASE WHEN prompt = 'RF' THEN 'test' ELSE 'validation' END AS split, * FROM met)"


@query("seed_comparison", f"WITH {LINES}, {_SEEDED}, {_drawn_sql(_SEED_BASELINES, _SEED_METRICS, 10000)} SELECT 'tracker_score' AS model, baseline, split, metric, seed, groups, mean_difference, low, high FROM mean JOIN ci USING (seed, split, baseline, metric)")
def _(spark, d):
    return ranking.compare_seeds(_seeded(spark, d), _SEED_MODELS, _SEED_BASELINES, _SEED_METRICS)


@query("paired_metric_bootstrap", f"""WITH {LINES}, {ranked_sql(['tracker_score', 'candidate_distance'])}, seeded AS (SELECT 0 AS seed, 'all' AS split, * FROM met), {_drawn_sql(['candidate_distance'], ['average_precision'], 10000)}
SELECT groups, mean_difference, low, high, (SELECT count(*) FROM met WHERE control = 'tracker_score') AS shared_groups FROM mean JOIN ci USING (seed, split, baseline, metric)""")
def _(spark, d):
    m = _models(spark, d)
    return ranking.paired_metric_bootstrap(m.where("model = 'pooled'"), m.where("model = 'task_id'"), "average_precision")
