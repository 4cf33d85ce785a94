"""The registered queries of the ranking-diagnostics engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalars as fn
from ..plans.base import BOXES, DOCS, GROUP, LINES, box_table, document_candidates, line_candidates, table
from . import align, assoc, audit, diagnosis, graph, pool, ranking
from .quantiles import quantiles
from .registry import QUERIES, SQL, query

#: All white space, as DuckDB's regular expressions spell it.
_STRIP = rf"'^{fn.BLANK}+|{fn.BLANK}+\z', '', 'g'"

# ---- Ranking ---------------------------------------------------------------------------------------------------------

def ranked_sql(controls=ranking.CONTROLS, seed: int = 0) -> str:
    return f"""freq AS (SELECT c.*, count(*) OVER (PARTITION BY name) AS freq FROM cand c),
long AS (SELECT * FROM (SELECT f.*, k.control FROM freq f, (SELECT unnest([{", ".join(repr(c) for c in controls)}]) AS control) k)),
keyed AS (SELECT *, {ranking.key_sql(seed)} AS k FROM long),
ranked AS (SELECT *, row_number() OVER w AS rank, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS found,
  sum(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS labeled_rank FROM keyed
  WINDOW w AS (PARTITION BY log_id, prompt, timestamp_ns, control ORDER BY k, track_id)),
met AS (SELECT log_id, prompt, timestamp_ns, control, count(*) AS candidate_count, count(label) AS labeled_candidate_count, count(*) FILTER (label = 0) AS positive_count,
  count(*) FILTER (label IN (1, 2)) AS negative_count, count(*) FILTER (label IS NULL) AS unknown_count,
  sum(CASE WHEN label = 0 THEN CAST(found AS DOUBLE) / rank END) / nullif(count(*) FILTER (label = 0), 0) AS average_precision,
  CASE WHEN count(*) FILTER (label = 0) > 0 THEN CAST(max(CASE WHEN rank = 1 AND label = 0 THEN 1 ELSE 0 END) AS INTEGER) END AS recall_at_1,
  sum(CASE WHEN label = 0 THEN CAST(found AS DOUBLE) / labeled_rank END) / nullif(count(*) FILTER (label = 0), 0) AS labeled_average_precision,
  CASE WHEN count(*) FILTER (label = 0) > 0 THEN CAST(max(CASE WHEN labeled_rank = 1 AND label = 0 THEN 1 ELSE 0 END) AS INTEGER) END AS labeled_recall_at_1
  FROM ranked GROUP BY ALL)"""


RANKED = ranked_sql()


def _summary_sql(base: str, by: str, where: str = "", source: str = "met") -> str:
    ok = "positive_count > 0 AND negative_count > 0"
    mean = lambda c, n: f"round(avg(CASE WHEN {ok} THEN {c} END), 6) AS {n}"
    return f"""WITH {base}, {RANKED} SELECT {by}, count(*) AS groups, count(*) FILTER ({ok}) AS rankable_groups, {mean("average_precision", "mean_ap")},
  {mean("recall_at_1", "recall_at_1")}, {mean("labeled_average_precision", "labeled_mean_ap")}, {mean("labeled_recall_at_1", "labeled_recall_at_1")},
  round(avg(candidate_count), 6) AS mean_candidates, round(avg(positive_count), 6) AS mean_positives, round(avg(negative_count), 6) AS mean_negatives, round(avg(unknown_count), 6) AS mean_unknown FROM {source} {where} GROUP BY ALL"""


METRICS = ("average_precision", "labeled_average_precision")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in METRICS})


@query("rank_controls_summary", _summary_sql(DOCS, "control"))
def _(spark, d):
    return ranking.summarize(ranking.group_metrics(ranking.rank(document_candidates(spark, d))), "control")


@query("rank_controls_long_lineitem", _summary_sql(LINES, "control"))
def _(spark, d):
    return ranking.summarize(ranking.group_metrics(ranking.rank(line_candidates(spark, d))), "control")


@query("rank_oracle_upper_bound", _summary_sql(LINES, "control", "WHERE control = 'oracle'"))
def _(spark, d):
    return ranking.summarize(ranking.group_metrics(ranking.rank(line_candidates(spark, d), ["oracle"])), "control")


@query("group_metrics_rows", f"WITH {LINES}, {RANKED} SELECT * REPLACE (round(average_precision, 6) AS average_precision, round(labeled_average_precision, 6) AS labeled_average_precision) FROM met WHERE control = 'tracker_score'")
def _(spark, d):
    return _rounded(ranking.group_metrics(ranking.rank(line_candidates(spark, d), ["tracker_score"])))


@query("labeled_only_bound", f"""WITH {DOCS}, {RANKED} SELECT log_id, prompt, control, round(average_precision, 6) AS operational, round(labeled_average_precision, 6) AS labeled_only,
  labeled_average_precision >= average_precision AS bounded FROM met WHERE positive_count > 0""")
def _(spark, d):
    m = ranking.group_metrics(ranking.rank(document_candidates(spark, d))).where("positive_count > 0")
    return m.select("log_id", "prompt", "control", F.round("average_precision", 6).alias("operational"), F.round("labeled_average_precision", 6).alias("labeled_only"), (F.col("labeled_average_precision") >= F.col("average_precision")).alias("bounded"))


@query("rank_seeded_random")
def _(spark, d):
    return ranking.rank_random(document_candidates(spark, d)).select(*GROUP, "track_id", "label", "rank")


@query("rank_hashed_random", f"WITH {DOCS}, {ranked_sql(['random'], 3)} SELECT log_id, prompt, timestamp_ns, track_id, label, rank FROM ranked")
def _(spark, d):
    return ranking.rank(document_candidates(spark, d), ["random"], seed=3).select(*GROUP, "track_id", "label", "rank")


@query("rank_positional_ties", f"""WITH {LINES}, p AS (SELECT c.*, row_number() OVER (PARTITION BY log_id, prompt, timestamp_ns ORDER BY track_id) AS _pos FROM (SELECT * REPLACE (round(score / 10000) AS score) FROM cand) c)
SELECT log_id, prompt, timestamp_ns, track_id, row_number() OVER (PARTITION BY log_id, prompt, timestamp_ns ORDER BY score DESC, _pos) AS rank FROM p""")
def _(spark, d):
    c = line_candidates(spark, d).withColumns({"score": F.round(F.col("score") / 10000), "_pos": F.row_number().over(Window.partitionBy(*GROUP).orderBy("track_id"))})
    return ranking.rank(c, ["tracker_score"], tie="_pos").select(*GROUP, "track_id", "rank")


@query("rank_score_fallback", f"WITH {LINES}, {ranked_sql(['tracker_score'])} SELECT log_id, prompt, timestamp_ns, round(average_precision, 6) AS average_precision FROM met")
def _(spark, d):
    c = line_candidates(spark, d).withColumnRenamed("score", "tracker_score")
    return ranking.group_metrics(ranking.rank(c, ["tracker_score"])).select(*GROUP, F.round("average_precision", 6).alias("average_precision"))


_HARD = """near AS (SELECT c.* FROM cand c WHERE label = 0 OR (label IN (1, 2) AND EXISTS (SELECT 1 FROM cand p WHERE p.label = 0 AND p.log_id = c.log_id
  AND p.prompt = c.prompt AND p.timestamp_ns = c.timestamp_ns AND abs(p.score - c.score) <= {delta})))"""
_AREA = """near2 AS (SELECT c.* FROM near c WHERE label = 0 OR EXISTS (SELECT 1 FROM cand p WHERE p.label = 0 AND p.log_id = c.log_id AND p.prompt = c.prompt
  AND p.timestamp_ns = c.timestamp_ns AND abs(ln(1 + p.area) - ln(1 + c.area)) <= 0.2))"""
_BOTH = "SELECT log_id, prompt, timestamp_ns, count(*) FILTER (label = 0) AS positives, count(*) FILTER (label <> 0) AS negatives FROM {t} GROUP BY ALL HAVING count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label <> 0) > 0"


def _both(df: DataFrame) -> DataFrame:
    return df.groupBy(*GROUP).agg(F.count_if(F.col("label") == 0).alias("positives"), F.count_if(F.col("label") != 0).alias("negatives"))


@query("hard_negative_score", f"WITH {LINES}, {_HARD.format(delta=500)} {_BOTH.format(t='near')}")
def _(spark, d):
    return _both(ranking.hard_negatives(line_candidates(spark, d), 500.0))


@query("hard_negative_score_size", f"WITH {LINES}, {_HARD.format(delta=5000)}, {_AREA} {_BOTH.format(t='near2')}")
def _(spark, d):
    return _both(ranking.hard_negatives(line_candidates(spark, d), 5000.0, 0.2))


#: Order lines as candidates, with scores, areas, names and prompts missing.
_FAULTY = LINES.replace("cand AS", "whole AS", 1) + """, cand AS (SELECT * REPLACE (CASE WHEN distance_m % 11 = 0 THEN NULL ELSE score END AS score, CASE WHEN distance_m % 7 = 0 THEN NULL ELSE area END AS area,
  CASE WHEN distance_m % 13 = 0 THEN NULL ELSE name END AS name, CASE WHEN prompt = 'RF' THEN NULL ELSE prompt END AS prompt) FROM whole)"""


def _faulty(spark, d):
    gone = lambda k, c: F.when(F.col("distance_m") % k != 0, F.col(c))
    return line_candidates(spark, d).withColumns({"score": gone(11, "score"), "area": gone(7, "area"), "name": gone(13, "name"), "prompt": F.when(F.col("prompt") != "RF", F.col("prompt"))})


@query("rank_controls_nulls", _summary_sql(_FAULTY, "control"))
def _(spark, d):
    return ranking.summarize(ranking.group_metrics(ranking.rank(_faulty(spark, d))), "control")


@query("hard_negative_nulls", f"""WITH {_FAULTY}, near AS (SELECT c.* FROM cand c WHERE label = 0 OR (label IN (1, 2) AND EXISTS (SELECT 1 FROM cand p WHERE p.label = 0 AND p.log_id = c.log_id
  AND p.prompt IS NOT DISTINCT FROM c.prompt AND p.timestamp_ns = c.timestamp_ns AND abs(p.score - c.score) <= 5000)
  AND EXISTS (SELECT 1 FROM cand p WHERE p.label = 0 AND p.score IS NOT NULL AND p.log_id = c.log_id AND p.prompt IS NOT DISTINCT FROM c.prompt
  AND p.timestamp_ns = c.timestamp_ns AND abs(ln(1 + coalesce(p.area, 0)) - ln(1 + coalesce(c.area, 0))) <= 0.2))) {_BOTH.format(t='near')}""")
def _(spark, d):
    return _both(ranking.hard_negatives(_faulty(spark, d), 5000.0, 0.2))


_LOGIT = "CAST(((score - 40000) / 8000) AS DOUBLE)"
_CAL = f"""p AS (SELECT 1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, {_LOGIT})))) AS p, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0 END AS y FROM cand WHERE label IS NOT NULL),
b AS (SELECT *, CAST(CASE {" ".join(f"WHEN p < {e!r}::DOUBLE THEN {i}" for i, e in enumerate(ranking.EDGES[1:10]))} ELSE 9 END AS INTEGER) AS bin FROM p)"""


def _logits(spark, d):
    return line_candidates(spark, d).withColumn("logit", (F.col("score") - 40000) / 8000)


@query("calibration_nll_brier", f"""WITH {LINES}, {_CAL}, g AS (SELECT bin, count(*) AS n, sum(-(y * ln(p + 1e-8::DOUBLE) + (1 - y) * ln(1 - p + 1e-8::DOUBLE))) AS l, sum((p - y) * (p - y)) AS s, abs(sum(p - y)) AS e FROM b GROUP BY bin)
SELECT CAST(sum(n) AS BIGINT) AS labeled, round(sum(l) / sum(n), 6) AS nll, round(sum(s) / sum(n), 6) AS brier, round(sum(e) / sum(n), 6) AS ece FROM g""")
def _(spark, d):
    return ranking.calibration(_logits(spark, d), "logit")


@query("calibration_ece_bins", f"""WITH {LINES}, {_CAL} SELECT CAST(i AS INTEGER) AS bin, count(p) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS positive_share
FROM range(10) r(i) LEFT JOIN b ON bin = i GROUP BY i""")
def _(spark, d):
    return ranking.reliability(_logits(spark, d), "logit")


_BIN = "CASE WHEN candidate_count BETWEEN 1 AND 64 THEN '1-64' WHEN candidate_count BETWEEN 65 AND 128 THEN '65-128' WHEN candidate_count BETWEEN 129 AND 256 THEN '129-256' ELSE '257+' END"


@query("strata_grouping_sets", f"""WITH {LINES}, {RANKED}, s AS (SELECT *, {_BIN} AS bin FROM met WHERE control IN ('tracker_score', 'candidate_distance'))
SELECT control, prompt, timestamp_ns AS year, bin, count(*) AS groups, round(avg(CASE WHEN positive_count > 0 AND negative_count > 0 THEN average_precision END), 6) AS mean_ap
FROM s GROUP BY GROUPING SETS ((control, prompt), (control, timestamp_ns), (control, bin))""")
def _(spark, d):
    m = ranking.group_metrics(ranking.rank(line_candidates(spark, d), ["tracker_score", "candidate_distance"]))
    m = m.withColumns({"bin": fn.size_bin(F.col("candidate_count")), "year": F.col("timestamp_ns")})
    ok = (F.col("positive_count") > 0) & (F.col("negative_count") > 0)
    c = [F.col(x) for x in ("control", "prompt", "year", "bin")]
    return m.groupingSets([[c[0], c[1]], [c[0], c[2]], [c[0], c[3]]], *c).agg(F.count("*").alias("groups"), F.round(F.avg(F.when(ok, F.col("average_precision"))), 6).alias("mean_ap"))


# ---- Groups and samples ----------------------------------------------------------------------------------------------

_RANKABLE = "rk AS (SELECT log_id, prompt, timestamp_ns FROM cand GROUP BY ALL HAVING bool_or(label = 0) AND bool_or(label IN (1, 2)))"


@query("rankable_groups", f"WITH {DOCS}, {_RANKABLE} SELECT * FROM rk")
def _(spark, d):
    return ranking.rankable(document_candidates(spark, d))


@query("sample_groups_hash", f"WITH {LINES}, {_RANKABLE} SELECT *, sha256('7|' || log_id || '|' || prompt || '|' || timestamp_ns) AS h FROM rk ORDER BY h, log_id, prompt, timestamp_ns LIMIT 50")
def _(spark, d):
    h = F.sha2(F.concat_ws("|", F.lit("7"), *[F.col(c).cast("string") for c in GROUP]), 256)
    return ranking.rankable(line_candidates(spark, d)).withColumn("h", h).orderBy("h", *GROUP).limit(50)


@query("group_semi_join", f"WITH {LINES}, {_RANKABLE} SELECT c.log_id, c.prompt, c.timestamp_ns, c.track_id, c.label FROM cand c SEMI JOIN rk USING (log_id, prompt, timestamp_ns)")
def _(spark, d):
    c = line_candidates(spark, d)
    return c.join(ranking.rankable(c), list(GROUP), "left_semi").select(*GROUP, "track_id", "label")


@query("group_seed", f"""WITH {DOCS}, g AS (SELECT DISTINCT log_id, prompt, timestamp_ns FROM cand), h AS (SELECT *, sha256('3|' || log_id || '|' || prompt || '|' || timestamp_ns) AS h FROM g)
SELECT log_id, prompt, timestamp_ns, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) AS seed FROM h""")
def _(spark, d):
    return document_candidates(spark, d).select(*GROUP).distinct().withColumn("seed", fn.group_seed(3, *[F.col(c) for c in GROUP]))


# ---- Contract --------------------------------------------------------------------------------------------------------


@query("inspect_core", f"""WITH {LINES} SELECT count(*) AS records, count(DISTINCT log_id) AS logs, count(DISTINCT prompt) AS prompts, count(DISTINCT (log_id, prompt, timestamp_ns)) AS groups,
  count(*) FILTER (isnan(score) OR isinf(score)) AS non_finite_scores, count(*) FILTER (distance_m <= 50) AS eligible FROM cand""")
def _(spark, d):
    return audit.core_counts(line_candidates(spark, d))


@query("inspect_missing", f"WITH {DOCS} SELECT field, count(*) - sum(present) AS missing FROM (SELECT unnest(['log_id','prompt','timestamp_ns','track_id','name','score','distance_m','area','label']) AS field, unnest([CAST(coalesce(log_id <> '', false) AS INT), CAST(coalesce(prompt <> '', false) AS INT), CAST(timestamp_ns IS NOT NULL AS INT), CAST(coalesce(track_id <> '', false) AS INT), CAST(coalesce(name <> '', false) AS INT), CAST(coalesce(NOT isnan(score), false) AS INT), CAST(coalesce(NOT isnan(distance_m), false) AS INT), CAST(coalesce(NOT isnan(area), false) AS INT), CAST(label IS NOT NULL AS INT)]) AS present FROM cand) GROUP BY field".replace("count(*) - sum(present)", "CAST(count(*) - sum(present) AS BIGINT)"))
def _(spark, d):
    return audit.missing_counts(document_candidates(spark, d))


@query("inspect_labels", f"WITH {DOCS} SELECT coalesce(CAST(label AS VARCHAR), 'UNKNOWN') AS value, count(*) AS n FROM cand GROUP BY 1")
def _(spark, d):
    return audit.value_counts(document_candidates(spark, d), "label")


@query("inspect_groups", f"""WITH {LINES}, g AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS p, count(*) FILTER (label IN (1, 2)) AS neg FROM cand GROUP BY log_id, prompt, timestamp_ns)
SELECT count(*) AS groups, count(*) FILTER (p > 0) AS with_positive, count(*) FILTER (p > 0 AND neg > 0) AS rankable, min(n) AS least, max(n) AS most FROM g""")
def _(spark, d):
    return audit.group_feasibility(line_candidates(spark, d))


@query("inspect_duplicates", "WITH g AS (SELECT count(*) - 1 AS r FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT CAST(sum(r) AS BIGINT) AS duplicates, count(*) FILTER (r > 0) AS keys FROM g")
def _(spark, d):
    return audit.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("inspect_time_order", """WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), o AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY first) > event_type AS back FROM f)
SELECT user_id, CAST(sum(CASE WHEN back THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM o GROUP BY user_id HAVING sum(CASE WHEN back THEN 1 ELSE 0 END) > 0""")
def _(spark, d):
    return align.time_order_violations(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id")


@query("conversation_turn_order", "SELECT conv_id, count(*) AS turns, max(turn) - min(turn) + 1 = count(DISTINCT turn) AS dense, count(*) - count(DISTINCT turn) AS repeats FROM conversations GROUP BY conv_id")
def _(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id")
    return t.agg(F.count("*").alias("turns"), (F.max("turn") - F.min("turn") + 1 == F.count_distinct("turn")).alias("dense"), (F.count("*") - F.count_distinct("turn")).alias("repeats"))


@query("normalize_records", """SELECT CAST(doc_id AS VARCHAR) AS track_id, source AS log_id, lang AS prompt, TRY_CAST(CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE CAST(n_chars AS VARCHAR) END AS BIGINT) AS timestamp_ns,
  CAST(n_chars AS DOUBLE) AS score, CASE doc_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '17' ELSE 'odd one' END AS label, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS DOUBLE) END AS yaw, doc_id AS confidence FROM documents""")
def _(spark, d):
    from ..sources.readers import normalize

    raw = table(spark, d, "documents").select(
        F.col("source").alias("seq_id"), F.col("lang").alias("prompt"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("n_chars").cast("string")).alias("time_ns"), F.col("doc_id").cast("string").alias("track_uuid"),
        F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("confidence"),  # score is there, so confidence stays what it is
        F.when(F.col("doc_id") % 3 == 0, " referred_object").when(F.col("doc_id") % 3 == 1, "17").otherwise("odd one").alias("mining_category"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("double")).alias("heading"),
    )
    return normalize(raw)


_NAMES = "CASE doc_id % 6 WHEN 0 THEN chr(9) || ' referred_object ' || chr(10) WHEN 1 THEN 'RELATED' WHEN 2 THEN '2' WHEN 3 THEN '017' WHEN 4 THEN 'x' END"


@query("label_coercion", f"""WITH n AS (SELECT doc_id, {_NAMES} AS raw, upper(regexp_replace({_NAMES}, {_STRIP})) AS t FROM labels), c AS (SELECT doc_id, raw, CASE WHEN t = 'REFERRED_OBJECT' THEN 0 WHEN t = 'RELATED' THEN 1 WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(TRY_CAST(t AS INTEGER) AS INTEGER) END AS coerced FROM n)
SELECT doc_id, CAST(coerced AS INTEGER) AS coerced, coalesce(CAST(coerced AS VARCHAR), raw) AS kept, CAST(CASE WHEN coerced IN (0, 1, 2) THEN coerced END AS INTEGER) AS tri_state FROM c""")
def _(spark, d):
    t = table(spark, d, "labels").select("doc_id", F.expr(_NAMES).alias("raw"))
    t = t.select("doc_id", fn.coerce_label(F.col("raw")).alias("coerced"), fn.label_text(F.col("raw")).alias("kept"))
    return t.withColumn("tri_state", fn.tri_state(F.col("coerced")))


@query("label_any_integer", """SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN NULL WHEN 3 THEN -2 ELSE NULL END AS INTEGER) AS from_number,
  CAST(CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 40 ELSE NULL END AS INTEGER) AS from_text FROM labels""")
def _(spark, d):
    m = F.col("doc_id") % 5
    number = F.when(m == 0, F.lit(1.9)).when(m == 1, F.lit(7.0)).when(m == 2, F.lit(float("nan"))).when(m == 3, F.lit(-2.5))
    text = F.when(m == 0, " 2 ").when(m == 1, "1.5").when(m == 2, "x").when(m == 3, "40")
    return table(spark, d, "labels").select("doc_id", fn.any_label(number).alias("from_number"), fn.any_label(text).alias("from_text"))


# ---- Prompts ---------------------------------------------------------------------------------------------------------


@query("template_keys", f"""WITH u AS (SELECT CASE WHEN page_id % 3 = 0 THEN chr(9) || ' ' || url || chr(10) || ' 12.5' || chr(11) ELSE url END AS url FROM pages), t AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(url, '')), {_STRIP}), '[0-9a-f]{{8}}-[0-9a-f-]{{27,}}', '<id>', 'g'), '\\b[0-9]+(?:\\.[0-9]+)?', '<num>', 'g'), '{fn.BLANK}+', ' ', 'g') AS key FROM u)
SELECT key, count(*) AS n FROM t GROUP BY key""")
def _(spark, d):
    url = F.expr("CASE WHEN page_id % 3 = 0 THEN chr(9) || ' ' || url || chr(10) || ' 12.5' || chr(11) ELSE url END")
    return table(spark, d, "pages").groupBy(fn.template_key(url).alias("key")).agg(F.count("*").alias("n"))


_PK = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+(\\.[0-9]+)?', '#', 'g'), '[^a-z0-9# ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("prompt_normalise_bucket", f"""WITH p AS (SELECT item_id, {_PK} AS key FROM benchmark), h AS (SELECT *, sha256(key) AS h FROM p),
m AS (SELECT *, (6 * list_sum([CAST('0x' || c AS INTEGER) FOR c IN string_split(h[1:63], '')]) + CAST('0x' || h[64:64] AS INTEGER)) % 10 AS m FROM h)
SELECT item_id, key, CASE WHEN m < 6 THEN 'train' WHEN m < 8 THEN 'validation' ELSE 'test' END AS split FROM m""")
def _(spark, d):
    p = table(spark, d, "benchmark").select("item_id", fn.prompt_key(F.col("text")).alias("key"))
    return p.withColumn("split", fn.split_bucket(F.col("key")))


_TOK = f"tok AS (SELECT item_id, list_distinct(string_split({_PK}, ' ')) AS t FROM benchmark)"


def _prompt_pairs(spark, d, least):
    """Pairs of items that share a token, with the Jaccard similarity of their token sets; only they can be above 0."""
    p = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(fn.prompt_key(F.col("text")), " ")).alias("t"))
    one = p.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    two = one.select(F.col("item_id").alias("b"), F.col("n").alias("m"), "w")
    both = one.withColumnRenamed("item_id", "a").join(two, "w").where("a < b").groupBy("a", "b", "n", "m").agg(F.count("*").alias("k"))
    return both.select("a", "b", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("jaccard")).where(F.col("jaccard") >= least)


_PAIRS = """pr AS (SELECT x.item_id AS a, y.item_id AS b, CAST(len(list_intersect(x.t, y.t)) AS DOUBLE) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS jaccard FROM tok x JOIN tok y ON x.item_id < y.item_id)"""


@query("prompt_jaccard_pairs", f"WITH {_TOK}, {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pr WHERE jaccard >= 0.1")
def _(spark, d):
    return _prompt_pairs(spark, d, 0.1).withColumn("jaccard", F.round("jaccard", 6))


@query("prompt_components", f"""WITH RECURSIVE {_TOK}, {_PAIRS}, e AS (SELECT a, b FROM pr WHERE jaccard >= 0.2 UNION SELECT b, a FROM pr WHERE jaccard >= 0.2),
r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a) SELECT node, min(root) AS root FROM r GROUP BY node""")
def _(spark, d):
    return graph.components(_prompt_pairs(spark, d, 0.2).select("a", "b"))


@query("prompt_ratio_pairs")
def _(spark, d):
    """All pairs of prompts that are near-duplicates, among benchmark texts and copies of them without their ends."""
    from .prompts import ratio_pairs

    p = table(spark, d, "benchmark").select("item_id", fn.prompt_key(F.col("text")).alias("key"))
    p = p.unionByName(p.select((F.col("item_id") + 1_000_000).alias("item_id"), F.expr("left(key, length(key) - 5)").alias("key")))
    return ratio_pairs(p, graph.similar_prompts(p.withColumnRenamed("item_id", "id")))


_PART_NAME = "CASE p_partkey % 4 WHEN 0 THEN chr(9) || 'box_truck' WHEN 1 THEN 'Truck' || chr(10) WHEN 2 THEN 'pedestrian' ELSE upper(p_type) END"


@query("taxonomy_match_counts", f"""WITH p AS (SELECT upper(regexp_replace({_PART_NAME}, {_STRIP})) AS n FROM part), g AS (SELECT CASE WHEN n IN ('BOX_TRUCK', 'TRUCK') THEN 'VEHICLE' ELSE n END AS grp FROM p)
SELECT grp, count(*) AS n, CAST(sum(CASE WHEN grp = 'VEHICLE' THEN 1 ELSE 0 END) AS BIGINT) AS like_a_bus FROM g GROUP BY grp""")
def _(spark, d):
    name = F.expr(_PART_NAME)
    return table(spark, d, "part").groupBy(fn.taxonomy_group(name).alias("grp")).agg(F.count("*").alias("n"), F.count_if(fn.class_compatible(name, F.lit("bus"))).alias("like_a_bus"))


# ---- Alignment -------------------------------------------------------------------------------------------------------

_TOL = 3_600_000_000


def _events(spark, d, kind):
    return table(spark, d, "events").where(F.col("event_type") == kind).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def _nearest_sql(tie: str) -> str:
    order = "g, v.us DESC" if tie == "later" else "g, v.us"
    return f"""WITH t AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events), m AS (SELECT c.event_id, c.user_id, v.event_id AS match_id, abs(c.us - v.us) AS g,
  row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.us - v.us), {"v.us DESC" if tie == "later" else "v.us"}) AS k FROM t c JOIN t v ON c.user_id = v.user_id AND c.event_type = 'click' AND v.event_type = 'view' AND abs(c.us - v.us) <= {_TOL})
SELECT event_id, user_id, match_id, g AS gap FROM m WHERE k = 1"""


@query("nearest_camera", _nearest_sql("later"))
def _(spark, d):
    return align.nearest(_events(spark, d, "click"), _events(spark, d, "view"), ["user_id"], "us", "us", _TOL, "later").select("event_id", "user_id", F.col("match.event_id").alias("match_id"), "gap")


@query("nearest_tracker", _nearest_sql("earlier"))
def _(spark, d):
    return align.nearest(_events(spark, d, "click"), _events(spark, d, "view"), ["user_id"], "us", "us", _TOL, "earlier").select("event_id", "user_id", F.col("match.event_id").alias("match_id"), "gap")


@query("timestamp_selection", """WITH t AS (SELECT DISTINCT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, event_type FROM events)
SELECT user_id, day FROM t WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events WHERE event_type IN ('click', 'view', 'purchase'))""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).alias("day"), "event_type")
    present = [k for k in ("click", "view", "purchase") if not e.where(F.col("event_type") == k).isEmpty()]
    return align.common_keys(*[e.where(F.col("event_type") == k) for k in present], on=["user_id", "day"])


@query("missing_logs", "SELECT c_custkey AS key FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def _(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return align.missing_keys(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), urgent.select(F.col("o_custkey").alias("key")), ["key"])


@query("first_seen_dedup", "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS k FROM lineitem) WHERE k = 1")
def _(spark, d):
    t = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return align.first_seen(t, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"]).drop("l_quantity")


@query("positional_zip", """SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS value, CAST((vec_id + i - 1) % 3 AS INTEGER) AS label FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def _(spark, d):
    t = table(spark, d, "embeddings").withColumn("labels", F.transform("embedding", lambda _, i: ((F.col("vec_id") + i) % 3).cast("int")))
    z = F.arrays_zip(F.col("embedding").alias("v"), F.col("labels").alias("l"))
    return t.select("vec_id", F.posexplode(z).alias("pos", "z")).select("vec_id", "pos", F.col("z.v").cast("double").alias("value"), F.col("z.l").alias("label"))


@query("json_props_flatten", "SELECT event_id, CAST(key AS VARCHAR) AS key, CAST(value AS BIGINT) AS value FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract(props, '$.' || unnest(json_keys(props))) AS value FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


# ---- Pool and geometry -----------------------------------------------------------------------------------------------


@query("pool_filter_strict", f"WITH {BOXES} SELECT vec_id, log_id, timestamp_ns, class, round(sqrt(x * x + y * y), 6) AS distance_m FROM box WHERE sqrt(x * x + y * y) < 10 AND length > 0 AND width > 0 AND height > 0")
def _(spark, d):
    return pool.strict_pool(box_table(spark, d), 10.0).select("vec_id", "log_id", "timestamp_ns", "class", F.round("distance_m", 6).alias("distance_m"))


@query("pool_build", f"WITH {BOXES} SELECT vec_id, log_id, timestamp_ns, CAST(row_number() OVER (PARTITION BY log_id, timestamp_ns ORDER BY vec_id) - 1 AS INTEGER) AS ordinal FROM box WHERE class IN (0, 1, 2, 3) AND sqrt(x * x + y * y) < 50")
def _(spark, d):
    p = pool.loose_pool(box_table(spark, d), [0, 1, 2, 3])
    return p.select("vec_id", "log_id", "timestamp_ns", (F.row_number().over(Window.partitionBy("log_id", "timestamp_ns").orderBy("vec_id")) - 1).alias("ordinal"))


@query("ego_partition", f"""WITH {BOXES}, named AS (SELECT *, vec_id % 11 = 0 AS synthetic, CASE vec_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'EGO_VEHICLE' ELSE 'K' || class END AS name FROM box)
SELECT log_id, timestamp_ns, count(*) FILTER (NOT synthetic AND coalesce(name, '') <> 'EGO_VEHICLE') AS external, count(*) FILTER (synthetic OR name = 'EGO_VEHICLE') AS ego FROM named GROUP BY ALL""")
def _(spark, d):
    name = F.when(F.col("vec_id") % 7 == 0, None).when(F.col("vec_id") % 7 == 1, "EGO_VEHICLE").otherwise(F.concat(F.lit("K"), F.col("class").cast("string")))
    b = box_table(spark, d).withColumns({"synthetic_ego": F.col("vec_id") % 11 == 0, "name": name})
    return b.groupBy("log_id", "timestamp_ns").agg(F.count_if(~pool.is_ego()).alias("external"), F.count_if(pool.is_ego()).alias("ego"))


@query("ego_inject", f"WITH {BOXES} SELECT log_id, timestamp_ns, count(*) + 1 AS rows, CAST(1.473 AS DOUBLE) + sum(height) AS heights FROM box GROUP BY ALL".replace("CAST(1.473 AS DOUBLE) + sum(height) AS heights", "round(1.473 + sum(height), 6) AS heights"))
def _(spark, d):
    b = box_table(spark, d).withColumns({"track_id": F.col("vec_id").cast("string"), "name": F.concat(F.lit("K"), F.col("class").cast("string"))})
    return pool.with_ego(b).groupBy("log_id", "timestamp_ns").agg(F.count("*").alias("rows"), F.round(F.sum("height"), 6).alias("heights"))


_R = """r AS (SELECT *, 1 - 2 * (qy * qy + qz * qz) AS r00, 2 * (qx * qy - qz * qw) AS r01, 2 * (qx * qz + qy * qw) AS r02, 2 * (qx * qy + qz * qw) AS r10,
  1 - 2 * (qx * qx + qz * qz) AS r11, 2 * (qy * qz - qx * qw) AS r12, 2 * (qx * qz - qy * qw) AS r20, 2 * (qy * qz + qx * qw) AS r21, 1 - 2 * (qx * qx + qy * qy) AS r22 FROM box)"""


def _posed(spark, d):
    b = box_table(spark, d)
    col = lambda *n: tuple(F.col(c) for c in n)
    return b, geo.rotation(*col("qw", "qx", "qy", "qz")), col("tx", "ty", "tz"), col("x", "y", "z")


@query("se3_city_to_ego", f"""WITH {BOXES}, {_R} SELECT vec_id, round(r00 * (x - tx) + r10 * (y - ty) + r20 * (z - tz), 6) AS ex, round(r01 * (x - tx) + r11 * (y - ty) + r21 * (z - tz), 6) AS ey,
  round(r02 * (x - tx) + r12 * (y - ty) + r22 * (z - tz), 6) AS ez FROM r""")
def _(spark, d):
    b, r, t, p = _posed(spark, d)
    return b.select("vec_id", *[F.round(v, 6).alias(n) for v, n in zip(geo.to_ego(r, t, p), ("ex", "ey", "ez"), strict=True)])


@query("se3_ego_to_city", f"""WITH {BOXES}, {_R} SELECT vec_id, round(r00 * x + r01 * y + r02 * z + tx, 6) AS cx, round(r10 * x + r11 * y + r12 * z + ty, 6) AS cy, round(r20 * x + r21 * y + r22 * z + tz, 6) AS cz FROM r""")
def _(spark, d):
    b, r, t, p = _posed(spark, d)
    return b.select("vec_id", *[F.round(v, 6).alias(n) for v, n in zip(geo.to_city(r, t, p), ("cx", "cy", "cz"), strict=True)])


@query("ego_yaw", f"WITH {BOXES}, {_R} SELECT vec_id, round(atan2(r10, r00), 6) AS ego_yaw, round(yaw - atan2(r10, r00), 6) AS relative_yaw FROM r")
def _(spark, d):
    b, r, _, _ = _posed(spark, d)
    return b.select("vec_id", F.round(geo.ego_yaw(r), 6).alias("ego_yaw"), F.round(F.col("yaw") - geo.ego_yaw(r), 6).alias("relative_yaw"))


_CORNERS = """k AS (SELECT b.*, i, CASE WHEN i // 4 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS sx, CASE WHEN (i // 2) % 2 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS sy, CASE WHEN i % 2 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS sz FROM box b, range(8) q(i)),
corner AS (SELECT *, x + length * sx * cos(yaw) - width * sy * sin(yaw) AS px, y + length * sx * sin(yaw) + width * sy * cos(yaw) AS py, z + height * sz AS pz FROM k)"""


def _cornered(spark, d):
    c = geo.corners(*[F.col(n) for n in ("x", "y", "z", "length", "width", "height", "yaw")])
    return box_table(spark, d).withColumn("corners", c)


def _projected(spark, d):
    """Boxes with the image box that a camera five metres behind sees, null out of view."""
    ahead = F.transform("corners", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (c["z"] + 5).alias("z")))
    return _cornered(spark, d).withColumn("ahead", ahead).withColumn("box", geo.project(F.col("ahead"), 100.0, 100.0, 96.0, 60.0, 192.0, 120.0))


@query("box_corners", f"WITH {BOXES}, {_CORNERS} SELECT vec_id, CAST(i AS INTEGER) AS i, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM corner")
def _(spark, d):
    return _cornered(spark, d).select("vec_id", F.posexplode("corners").alias("i", "c")).select("vec_id", "i", *[F.round(f"c.{n}", 6).alias(f"p{n}") for n in "xyz"])


@query("roi_any_corner", f"""WITH {BOXES}, {_CORNERS}, roi AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy FROM box WHERE vec_id % 3 = 0)
SELECT vec_id, bool_or(roi.cx IS NOT NULL) AS inside FROM corner LEFT JOIN roi ON CAST(floor(px) AS BIGINT) = roi.cx AND CAST(floor(py) AS BIGINT) = roi.cy GROUP BY vec_id""")
def _(spark, d):
    b = _cornered(spark, d)
    roi = b.where("vec_id % 3 = 0").select(F.floor("x").alias("cx"), F.floor("y").alias("cy")).distinct().withColumn("hit", F.lit(True))
    c = b.select("vec_id", F.explode("corners").alias("c")).select("vec_id", F.floor("c.x").alias("cx"), F.floor("c.y").alias("cy"))
    return c.join(roi, ["cx", "cy"], "left").groupBy("vec_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("inside"))


_EDGE = " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b" for i, j in geo.EDGES)


_CLIPPED = f"""c AS (SELECT vec_id, i, px AS x, py AS y, pz + 5 AS z FROM corner), ed AS ({_EDGE}),
s AS (SELECT vec_id, x, y, z FROM c WHERE z >= 0.1::DOUBLE UNION ALL SELECT p.vec_id, p.x + (q.x - p.x) * (0.1::DOUBLE - p.z) / (q.z - p.z), p.y + (q.y - p.y) * (0.1::DOUBLE - p.z) / (q.z - p.z), 0.1::DOUBLE
  FROM ed JOIN c p ON p.i = ed.a JOIN c q ON q.i = ed.b AND q.vec_id = p.vec_id WHERE (p.z >= 0.1::DOUBLE) <> (q.z >= 0.1::DOUBLE)),
u AS (SELECT vec_id, x * 100.0::DOUBLE / z + 96 AS u, y * 100.0::DOUBLE / z + 60 AS v FROM s),
m AS (SELECT vec_id, greatest(0, min(u)) AS x0, greatest(0, min(v)) AS y0, least(192, max(u)) AS x1, least(120, max(v)) AS y1 FROM u GROUP BY vec_id)"""


@query("project_clip", f"""WITH {BOXES}, {_CORNERS}, {_CLIPPED}
SELECT b.vec_id, CASE WHEN greatest(0, x1 - x0) * greatest(0, y1 - y0) > 1 THEN 'PROJECTED' ELSE 'OUT_OF_VIEW' END AS status,
  CASE WHEN greatest(0, x1 - x0) * greatest(0, y1 - y0) > 1 THEN round(greatest(0, x1 - x0) * greatest(0, y1 - y0), 4) ELSE 0 END AS area FROM box b LEFT JOIN m USING (vec_id)""")
def _(spark, d):
    b = _projected(spark, d)
    return b.select("vec_id", F.when(F.col("box").isNotNull(), "PROJECTED").otherwise("OUT_OF_VIEW").alias("status"), F.round(F.coalesce(fn.box_area(F.col("box")), F.lit(0.0)), 4).alias("area"))


_XY = ("vec_id", "class", "CAST(round(x * 1e6) AS BIGINT)", "CAST(round(y * 1e6) AS BIGINT)")


@query("pool_digest", f"WITH {BOXES} SELECT log_id, timestamp_ns, {pool.membership_sql(pool.record_sql(*_XY))} AS digest, count(*) AS members FROM box GROUP BY ALL")
def _(spark, d):
    b = box_table(spark, d).withColumns({"xi": F.round(F.col("x") * 1e6).cast("long"), "yi": F.round(F.col("y") * 1e6).cast("long")})
    return pool.membership(b, ["log_id", "timestamp_ns"], ["vec_id", "class", "xi", "yi"])


_MEMBER = ("vec_id", "class", "CAST(round((x{shift}) * 1e6) AS BIGINT)")


def _moved_sql(shift: str) -> str:
    return pool.membership_sql(pool.record_sql(*[m.format(shift=shift) for m in _MEMBER]))


@query("pool_digest_invariance", f"""WITH {BOXES}, g AS (SELECT {_moved_sql("")} AS a, {_moved_sql(" + CASE WHEN vec_id % 90 = 0 THEN 1 ELSE 0 END")} AS b FROM box GROUP BY log_id, timestamp_ns)
SELECT count(*) AS groups, count(*) FILTER (a <> b) AS changed, CAST(0 AS BIGINT) AS changed_by_labels FROM g""")
def _(spark, d):
    b = box_table(spark, d)
    xi = lambda c: F.round(c * 1e6).cast("long")
    by, f = ["log_id", "timestamp_ns"], ["vec_id", "class", "xi"]
    one = pool.membership(b.withColumn("xi", xi(F.col("x"))), by, f)
    labeled = pool.membership(b.withColumns({"xi": xi(F.col("x")), "label": F.hash("vec_id") % 3}).repartition(7, "vec_id"), by, f).select(*by, F.col("digest").alias("labeled"))
    moved = pool.membership(b.withColumn("xi", xi(F.col("x") + F.when(F.col("vec_id") % 90 == 0, 1).otherwise(0))), by, f).select(*by, F.col("digest").alias("moved"))
    return one.join(labeled, by).join(moved, by).agg(F.count("*").alias("groups"), F.count_if(F.col("digest") != F.col("moved")).alias("changed"), F.count_if(F.col("digest") != F.col("labeled")).alias("changed_by_labels"))


@query("pool_canonical_digest")
def _(spark, d):
    return pool.canonical_digest(box_table(spark, d), ["log_id", "timestamp_ns"], ["vec_id", "class", "x", "y", "z", "yaw", "score"], ["vec_id"])


@query("source_union_diff", """WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 800), b AS (SELECT doc_id FROM documents WHERE lang = 'en'), c AS (SELECT doc_id FROM labels),
u AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b UNION SELECT doc_id FROM c), t AS (SELECT doc_id IN (SELECT doc_id FROM a) AS long, doc_id IN (SELECT doc_id FROM b) AS english, doc_id IN (SELECT doc_id FROM c) AS labeled FROM u)
SELECT long, english, labeled, count(*) AS n FROM t GROUP BY ALL""")
def _(spark, d):
    t = table(spark, d, "documents")
    p = pool.source_presence({"long": t.where("n_chars > 800"), "english": t.where("lang = 'en'"), "labeled": table(spark, d, "labels")}, ["doc_id"])
    return p.groupBy("long", "english", "labeled").agg(F.count("*").alias("n"))


# ---- Association -----------------------------------------------------------------------------------------------------


_CLASS_NAMES = ("BOX_TRUCK", "bus ", "BICYCLE", "BICYCLIST", " pedestrian", "PEDESTRIAN", "STROLLER", "WHEELCHAIR", "Sign", "SIGN")


def _side_name():
    return F.element_at(F.array(*map(F.lit, _CLASS_NAMES)), (F.col("class") + 1).cast("int"))


def _sides(spark, d):
    """Boxes by pairs of ids into frames, even ids as candidates and odd ones as ground truth."""
    k = F.floor(F.col("vec_id") / 2)
    b = box_table(spark, d).select(F.col("vec_id").alias("id"), _side_name().alias("name"), F.concat(F.lit("log"), (k % 3).cast("string")).alias("log_id"), (k % 4).alias("timestamp_ns"), (F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y"))
    return b.where("id % 2 = 0"), b.where("id % 2 = 1")


_SIDES = """side AS (SELECT vec_id AS id, CASE class WHEN 0 THEN 'VEHICLE' WHEN 1 THEN 'VEHICLE' WHEN 2 THEN 'BICYCLE' WHEN 3 THEN 'BICYCLE' WHEN 4 THEN 'PEDESTRIAN' WHEN 5 THEN 'PEDESTRIAN' WHEN 6 THEN 'WHEELED_DEVICE' WHEN 7 THEN 'WHEELED_DEVICE' ELSE 'SIGN' END AS grp,
  'log' || (vec_id // 2) % 3 AS log_id, (vec_id // 2) % 4 AS timestamp_ns, x / 2 AS x, y / 2 AS y FROM box), c AS (SELECT * FROM side WHERE id % 2 = 0), g AS (SELECT * FROM side WHERE id % 2 = 1),
ed AS (SELECT c.log_id, c.timestamp_ns, c.id AS cand, g.id AS gt, c.grp, sqrt((c.x - g.x) * (c.x - g.x) + (c.y - g.y) * (c.y - g.y)) AS distance FROM c JOIN g USING (log_id, timestamp_ns, grp))"""


@query("assoc_edges", f"WITH {BOXES}, {_SIDES} SELECT log_id, timestamp_ns, cand, grp AS group, count(*) AS valid_edge_count, count(*) > 1 AS multiple_valid_edges, round(min(distance), 6) AS nearest FROM ed WHERE distance <= 2 GROUP BY ALL")
def _(spark, d):
    e = assoc.edges(*_sides(spark, d), 2.0)
    return e.groupBy("log_id", "timestamp_ns", "cand", "group").agg(F.count("*").alias("valid_edge_count"), (F.count("*") > 1).alias("multiple_valid_edges"), F.round(F.min("distance"), 6).alias("nearest"))


@query("assoc_gated")
def _(spark, d):
    return assoc.associate(*_sides(spark, d), 0.5)


@query("assoc_star_components", f"""WITH {BOXES}, {_SIDES}, edge AS (SELECT *, count(*) OVER (PARTITION BY cand) AS dc, count(*) OVER (PARTITION BY gt) AS dg FROM ed WHERE distance <= 0.5::DOUBLE),
f AS (SELECT *, max(dg) OVER (PARTITION BY cand) AS rivals, max(dc) OVER (PARTITION BY gt) AS choices, row_number() OVER (PARTITION BY cand ORDER BY distance) AS k, row_number() OVER (PARTITION BY gt ORDER BY distance) AS j FROM edge)
SELECT cand, gt, round(distance, 6) AS distance, dc AS valid_edge_count FROM f WHERE (rivals = 1 AND k = 1) OR (choices = 1 AND dg > 1 AND j = 1)""")
def _(spark, d):
    e = assoc.edges(*_sides(spark, d), 0.5)
    w = lambda c: Window.partitionBy(c)
    star = e.withColumns({"dc": F.count("*").over(w("cand")), "dg": F.count("*").over(w("gt"))}).withColumns({"rivals": F.max("dg").over(w("cand")), "choices": F.max("dc").over(w("gt"))})
    star = star.where("rivals = 1 or choices = 1").select("cand", "gt")
    return assoc.match_edges(e, 0.5).join(star, ["cand", "gt"]).select("cand", "gt", F.round("distance", 6).alias("distance"), "valid_edge_count")


def _frames_sql(pairs: int, grid: bool) -> str:
    """_SIDES with frames of about `pairs` candidates, more of them the more boxes there are; on a grid many distances are equal."""
    x = "round({c}) / 2 AS {c}" if grid else "{c} / 2 AS {c}"
    out = _SIDES.replace("(vec_id // 2) % 4 AS timestamp_ns", f"(vec_id // 2) // {3 * pairs} AS timestamp_ns")
    return out.replace("x / 2 AS x, y / 2 AS y", ", ".join(x.format(c=c) for c in "xy"))


def _frames(spark, d, pairs: int, grid: bool):
    k = F.floor(F.col("vec_id") / 2)
    at = lambda c: ((F.round(c) if grid else F.col(c)) / 2).alias(c)
    b = box_table(spark, d).select(F.col("vec_id").alias("id"), _side_name().alias("name"), F.concat(F.lit("log"), (k % 3).cast("string")).alias("log_id"), F.floor(k / (3 * pairs)).alias("timestamp_ns"), at("x"), at("y"))
    return b.where("id % 2 = 0"), b.where("id % 2 = 1")


def _brute_sql(name: str, threshold: float, most: int) -> str:
    """Every matching of every component of at most `most` edges within a threshold: {name}_all (root, chosen edges, pairs, total) over the edges {name}_e, by recursion."""
    return f"""{name}_e AS (SELECT *, row_number() OVER (ORDER BY cand, gt) AS id FROM ed WHERE distance <= {threshold}::DOUBLE),
{name}_link AS (SELECT p.id AS a, q.id AS b FROM {name}_e p JOIN {name}_e q ON p.cand = q.cand UNION SELECT p.id, q.id FROM {name}_e p JOIN {name}_e q ON p.gt = q.gt),
{name}_reach(a, b) AS (SELECT id, id FROM {name}_e UNION SELECT r.a, l.b FROM {name}_reach r JOIN {name}_link l ON r.b = l.a),
{name}_root AS (SELECT a AS id, min(b) AS root FROM {name}_reach GROUP BY a),
{name}_c AS (SELECT e.*, root, row_number() OVER (PARTITION BY root ORDER BY id) AS k, count(*) OVER (PARTITION BY root) AS n FROM {name}_e e JOIN {name}_root USING (id) QUALIFY n <= {most}),
{name}_m(root, k, n, used, chosen, pairs, total) AS (SELECT DISTINCT root, 0::BIGINT, n, []::BIGINT[], []::BIGINT[], 0, 0.0::DOUBLE FROM {name}_c
  UNION ALL SELECT m.root, m.k + 1, m.n, CASE WHEN t.t THEN list_concat(m.used, [c.cand, c.gt]) ELSE m.used END, CASE WHEN t.t THEN list_append(m.chosen, c.id) ELSE m.chosen END, m.pairs + t.t::INT, m.total + CASE WHEN t.t THEN c.distance ELSE 0 END
  FROM {name}_m m JOIN {name}_c c ON c.root = m.root AND c.k = m.k + 1, (VALUES (true), (false)) t(t) WHERE NOT t.t OR NOT (list_contains(m.used, c.cand) OR list_contains(m.used, c.gt))),
{name}_all AS (SELECT *, max(pairs) OVER (PARTITION BY root) AS most FROM {name}_m WHERE k = n),
{name}_best AS (SELECT root, most AS matched, min(total) AS total, arg_min(chosen, total) AS chosen FROM {name}_all WHERE pairs = most GROUP BY root, most)"""


@query("assoc_small_components", f"""WITH RECURSIVE {BOXES}, {_frames_sql(10, True)}, {_brute_sql('s', 1.0, 6)}
SELECT c.log_id, c.timestamp_ns, min(c.cand) AS first_cand, any_value(c.n) AS edges, CAST(any_value(b.matched) AS BIGINT) AS matched, round(any_value(b.total), 6) AS total, any_value((SELECT count(*) FROM s_all a WHERE a.root = c.root AND a.pairs = b.matched AND a.total <= b.total + 1e-9)) > 1 AS ambiguous
FROM s_c c JOIN s_best b USING (root) GROUP BY c.root, c.log_id, c.timestamp_ns""")
def _(spark, d):
    """Components of at most six edges, where all matchings can be listed: pairs, total distance, and whether another matching is as good."""
    e = graph._checkpoint(assoc.edges(*_frames(spark, d, 10, True), 1.0))
    roots = graph.components(e.select((2 * F.col("cand")).alias("a"), (2 * F.col("gt") + 1).alias("b")))
    own = e.join(roots, 2 * F.col("cand") == F.col("node")).groupBy("root", "log_id", "timestamp_ns").agg(F.min("cand").alias("first_cand"), F.count("*").alias("edges")).where("edges <= 6")
    m = assoc.match_edges(e, 1.0).select("cand", "distance", "ambiguous").join(roots, 2 * F.col("cand") == F.col("node"))
    m = m.groupBy("root").agg(F.count("*").alias("matched"), F.round(F.sum("distance"), 6).alias("total"), F.bool_or("ambiguous").alias("ambiguous"))
    return own.join(m, "root").drop("root")


def _sensitivity_sql(k: int, t: float) -> str:
    return f"""SELECT {t}::DOUBLE AS threshold, count(*) AS groups, round(count(*) FILTER (hit > 0) / count(*), 6) AS confirmed_recall, round(count(*) FILTER (hit > 0) / count(*), 6) AS recall_including_ambiguous, CAST(sum(assigned) AS BIGINT) AS assigned, CAST(0 AS BIGINT) AS ambiguous, CAST(sum(multi) AS BIGINT) AS multiple_valid_edges
FROM (SELECT a.log_id, a.timestamp_ns, a.prompt, count(m.gt) AS hit, (SELECT count(*) FROM t{k}_pair p WHERE p.log_id = a.log_id AND p.timestamp_ns = a.timestamp_ns) AS assigned, (SELECT count(*) FILTER (p.valid > 1) FROM t{k}_pair p WHERE p.log_id = a.log_id AND p.timestamp_ns = a.timestamp_ns) AS multi
  FROM asked a LEFT JOIN wanted w USING (log_id, timestamp_ns, prompt) LEFT JOIN t{k}_pair m ON m.gt = w.id GROUP BY ALL)"""


_THRESHOLDS = (1.0, 2.0, 4.0)


@query("match_sensitivity_frames", f"""WITH RECURSIVE {BOXES}, {_frames_sql(4, False)}, {", ".join(f"{_brute_sql(f't{k}', t, 99)}, t{k}_pair AS (SELECT c.*, count(*) OVER (PARTITION BY c.cand) AS valid, list_contains(b.chosen, c.id) AS taken FROM t{k}_c c JOIN t{k}_best b USING (root) QUALIFY taken)" for k, t in enumerate(_THRESHOLDS))},
wanted AS (SELECT *, 'p' || id % 3 AS prompt FROM g WHERE id % 3 < 2), asked AS (SELECT DISTINCT w.log_id, w.timestamp_ns, w.prompt FROM wanted w JOIN c USING (log_id, timestamp_ns)) {" UNION ALL ".join(_sensitivity_sql(k, t) for k, t in enumerate(_THRESHOLDS))}""")
def _(spark, d):
    """As match_sensitivity, over small frames, where the oracle can list all matchings."""
    return _sensitivity(*_frames(spark, d, 4, False))


@query("assoc_hungarian")
def _(spark, d):
    return assoc.associate_then_filter(*_sides(spark, d), 2.0)


@query("assoc_hungarian_single", f"""WITH {BOXES}, {_SIDES}, single AS (SELECT c.log_id, c.timestamp_ns, c.grp, count(DISTINCT c.id) AS cs, count(DISTINCT g.id) AS gs FROM c JOIN g USING (log_id, timestamp_ns, grp) GROUP BY ALL),
k AS (SELECT ed.*, row_number() OVER (PARTITION BY log_id, timestamp_ns, grp ORDER BY distance) AS k FROM ed JOIN single USING (log_id, timestamp_ns, grp) WHERE cs = 1 OR gs = 1) SELECT log_id, timestamp_ns, cand, gt, round(distance, 6) AS distance FROM k WHERE k = 1 AND distance <= 2""")
def _(spark, d):
    """Groups with one candidate or one ground truth: the nearest pair, if within the threshold."""
    on = [*assoc.FRAME, "_g"]
    c, g = (t.withColumn("_g", fn.taxonomy_group(F.col("name"))) for t in _sides(spark, d))
    n = c.groupBy(*on).agg(F.count("*").alias("cs")).join(g.groupBy(*on).agg(F.count("*").alias("gs")), on).where("cs = 1 or gs = 1").select(*on)
    got = assoc.associate_then_filter(c.join(n, on, "left_semi"), g.join(n, on, "left_semi"), 2.0)
    return got.withColumn("distance", F.round("distance", 6))


_LEVELS = "(VALUES (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) t(threshold)"


@query("match_edge_counts", f"WITH {BOXES}, {_SIDES} SELECT threshold, count(DISTINCT cand) AS with_edge, count(*) AS edges FROM ed, {_LEVELS} WHERE distance <= threshold GROUP BY threshold")
def _(spark, d):
    e = assoc.edges(*_sides(spark, d), 4.0).withColumn("threshold", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)))).where("distance <= threshold")
    return e.groupBy("threshold").agg(F.count_distinct("cand").alias("with_edge"), F.count("*").alias("edges"))


def _sensitivity(cands, truth):
    """Two prompts a frame; ground truth is wanted by the prompt of its id's remainder by three."""
    frames = cands.select(*assoc.FRAME).distinct().withColumn("prompt", F.explode(F.array(F.lit("p0"), F.lit("p1"))))
    wanted = truth.where("id % 3 < 2").select(*assoc.FRAME, F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("prompt"), F.col("id").alias("gt"))
    return assoc.point_sensitivity(cands, truth, frames, wanted)


@query("match_sensitivity")
def _(spark, d):
    return _sensitivity(*_sides(spark, d))


@query("matching_range", f"WITH {BOXES}, {_SIDES}, r AS (SELECT threshold, CAST(count(DISTINCT cand) AS DOUBLE) / (SELECT count(*) FROM c) AS v FROM ed, {_LEVELS} WHERE distance <= threshold GROUP BY threshold) SELECT round(max(v) - min(v), 6) AS matching_range FROM r")
def _(spark, d):
    n = _sides(spark, d)[0].agg(F.count("*").alias("n"))
    r = QUERIES["match_edge_counts"](spark, d).crossJoin(F.broadcast(n))  # one row
    return assoc.matching_range(r.withColumn("v", F.col("with_edge") / F.col("n")), "v")


@query("assoc_by_id", "SELECT d.doc_id, l.doc_id IS NOT NULL AS matched, CASE WHEN l.doc_id IS NOT NULL THEN 0.0::DOUBLE END AS distance FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.lit(True).alias("m"))
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.col("m").isNotNull().alias("matched"), F.when(F.col("m"), 0.0).alias("distance"))


@query("label_transfer", """WITH m AS (SELECT doc_id AS cand, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS gt, doc_id % 11 = 0 AS amb FROM documents), j AS (SELECT m.*, l.quality FROM m LEFT JOIN labels l ON l.doc_id = m.gt),
s AS (SELECT *, CASE WHEN gt IS NULL THEN 'UNMATCHED_TRACK' WHEN quality IS NULL THEN 'MATCHED_UNANNOTATED_GT' WHEN amb THEN 'AMBIGUOUS_MATCH' ELSE 'MATCHED_ANNOTATED' END AS match_status FROM j)
SELECT match_status, CAST(CASE WHEN match_status = 'MATCHED_ANNOTATED' THEN quality END AS INTEGER) AS label, count(*) AS n FROM s GROUP BY ALL""")
def _(spark, d):
    docs = table(spark, d, "documents")
    p = docs.select(F.col("doc_id").alias("cand"))
    m = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("cand"), F.col("doc_id").alias("gt"), (F.col("doc_id") % 11 == 0).alias("ambiguous"))
    a = table(spark, d, "labels").select(F.col("doc_id").alias("gt"), F.col("quality").alias("gt_label"))
    return assoc.transfer_labels(p, m, a).groupBy("match_status", "label").agg(F.count("*").alias("n"))


@query("prompt_expand", "SELECT o_orderpriority AS prompt, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("prompt"))
    x = pool.expand_prompts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice"), p, ["k"])
    return x.groupBy("prompt").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


# ---- Coverage, distributions, decisions ------------------------------------------------------------------------------

_COV = f"""WITH {LINES}, g AS (SELECT log_id, prompt, timestamp_ns, count(*) AS candidates, count(*) FILTER (label = 0) AS gt_positive, count(*) FILTER (label = 0 AND distance_m <= 40) AS eligible,
  count(*) FILTER (label = 0 AND distance_m <= 30) AS matched, count(*) FILTER (label = 0 AND distance_m <= 30 AND area > 0) AS projected, count(*) FILTER (label IS NULL) AS unknown FROM cand GROUP BY ALL)"""


def _coverage_groups(spark, d):
    p = F.col("label") == 0
    return line_candidates(spark, d).groupBy(*GROUP).agg(F.count("*").alias("candidates"), F.count_if(p).alias("gt_positive"), F.count_if(p & (F.col("distance_m") <= 40)).alias("eligible"), F.count_if(p & (F.col("distance_m") <= 30)).alias("matched"), F.count_if(p & (F.col("distance_m") <= 30) & (F.col("area") > 0)).alias("projected"), F.count_if(F.col("label").isNull()).alias("unknown"))


@query("coverage_count_bins", _COV + " SELECT CASE WHEN candidates = 0 THEN '0' WHEN candidates <= 10 THEN '1-10' WHEN candidates <= 50 THEN '11-50' WHEN candidates <= 100 THEN '51-100' ELSE '101+' END AS bin, count(*) AS groups, CAST(sum(matched) AS BIGINT) AS matched FROM g GROUP BY 1")
def _(spark, d):
    return _coverage_groups(spark, d).groupBy(fn.count_bin(F.col("candidates")).alias("bin")).agg(F.count("*").alias("groups"), F.sum("matched").alias("matched"))


def _dist_sql(base: str, c: str, by: str) -> str:
    q = lambda x, n: f"round(quantile_cont({c}, {x}), 6) AS {n}"
    return f"WITH {base} SELECT {by}, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS least, {q(0.25, 'q25')}, {q(0.5, 'median')}, {q(0.75, 'q75')}, max({c}) AS most FROM cand GROUP BY ALL"


@query("distributions", _dist_sql(LINES, "distance_m", "prompt"))
def _(spark, d):
    return audit.distribution(line_candidates(spark, d), "distance_m", "prompt")


@query("label_feature_dist", _dist_sql(DOCS, "score", "coalesce(label, -1) AS label"))
def _(spark, d):
    return audit.distribution(document_candidates(spark, d).withColumn("label", F.coalesce("label", F.lit(-1))), "score", "label")


@query("quantiles_10_50_90", f"WITH {LINES} SELECT prompt, round(quantile_cont(score, 0.1), 4) AS q10, round(quantile_cont(score, 0.5), 4) AS q50, round(quantile_cont(score, 0.9), 4) AS q90 FROM cand GROUP BY prompt")
def _(spark, d):
    q = lambda i, name: F.round(F.get("score", F.lit(i)), 4).alias(name)
    return quantiles(line_candidates(spark, d).select("prompt", "score"), ["score"], (0.1, 0.5, 0.9), ["prompt"]).select("prompt", q(0, "q10"), q(1, "q50"), q(2, "q90"))


@query("group_summary", f"""WITH {DOCS}, g AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS p, count(*) FILTER (label IN (1, 2)) AS neg, count(*) FILTER (label IS NULL) AS u FROM cand GROUP BY log_id, prompt, timestamp_ns)
SELECT count(*) AS groups, count(*) FILTER (p > 0 AND neg > 0) AS rankable, count(*) FILTER (p > 0) AS positive_groups, round(count(*) FILTER (p > 0) / count(*), 6) AS oracle_coverage, round(sum(u) / sum(n), 6) AS unknown_rate, round(median(n), 6) AS median_candidates FROM g""")
def _(spark, d):
    return diagnosis.group_summary(document_candidates(spark, d)).select("groups", F.col("rankable_groups").alias("rankable"), "positive_groups", "oracle_coverage", "unknown_rate", "median_candidates")


# ---- Splits and plans ------------------------------------------------------------------------------------------------


@query("split_overlap", "WITH s AS (SELECT DISTINCT o_orderstatus AS split, CAST(o_custkey % 50 AS VARCHAR) AS log FROM orders) SELECT log, string_agg(split, '/' ORDER BY split) AS splits FROM s GROUP BY log HAVING count(*) > 1")
def _(spark, d):
    return audit.split_overlap(table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 50).cast("string").alias("log")))


@query("split_agreement", """WITH plan AS (SELECT n_nationkey AS log, CASE WHEN n_nationkey % 10 < 6 THEN 'train' WHEN n_nationkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM nation WHERE n_nationkey <> 3),
g AS (SELECT c_nationkey AS log, CASE WHEN c_custkey % 97 = 0 THEN 'test' ELSE CASE WHEN c_nationkey % 10 < 6 THEN 'train' WHEN c_nationkey % 10 < 8 THEN 'validation' ELSE 'test' END END AS split FROM customer)
SELECT CASE WHEN plan.log IS NULL THEN 'absent' WHEN plan.split <> g.split THEN 'mismatched' ELSE 'ok' END AS status, count(*) AS n FROM g LEFT JOIN plan USING (log) GROUP BY 1""")
def _(spark, d):
    s = lambda c: F.when(c % 10 < 6, "train").when(c % 10 < 8, "validation").otherwise("test")
    plan = table(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("log"), s(F.col("n_nationkey")).alias("planned"))
    g = table(spark, d, "customer").select(F.col("c_nationkey").alias("log"), F.when(F.col("c_custkey") % 97 == 0, "test").otherwise(s(F.col("c_nationkey"))).alias("split"))
    j = g.join(plan, "log", "left")
    return j.groupBy(F.when(F.col("planned").isNull(), "absent").when(F.col("planned") != F.col("split"), "mismatched").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


@query("prompt_log_sets", "SELECT lang AS prompt, string_agg(DISTINCT source, ',' ORDER BY source) AS logs, count(DISTINCT source) AS n FROM documents WHERE trim(lang) <> '' GROUP BY lang")
def _(spark, d):
    t = table(spark, d, "documents").where(F.trim("lang") != "")
    return t.groupBy(F.col("lang").alias("prompt")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("logs"), F.count_distinct("source").alias("n"))


def _prompt_logs(spark, d):
    """Orders as prompts (priority and status) and logs (customers by twelve)."""
    return table(spark, d, "orders").select(F.concat("o_orderpriority", "o_orderstatus").alias("prompt"), (F.col("o_custkey") % 12).cast("string").alias("log"))


@query("triplet_counts", "WITH p AS (SELECT DISTINCT o_orderpriority || o_orderstatus AS prompt, CAST(o_custkey % 12 AS VARCHAR) AS log FROM orders) SELECT a.log AS a, b.log AS b, c.log AS c, count(*) AS shared FROM p a JOIN p b ON a.prompt = b.prompt AND a.log < b.log JOIN p c ON b.prompt = c.prompt AND b.log < c.log GROUP BY ALL")
def _(spark, d):
    return graph.log_triplets(_prompt_logs(spark, d))


_TRIPLES = """p AS (SELECT DISTINCT o_orderpriority || o_orderstatus AS prompt, CAST(o_custkey % 12 AS VARCHAR) AS log FROM orders),
t AS (SELECT a.log AS a, b.log AS b, c.log AS c, count(*) AS shared FROM p a JOIN p b ON a.prompt = b.prompt AND a.log < b.log JOIN p c ON b.prompt = c.prompt AND b.log < c.log GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT [a, b, c] AS x, row_number() OVER (ORDER BY shared DESC, a, b, c) AS k FROM t)"""


@query("three_way_plan", f"""WITH {_TRIPLES}, p1 AS (SELECT x FROM r WHERE k = 1), p2 AS (SELECT r.x FROM r, p1 WHERE NOT list_has_any(r.x, p1.x) ORDER BY k LIMIT 1),
p3 AS (SELECT r.x FROM r, p1, p2 WHERE NOT list_has_any(r.x, p1.x) AND NOT list_has_any(r.x, p2.x) ORDER BY k LIMIT 1), c AS (SELECT x FROM p1 UNION ALL SELECT x FROM p2 UNION ALL SELECT x FROM p3)
SELECT unnest(x) AS log, unnest(['train', 'validation', 'test']) AS split FROM c""")
def _(spark, d):
    plan = graph.three_way_plan(graph.disjoint_triplets(_prompt_logs(spark, d)))
    return spark.createDataFrame([(log, s) for s, logs in plan.items() for log in logs], "log string, split string")


@query("paired_metric_join", f"WITH {LINES}, {RANKED} SELECT count(*) AS groups, round(avg(a.average_precision - b.average_precision), 6) AS mean_difference FROM met a JOIN met b USING (log_id, prompt, timestamp_ns) WHERE a.control = 'tracker_score' AND b.control = 'candidate_distance' AND a.average_precision IS NOT NULL AND b.average_precision IS NOT NULL")
def _(spark, d):
    return _paired(spark, d).agg(F.count("*").alias("groups"), F.round(F.avg("difference"), 6).alias("mean_difference"))


def _paired(spark, d):
    m = ranking.group_metrics(ranking.rank(line_candidates(spark, d), ["tracker_score", "candidate_distance"]))
    return ranking.paired_differences(m.where("control = 'tracker_score'"), m.where("control = 'candidate_distance'"), "average_precision")


_WEIGHT = " + ".join(f"(u >= {e})::INT" for e in ranking.POISSON)
_DRAWS = f"""s AS (SELECT range AS s, 1 + CAST('0x' || substr(sha256('a|0|' || range), 1, 12) AS BIGINT) % {ranking.PRIME - 1} AS a, CAST('0x' || substr(sha256('b|0|' || range), 1, 12) AS BIGINT) % {ranking.PRIME} AS b FROM range(10000)),
h AS (SELECT difference, CAST('0x' || substr(sha256(log_id || '|' || prompt || '|' || timestamp_ns), 1, 12) AS BIGINT) % {ranking.PRIME} AS h FROM diff),
u AS (SELECT s, difference, (a * h + b) % {ranking.PRIME} AS u FROM h, s), m AS (SELECT s, sum(({_WEIGHT}) * difference) / nullif(sum({_WEIGHT}), 0) AS m FROM u GROUP BY s)"""


@query("paired_bootstrap", f"""WITH {LINES}, {RANKED}, diff AS (SELECT log_id, prompt, timestamp_ns, a.average_precision - b.average_precision AS difference FROM met a JOIN met b USING (log_id, prompt, timestamp_ns) WHERE a.control = 'tracker_score' AND b.control = 'candidate_distance' AND a.average_precision IS NOT NULL AND b.average_precision IS NOT NULL), {_DRAWS}
SELECT (SELECT count(*) FROM diff) AS groups, (SELECT round(avg(difference), 6) FROM diff) AS mean_difference, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def _(spark, d):
    return ranking.paired_bootstrap(_paired(spark, d))


# ---- Features --------------------------------------------------------------------------------------------------------


@query("box_feature_vector", f"""WITH {BOXES}, {_CORNERS}, {_CLIPPED}, v AS (SELECT box.*, x0, y0, x1, y1, coalesce(greatest(0, x1 - x0) * greatest(0, y1 - y0) > 1, false) AS seen FROM box LEFT JOIN m USING (vec_id)),
f AS (SELECT vec_id, [CASE WHEN seen THEN x0 / 192 ELSE 0 END, CASE WHEN seen THEN y0 / 120 ELSE 0 END, CASE WHEN seen THEN x1 / 192 ELSE 0 END, CASE WHEN seen THEN y1 / 120 ELSE 0 END, seen::INT::DOUBLE, sqrt(x * x + y * y) / 50, length / 10, width / 10, height / 10, x / 50, y / 50, z / 50] AS f FROM v)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(f[i], 5) AS value FROM f, range(1, 13) r(i)""")
def _(spark, d):
    b = _projected(spark, d)
    at = lambda *names: F.array(*[F.col(n) for n in names])
    f = fn.box_features(F.col("box"), F.lit(192.0), F.lit(120.0), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), at("length", "width", "height"), at("x", "y", "z"))
    return b.select("vec_id", F.posexplode(f).alias("i", "value")).withColumn("value", F.round("value", 5))


@query("metadata_features", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 4) AS f0, round(l_quantity / 10, 4) AS f1, round(l_tax / 50, 6) AS f2 FROM lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem").withColumn("f", fn.metadata_features(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax")))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.get("f", 0), 4).alias("f0"), F.round(F.get("f", 1), 4).alias("f1"), F.round(F.get("f", 2), 6).alias("f2"))


@query("unit_norms", "SELECT vec_id, round(list_sum([CAST(w AS DOUBLE) * CAST(w AS DOUBLE) FOR w IN embedding]), 5) AS square, round(CAST(embedding[1] AS DOUBLE) / greatest(sqrt(list_sum([CAST(w AS DOUBLE) * CAST(w AS DOUBLE) FOR w IN embedding])), 1e-12), 5) AS first FROM embeddings")
def _(spark, d):
    t = table(spark, d, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    return t.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 5).alias("square"), F.round(F.element_at(fn.unit_vector(F.col("e")), 1), 5).alias("first"))


@query("vocab_fit_train_only", f"""WITH {LINES}, v AS (SELECT name, CAST(dense_rank() OVER (ORDER BY name) AS INTEGER) AS idx FROM (SELECT DISTINCT name FROM cand WHERE timestamp_ns < 1994 AND name <> 'p3'))
SELECT coalesce(idx, 0) AS idx, count(*) AS n FROM cand LEFT JOIN v USING (name) GROUP BY 1""")
def _(spark, d):
    c = line_candidates(spark, d)
    vocab = c.where("timestamp_ns < 1994 and name <> 'p3'").select("name").distinct().withColumn("idx", F.dense_rank().over(Window.orderBy("name")))  # as long as the vocabulary
    return c.join(vocab, "name", "left").groupBy(F.coalesce("idx", F.lit(0)).alias("idx")).agg(F.count("*").alias("n"))


@query("scorer_forward")
def _(spark, d):
    from .scorer import score_vectors

    return score_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"))


# ---- Suites, exports and assessments ---------------------------------------------------------------------------------

_FULL = "all_freq AS (SELECT name, count(*) AS freq FROM cand GROUP BY name)"


def _view_sql(view: str, source: str, controls=ranking.CONTROLS, seed: int | None = None) -> str:
    keep = "" if view == "full" else " WHERE (log_id, prompt, timestamp_ns) IN (SELECT (log_id, prompt, timestamp_ns) FROM {s} GROUP BY log_id, prompt, timestamp_ns HAVING count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label <> 0) > 0)".format(s=source)
    freq = f"freq AS (SELECT n.*, k.freq FROM {source} n JOIN all_freq k USING (name){keep})"
    ranked = ranked_sql(controls, seed or 0)
    ranked = ranked[ranked.index("long AS") :]
    ok = "positive_count > 0 AND negative_count > 0"
    mean = lambda c, n: f"round(avg(CASE WHEN {ok} THEN {c} END), 6) AS {n}"
    return f"""SELECT * FROM (WITH {freq}, {ranked} SELECT control, count(*) AS groups, count(*) FILTER ({ok}) AS rankable_groups, {mean("average_precision", "mean_ap")}, {mean("recall_at_1", "recall_at_1")},
  {mean("labeled_average_precision", "labeled_mean_ap")}, {mean("labeled_recall_at_1", "labeled_recall_at_1")}, round(avg(candidate_count), 6) AS mean_candidates, round(avg(positive_count), 6) AS mean_positives, round(avg(negative_count), 6) AS mean_negatives, round(avg(unknown_count), 6) AS mean_unknown, '{view}' AS view{"" if seed is None else f", {seed} AS seed"} FROM met GROUP BY control)"""


@query("control_suite", f"WITH {LINES}, {_HARD.format(delta=5000)}, {_AREA}, {_FULL} " + " UNION ALL ".join(_view_sql(v, s) for v, s in (("full", "cand"), ("score_matched", "near"), ("score_size_matched", "near2"))))
def _(spark, d):
    return ranking.control_suite(line_candidates(spark, d), 5000.0, 0.2)


@query("control_suite_hashed_random", f"WITH {LINES}, {_HARD.format(delta=5000)}, {_AREA}, {_FULL} " + " UNION ALL ".join(_view_sql(v, s, ["random"], seed) for seed in (0, 1) for v, s in (("full", "cand"), ("score_matched", "near"), ("score_size_matched", "near2"))))
def _(spark, d):
    return ranking.control_suite(line_candidates(spark, d), 5000.0, 0.2, ["random"], (0, 1))


@query("control_suite_random")
def _(spark, d):
    return ranking.random_control_suite(line_candidates(spark, d), 5000.0, 0.2)


@query("control_suite_seeded")
def _(spark, d):
    return ranking.seeded_control_suite(line_candidates(spark, d), 5000.0, 0.2)


@query("control_strata_by_log", _summary_sql(LINES, "control, log_id"))
def _(spark, d):
    return ranking.summarize(ranking.group_metrics(ranking.rank(line_candidates(spark, d))), "control", "log_id")


@query("hash_shuffle", f"WITH {DOCS} SELECT log_id, prompt, timestamp_ns, track_id, CAST(row_number() OVER (PARTITION BY log_id, prompt, timestamp_ns ORDER BY sha256('5|' || log_id || '|' || prompt || '|' || timestamp_ns || '|' || track_id), track_id) - 1 AS INTEGER) AS position FROM cand")
def _(spark, d):
    return pool.hash_shuffle(document_candidates(spark, d).select(*GROUP, "track_id"), list(GROUP), 5)


@query("numpy_shuffle")
def _(spark, d):
    return pool.numpy_shuffle(document_candidates(spark, d).select(*GROUP, "track_id"), list(GROUP), 5)


def _label_groups(spark, d):
    """Two prompts a frame, each with an array of labels in string order of the ids."""
    b = box_table(spark, d)
    g = b.withColumn("prompt", F.explode(F.array(F.lit("q0"), F.lit("q1"))))
    shift = F.when(F.col("prompt") == "q1", 1).otherwise(0)
    label = F.when((F.col("vec_id") + shift) % 4 != 3, ((F.col("vec_id") + shift) % 4).cast("int"))
    arr = F.array_sort(F.collect_list(F.struct(F.col("vec_id").cast("string").alias("k"), label.alias("l"))))
    return g.groupBy("log_id", "timestamp_ns", "prompt").agg(F.transform(arr, lambda x: x["l"]).alias("labels"), F.count("*").alias("candidate_count"))


@query("baseline_rows", f"""WITH {BOXES}, {_R}, q AS (SELECT r.*, p.prompt, CASE WHEN (vec_id + p.s) % 4 <> 3 THEN CAST((vec_id + p.s) % 4 AS INTEGER) END AS label FROM r, (VALUES ('q0', 0), ('q1', 1)) p(prompt, s))
SELECT prompt, vec_id, label, CASE WHEN label IS NULL THEN 'UNKNOWN' ELSE 'MATCHED_ANNOTATED' END AS match_status, round(r00 * (x - tx) + r10 * (y - ty) + r20 * (z - tz), 5) AS ego_x FROM q""")
def _(spark, d):
    rows = pool.baseline_rows(box_table(spark, d), _label_groups(spark, d), ["log_id", "timestamp_ns"], "vec_id")
    return rows.select("prompt", "vec_id", "label", "match_status", F.round("ego_x", 5).alias("ego_x"))


@query("source_group_audit", f"""WITH {BOXES}, g AS (SELECT DISTINCT log_id, timestamp_ns, prompt FROM box, (VALUES ('q0'), ('q1')) p(prompt)), k AS (SELECT *, row_number() OVER (ORDER BY log_id, timestamp_ns, prompt) % 6 AS k FROM g)
SELECT log_id, timestamp_ns, prompt, CASE k WHEN 0 THEN 'labels do not fit the count' WHEN 1 THEN 'rows do not fit the count' WHEN 2 THEN 'digest differs' END AS problem FROM k WHERE k < 3""")
def _(spark, d):
    """Of every six groups, one lacks a label, one counts a row too many, one has another digest."""
    b, on = box_table(spark, d), ["log_id", "timestamp_ns"]
    g = _label_groups(spark, d).join(pool.membership(b, on, ["vec_id", "class"]).select(*on, "digest"), on)
    k = F.row_number().over(Window.orderBy(*on, "prompt")) % 6  # a few groups
    g = g.withColumn("k", k)
    more = F.when(F.col("k") == 1, F.col("candidate_count") + 1).otherwise(F.col("candidate_count"))
    labels = F.when(F.col("k") == 0, F.slice("labels", 2, 1000000)).when(F.col("k") == 1, F.concat("labels", F.array(F.lit(1)))).otherwise(F.col("labels"))
    g = g.withColumns({"candidate_count": more, "labels": labels, "digest": F.when(F.col("k") == 2, "x").otherwise(F.col("digest"))})
    return pool.source_group_problems(b, g, on, "vec_id", ["vec_id", "class"], ["prompt"])


@query("assess_pool", f"""WITH {LINES}, g AS (SELECT count(*) AS n, count(DISTINCT track_id) AS d, count(*) FILTER (label = 0) AS p, count(*) FILTER (label = 0 AND area > 0) AS pp, count(*) FILTER (label IS NULL) AS u FROM cand GROUP BY log_id, prompt, timestamp_ns)
SELECT count(*) AS groups, round(count(*) FILTER (p > 0) / count(*), 6) AS availability, round(sum(pp) / nullif(sum(p), 0), 6) AS projection, round(sum(u) / nullif(sum(n), 0), 6) AS unknown_fraction, CAST(sum(n - d) AS BIGINT) AS repeats FROM g""")
def _(spark, d):
    return audit.assess(line_candidates(spark, d).withColumn("projected", F.col("area") > 0))


@query("split_file_stats", f"""WITH {LINES}, s AS (SELECT *, CASE WHEN timestamp_ns % 10 < 6 THEN 'train' WHEN timestamp_ns % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM cand)
SELECT split, count(*) AS rows, count(DISTINCT (log_id, prompt, timestamp_ns)) AS groups, count(*) - count(DISTINCT (log_id, prompt, timestamp_ns, track_id)) AS repeats, round(avg(CASE WHEN area > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS projected FROM s GROUP BY split""")
def _(spark, d):
    m = F.col("timestamp_ns") % 10
    s = line_candidates(spark, d).withColumn("split", F.when(m < 6, "train").when(m < 8, "validation").otherwise("test"))
    return s.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(*GROUP).alias("groups"), (F.count("*") - F.count_distinct(*GROUP, "track_id")).alias("repeats"), F.round(F.avg((F.col("area") > 0).cast("double")), 6).alias("projected"))


@query("group_records", f"""WITH {DOCS} SELECT log_id, prompt, count(*) AS candidate_count, count(*) FILTER (label = 0) AS gt_positive, count(*) FILTER (label = 0 AND name <> 'c0') AS external_positive,
  count(*) FILTER (label IS NULL) AS unknown_count, CASE WHEN count(*) FILTER (label = 0 AND name <> 'c0') = 0 THEN 'ego_or_scenario' WHEN count(*) FILTER (label = 0 AND name = 'c0') > 0 THEN 'mixed' ELSE 'external_object' END AS track_family FROM cand GROUP BY log_id, prompt""")
def _(spark, d):
    ext, ego = (F.col("label") == 0) & (F.col("name") != "c0"), (F.col("label") == 0) & (F.col("name") == "c0")
    family = F.when(F.count_if(ext) == 0, "ego_or_scenario").when(F.count_if(ego) > 0, "mixed").otherwise("external_object")
    return document_candidates(spark, d).groupBy("log_id", "prompt").agg(F.count("*").alias("candidate_count"), F.count_if(F.col("label") == 0).alias("gt_positive"), F.count_if(ext).alias("external_positive"), F.count_if(F.col("label").isNull()).alias("unknown_count"), family.alias("track_family"))


@query("projection_summary", f"""WITH {BOXES}, {_CORNERS}, cam AS (SELECT * FROM (VALUES ('near', 0.5::DOUBLE), ('mid', 5.0::DOUBLE), ('behind', -50.0::DOUBLE)) v(camera, shift)), c AS (SELECT vec_id, camera, i, px AS x, py AS y, pz + shift AS z FROM corner, cam), ed AS ({_EDGE}),
s AS (SELECT vec_id, camera, x, y, z FROM c WHERE z >= 0.1::DOUBLE UNION ALL SELECT p.vec_id, p.camera, p.x + (q.x - p.x) * (0.1::DOUBLE - p.z) / (q.z - p.z), p.y + (q.y - p.y) * (0.1::DOUBLE - p.z) / (q.z - p.z), 0.1::DOUBLE
  FROM ed JOIN c p ON p.i = ed.a JOIN c q ON q.i = ed.b AND q.vec_id = p.vec_id AND q.camera = p.camera WHERE (p.z >= 0.1::DOUBLE) <> (q.z >= 0.1::DOUBLE)),
m AS (SELECT vec_id, camera, greatest(0, least(192, max(x * 100.0::DOUBLE / z + 96)) - greatest(0, min(x * 100.0::DOUBLE / z + 96))) * greatest(0, least(120, max(y * 100.0::DOUBLE / z + 60)) - greatest(0, min(y * 100.0::DOUBLE / z + 60))) AS area FROM s GROUP BY ALL),
cnt AS (SELECT b.vec_id, count(*) FILTER (area > 1) AS seen FROM box b LEFT JOIN m USING (vec_id) GROUP BY b.vec_id) SELECT count(*) AS boxes, count(*) FILTER (seen > 0) AS any_camera, count(*) FILTER (seen = 3) AS all_cameras, CAST(sum(seen) AS BIGINT) AS projections FROM cnt""")
def _(spark, d):
    b = _cornered(spark, d)

    def ahead(shift):
        return F.transform("corners", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (c["z"] + shift).alias("z")))

    b = b.withColumns({f"a{k}": ahead(s) for k, s in enumerate((0.5, 5.0, -50.0))})  # columns, so that each is worked out once
    seen = sum((geo.project(F.col(f"a{k}"), 100.0, 100.0, 96.0, 60.0, 192.0, 120.0).isNotNull().cast("int") for k in range(3)), F.lit(0))
    return b.select(seen.alias("seen")).agg(F.count("*").alias("boxes"), F.count_if(F.col("seen") > 0).alias("any_camera"), F.count_if(F.col("seen") == 3).alias("all_cameras"), F.sum("seen").cast("long").alias("projections"))


@query("camera_entry", "SELECT vec_id, 'img' || CAST(vec_id AS VARCHAR) AS image_path, CAST(vec_id % 7 AS BIGINT) AS timestamp_delta_ns FROM embeddings")
def _(spark, d):
    from ..sources.readers import camera_entry

    front = F.struct(F.lit("front").alias("camera_name"), F.concat(F.lit("img"), F.col("vec_id").cast("string")).alias("image_path"), (F.col("vec_id") % 7).cast("long").alias("timestamp_delta_ns"))
    left = F.struct(F.lit("left").alias("camera_name"), F.lit(None).cast("string").alias("image_path"), F.lit(0).cast("long").alias("timestamp_delta_ns"))
    t = table(spark, d, "embeddings").select("vec_id", F.to_json(F.array(left, front)).alias("c"))
    return camera_entry(t, "c", "front").select("vec_id", "entry.image_path", "entry.timestamp_delta_ns")


@query("baseline_problems", f"""WITH {LINES}, c AS (SELECT *, CAST(timestamp_ns % 2 AS VARCHAR) AS split, CASE WHEN area = 0 THEN 'other' ELSE 'image' END AS image_path, CASE WHEN distance_m = 50 THEN 7 ELSE label END AS own,
  CASE WHEN log_id = '1' AND distance_m = 1 THEN 'a' ELSE 'b' END AS prompt_split FROM cand)
SELECT (SELECT count(*) FROM (SELECT log_id FROM c GROUP BY log_id HAVING count(DISTINCT split) > 1)) AS logs_in_two_splits, CAST(count(*) - count(DISTINCT (log_id, prompt, timestamp_ns, track_id)) AS BIGINT) AS repeated_candidates,
  (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY log_id, prompt, timestamp_ns HAVING count(DISTINCT image_path) > 1)) AS groups_with_two_images, (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY log_id, prompt, timestamp_ns HAVING count(DISTINCT prompt_split) > 1)) AS groups_with_two_holdouts,
  count(*) FILTER (own NOT IN (0, 1, 2)) AS labels_out_of_range, CAST(2 - count(DISTINCT split) AS BIGINT) AS empty_splits FROM c""")
def _(spark, d):
    c = line_candidates(spark, d)
    prompt_split = F.when((F.col("log_id") == "1") & (F.col("distance_m") == 1), "a").otherwise("b")
    c = c.withColumns({"split": (F.col("timestamp_ns") % 2).cast("string"), "image_path": F.when(F.col("area") == 0, "other").otherwise("image"), "label": F.when(F.col("distance_m") == 50, 7).otherwise(F.col("label")), "prompt_split": prompt_split})
    return audit.baseline_problems(c, ["0", "1"], ["prompt_split"])


@query("scorer_train")
def _(spark, d):
    import numpy as np

    from .scorer import score_vectors, train

    t = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    rows = t.orderBy(F.xxhash64("vec_id")).limit(1000).toArrow()  # the bound of the training sample
    x = rows["embedding"].combine_chunks().values.to_numpy().reshape(rows.num_rows, -1).astype(float)
    w, _ = train(x, (rows["label"].to_numpy() == 0).astype(float), 100)
    return score_vectors(t.select("vec_id", "embedding"), w)


from . import suite_audit, suite_pool  # noqa: E402, F401  (they register their queries)
