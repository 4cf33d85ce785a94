"""Ranking controls and the metrics of ranked groups.

All controls of a group are ranked by one window over one hash exchange: the group key is the exchange's key, and the
control only subdivides it. Rows are multiplied by controls after the exchange, so each moves once. Unknown candidates
hold ranks but are no negatives.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import score_or_last, sigmoid
from ..plans.base import GROUP
from .graph import _checkpoint
from .quantiles import BROADCAST_ROWS, on_groups

CONTROLS = ("tracker_score", "candidate_distance", "projected_box_area", "category_frequency", "oracle")

#: Places in a seeded permutation of the group, as seeded_ties gives them.
TIE = "_tie"

#: Rows that a task of by_group should hold: some hundred MB once they are multiplied by controls and sorted.
TASK_ROWS = 200_000

VIEWS = ("full", "score_matched", "score_size_matched")

#: The columns of group_metrics beside its keys.
METRICS = ("candidate_count", "labeled_candidate_count", "positive_count", "negative_count", "unknown_count", "average_precision", "recall_at_1", "labeled_average_precision", "labeled_recall_at_1")


def key_sql(seed: int = 0) -> str:
    """The same keys as in control_key, for the oracle queries."""
    return f"""CASE control WHEN 'random' THEN CAST(CAST('0x' || substr(sha256('{seed}|' || log_id || '|' || prompt || '|' || timestamp_ns || '|' || track_id), 1, 13) AS BIGINT) AS DOUBLE)
  WHEN 'tracker_score' THEN -coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, '-inf'::DOUBLE)
  WHEN 'candidate_distance' THEN coalesce(distance_m, 'inf'::DOUBLE) WHEN 'projected_box_area' THEN -coalesce(area, 0)
  WHEN 'category_frequency' THEN -CAST(freq AS DOUBLE) ELSE CASE WHEN label = 0 THEN 0 ELSE 1 END END"""


def with_frequency(cands: DataFrame) -> DataFrame:
    """How often each name occurs in the whole table, null being a name as well; count before taking subsets."""
    return with_counts(cands, cands.groupBy("name").agg(F.count("*").alias("freq")), ["name"])


def with_counts(cands: DataFrame, counts: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """cands joined with counts; few of them (names, mostly) are broadcast, so that no row moves to meet them."""
    counts = _checkpoint(counts)
    return on_groups(cands, F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts.hint("merge"), on, how)


def by_group(df: DataFrame, rows: int | None = None, on: Sequence[str] = GROUP) -> DataFrame:
    """df with whole groups in as many partitions as its rows ask for, so that what a task sorts does not grow with the table.

    Windows and aggregates by group and anything below it then need no exchange of their own. Rows are counted, unless
    their number is given: give it where they are dear. `on` names what keeps groups whole in place of their key.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1), *on)


def tracker_score(df: DataFrame) -> Column:
    """A candidate's score; a table without that column has tracker_score. A score that is there but null ranks last."""
    return score_or_last(F.col("score" if "score" in df.columns else "tracker_score"))


def control_key(df: DataFrame, control: str, seed: int = 0, tie: str = "track_id") -> Column:
    """Ascending sort key of a candidate under a control. The random one is a digest of seed, group and candidate, or all tie."""
    if control == "random" and tie == TIE:
        return F.lit(0.0)
    if control == "random":
        digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*GROUP, tie)]), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    if control == "tracker_score":
        return -tracker_score(df)
    if control == "candidate_distance":
        return F.coalesce("distance_m", F.lit(float("inf")))
    if control == "projected_box_area":
        return -F.coalesce("area", F.lit(0.0))
    if control == "category_frequency":
        return -F.col("freq").cast("double")
    if control == "oracle":
        return F.when(F.col("label") == 0, 0.0).otherwise(1.0)
    raise ValueError(f"unknown control: {control}")


def rank(cands: DataFrame, controls: Sequence[str] = CONTROLS, tie: str = "track_id", seed: int = 0, seeds: Sequence[int] = (), by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """A row for each candidate and control, with rank, labeled_rank (unknown left out) and found (positives so far).

    Columns are group, candidate, label, by and these: what a control needs is made into its key before rows are
    multiplied. Groups are those of the group key and `by`. With `seeds` there is a row for each of them, and a column
    seed. A column freq that is there already (of the table that a subset was taken from) is kept.
    """
    full = with_frequency(cands) if "category_frequency" in controls and "freq" not in cands.columns else cands
    rest = [*by, *([] if tie == "track_id" else [tie])]
    made = ["_c.control", *(["_c.seed"] if seeds else [])]
    used = dict.fromkeys([*GROUP, "track_id", *rest, "label", *[c for c in ("score", "tracker_score", "distance_m", "area", "freq") if c in full.columns]])
    moved = by_group(full.select(*used), rows)
    long = moved.select(*GROUP, "track_id", *rest, "label", F.explode(_keys(moved, controls, tie, seeds or (seed,))).alias("_c")).select(*GROUP, "track_id", *rest, "label", *made, "_c._key")
    return _placed(long, Window.partitionBy(*GROUP, "control", *by, *(["seed"] if seeds else [])).orderBy("_key", tie)).drop("_key")


def rank_by(cands: DataFrame, keys: Mapping[str, Column], tie: str = "track_id", keep: Sequence[str] = ()) -> DataFrame:
    """rank with controls given as names and their ascending sort keys; the columns of `keep` have one value in a group.

    Groups stay where they are if a window or join has them in one task each already.
    """
    made = F.array(*[F.struct(F.lit(c).alias("control"), k.alias("_key")) for c, k in keys.items()])
    long = cands.select(*GROUP, tie, "label", *keep, F.explode(made).alias("_c")).select(*GROUP, tie, "label", *keep, "_c.*")
    return _placed(long, Window.partitionBy(*GROUP, "control").orderBy("_key", tie)).drop("_key")


def _placed(long: DataFrame, w: WindowSpec) -> DataFrame:
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return long.withColumns({"rank": F.row_number().over(w), "found": F.sum((F.coalesce(F.col("label") == 0, F.lit(False))).cast("int")).over(so_far), "labeled_rank": F.sum(F.col("label").isNotNull().cast("int")).over(so_far)})


def _keys(df: DataFrame, controls: Sequence[str], tie: str, seeds: Sequence[int]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("control"), F.lit(s).alias("seed"), control_key(df, c, s, tie).alias("_key")) for s in seeds for c in controls])


def group_metrics(ranked: DataFrame, *by: str) -> DataFrame:
    """Counts, average precision and recall at 1 of each group and control, over all and over labeled candidates."""
    return ranked.groupBy(*GROUP, "control", *by).agg(*_measures())


def _measures(of: Column | None = None, rank: str = "rank", found: str = "found", labeled_rank: str = "labeled_rank") -> list[Column]:
    """Aggregates of a group's rows, or of those that a condition names."""
    of = F.lit(True) if of is None else of
    pos, known = of & F.coalesce(F.col("label") == 0, F.lit(False)), of & F.col("label").isNotNull()
    n = F.count_if(pos)
    safe = lambda x: F.when(n > 0, x / n)
    first = lambda c: F.when(n > 0, F.max(F.when(pos & (F.col(c) == 1), 1).otherwise(0)))
    return [
        F.count_if(of).alias("candidate_count"),
        F.count_if(known).alias("labeled_candidate_count"),
        n.alias("positive_count"),
        F.count_if(of & F.col("label").isin(1, 2)).alias("negative_count"),
        F.count_if(of & F.col("label").isNull()).alias("unknown_count"),
        safe(F.sum(F.when(pos, F.col(found) / F.col(rank)))).alias("average_precision"),
        first(rank).alias("recall_at_1"),
        safe(F.sum(F.when(pos, F.col(found) / F.col(labeled_rank)))).alias("labeled_average_precision"),
        first(labeled_rank).alias("labeled_recall_at_1"),
    ]


def summarize(metrics: DataFrame, *by: str, more: Sequence[Column] = ()) -> DataFrame:
    """Means over rankable groups (a positive and a negative), counts over all, and more aggregates of their rows."""
    ok = (F.col("positive_count") > 0) & (F.col("negative_count") > 0)
    mean = lambda c: F.round(F.avg(F.when(ok, F.col(c))), 6)
    return metrics.groupBy(*by).agg(
        F.count("*").alias("groups"),
        F.count_if(ok).alias("rankable_groups"),
        mean("average_precision").alias("mean_ap"),
        mean("recall_at_1").alias("recall_at_1"),
        mean("labeled_average_precision").alias("labeled_mean_ap"),
        mean("labeled_recall_at_1").alias("labeled_recall_at_1"),
        F.round(F.avg("candidate_count"), 6).alias("mean_candidates"),
        F.round(F.avg("positive_count"), 6).alias("mean_positives"),
        F.round(F.avg("negative_count"), 6).alias("mean_negatives"),
        F.round(F.avg("unknown_count"), 6).alias("mean_unknown"),
        *more,
    )


def rankable(cands: DataFrame) -> DataFrame:
    """Keys of the groups with a positive and a negative."""
    return cands.groupBy(*GROUP).agg(F.bool_or(F.col("label") == 0).alias("_p"), F.bool_or(F.col("label").isin(1, 2)).alias("_n")).where("_p and _n").select(*GROUP)


def matched(cands: DataFrame, score_delta: float | None = 0.05, log_area_delta: float | None = None) -> DataFrame:
    """cands with two columns, _by_score and _by_size: whether a row belongs to the matched parts of its group.

    By score: positives, and negatives whose finite score is near that of any positive of the group. By size: of these
    the positives, and negatives that are also near any positive with a finite score in log area (a missing area is 0). Groups
    without a negative left, or without a positive of finite score, belong to neither. The nearest positive on either side is
    found by a running maximum and minimum over the sorted group, so a group of any size costs two sorts and never a
    list of its positives.
    """
    return marked(by_group(cands), score_delta, log_area_delta)


def marked(cands: DataFrame, score_delta: float | None = 0.05, log_area_delta: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """matched without its exchange, for cands whose groups are whole in a task; `by`: columns of one value in a group that place it."""
    group = [*GROUP, *by]
    finite = F.coalesce(F.abs("_score") < float("inf"), F.lit(False))
    s = cands.withColumns({"_score": tracker_score(cands), "_area": F.log1p(F.coalesce("area", F.lit(0.0)))})
    anchor = (F.col("label") == 0) & finite

    def near(c: str, delta: float | None) -> Column:
        if delta is None:
            return F.lit(True)
        by = Window.partitionBy(*group).orderBy(c)
        at = F.when(anchor, F.col(c))
        low = F.max(at).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        high = F.min(at).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
        far = F.lit(float("inf"))
        return F.least(F.coalesce(F.col(c) - low, far), F.coalesce(high - F.col(c), far)) <= delta

    negative = F.coalesce(F.col("label").isin(1, 2), F.lit(False)) & finite
    positive = F.coalesce(F.col("label") == 0, F.lit(False))
    s = s.withColumn("_near", near("_score", score_delta)).withColumn("_close", F.col("_near") & near("_area", log_area_delta))
    s = s.withColumns({"_by_score": positive | (negative & F.col("_near")), "_by_size": positive | (negative & F.col("_close"))})
    w = Window.partitionBy(*group)
    both = lambda c: F.col(c) & (F.count_if(positive).over(w) > 0) & (F.count_if(F.col(c) & ~positive).over(w) > 0)
    return s.withColumns({c: both(c) for c in ("_by_score", "_by_size")}).drop("_score", "_area", "_near", "_close")


def hard_negatives(cands: DataFrame, score_delta: float | None = 0.05, log_area_delta: float | None = None) -> DataFrame:
    """The rows of cands that are matched by score, or by score and size if there is a delta of areas."""
    return matched(cands, score_delta, log_area_delta).where("_by_size").drop("_by_score", "_by_size")


def viewed(cands: DataFrame, score_delta: float, log_area_delta: float) -> DataFrame:
    """cands with a column view: each row once for each of VIEWS that it belongs to, all of one pass over the groups."""
    told = matched(cands, score_delta, log_area_delta)
    own = F.array_compact(F.array(F.lit(VIEWS[0]), F.when(F.col("_by_score"), VIEWS[1]), F.when(F.col("_by_size"), VIEWS[2])))
    return told.withColumn("view", F.explode(own)).drop("_by_score", "_by_size")


def control_suite(cands: DataFrame, score_delta: float, log_area_delta: float, controls: Sequence[str] = CONTROLS, seeds: Sequence[int] = ()) -> DataFrame:
    """Summaries of all controls over the whole table and over its score-matched and score-and-size-matched parts.

    Ties go by track_id; for ties by numpy's permutation see seeded_control_suite.
    """
    extra = ["seed"] if seeds else []
    told = matched(with_frequency(cands) if "category_frequency" in controls else cands, score_delta, log_area_delta)
    return summarize(view_metrics(told, controls, seeds), "control", "view", *extra)


def view_metrics(told: DataFrame, controls: Sequence[str] | Mapping[str, Column] = CONTROLS, seeds: Sequence[int] = (), tie: str = "track_id", by: Sequence[str] = ()) -> DataFrame:
    """group_metrics of each of VIEWS, of the rows of `matched`: (group key..., control, view, by..., seed if there are seeds, metrics).

    A view's ranks are running counts of its rows over the order of the whole group, so one order serves all views and
    rows are multiplied by controls and seeds alone, on the exchange that told which rows belong where. Rows that were not
    matched have the full view alone; controls may be names with their ascending sort keys, if there are no seeds.
    """
    extra = [*by, *(["seed"] if seeds else [])]
    made = ["_c.control", *(["_c.seed"] if seeds else []), "_c._key"]
    flags = [c for c in ("_by_score", "_by_size") if c in told.columns]
    keys = F.array(*[F.struct(F.lit(c).alias("control"), k.alias("_key")) for c, k in controls.items()]) if isinstance(controls, Mapping) else _keys(told, controls, tie, seeds or (0,))
    long = told.select(*GROUP, tie, "label", *by, *flags, F.explode(keys).alias("_c")).select(*GROUP, tie, "label", *by, *flags, *made)
    so_far = Window.partitionBy(*GROUP, "control", *extra).orderBy("_key", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    positive = F.coalesce(F.col("label") == 0, F.lit(False))
    upto = lambda c: F.sum(c.cast("int")).over(so_far)
    of = dict(zip(VIEWS, (F.lit(True), *map(F.col, flags)), strict=False))
    ranked = long.withColumns({f"_{n}{i}": upto(c) for i, own in enumerate(of.values()) for n, c in (("rank", own), ("found", own & positive), ("labeled", own & F.col("label").isNotNull()))})
    one = ranked.groupBy(*GROUP, "control", *extra).agg(*[m.alias(f"_m{i}_{k}") for i, own in enumerate(of.values()) for k, m in enumerate(_measures(own, f"_rank{i}", f"_found{i}", f"_labeled{i}"))])
    rows = F.array(*[F.struct(F.lit(v).alias("view"), *[F.col(f"_m{i}_{k}").alias(n) for k, n in enumerate(METRICS)]) for i, v in enumerate(of)])
    return one.select(*GROUP, "control", *extra, F.explode(rows).alias("_v")).select(*GROUP, "control", *extra, "_v.*").where("candidate_count > 0")


def numbered(keys: DataFrame, order: Sequence[str] = GROUP) -> DataFrame:
    """keys with _g, their number in the given order, from 0; sorted in ranges, not in one task."""
    part = _checkpoint(keys.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    start = part.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_s")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return part.withColumn("_i", own).join(F.broadcast(start), "_p").select(*keys.columns, (F.col("_s") + F.col("_i")).alias("_g"))


def seeded_ties(cands: DataFrame, seeds: Sequence[int] = (0,), by: Sequence[str] = (), tie: str = "track_id") -> DataFrame:
    """cands once for each seed, with columns seed and _tie: the row's place in numpy's permutation of its group.

    The generator's seed is seed + 1009 * the group's number. Groups are numbered within each value of `by` as they first
    appear, and their rows taken in the order in which they come, by a column _row_ord; without one, groups go by their
    key and rows by `tie`. Groups stream through Arrow batches, whole, since a permutation needs its whole group.
    """
    placed = "_row_ord" in cands.columns
    first = [F.min("_row_ord").alias("_first")] if placed else []
    keys = cands.groupBy(*by, *GROUP).agg(*first) if placed else cands.select(*by, *GROUP).distinct()
    if placed and by:  # a part's groups go as they first appear in the whole
        keys = keys.withColumn("_first", F.min("_first").over(Window.partitionBy(*GROUP)))
    order = [*by, *(["_first"] if placed else []), *GROUP]
    count = numbered(keys, order).drop("_first").withColumnRenamed("_g", "_n")
    begin = count.groupBy(*by).agg(F.min("_n").alias("_b"))  # a row for each value of by
    count = on_groups(count, begin, by).withColumn("_k", F.col("_n") - F.col("_b")).drop("_b")
    rows = on_groups(cands, count, [*by, *GROUP]).repartition("_n").sortWithinPartitions("_n", "_row_ord" if placed else tie)
    kept = rows.columns

    def tied(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n, k = t["_n"].to_numpy(), t["_k"].to_numpy()
        start = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        size = np.diff(np.append(start, len(n)))
        for seed in seeds:
            place = np.empty(len(n), np.int64)
            for a, m in zip(start, size, strict=True):
                place[a + np.random.default_rng(seed + 1009 * int(k[a])).permutation(m)] = np.arange(m)
            yield from t.append_column("seed", pa.array(np.full(len(n), seed, np.int32))).append_column(TIE, pa.array(place)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(kept.index("_n")).to_numpy()
            cut = int(np.searchsorted(n, n[-1]))
            if held and held[0].column(kept.index("_n"))[0].as_py() != n[-1] or cut:
                yield from tied(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from tied(pa.Table.from_batches(held))

    types = T.StructType([*rows.schema.fields]).add("seed", "integer").add(TIE, "long")
    return rows.mapInArrow(run, types).drop("_n", "_k")


def rank_random(cands: DataFrame, seeds: Sequence[int] = (0,), tie: str = "track_id") -> DataFrame:
    """As rank, for the control random, with a column seed: numpy's permutation lists a group's rows (see seeded_ties).

    The control random of `rank` without these ties goes by digests and needs no whole group in one task.
    """
    slim = cands.select(*GROUP, *dict.fromkeys(["track_id", tie]), "label", *(["_row_ord"] if "_row_ord" in cands.columns else []))
    return rank(seeded_ties(slim, seeds, tie=tie), ["random"], tie=TIE, by=["seed"], rows=slim.count() * len(seeds)).drop(TIE)


def seeded_control_suite(cands: DataFrame, score_delta: float, log_area_delta: float, controls: Sequence[str] = ("random", *CONTROLS), seeds: Sequence[int] = (0, 1)) -> DataFrame:
    """Summaries of the controls by seed over the views of control_suite, ties going by numpy's permutation in every control; groups are numbered anew in each view."""
    tied = seeded_ties(viewed(with_frequency(cands), score_delta, log_area_delta), seeds, by=["view"])
    return summarize(group_metrics(rank(tied, controls, tie=TIE, by=["view", "seed"], rows=cands.count() * len(seeds) * len(VIEWS)), "view", "seed"), "control", "seed", "view")


def random_control_suite(cands: DataFrame, score_delta: float, log_area_delta: float, seeds: Sequence[int] = (0, 1)) -> DataFrame:
    """The control random of seeded_control_suite."""
    return seeded_control_suite(cands, score_delta, log_area_delta, ("random",), seeds)


def calibration(cands: DataFrame, logit: str, *by: str) -> DataFrame:
    """NLL, Brier score and expected calibration error (ten bins) of labeled candidates: one row, or one for each value of `by`."""
    p = sigmoid(F.col(logit))
    s = cands.where("label is not null").select(*by, p.alias("p"), (F.col("label") == 0).cast("double").alias("y"))
    s = s.withColumn("bin", calibration_bin(F.col("p")))
    eps = 1e-8
    loss = -(F.col("y") * F.log(F.col("p") + eps) + (1 - F.col("y")) * F.log(1 - F.col("p") + eps))
    bins = s.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum(loss).alias("l"), F.sum((F.col("p") - F.col("y")) ** 2).alias("b"), F.abs(F.sum(F.col("p") - F.col("y"))).alias("e"))
    return bins.groupBy(*by).agg(F.sum("n").alias("labeled"), F.round(F.sum("l") / F.sum("n"), 6).alias("nll"), F.round(F.sum("b") / F.sum("n"), 6).alias("brier"), F.round(F.sum("e") / F.sum("n"), 6).alias("ece"))


#: Ten equal bins, closed on the left, the last on both sides.
EDGES = [float(x) for x in np.linspace(0, 1, 11)]


def calibration_bin(p: Column) -> Column:
    out = F.lit(9)
    for i in range(8, -1, -1):
        out = F.when(p < EDGES[i + 1], i).otherwise(out)
    return out


def reliability(cands: DataFrame, logit: str) -> DataFrame:
    """All ten bins with count, mean probability and positive share, null where empty."""
    s = cands.where("label is not null").select(sigmoid(F.col(logit)).alias("p"), (F.col("label") == 0).cast("double").alias("y"))
    got = s.groupBy(calibration_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("positive_share"))
    every = cands.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_p", "positive_share")


def paired_differences(left: DataFrame, right: DataFrame, metric: str) -> DataFrame:
    """Per group both metrics and their difference; groups with a null on either side go."""
    a = left.select(*GROUP, F.col(metric).alias("left_value"))
    b = right.select(*GROUP, F.col(metric).alias("right_value"))
    return on_groups(a, b, GROUP).where("left_value is not null and right_value is not null").withColumn("difference", F.col("left_value") - F.col("right_value"))


#: Modulus of the draws, and the ends of a Poisson(1) count's cumulative shares of it.
PRIME = 2**31 - 1
POISSON = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * PRIME) for k in range(10)]


def _hash48(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:12], 16)


def paired_bootstrap(diffs: DataFrame, samples: int = 10000, seed: int = 0, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference with a percentile interval; a row for each value of `by`, of which there must be few.

    Each group's weight in each resample is a Poisson(1) draw: (a * h + b) modulo PRIME, with h from the digest of the
    group's key and a, b from that of the seed and the resample, so draws of two groups are independent and any engine
    can repeat them. Resampling runs where the groups are and only sums by sample travel; the interval is that of the
    classic bootstrap for many groups, but not draw for draw. No differences give no row (one without `by`: nulls).
    """
    if samples < 1 or not 0 < confidence < 1:
        raise ValueError("samples must be 1 or more and confidence between 0 and 1")
    a = np.array([1 + _hash48(f"a|{seed}|{s}") % (PRIME - 1) for s in range(samples)], np.int64)
    b = np.array([_hash48(f"b|{seed}|{s}") % PRIME for s in range(samples)], np.int64)
    ends, by = np.array(POISSON, np.int32), list(by)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}  # a row of sums for each value of `by`
        n, total = np.zeros((0, samples)), np.zeros((0, samples))
        for batch in batches:
            own = pa.table({"k": pa.nulls(batch.num_rows)} if not by else {c: batch.column(c) for c in by}).combine_chunks()
            codes = np.zeros(batch.num_rows, np.int64)
            for c in own.columns:
                told = c.dictionary_encode(null_encoding="encode").combine_chunks()
                codes = np.unique(codes * (len(told.dictionary) + 1) + told.indices.to_numpy(), return_inverse=True)[1]
            _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
            to = [place.setdefault(tuple(r.values()) if by else (), len(place)) for r in own.take(pa.array(first)).to_pylist()]
            if len(place) > len(n):
                n, total = (np.vstack([x, np.zeros((len(place) - len(x), samples))]) for x in (n, total))
            h, which = np.unique(batch.column("h").to_numpy(), return_inverse=True)
            rows = np.array(to)[codes]
            d = batch.column("difference").to_numpy(zero_copy_only=False)
            order = np.argsort(which, kind="stable")
            starts = np.searchsorted(which[order], np.arange(0, len(h) + 64, 64))
            for k, i in enumerate(range(0, len(h), 64)):  # a group's draws serve all of its differences
                at = order[starts[k] : starts[k + 1]]
                cells = rows[at] * 64 + which[at] - i
                w = weights(h[i : i + 64])
                for sums, v in ((n, None), (total, d[at])):
                    sums += (np.bincount(cells, v, 64 * len(n)).reshape(len(n), 64)[:, : len(w)]) @ w
        for key, k in place.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * samples, t.type) for v, t in zip(key, own.schema, strict=False)], pa.array(np.arange(samples)), pa.array(n[k]), pa.array(total[k])], [*by, "sample", "n", "total"])

    def weights(h: np.ndarray) -> np.ndarray:
        """Draws of groups (rows) in all resamples: the residue modulo PRIME = 2**31 - 1 by two folds, then the ends it reaches."""
        u = a[None, :] * h[:, None] + b[None, :]
        u = (u & PRIME) + (u >> 31)
        u = (u & PRIME) + (u >> 31)
        u[u == PRIME] = 0
        u = u.astype(np.int32)
        w = np.zeros(u.shape, np.int8)
        for e in ends:
            w += u >= e
        return w.astype(np.float64)

    kinds = dict(diffs.dtypes)
    own = "".join(f"`{c}` {kinds[c]}, " for c in by)
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in GROUP]), 256), 1, 12), 16, 10).cast("long") % PRIME
    # Few bytes, but much work for each: more tasks than bytes alone would ask for, and a group's rows in one.
    tasks = 2 * diffs.sparkSession.sparkContext.defaultParallelism
    spread = diffs.select(*by, h.alias("h"), "difference").repartition(tasks, "h").sortWithinPartitions("h")
    parts = spread.mapInArrow(draw, own + "sample long, n double, total double")
    means = parts.groupBy(*by, "sample").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("m"))
    tail = (1 - confidence) / 2
    q = lambda x: F.round(F.percentile("m", F.lit(x)), 6)
    ci = means.groupBy(*by).agg(q(tail).alias("low"), q(1 - tail).alias("high"))
    mean = diffs.groupBy(*by).agg(F.count("*").alias("groups"), F.round(F.avg("difference"), 6).alias("mean_difference"))
    return mean.join(ci, by) if by else mean.crossJoin(F.broadcast(ci))  # one row each


def paired_metric_bootstrap(left: DataFrame, right: DataFrame, metric: str, **options) -> DataFrame:
    """paired_bootstrap of a metric over the groups of both tables: one row, with the shared groups and those without a null.

    Where a table has a group more than once, the row with the largest `_row_ord`, if it has such a column, counts.
    """
    def once(df: DataFrame) -> DataFrame:
        return df.groupBy(*GROUP).agg(F.max_by(metric, "_row_ord").alias(metric)) if "_row_ord" in df.columns else df

    a, b = once(left), once(right)
    shared = on_groups(a.select(*GROUP), b.select(*GROUP), GROUP).agg(F.count("*").alias("shared_groups"))
    return paired_bootstrap(paired_differences(a, b, metric), **options).crossJoin(F.broadcast(shared))  # one row each


def compare_seeds(metrics: DataFrame, models: Sequence[str], baselines: Sequence[str], names: Sequence[str], **options) -> DataFrame:
    """paired_bootstrap of each model against each baseline by split, metric and seed, in one pass.

    metrics: (seed, split, model, group key..., one column for each of names).
    """
    names = list(names)
    known = metrics.where(F.col("model").isin([*models, *baselines]))
    rows = known.groupBy("seed", "split", *GROUP).agg(F.collect_list(F.struct("model", *names)).alias("_r"))  # a row a model
    side = lambda them, c: F.explode(F.filter("_r", lambda x: x["model"].isin(list(them)))).alias(c)
    pairs = rows.select("seed", "split", *GROUP, "_r", side(models, "_a")).select("seed", "split", *GROUP, "_a", side(baselines, "_b"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), (F.col("_a")[n] - F.col("_b")[n]).alias("difference")) for n in names]))
    diffs = pairs.select("seed", "split", *GROUP, F.col("_a.model").alias("model"), F.col("_b.model").alias("baseline"), each.alias("_d")).select("seed", "split", *GROUP, "model", "baseline", "_d.*").where("difference is not null")
    return paired_bootstrap(diffs, by=["model", "baseline", "split", "metric", "seed"], **options)
