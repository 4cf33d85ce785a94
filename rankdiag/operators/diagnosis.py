"""Whether a ranking protocol can be won by shortcuts: distributions by label, strata, flags and their composition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FEATURES, diagnosis_features, size_bin
from ..plans.base import GROUP
from . import ranking
from .audit import label_name
from .graph import _checkpoint
from .quantiles import on_groups, quantiles

#: Metrics that reports keep (fixed values).
COMPACT = ("groups", "rankable_groups", "mean_ap", "recall_at_1", "labeled_mean_ap", "labeled_recall_at_1", "mean_candidates", "mean_unknown")


#: The control category_frequency with frequencies within a log, and within a bin of candidate counts.
LOG_FREQUENCY, BIN_FREQUENCY = "log_frequency", "bin_frequency"

#: Rows up to which a log is kept together; a larger one is cut between its groups into pieces of about so many.
LOG_ROWS = 25_000


def with_features(rows: DataFrame) -> DataFrame:
    """rows (projected_box, score, distance_m, match_distance_m, size, translation_m) with their ten features and label_name."""
    f = diagnosis_features(*[F.col(c) for c in ("projected_box", "score", "distance_m", "match_distance_m", "size", "translation_m")])
    return rows.withColumns({"_f": f, "label_name": F.coalesce(label_name(F.col("label")), F.lit("UNKNOWN"))})


def label_distributions(rows: DataFrame) -> DataFrame:
    """(label_name, feature, count, missing, mean, std, min, q25, median, q75, max) of rows by label.

    Rows are read again for each round of the narrowing that finds quartiles and are never written, as their features take
    more room than they do; moments come of one pass without multiplying rows.
    """
    r = lambda c: F.round(c, 6)
    told = with_features(rows).select("label_name", *[F.col(f"_f.{n}").alias(n) for n in FEATURES])

    def summary(name: str) -> Column:
        v = F.col(name)
        parts = {"count": F.count(v), "missing": F.count("*") - F.count(v), "mean": r(F.avg(v)), "std": r(F.stddev_pop(v)), "min": r(F.min(v)), "max": r(F.max(v))}
        return F.struct(F.lit(name).alias("feature"), *[c.alias(n) for n, c in parts.items()]).alias(name)

    long = lambda wide, parts: wide.select("label_name", F.explode(F.array(*parts)).alias("s")).select("label_name", "s.*")
    moments = long(told.groupBy("label_name").agg(*[summary(n) for n in FEATURES]), FEATURES)
    cuts = long(quantiles(told, list(FEATURES), (0.25, 0.5, 0.75), ["label_name"]), [F.struct(F.lit(n).alias("feature"), F.col(n).alias("q")) for n in FEATURES])
    quartile = [r(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("q25", "median", "q75"))]
    return moments.join(cuts, ["label_name", "feature"]).select("label_name", "feature", "count", "missing", "mean", "std", "min", *quartile, "max")


def visibility(rows: DataFrame) -> DataFrame:
    """One row: how often referred rows and labeled negatives have a projected box, and the gap; null where a side is empty."""
    seen = F.coalesce(F.col("projection_status") == "PROJECTED", F.lit(False))
    rate = lambda of: F.try_divide(F.count_if(of & seen), F.count_if(of))
    p, n = F.col("label") == 0, F.col("label").isin(1, 2)
    one = rows.agg(rate(p).alias("p"), rate(n).alias("n"), F.count_if(p).alias("positive_rows"), F.count_if(n).alias("negative_rows"))
    r = lambda c: F.round(c, 6)
    return one.select(r(F.col("p")).alias("referred_visible_rate"), r(F.col("n")).alias("negative_visible_rate"), r(F.col("p") - F.col("n")).alias("visibility_gap"), "positive_rows", "negative_rows")


def control_strata(cands: DataFrame, controls: Sequence[str] = ranking.CONTROLS) -> DataFrame:
    """Summaries of controls for each log and each bin of candidate counts: (field, value, control, ...), of one ranking.

    Frequencies are those within each stratum's rows, as each stratum is ranked by itself.
    """
    return split_summaries(cands, ["control_strata"], controls=controls).drop("part", "positive_groups")


def _placed(slim: DataFrame) -> tuple[DataFrame, list[str]]:
    """slim with _bin and the frequencies of names in the table, the bin and the log; and what places a group beside its key.

    Logs stay together, so that their names are counted where their groups are ranked. A log of more than LOG_ROWS rows is
    dealt out by its groups, and its names are counted before.
    """
    size = lambda group: size_bin(F.count("*").over(Window.partitionBy(*group)))
    named = ranking.by_group(slim.select(*GROUP, "name")).select("log_id", "name", size(GROUP).alias("_bin"))
    kind = slim.schema
    none = lambda c: F.lit(None).cast(kind[c].dataType).alias(c)
    each = F.array(F.struct("_bin", "name", none("log_id")), F.struct(F.lit(None).cast("string").alias("_bin"), none("name"), "log_id"))
    counts = named.select(F.explode(each).alias("_e")).select("_e.*").groupBy("_bin", "name", "log_id").agg(F.count("*").alias("_n"))
    counts = _checkpoint(counts.where((F.col("_n") > LOG_ROWS) | F.col("_bin").isNotNull()))
    by_bin = counts.where("_bin is not null").select("_bin", "name", F.col("_n").alias("_bin_freq"), F.sum("_n").over(Window.partitionBy("name")).alias("freq"))
    large = counts.where("_bin is null").select("log_id", F.ceil(F.col("_n") / LOG_ROWS).alias("_pieces"))
    rows = by_bin.agg(F.sum("_bin_freq")).first()[0] or 0
    at, known = ["log_id"], None
    if not large.isEmpty():
        slim = on_groups(slim, F.broadcast(large), ["log_id"], "left")  # a row for each LOG_ROWS rows at most
        own = slim.where("_pieces is not null").groupBy("log_id", "name").agg(F.count("*").alias("_known"))
        piece = F.coalesce(F.pmod(F.xxhash64("prompt", "timestamp_ns"), F.col("_pieces")), F.lit(0))
        slim = ranking.with_counts(slim, own, ["log_id", "name"], "left").withColumn("_piece", piece).drop("_pieces")
        at, known = ["log_id", "_piece"], F.col("_known")
    here = F.count("*").over(Window.partitionBy(*at, "name"))
    told = ranking.by_group(slim, rows, at).withColumns({"_log_freq": here if known is None else F.coalesce(known, here), "_bin": size([*GROUP, *at[1:]])})
    return ranking.with_counts(told, by_bin, ["_bin", "name"]), at[1:]


def split_summaries(rows: DataFrame, parts: Sequence[str], score_delta: float = 0.05, log_area_delta: float = 0.2, models: Mapping[str, str] | None = None, controls: Sequence[str] = ranking.CONTROLS) -> DataFrame:
    """(part, control, field, value, positive_groups, the columns of summarize): all that the parts need of ranked groups, by one exchange of the rows.

    controls (for flags too): field is the view. control_strata: field and value are the stratum's. learned_strata: the same,
    control being the model; models names the control that ranks as each does. models: a row a model. dataset: value is the
    number of candidates that the groups have.
    """
    strata, suite = "control_strata" in parts, bool({"controls", "flags"} & set(parts))
    slim = rows.select(*GROUP, "track_id", "name", "label", *[c for c in ("score", "tracker_score", "distance_m", "area") if c in rows.columns])
    own = "category_frequency" in controls
    if strata:
        told, at = _placed(slim)
    else:
        told, at = ranking.by_group(ranking.with_frequency(slim) if own else slim).withColumn("_bin", size_bin(F.count("*").over(Window.partitionBy(*GROUP)))), []
    if suite:
        told = ranking.marked(told, score_delta, log_area_delta, at)
    keys = {c: ranking.control_key(told, c) for c in controls}
    if strata and own:
        keys |= {LOG_FREQUENCY: -F.col("_log_freq").cast("double"), BIN_FREQUENCY: -F.col("_bin_freq").cast("double")}
    metrics = ranking.view_metrics(told, keys, by=["_bin", *at])
    name, view = F.col("control"), F.col("view")
    full, text = view == ranking.VIEWS[0], lambda c: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")

    def to(part: str, control: Column | str | None = None, field: Column | str | None = None, value: Column | None = None) -> Column:
        return F.struct(F.lit(part).alias("part"), *[text(v).alias(n) for n, v in (("control", control), ("field", field), ("value", value))])

    by_log, by_bin = ("log_id", F.col("log_id")), ("candidate_count", F.col("_bin"))
    picked = []
    if suite:
        picked.append(F.when(name.isin(*controls), to("controls", name, view)))
    if strata:
        # A group is of one log and one bin, so only the frequencies rank it differently in the two.
        of = F.when(name.isin(LOG_FREQUENCY, BIN_FREQUENCY), "category_frequency").otherwise(name)
        picked += [F.when(full & ~name.isin("category_frequency", other), to("control_strata", of, *by)) for other, by in ((BIN_FREQUENCY, by_log), (LOG_FREQUENCY, by_bin))]
    for model, control in (models or {}).items():
        same = full & (name == control)
        picked.append(F.when(same, to("models", model)))
        picked += [F.when(same, to("learned_strata", model, *by)) for by in (by_log, by_bin)] if "learned_strata" in parts else []
    if "dataset" in parts:
        picked.append(F.when(full & (name == controls[0]), to("dataset", value=F.col("candidate_count"))))
    long = metrics.withColumn("_p", F.explode(F.array_compact(F.array(*picked)))).select("_p.*", *ranking.METRICS)
    return ranking.summarize(long, "part", "control", "field", "value", more=[F.count_if(F.col("positive_count") > 0).alias("positive_groups")])


def learned_strata(metrics: DataFrame) -> DataFrame:
    """Summaries of learned models by log and by bin of candidate counts, of per-group metrics with a column model."""
    pick = F.array(F.struct(F.lit("log_id").alias("field"), F.col("log_id").alias("value")), F.struct(F.lit("candidate_count").alias("field"), size_bin(F.col("candidate_count")).alias("value")))
    long = metrics.withColumn("_f", F.explode(pick)).withColumns({"field": F.col("_f.field"), "value": F.col("_f.value")})
    return ranking.summarize(long, "model", "field", "value")


def compact(summaries: DataFrame, *by: str) -> DataFrame:
    """The keys of `by` and the metrics that reports keep."""
    return summaries.select(*by, *[c for c in COMPACT if c in summaries.columns])


def shortcut_flags(rows: DataFrame, controls: DataFrame, model_map: Column | float, gap: float = 0.10, ratio: float = 1.5, margin: float = 0.03) -> DataFrame:
    """One row: visibility gap, ratio of median areas, the controls that beat the model, and the reasons in order.

    rows: as for label_distributions, with projection_status. controls: (view, control, mean_ap) of a control suite. The
    ratio is that of the referred rows' median area to the mean of the two negative labels' medians that are above 0. The
    oracle is no control.
    """
    model = F.lit(model_map) if isinstance(model_map, float) else model_map
    told = with_features(rows).select("label_name", F.col("_f.projected_area_px").alias("area"))  # cheaper read again than written
    sides = {"p": "REFERRED_OBJECT", "a": "RELATED_OBJECT", "b": "OTHER_OBJECT"}
    m = quantiles(told, {k: F.when(F.col("label_name") == n, F.col("area")) for k, n in sides.items()}, (0.5,)).select(*[F.get(k, F.lit(0)).alias(k) for k in sides])
    own = lambda c: F.when(F.col(c) > 0, F.col(c))
    known = F.filter(F.array(own("a"), own("b")), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))
    areas = m.select(F.round(F.try_divide(F.col("p"), mean), 6).alias("area_ratio"))
    rival = controls.where("control <> 'oracle' and mean_ap is not null")
    full, sized = F.col("view") == "full", F.col("view") == "score_size_matched"
    beaten = rival.agg(
        F.array_sort(F.collect_list(F.when(full & (F.col("mean_ap") - model >= margin), F.col("control")))).alias("dominant_controls"),
        F.max(F.when(sized, F.col("mean_ap"))).alias("strongest_size_matched"),
    ).withColumn("model_map", model)
    one = visibility(rows).crossJoin(areas).crossJoin(beaten)  # one row each
    flags = {
        "visibility_gap_flag": F.coalesce(F.col("visibility_gap") >= gap, F.lit(False)),
        "area_ratio_flag": F.coalesce(F.col("area_ratio") >= ratio, F.lit(False)),
        "control_dominance_flag": F.size("dominant_controls") > 0,
        "size_matched_flag": F.coalesce(F.col("strongest_size_matched") - F.col("model_map") >= margin, F.lit(False)),
    }
    names = ("visibility_gap", "area_ratio", "control_dominance", "size_matched_dominance")
    reasons = F.filter(F.array(*[F.when(F.col(f), n) for f, n in zip(flags, names, strict=True)]), lambda x: x.isNotNull())
    return one.withColumns(flags).withColumn("reasons", reasons)


PARTS = ("dataset", "features", "controls", "control_strata", "learned_strata", "flags")


def diagnose_split(rows: DataFrame, models: DataFrame | Mapping[str, str], score_delta: float = 0.05, log_area_delta: float = 0.2, parts: Sequence[str] = PARTS, **thresholds: float) -> dict[str, DataFrame]:
    """The parts of one split's diagnosis that are asked for: dataset, features, controls, control_strata, learned_strata and flags.

    models: per-group metrics of learned models with a column model, or models by name with the control that ranks as each
    does; the flags compare with the model `pooled`. Rows move once for all parts that need whole groups (and their names
    once more for control_strata), and only summaries are written. The other parts read rows anew: write them first where
    they are dear.
    """
    named = models if isinstance(models, Mapping) else {}
    learned = None if isinstance(models, Mapping) else _checkpoint(models)  # a row a group and model, which two parts read
    ranked = {"dataset", "controls", "control_strata", "flags", *(["learned_strata"] if named else [])} & set(parts)
    told = _checkpoint(split_summaries(rows, parts, score_delta, log_area_delta, named)) if ranked else None
    of = lambda part: told.where(F.col("part") == part)
    controls = lambda: of("controls").withColumnRenamed("field", "view")

    def flags() -> DataFrame:
        pooled = (of("models").where("control = 'pooled'") if learned is None else ranking.summarize(learned.where("model = 'pooled'"))).first()
        best = float(pooled["mean_ap"]) if pooled and pooled["mean_ap"] is not None else F.lit(None).cast("double")
        return shortcut_flags(rows, controls(), best, **thresholds)

    made = {
        "dataset": lambda: _of_sizes(of("dataset").withColumn("n", F.col("value").cast("long")), rows),
        "features": lambda: label_distributions(rows),
        "controls": lambda: compact(controls(), "view", "control"),
        "control_strata": lambda: compact(of("control_strata"), "field", "value", "control"),
        "learned_strata": lambda: compact(of("learned_strata").withColumnRenamed("control", "model") if learned is None else learned_strata(learned), "model", "field", "value"),
        "flags": flags,
    }
    return {p: made[p]() for p in parts}


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts of a split's diagnosis as one table: part, key (its text columns, joined by |), metric, value as text."""
    out = None
    for name, df in parts.items():
        kinds = dict(df.dtypes)
        keys = [] if name in ("dataset", "flags") else [c for c, k in kinds.items() if k == "string"]
        text = lambda c: F.concat_ws(",", c) if kinds[c].startswith("array") else F.col(c).cast("string")
        values = F.array(*[F.struct(F.lit(c).alias("metric"), text(c).alias("value")) for c in df.columns if c not in keys])
        key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in sorted(keys)])
        one = df.select(F.lit(name).alias("part"), key.alias("key"), F.explode(values).alias("v")).select("part", "key", "v.*")
        out = one if out is None else out.unionByName(one)
    return out


def group_summary(rows: DataFrame) -> DataFrame:
    """One row: groups, rankable and positive ones, their rates, candidate counts, rows by label and the share of unknown rows."""
    g = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("p"), F.count_if(F.col("label").isin(1, 2)).alias("q"))
    pos = F.col("p") > 0
    return _of_sizes(g.groupBy("n").agg(F.count("*").alias("groups"), F.count_if(pos & (F.col("q") > 0)).alias("rankable_groups"), F.count_if(pos).alias("positive_groups")), rows)


def _of_sizes(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """group_summary of the number of groups (all, rankable, positive) of each size n, and the rows' labels.

    Sizes that differ are few: n of them have n * (n + 1) / 2 rows at least.
    """
    r = lambda c: F.round(c, 6)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    rate = lambda c: r(F.try_divide(F.sum(c), F.sum("groups")))
    in_all = F.col("n") * F.col("groups")
    one = sizes.agg(
        *[total(c).alias(c) for c in ("groups", "rankable_groups", "positive_groups")], rate("positive_groups").alias("oracle_coverage"), rate("rankable_groups").alias("rankable_rate"),
        rate(in_all).alias("mean_candidates"), F.min("n").alias("least_candidates"), F.max("n").alias("most_candidates"), F.percentile("n", [0.25, 0.5, 0.75], F.col("groups")).alias("_q"),
    )
    known = [F.count_if(F.col("label") == k) for k in range(3)]
    labels = rows.agg(F.count("*").alias("rows"), *[c.alias(n) for c, n in zip(known, ("referred", "related", "other"), strict=True)])
    labels = labels.withColumn("unknown", F.col("rows") - F.col("referred") - F.col("related") - F.col("other")).withColumn("unknown_rate", r(F.try_divide("unknown", "rows")))
    cuts = [r(F.get("_q", F.lit(i))).alias(f"{x}_candidates") for i, x in enumerate(("q25", "median", "q75"))]
    return one.crossJoin(F.broadcast(labels)).select(*[c for c in one.columns if c != "_q"], *labels.columns, *cuts)  # one row each
