"""Exact quantiles of many columns at once, by narrowing histograms over all of them.

`percentile` keeps every distinct value of a group in one task. Here each wanted rank keeps an interval that holds it; a
round counts the values of all intervals in BINS bins each, with partial sums, and goes on with the bin that holds the
rank, whose least and largest value are the next interval. A few numbers a rank move, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _checkpoint

BINS = 256

#: Intervals that are broadcast to the values; more of them are merged with the values by group.
BROADCAST_ROWS = 20_000


def on_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns that may be null, with the left ones kept."""
    there = right.select(*[F.col(f"`{c}`").alias(f"_on_{c}") for c in by], *[c for c in right.columns if c not in by])
    if not by:
        return left.join(there, how=how) if how != "inner" else left.crossJoin(there)
    same = F.lit(True)
    for c in by:
        same = same & left[f"`{c}`"].eqNullSafe(there[f"_on_{c}"])
    return left.join(there, same, how).drop(*[f"_on_{c}" for c in by])


def quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """A row for each group of `by`, with an array of quantiles for each column, as `percentile` gives them.

    Between two ranks the value is interpolated. Nulls do not count, infinities do, NaN is above all; a column without
    values has null. df is read once for each round and once before: write it first where it is dear.
    """
    made = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    keys, names = [f"_b{i}" for i in range(len(by))], list(made)
    slim = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(made.values())])
    inf = F.lit(float("inf"))

    def told(i: int) -> Column:
        v = F.col(f"_v{i}")
        fine = F.when(F.abs(v) < inf, v)
        return F.struct(F.lit(i).alias("c"), F.count_if(v == -inf).alias("under"), F.count(fine).alias("n"), F.count_if(v == inf).alias("over"), F.count(v).alias("all"), F.min(fine).alias("lo"), F.max(fine).alias("hi"))

    groups = slim.groupBy(*keys).agg(*[told(i).alias(f"_s{i}") for i in range(len(names))])
    groups = _checkpoint(groups.select(*keys, F.explode(F.array(*[f"_s{i}" for i in range(len(names))])).alias("s")).select(*keys, "s.*"))
    place = F.col("p.at") * (F.col("all") - 1)
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("at")) for k, p in enumerate(probs)])
    state = groups.where(F.col("all") > 0).withColumn("p", F.explode(wanted)).withColumns({"k": F.col("p.k"), "place": place})
    state = state.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    inner = F.col("rank") - F.col("under")
    value = F.when(inner < 0, -inf).when(inner >= F.col("n") + F.col("over"), F.lit(float("nan"))).when(inner >= F.col("n"), inf).when(F.col("lo") == F.col("hi"), F.col("lo"))
    state = state.select(*keys, "c", "k", "place", "rank", inner.alias("r"), "lo", "hi", F.col("n").alias("held"), value.alias("value"))
    known, live = _split(state)
    long = slim.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_v{i}").alias("v")) for i in range(len(names))])).alias("s")).select(*keys, "s.c", "s.v")
    while n := live.count():
        spans = live.select(*keys, "c", "lo", "hi", "held").distinct()
        counted = _histogram(long, F.broadcast(spans) if n <= BROADCAST_ROWS else spans.hint("merge"), keys)
        here = [*keys, "c", "lo", "hi"]
        w = Window.partitionBy(*here).orderBy("at")
        counted = counted.withColumn("upto", F.sum("bin").over(w))
        found = on_groups(live, counted, here).where("r >= upto - bin and r < upto")
        state = found.select(*keys, "c", "k", "place", "rank", (F.col("r") - F.col("upto") + F.col("bin")).alias("r"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("bin").alias("held"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("value"))
        more, live = _split(state)
        known = known.unionByName(more)
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    far = F.max("place") - F.min("rank")
    part = known.groupBy(*keys, "c", "k").agg(low.alias("a"), high.alias("b"), far.alias("f"))
    part = part.withColumn("q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("f")) * F.col("a") + F.col("f") * F.col("b")))
    rows = part.groupBy(*keys, "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))
    all_groups = groups.select(*keys, "c")
    rows = on_groups(all_groups, rows, [*keys, "c"], "left")
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("c") == i, F.col("q"))).alias(x) for i, x in enumerate(names)])
    return wide.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *names)


def _split(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    state = _checkpoint(state)
    return state.where("value is not null"), state.where("value is null")


def _histogram(long: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each interval its bins that hold values: number (or the value itself), count, least and largest value.

    Intervals of few values, and those too narrow to be cut (no more than some hundred doubles lie in them), are counted
    by value; all others get narrower in each round, as their ends fall into different bins.
    """
    both = on_groups(long.where("v is not null"), spans, [*keys, "c"]).where("v >= lo and v <= hi")
    width = F.col("hi") / (2 * BINS) - F.col("lo") / (2 * BINS)  # halves, so that no difference overflows
    bin_ = F.least(F.lit(BINS - 1.0), F.floor((F.col("v") / 2 - F.col("lo") / 2) / F.nullif(width, F.lit(0.0))).cast("double"))
    exact = (F.col("held") <= BINS) | (F.col("lo") + width == F.col("lo")) | (F.col("hi") - width == F.col("hi"))
    at = F.when(exact, F.col("v")).otherwise(bin_)
    return both.withColumn("at", at).groupBy(*keys, "c", "lo", "hi", "at").agg(F.count("*").alias("bin"), F.min("v").alias("least"), F.max("v").alias("most"))
