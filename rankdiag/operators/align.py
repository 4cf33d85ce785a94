"""Joins in time and space: nearest timestamp with a tolerance, grid range join, timestamp selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, tolerance: int, tie: str = "later") -> DataFrame:
    """Each left row with the right row of its key nearest in time within the tolerance (inclusive); others go.

    Times are integers. Both sides are dealt into buckets as wide as the tolerance, so a left row meets three
    buckets; a dense key is spread over its buckets and no key lands in one task. On a tie the later or the earlier
    right row wins.
    """
    width = max(1, tolerance)
    lefts = left.withColumn("_id", F.struct(*[F.col(c) for c in left.columns]))
    lefts = lefts.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(F.col(left_time) / width) + d)))
    rights = right.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(right_time).alias("_rt"), F.floor(F.col(right_time) / width).alias("_rb"), F.struct(*right.columns).alias("_right"))
    met = lefts.join(rights, [F.col(c) == F.col(f"_{c}") for c in on] + [F.col("_b") == F.col("_rb")])
    gap = F.abs(F.col(left_time) - F.col("_rt"))
    met = met.where(gap <= tolerance)
    order = F.col("_rt") if tie == "earlier" else -F.col("_rt")
    best = met.groupBy("_id").agg(F.min_by(F.col("_right"), F.struct(gap, order)).alias("match"), F.min(gap).alias("gap"))
    return best.select("_id.*", "match", "gap")


def range_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], reach: float) -> DataFrame:
    """Pairs (left, right as structs a and b) that agree in `on`, within `reach` in x and y, by cells as wide as the reach."""
    cell = lambda c: F.floor(F.col(c) / reach)
    key = F.struct(*on)
    ls = left.select(F.struct(*left.columns).alias("a"), key.alias("_on"), F.explode(F.array(*[F.struct((cell("x") + i).alias("i"), (cell("y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_c"))
    rs = right.select(F.struct(*right.columns).alias("b"), key.alias("_on2"), F.struct(cell("x").alias("i"), cell("y").alias("j")).alias("_c2"))
    met = ls.join(rs, (F.col("_on") == F.col("_on2")) & (F.col("_c") == F.col("_c2")))
    d = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    return met.withColumn("distance", d).where(F.col("distance") <= reach).select("a", "b", "distance")


def common_keys(*tables: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys that all tables have."""
    out = tables[0].select(*on).distinct()
    for t in tables[1:]:
        out = out.join(t.select(*on).distinct(), list(on), "left_semi")
    return out


def missing_keys(wanted: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    return wanted.select(*on).distinct().join(present.select(*on).distinct(), list(on), "left_anti")


def first_seen(df: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the first in a stated order, by a partial aggregate and no window."""
    rest = [c for c in df.columns if c not in on]
    best = df.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*on, "_r.*").select(*df.columns)


def time_order_violations(df: DataFrame, on: Sequence[str], time: str, order: str) -> DataFrame:
    """Keys whose times, in order of first occurrence, go back; with how often."""
    firsts = df.groupBy(*on, time).agg(F.min(order).alias("_first"))
    before = F.lag(time).over(Window.partitionBy(*on).orderBy("_first"))
    return firsts.withColumn("_back", (before > F.col(time)).cast("int")).groupBy(*on).agg(F.sum("_back").alias("violations")).where("violations > 0")


def usable_times(wanted: DataFrame, tracked: DataFrame, posed: DataFrame, cameras: DataFrame, tolerance: int) -> DataFrame:
    """(log_id, prompt, timestamp_ns) of a table of prompts' times at which tracker, pose and a camera frame (image_ns) are there.

    Labels are never looked at.
    """
    at = ["log_id", "timestamp_ns"]
    times = wanted.select("log_id", "prompt", "timestamp_ns").distinct()
    ready = times.join(tracked.select(*at).distinct(), at, "left_semi").join(posed.select(*at).distinct(), at, "left_semi")
    seen = nearest(ready.select(*at).distinct(), cameras.select("log_id", "image_ns"), ["log_id"], "timestamp_ns", "image_ns", tolerance)
    return ready.join(seen.select(*at), at, "left_semi").select("log_id", "prompt", "timestamp_ns")


def unusable_prompts(wanted: DataFrame, usable: DataFrame) -> DataFrame:
    """(log_id, prompt) without a usable time."""
    return missing_keys(wanted, usable, ["log_id", "prompt"])
