"""Nearest-in-time join over streams: an addition to the batch join with the same bounds.

Both streams carry watermarks, and the join condition bounds the time between partners, so Spark drops state that
can no longer match. A stream cannot know that a nearer partner will not come, so it returns all partners within the
tolerance with their gap; the batch join picks the nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partners(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, tolerance: str, delay: str) -> DataFrame:
    """Pairs of rows of one key at most `tolerance` apart (both are interval texts such as `10 minutes`)."""
    a = left.withWatermark(time, delay).select(*on, F.col(time).alias("left_time"), F.struct(*left.columns).alias("left_row"))
    b = right.withWatermark(time, delay).select(*[F.col(c).alias(f"_{c}") for c in on], F.col(time).alias("right_time"), F.struct(*right.columns).alias("right_row"))
    reach = F.expr(f"INTERVAL {tolerance}")
    near = (F.col("right_time") >= F.col("left_time") - reach) & (F.col("right_time") <= F.col("left_time") + reach)
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    pairs = a.join(b, [*same, near])
    gap = F.abs(F.unix_micros(F.col("right_time").cast("timestamp")) - F.unix_micros(F.col("left_time").cast("timestamp")))
    return pairs.select(*on, "left_row", "right_row", gap.alias("gap_us"))
