"""Similarity of prompts by matching blocks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp ratio of each pair, in Arrow batches."""
    return F.pandas_udf(_ratios, "double")(a, b)  # made here, as it needs a session


def ratio_pairs(prompts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ratio) of pairs of ids of a table (item_id, key)."""
    x = prompts.select(F.col("item_id").alias("a"), F.col("key").alias("ka"))
    y = prompts.select(F.col("item_id").alias("b"), F.col("key").alias("kb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", F.round(sequence_ratio("ka", "kb"), 6).alias("ratio"))
