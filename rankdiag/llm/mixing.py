"""Mixing sources to target weights by the cube method.

Targets. Sources in code point order, null last, weigh 5, 2, 1, repeating. They share `share` times the total size in
proportion to their weights; a target stops at `most` times its source's size and the excess goes to the others by
weight until none is above. That is the water level L with sum(min(weight * L, cap)) equal to the total.

Sampling. A source with target t and size s takes each document floor(t / s) times, and once more with probability
pi = t / s - floor(t / s). The cube method draws those extras: the vector of probabilities moves along the null
space of the constraints (documents, tokens), so both totals keep their expected values, until each coordinate is 0
or 1. The flight runs in blocks of about BLOCK documents of a source, each of which leaves at most two undecided
units; these are gathered and fly again until a source has at most two, and the landing picks the choice of these
that comes nearest to the target. Every step of the flight moves along the exact null vector of three units, so a
source misses its target by two documents at most, besides rounding.

Large documents fly first, so that those left for the landing are small.

Determinism. Order and coin tosses come from hashes of id, size and seed, never from partitions; repeated rows are
ordered arbitrarily among themselves but are alike, so reruns agree as sets of rows.

Null and empty texts have size 0 and are taken 0 words. A source without words has target 0. A null source is a
source of its own. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, words

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 2_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with a row for each source.

    The table is as long as there are sources; its windows run in one task over those few rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_k", (F.row_number().over(order) - 1) % len(weights))
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_k") + 1)).withColumn("_cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_rest": F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)), "_all": share * F.sum("source_size").over(whole)})
    level = (F.col("_all") - F.col("_full")) / F.col("_rest")  # the level if this and all later sources are under their caps
    s = s.withColumn("_level", F.when(F.col("_cap") > F.col("_w") * level, level))
    s = s.withColumn("_level", F.max("_level").over(whole))  # the first in this order: later ones are lower
    return s.select("source", "source_size", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_level"))).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move pi until at most two coordinates lie strictly between 0 and 1, keeping the sums of pi and of pi * size."""
    pi = pi.astype(float).copy()
    eps = 1e-12
    open_ = [i for i in range(len(pi)) if eps < pi[i] < 1 - eps]
    toss = rng.random(len(open_) + 1)
    held: list[int] = []
    t = 0
    scale = max(1.0, float(np.mean(size)) if len(size) else 1.0)
    x = (size / scale).tolist()
    p = pi.tolist()
    for i in open_:
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            # The null vector of [[1, 1, 1], [x_a, x_b, x_c]]; if all sizes agree, any move that keeps the sum.
            v = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if not (v[0] or v[1] or v[2]):
                v = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(held, v, strict=True) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(held, v, strict=True) if d)
            step = up if toss[t] * (up + down) < down else -down
            t += 1
            for k, d in zip(held, v, strict=True):
                p[k] = min(1.0, max(0.0, p[k] + step * d))
            left = [k for k in held if eps < p[k] < 1 - eps]
            if len(left) == 3:  # rounding: settle the nearest
                k = min(left, key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                left.remove(k)
            for k in held:
                if k not in left:
                    p[k] = float(round(p[k]))
            held = left
            if t >= len(toss):
                toss, t = rng.random(len(toss)), 0
    out = np.array(p)
    near = (out <= eps) | (out >= 1 - eps)
    out[near] = np.round(out[near])
    return out


def landing(pi: np.ndarray, size: np.ndarray, short: float) -> np.ndarray:
    """Of the ways to settle at most two units, the one whose words come nearest to `short`."""
    best = min(((abs(short - sum(s for s, bit in zip(size, bits, strict=True) if bit)), bits) for bits in ((a, b)[: len(pi)] for a in (0, 1) for b in (0, 1))), default=(0, ()))
    return np.array(best[1], float)


FLOWN = "doc_id long, key long, source string, size long, source_size long, target double, copies int, pi double"


def _fly(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_order", "doc_id"], ascending=[False, True, True], kind="stable")  # so that small ones are left for the landing
        first = int(pdf["_order"].iloc[0]) & 0xFFFFFFFF
        pdf["pi"] = flight(pdf["pi"].to_numpy(), pdf["size"].to_numpy(float), np.random.default_rng([seed, first]))
        return pdf[[c.split()[0] for c in FLOWN.split(", ")]]

    return run


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_order", "doc_id", "size"], kind="stable")
    pdf["pi"] = landing(pdf["pi"].to_numpy(), pdf["size"].to_numpy(float), float(pdf["_short"].iloc[0]))
    return pdf[[c.split()[0] for c in FLOWN.split(", ")]]


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 8, block: int = BLOCK, text: str = "text") -> DataFrame:
    """A row for each of docs: doc_id, source, size, source_size, target, copies, taken (copies * size)."""
    sized = docs.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64("doc_id", text).alias("key"))
    sized = cut(sized, "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")).drop("_docs"), weights, share, most)
    n = sized.groupBy("source").agg(F.count_if(F.col("size") > 0).alias("_docs"))
    goal = goal.join(n, goal["source"].eqNullSafe(n["source"])).select(goal["*"], n["_docs"])
    goal = cut(goal, "targets").withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(ratio + F.lit(1e-12)).cast("int")
    part = F.greatest(F.lit(0.0), ratio - base)
    order = F.xxhash64("key", "doc_id", "size", F.lit(seed))
    all_ = sized.join(goal, sized["source"].eqNullSafe(goal["_source"])).withColumns({"copies": base, "pi": F.when((F.col("size") > 0) & (part > 1e-9), part).otherwise(F.lit(0.0)), "_order": order})
    first = all_.withColumn("_block", F.pmod("_order", F.greatest(F.lit(1), F.ceil(F.col("_docs") / block))))
    still = (F.col("pi") > 0) & (F.col("pi") < 1)
    names = [c.split()[0] for c in FLOWN.split(", ")]
    settled = [first.where(~still).select(*names)]
    round_ = first.where(still)
    for k in range(1, 20):
        flown = cut(round_.groupBy("_source", "_block").applyInPandas(_fly(seed * 100 + k), FLOWN), f"flight{k}")
        settled.append(flown.where(~still))
        left = flown.where(still).withColumn("_order", order)
        most_left = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most_left <= 2:
            break
        counts = left.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_source")
        round_ = left.join(counts, left["source"].eqNullSafe(counts["_source"])).withColumn("_block", F.pmod("_order", F.ceil(F.col("_n") / block)))
    done = settled[0]
    for x in settled[1:]:
        done = done.unionByName(x)
    taken = (F.col("size") * (F.col("copies") + F.col("pi").cast("int"))).alias("taken")
    sums = done.groupBy("source").agg(F.sum(F.col("size") * (F.col("copies") + F.col("pi"))).alias("_sum"), F.max("copies").alias("_c")).withColumnRenamed("source", "_source")
    rest = left.join(sums, left["source"].eqNullSafe(sums["_source"]), "left")
    base_left = left.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("_base")).withColumnRenamed("source", "_source2")
    rest = rest.join(base_left, rest["source"].eqNullSafe(base_left["_source2"])).withColumn("_short", F.col("target") - F.coalesce("_sum", F.lit(0.0)) - F.col("_base"))
    landed = rest.groupBy("_source2").applyInPandas(_land, FLOWN)
    return done.unionByName(landed).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.col("pi").cast("int")).alias("copies"), taken)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
