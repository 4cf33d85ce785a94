"""The strict export of a source's groups as prompt-expanded baseline rows, and the joins that feed a scorer."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.scalars import box_features, group_seed, metadata_features, unit_vector
from ..plans.base import GROUP
from ..sources.readers import camera_entry
from .pool import source_group_problems, zip_labels

TRACK = ("log_id", "timestamp_ns", "track_id")


def checked(ok: Column, value: Column, what: str, *named: str) -> Column:
    """value where ok holds, else an error that names the row."""
    said = F.concat_ws(" ", F.lit(what), *[F.col(c).cast("string") for c in named])
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(said))


def enrich(rows: DataFrame, index: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Rows with raw_tracker_label of a tracker index (TRACK, label, name, score).

    A row without an entry, of another name or with a score farther away than the tolerance is an error.
    """
    i = index.select(*TRACK, F.col("label").alias("_label"), F.col("name").alias("_name"), F.col("score").alias("_score"), F.lit(True).alias("_there"))
    j = rows.join(i, list(TRACK), "left")
    label = checked(F.abs(F.col("score") - F.col("_score")) <= tolerance, F.col("_label"), "tracker and source scores differ:", *TRACK)
    label = checked(F.col("name") == F.col("_name"), label, "tracker and source names differ:", *TRACK)
    label = checked(F.col("_there"), label, "no tracker row for", *TRACK)
    return j.withColumn("raw_tracker_label", label).drop("_label", "_name", "_score", "_there")


def checked_groups(rows: DataFrame, groups: DataFrame, on: Sequence[str], order: str, fields: list[str]) -> DataFrame:
    """groups, or an error if one occurs twice or does not fit its pool rows (see source_group_problems)."""
    again = groups.groupBy(*GROUP).count().where("count > 1").limit(1).collect()
    bad = source_group_problems(rows, groups, list(on), order, fields, ["prompt"]).limit(1).collect()
    if again or bad:
        raise ValueError(f"duplicate source group: {again[0].asDict()}" if again else f"{bad[0]['problem']}: {bad[0].asDict()}")
    return groups


def export_rows(rows: DataFrame, groups: DataFrame, poses: DataFrame, index: DataFrame, camera: str, seed: int = 0, fields: Sequence[str] = ("track_id", "name"), shuffle: str = "digest") -> DataFrame:
    """Baseline rows of a source, with `position`, the seeded place of a row within its group.

    rows: (TRACK, name, score, translation_m, camera_projections: a JSON list, ...); groups: (GROUP, labels, candidate_count,
    digest over fields, split, ...); poses: (log_id, timestamp_ns, qw..qz, tx..tz). What the export must not get past is an
    error: groups that do not fit, rows without pose, tracker row or image. Geometry is worked out on the pool, before prompts
    multiply it. The order is numpy's permutation by the group's seed, or (shuffle "digest") that of digests, which needs no
    group in one task.
    """
    on = ["log_id", "timestamp_ns"]
    groups = checked_groups(rows, groups, on, "track_id", list(fields))
    posed = rows.join(poses.withColumn("_pose", F.lit(True)), on, "left")
    c = lambda *n: tuple(F.col(x) for x in n)
    city = tuple(F.get("translation_m", i) for i in range(3))
    ego = geo.to_ego(geo.rotation(*c("qw", "qx", "qy", "qz")), c("tx", "ty", "tz"), city)
    place = checked(F.col("_pose"), F.array(*ego), "no pose for", *TRACK)
    made = enrich(camera_entry(posed, "camera_projections", camera), index)
    made = made.withColumns({
        "city_translation_m": F.col("translation_m"), "translation_m": place, "camera_name": F.lit(camera), "projected_box": F.col("entry.box"), "image_path": F.col("entry.image_path"),
        "camera_timestamp_ns": F.col("entry.image_timestamp_ns"), "camera_delta_ns": F.col("entry.timestamp_delta_ns"),
    }).drop("entry", "camera_projections", "_pose", "qw", "qx", "qy", "qz", "tx", "ty", "tz")
    out = zip_labels(made, groups.drop("digest", "candidate_count"), on, "track_id")
    out = out.withColumns({"source_label": F.col("label"), "match_status": F.when(F.col("label").isNull(), "UNKNOWN").otherwise("MATCHED_ANNOTATED"), "match_distance_m": F.lit(None).cast("double")})
    if shuffle == "digest":
        h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(x).cast("string") for x in (*GROUP, "track_id")]), 256)
        return out.withColumn("position", F.row_number().over(Window.partitionBy(*GROUP).orderBy(h, "track_id")) - 1)
    return out.withColumn("position", _numpy_place(group_seed(seed, *[F.col(x) for x in GROUP]), F.count("*").over(Window.partitionBy(*GROUP)), F.row_number().over(Window.partitionBy(*GROUP).orderBy("track_id")) - 1))


def _numpy_place(seed: Column, n: Column, at: Column) -> Column:
    """Where numpy's permutation by a seed puts the at-th of n; only numbers reach Python, in Arrow batches."""
    @F.pandas_udf("int")
    def place(seed: pd.Series, n: pd.Series, at: pd.Series) -> pd.Series:
        made: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for s, k, i in zip(seed, n, at, strict=True):
            if (s, k) not in made:
                made = {(s, k): np.argsort(np.random.default_rng(int(s)).permutation(int(k)))}  # rows of a group come together
            out.append(made[s, k][i])
        return pd.Series(out, dtype="int32")

    return place(seed, n, at)


def lookup(rows: DataFrame, features: DataFrame, key: str, feature: str) -> DataFrame:
    """rows with a unit-length feature vector by key; a key that the features lack is an error."""
    f = features.select(F.col(key).alias("_k"), unit_vector(F.col(feature)).alias(f"_{feature}"))
    j = rows.join(f, F.col(key) == F.col("_k"), "left")
    return j.withColumn(feature, checked(F.col("_k").isNotNull(), F.col(f"_{feature}"), f"no {feature} for", key)).drop("_k", f"_{feature}")


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """(column, id) of the values in training rows, from 1 in their order; 0 is left for unknown values."""
    ranked = rows.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    return ranked.withColumn("id", F.row_number().over(Window.orderBy(column)))  # as long as the vocabulary


def build_inputs(rows: DataFrame, categories: DataFrame, prompts: DataFrame, images: DataFrame, texts: DataFrame, width: float, height: float) -> DataFrame:
    """Scorer inputs of rows: candidate (12 numbers), metadata (3), category and prompt ids, image and text vectors.

    Vocabularies are those of `vocabulary` over training rows; images (image_path, image) and texts (prompt, text) must hold
    every row's key.
    """
    c = categories.select(F.col("raw_tracker_label").alias("_c"), F.col("id").alias("category"))
    p = prompts.select(F.col("prompt").alias("_p"), F.col("id").alias("prompt_id"))
    out = rows.join(c, F.col("raw_tracker_label").cast("string") == F.col("_c"), "left").join(p, F.col("prompt") == F.col("_p"), "left").drop("_c", "_p")
    out = lookup(lookup(out, images, "image_path", "image"), texts, "prompt", "text")
    box = box_features(F.col("projected_box"), F.lit(width), F.lit(height), F.col("distance_m"), F.col("size"), F.col("translation_m"))
    meta = metadata_features(F.col("score"), F.col("raw_tracker_label"), F.col("distance_m"))
    return out.withColumns({"candidate": box, "metadata": meta, "category": F.coalesce("category", F.lit(0)), "prompt_id": F.coalesce("prompt_id", F.lit(0))})


def single_image_size(images: DataFrame) -> DataFrame:
    """The one (width, height) of a table of images; several, or none, are an error."""
    one = images.agg(F.count_distinct("width", "height").alias("n"), F.first("width", True).alias("width"), F.first("height", True).alias("height"))
    ok = F.col("n") == 1
    return one.select(checked(ok, F.col("width"), "sizes of images:", "n").alias("width"), F.col("height"))


def sample_groups(keys: DataFrame, count: int, seed: int) -> DataFrame:
    """The first `count` groups of numpy's permutation of the keys in order (log_id, prompt as text, timestamp_ns).

    Keys are numbered in ranges; only the permutation's first numbers, at most `count`, leave the driver.
    """
    if count < 1:
        raise ValueError("count must be 1 or more")
    from .ranking import numbered

    n = keys.count()
    chosen = np.random.default_rng(seed).permutation(n)[:count]
    spark: SparkSession = keys.sparkSession
    wanted = spark.createDataFrame([(int(g), i) for i, g in enumerate(chosen)], "_g long, place int")
    return numbered(keys).join(wanted, "_g").drop("_g")


#: Rounds of the keyed permutation.
FEISTEL_ROUNDS = 6


def _round_keys(seed: int) -> list[tuple[int, int]]:
    """A summand and an odd factor below 2^30 for each round, from digests of the seed."""
    h = [int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:15], 16) for i in range(FEISTEL_ROUNDS)]
    return [(x % 2**30, (x >> 30) % 2**29 * 2 + 1) for x in h]


def half_bits(n: int) -> int:
    """Bits of either half, so that both hold n numbers."""
    if n > 2**62:
        raise ValueError("more than 2^62 numbers")
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _scrambled(half: Column, key: tuple[int, int], bits: int) -> Column:
    x = (half + F.lit(key[0])) * F.lit(key[1]) % F.lit(2**31 - 1)
    return x.bitwiseXOR(F.shiftright(x, 15)).bitwiseAND(F.lit(2**bits - 1))


def permuted(number: Column, seed: int, bits: int, inverse: bool = False) -> Column:
    """A keyed permutation of [0, 4^bits) as arithmetic on columns: a Feistel network, or its inverse.

    Each round swaps the halves and adds (without carry) a function of one to the other, so it can be undone; any number's
    place, and any place's number, come of it alone.
    """
    left, right = F.shiftright(number.cast("long"), bits), number.cast("long").bitwiseAND(F.lit(2**bits - 1))
    for key in reversed(_round_keys(seed)) if inverse else _round_keys(seed):
        if inverse:
            left, right = right.bitwiseXOR(_scrambled(left, key, bits)), left
        else:
            left, right = right, left.bitwiseXOR(_scrambled(right, key, bits))
    return F.shiftleft(left, bits) + right


def permuted_sql(number: str, seed: int, half: str) -> str:
    """permuted for the oracle queries as a chain of common table expressions p0 ... over a table with number; half: 2^bits."""
    steps = [f"p0 AS (SELECT *, {number} // {half} AS l, {number} % {half} AS r FROM numbered)"]
    for i, (c, m) in enumerate(_round_keys(seed)):
        steps.append(f"q{i} AS (SELECT *, ((r + {c}) * {m}) % {2**31 - 1} AS x FROM p{i})")
        steps.append(f"p{i + 1} AS (SELECT * EXCLUDE (l, r, x), r AS l, xor(l, xor(x, x >> 15) & ({half} - 1)) AS r FROM q{i})")
    return ", ".join(steps)


def sample_groups_keyed(keys: DataFrame, count: int, seed: int) -> DataFrame:
    """The first `count` groups of a keyed permutation of the keys in order, with place, from 0; fewer if there are fewer.

    The order is that of `permuted` over the groups' numbers. Places are turned back into numbers, so only those that
    are asked for (of about four, one is a group's) are ever made, whatever the number of groups.
    """
    if count < 1:
        raise ValueError("count must be 1 or more")
    from .ranking import numbered

    n, spark = keys.count(), keys.sparkSession
    bits = half_bits(n)
    tried = 4 * count + 64
    while True:
        k = spark.range(min(tried, 4**bits)).select(F.col("id").alias("_k"), permuted(F.col("id"), seed, bits, inverse=True).alias("_w")).where(F.col("_w") < n)
        if tried >= 4**bits or k.count() >= count:
            break
        tried *= 2
    first = k.orderBy("_k").limit(count)
    chosen = first.withColumn("place", F.row_number().over(Window.orderBy("_k")) - 1)  # as many as are asked for
    return numbered(keys).join(chosen, F.col("_g") == F.col("_w")).drop("_g", "_w", "_k")


def epoch_order(rows: DataFrame, seed: int, epoch: int, *key: str) -> DataFrame:
    """rows with `place`, a shuffled order of one epoch that seed and epoch fix, by digests of the key."""
    h = F.sha2(F.concat_ws("|", F.lit(f"{seed}|{epoch}"), *[F.col(c).cast("string") for c in key]), 256)
    return rows.withColumn("place", h)
