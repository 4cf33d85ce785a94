"""Candidate pools: filters, the ego row, digests that prove label independence, source unions and prompt expansion."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions.scalars import finite_vector, group_seed, taxonomy_group

#: Size of the observer's own box (fixed values).
EGO_SIZE = (4.877, 2.0, 1.473)


def _finite(c: Column | str) -> Column:
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def strict_pool(boxes: DataFrame, max_distance: float = 50.0, selected: DataFrame | None = None, roi: str | None = None) -> DataFrame:
    """Finite geometry and score, positive size, ego distance below the maximum.

    selected: (log_id, track_id) of a filter over whole logs, which looks ahead in time and so is never causal. roi: a
    boolean column of boxes that touch the region of interest.
    """
    keep = F.lit(True)
    for c in ("x", "y", "z", "length", "width", "height", "score"):
        keep = keep & _finite(c)
    for c in ("length", "width", "height"):
        keep = keep & (F.col(c) > 0)
    if roi:
        keep = keep & F.coalesce(F.col(roi), F.lit(False))
    if selected is not None:
        boxes = boxes.join(selected.select("log_id", "track_id").distinct(), ["log_id", "track_id"], "left_semi").select(*boxes.columns)
    return boxes.withColumn("distance_m", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).where(keep & (F.col("distance_m") < max_distance))


def loose_pool(boxes: DataFrame, classes: list[int], max_distance: float = 50.0, roi: str | None = None) -> DataFrame:
    """Supported classes with finite position and size, ego distance below the maximum; score and sign of size are not looked at."""
    keep = F.col("class").isin(classes)
    for c in ("x", "y", "z", "length", "width", "height"):
        keep = keep & _finite(c)
    if roi:
        keep = keep & F.coalesce(F.col(roi), F.lit(False))
    return boxes.withColumn("distance_m", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).where(keep & (F.col("distance_m") < max_distance))


def candidate_pool(frames: DataFrame, groups: Sequence[str] | None = None, max_distance: float = 50.0, roi: str | None = None, ego: str = "translation_m") -> DataFrame:
    """Pool rows of detections (log_id, timestamp_ns, track_id, candidate_ordinal, name, label, score, translation_m, size, yaw).

    Kept are names of the taxonomy groups, finite positions and sizes, positions (column ego) nearer than max_distance
    and, with a column roi, those inside. Labels are unknown and every row unmatched: nothing of a query is looked at.
    """
    at = F.sqrt(F.get(ego, 0) ** 2 + F.get(ego, 1) ** 2)
    group = taxonomy_group(F.col("name"))
    keep = finite_vector(F.col("translation_m"), 3) & finite_vector(F.col("size"), 3) & _finite(at) & (at < max_distance)
    if groups is not None:
        keep = keep & group.isin(list(groups))
    if roi:
        keep = keep & F.coalesce(F.col(roi), F.lit(False))
    out = frames.where(keep).select(
        "log_id", "timestamp_ns", F.col("track_id").cast("long").alias("track_id"), F.col("candidate_ordinal").cast("int").alias("candidate_ordinal"), "name", group.alias("taxonomy_group"),
        F.col("label").cast("int").alias("tracker_label"), F.col("score").alias("tracker_score"), "score", "translation_m", F.col(ego).alias("ego_translation_m"), "size", "yaw", at.alias("distance_m"),
        F.lit(True).alias("roi_eligible"), F.lit(True).alias("is_drivable"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("label_name"), F.lit("UNMATCHED_TRACK").alias("match_status"),
    )
    return out


def pool_problems(pool: DataFrame) -> DataFrame:
    """One row: rows, groups, keys that repeat, and whether any row has a prompt, category or label."""
    keys = pool.groupBy("log_id", "timestamp_ns", "track_id").agg(F.count("*").alias("n"))
    told = [F.col(c).isNotNull() for c in ("prompt", "mining_category", "label") if c in pool.columns]
    flag = F.bool_or(reduce(lambda a, b: a | b, told)) if told else F.lit(False)
    one = pool.agg(F.count("*").alias("rows"), F.count_distinct("log_id", "timestamp_ns").alias("groups"), F.coalesce(flag, F.lit(False)).alias("prompt_dependent"))
    return one.crossJoin(keys.agg(F.count_if(F.col("n") > 1).alias("repeated_keys")))  # one row each


def raised(position: geo.Vector, rotation: geo.Rotation, translation: geo.Vector, height: Column) -> geo.Vector:
    """A city position moved up by half a height along the observer's own z axis."""
    x, y, z = geo.to_ego(rotation, translation, position)
    return geo.to_city(rotation, translation, (x, y, z + height / 2))


def truth_rows(annotations: DataFrame) -> DataFrame:
    """Ground truth in the observer's frame (x, y, z, ..., pose qw..qz, tx..tz, name) as city rows; a missing score is 1, the observer is marked."""
    c = lambda *n: tuple(F.col(x) for x in n)
    city = geo.to_city(geo.rotation(*c("qw", "qx", "qy", "qz")), c("tx", "ty", "tz"), c("x", "y", "z"))
    score = F.coalesce("score", F.lit(1.0)) if "score" in annotations.columns else F.lit(1.0)
    return annotations.withColumns({"translation_m": F.array(*city), "score": score, "synthetic_ego": F.coalesce(F.col("name") == "EGO_VEHICLE", F.lit(False))})


def build_source_pool(objects: DataFrame, poses: DataFrame, max_distance: float = 50.0, selected: DataFrame | None = None, ego: bool = True) -> DataFrame:
    """A source's pool in one build: filters, distances, the observer's row of each pose, and ordinals by track as text.

    objects: (log_id, timestamp_ns, track_id, name, translation_m, size, rotation, score, roi) in the city's frame, rotation
    being a matrix; poses: (log_id, timestamp_ns, qw..qz, tx..tz). Kept are finite positions, sizes, rotations and scores,
    sizes above 0, inside the region, nearer to the observer than max_distance; selected as for strict_pool. Objects
    without a pose are left out, and no label or prompt is looked at.
    """
    on = ["log_id", "timestamp_ns"]
    if selected is not None:
        objects = objects.join(selected.select("log_id", F.col("track_id").cast("string").alias("track_id")).distinct(), ["log_id", "track_id"], "left_semi").select(*objects.columns)
    turn = geo.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    keep = finite_vector(F.col("translation_m"), 3) & finite_vector(F.col("size"), 3) & finite_vector(F.flatten("rotation"), 9) & (F.array_min("size") > 0) & _finite("score") & F.coalesce(F.col("roi"), F.lit(False))
    place = geo.to_ego(turn, tuple(F.col(c) for c in ("tx", "ty", "tz")), tuple(F.get("translation_m", i) for i in range(3)))
    kept = objects.where(keep).join(poses, on).withColumn("distance_m", F.sqrt(place[0] ** 2 + place[1] ** 2)).where(F.col("distance_m") < max_distance)
    fields = [*on, F.col("track_id").cast("string").alias("track_id"), "name", "translation_m", "size", "rotation", "score", "distance_m"]
    out = kept.select(*fields, F.lit(False).alias("synthetic_ego"))
    if ego:
        own = poses.select(
            *on, F.lit("ego").alias("track_id"), F.lit("EGO_VEHICLE").alias("name"), F.array("tx", "ty", "tz").alias("translation_m"), F.array(*map(F.lit, EGO_SIZE)).alias("size"),
            F.array(*[F.array(*r) for r in turn]).alias("rotation"), F.lit(1.0).alias("score"), F.lit(0.0).alias("distance_m"), F.lit(True).alias("synthetic_ego"),
        )
        out = out.unionByName(own)
    return out.withColumn("candidate_ordinal", F.row_number().over(Window.partitionBy(*on).orderBy("track_id")) - 1)


def source_counts(sources: dict[str, DataFrame], at: Sequence[str], key: str, first: str, second: str) -> DataFrame:
    """For each of `at` (such as a log and a time): members by source, and those in one of two sources only."""
    p = source_presence(sources, [*at, key])
    counts = [F.count_if(n).alias(f"{n}_count") for n in sources]
    only = [F.count_if(F.col(a) & ~F.col(b)).alias(f"{a}_only") for a, b in ((first, second), (second, first))]
    return p.groupBy(*at).agg(*counts, *only)


def with_ego(pool: DataFrame) -> DataFrame:
    """One row of the observer for each (log_id, timestamp_ns)."""
    ego = pool.select("log_id", "timestamp_ns").distinct().select(
        "log_id", "timestamp_ns", F.lit("ego").alias("track_id"), F.lit("EGO_VEHICLE").alias("name"), F.lit(0.0).alias("distance_m"), F.lit(1.0).alias("score"),
        *[F.lit(v).alias(n) for v, n in zip(EGO_SIZE, ("length", "width", "height"), strict=True)], F.lit(True).alias("synthetic_ego"),
    )
    return pool.withColumn("synthetic_ego", F.lit(False)).unionByName(ego, allowMissingColumns=True)


def is_ego() -> Column:
    return F.coalesce(F.col("synthetic_ego"), F.lit(False)) | F.coalesce(F.col("name") == "EGO_VEHICLE", F.lit(False))


def record(c: Column, kind: T.DataType) -> Column:
    """A text that only equal values share: n for null, else the value's length and text, and for arrays the number of members and their records."""
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: record(x, kind.elementType)), "")
        return F.coalesce(F.concat(F.size(c).cast("string"), F.lit("["), inner), F.lit("n"))
    text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def record_sql(*fields: str) -> str:
    """record of several fields that are no arrays, for the oracle queries."""
    return " || ".join(f"coalesce(CAST(length(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), 'n')" for f in fields)


def membership(pool: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A digest of a group's members, the same in any order, and their number: by, digest, members.

    A member is the records of its fields, one after the other, so members that differ in any field, also in where a null or a
    comma stands, have different texts. The digest is that of the members' SHA-256 digests added up in four lanes of 64
    bits, without overflow: sums merge as they travel, so a group is never gathered, and a member that comes twice
    counts twice. Fields that the pool lacks are null.
    """
    kinds = {f.name: f.dataType for f in pool.schema}
    h = F.sha2(F.concat(*[record(F.col(f), kinds[f]) if f in kinds else F.lit("n") for f in fields]), 256)
    lane = lambda i: F.conv(F.substring("_h", 1 + 16 * i, 16), 16, 10).cast("decimal(28,0)")
    sums = pool.select(*by, h.alias("_h")).groupBy(*by).agg(F.count("*").alias("members"), *[F.sum(lane(i)).alias(f"_{i}") for i in range(4)])
    return sums.select(*by, F.sha2(F.concat_ws(",", F.col("members").cast("string"), *[F.col(f"_{i}").cast("string") for i in range(4)]), 256).alias("digest"), "members")


def membership_sql(member: str) -> str:
    """The digest of membership as an aggregate over an expression that gives a member's text."""
    lane = lambda i: f"CAST(sum(CAST(CAST('0x' || substr(sha256({member}), {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)"
    return f"sha256(CAST(count(*) AS VARCHAR) || ',' || {' || chr(44) || '.join(map(lane, range(4)))})"


#: Fields of the two canonical digests (fixed values).
POOL_FIELDS = ("log_id", "timestamp_ns", "tracker_timestamp_ns", "track_id", "candidate_ordinal", "name", "translation_m", "size", "yaw", "tracker_score", "roi_eligible")
SOURCE_FIELDS = ("log_id", "timestamp_ns", "track_id", "name", "translation_m", "size", "rotation", "score")


def canonical_digest(pool: DataFrame, by: list[str], fields: Sequence[str], order: list[str], end: str = "") -> DataFrame:
    """SHA-256 of the members as compact JSON with sorted keys, in a stated order, as Python writes it; NaN is an error.

    Fields that the pool lacks are null. A group (such as a frame of a log) is held by one task, as one digest demands.
    """
    kinds = dict(pool.dtypes)
    there = [f for f in fields if f in kinds]

    def digest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable")[there].to_dict("records")
        rows = [{f: _plain(r.get(f)) for f in fields} for r in rows]
        text = json.dumps(rows, sort_keys=True, separators=(",", ":"), allow_nan=False) + end
        return pd.DataFrame([[*key, hashlib.sha256(text.encode()).hexdigest()]], columns=[*by, "digest"])

    slim = pool.select(*dict.fromkeys([*by, *there, *order]))
    return slim.groupBy(*by).applyInPandas(digest, ", ".join(f"{c} {kinds[c]}" for c in by) + ", digest string")


def _plain(v):
    return [_plain(x) for x in v] if isinstance(v, (list, np.ndarray)) else v.item() if hasattr(v, "item") else v


def candidate_pool_digest(pool: DataFrame, by: list[str]) -> DataFrame:
    """The digest of candidate pools: POOL_FIELDS by numeric track and ordinal, with a line feed at the end.

    For groups of a bounded size, such as a frame; `membership` of POOL_FIELDS tells any groups apart.
    """
    return canonical_digest(pool, by, POOL_FIELDS, ["log_id", "timestamp_ns", "track_id", "candidate_ordinal"], "\n")


def source_pool_digest(pool: DataFrame, by: list[str]) -> DataFrame:
    """The digest of source pools: SOURCE_FIELDS by track as text."""
    text = pool.withColumn("track_id", F.col("track_id").cast("string"))
    return canonical_digest(text, by, SOURCE_FIELDS, ["log_id", "timestamp_ns", "track_id"])


def source_presence(sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """For each key in any source, a boolean column for each source."""
    tagged = None
    for name, df in sources.items():
        one = df.select(*key, F.lit(name).alias("source"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(*key).agg(*[F.bool_or(F.col("source") == n).alias(n) for n in sources])


def expand_prompts(pool: DataFrame, prompts: DataFrame, on: list[str]) -> DataFrame:
    """Pool rows times the prompts of their key; expand last, after geometry."""
    return pool.join(prompts, on)


def hash_shuffle(pool: DataFrame, by: list[str], seed: int, track: str = "track_id") -> DataFrame:
    """pool with `position`, an order within each group that a digest of seed, group and track fixes."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, track]]), 256)
    return pool.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(h, track)) - 1)


def numpy_shuffle(pool: DataFrame, by: list[str], seed: int, track: str = "track_id") -> DataFrame:
    """As hash_shuffle, by numpy's generator with the group's seed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(track, kind="stable")
        order = np.random.default_rng(int(pdf["_seed"].iloc[0])).permutation(len(pdf))
        return pdf.iloc[order].assign(position=np.arange(len(pdf))).drop(columns="_seed")

    seeded = pool.withColumn("_seed", group_seed(seed, *[F.col(c) for c in by]))
    return seeded.groupBy(*by).applyInPandas(run, pool.withColumn("position", F.lit(0).cast("long")).schema)


def source_group_problems(rows: DataFrame, groups: DataFrame, on: list[str], order: str, fields: list[str], own: Sequence[str] = ()) -> DataFrame:
    """(on..., own..., problem) of groups whose labels, count or digest do not fit their pool rows; groups have labels, candidate_count, digest.

    With a column _row_ord, rows that are not in string order of their ids are a problem too.
    """
    had = membership(rows, on, fields).withColumnRenamed("digest", "_digest")
    repeats = rows.groupBy(*on).agg((F.count("*") - F.count_distinct(order)).alias("_repeats"))
    g = groups.join(had, on, "left").join(repeats, on, "left")
    if "_row_ord" in rows.columns:
        text = F.col(order).cast("string")
        back = F.lag(text).over(Window.partitionBy(*on).orderBy("_row_ord")) > text
        g = g.join(rows.withColumn("_back", back).groupBy(*on).agg(F.count_if("_back").alias("_unsorted")), on, "left")
    else:
        g = g.withColumn("_unsorted", F.lit(0))
    problem = (
        F.when(F.col("members").isNull(), "no rows")
        .when(F.size("labels") != F.col("candidate_count"), "labels do not fit the count")
        .when(F.col("members") != F.col("candidate_count"), "rows do not fit the count")
        .when(F.col("_unsorted") > 0, "rows are not in order of their ids")
        .when(F.col("digest") != F.col("_digest"), "digest differs")
        .when(F.col("_repeats") > 0, "repeated candidate")
    )
    return g.withColumn("problem", problem).where("problem is not null").select(*on, *own, "problem")


def zip_labels(rows: DataFrame, groups: DataFrame, on: list[str], order: str) -> DataFrame:
    """Pool rows with the label at their place in string order of `order`; a group's array may hold nulls (unknown)."""
    placed = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(*on).orderBy(F.col(order).cast("string"))) - 1)
    labels = groups.select(*on, *[c for c in groups.columns if c not in (*on, "labels")], F.posexplode("labels").alias("_pos", "label"))
    return placed.join(labels, [*on, "_pos"]).drop("_pos")


def baseline_rows(rows: DataFrame, groups: DataFrame, on: list[str], order: str) -> DataFrame:
    """Prompt-expanded rows with label, match_status and the position in the observer's frame.

    Geometry is worked out on the pool, before prompts multiply it.
    """
    c = lambda *n: tuple(F.col(x) for x in n)
    ego = geo.to_ego(geo.rotation(*c("qw", "qx", "qy", "qz")), c("tx", "ty", "tz"), c("x", "y", "z"))
    posed = rows.withColumns(dict(zip(("ego_x", "ego_y", "ego_z"), ego, strict=True)))
    out = zip_labels(posed, groups, on, order)
    return out.withColumn("match_status", F.when(F.col("label").isNull(), "UNKNOWN").otherwise("MATCHED_ANNOTATED"))
