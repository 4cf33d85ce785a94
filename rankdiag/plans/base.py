"""The engine's inputs, taken from the driver's tables, and the same as SQL common table expressions.

Every candidate table has log_id, prompt, timestamp_ns, track_id, name, score, distance_m, area, label; a null label
means unknown and is never a negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("log_id", "prompt", "timestamp_ns")
CANDIDATE = (*GROUP, "track_id", "name", "score", "distance_m", "area", "label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates; labels cover some of them."""
    d, l = table(spark, sf_dir, "documents").drop("text"), table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality").isNotNull(), 1)
    return d.join(l, "doc_id", "left").select(
        F.col("source").alias("log_id"),
        F.col("lang").alias("prompt"),
        F.lit(0).cast("long").alias("timestamp_ns"),
        F.col("doc_id").cast("string").alias("track_id"),
        F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string")).alias("name"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("doc_id") % 50).cast("double").alias("distance_m"),
        ((F.col("n_chars") % 40) * (F.col("doc_id") % 30)).cast("double").alias("area"),
        label.alias("label"),
    )


DOCS = """cand AS (SELECT d.source AS log_id, d.lang AS prompt, CAST(0 AS BIGINT) AS timestamp_ns, CAST(d.doc_id AS VARCHAR) AS track_id,
  'c' || CAST(d.doc_id % 5 AS VARCHAR) AS name, CAST(d.n_chars AS DOUBLE) AS score, CAST(d.doc_id % 50 AS DOUBLE) AS distance_m,
  CAST((d.n_chars % 40) * (d.doc_id % 30) AS DOUBLE) AS area,
  CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 WHEN l.quality IS NOT NULL THEN 1 END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as candidates, ranked within supplier, flags and year."""
    x = table(spark, sf_dir, "lineitem")
    d = F.col("l_discount")
    return x.select(
        F.col("l_suppkey").cast("string").alias("log_id"),
        F.concat("l_returnflag", "l_linestatus").alias("prompt"),
        F.year("l_shipdate").cast("long").alias("timestamp_ns"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("track_id"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("name"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("distance_m"),
        (F.round(F.col("l_tax") * 100) * F.col("l_quantity")).alias("area"),
        F.when(d < 0.025, 0).when(d < 0.055, 1).when(d < 0.075, 2).alias("label"),
    )


LINES = """cand AS (SELECT CAST(l_suppkey AS VARCHAR) AS log_id, l_returnflag || l_linestatus AS prompt, CAST(year(l_shipdate) AS BIGINT) AS timestamp_ns,
  concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS track_id,
  'p' || CAST(l_partkey % 20 AS VARCHAR) AS name, l_extendedprice AS score, l_quantity AS distance_m, round(l_tax * 100) * l_quantity AS area,
  CASE WHEN l_discount < 0.025 THEN 0 WHEN l_discount < 0.055 THEN 1 WHEN l_discount < 0.075 THEN 2 END AS label FROM lineitem)"""


def box_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as boxes with a class, a position, a size, a yaw and a pose of the observer."""
    e = lambda i: F.element_at("embedding", i + 1).cast("double")
    x = table(spark, sf_dir, "embeddings")
    q = [e(i) for i in (2, 3, 4, 5)]
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return x.select(
        "vec_id",
        F.concat(F.lit("log"), (F.col("vec_id") % 3).cast("string")).alias("log_id"),
        (F.col("vec_id") % 4).cast("long").alias("timestamp_ns"),
        F.col("label").alias("class"),
        (e(0) * 10).alias("x"), (e(1) * 10).alias("y"), (e(12) * 10).alias("z"),
        *[(v / norm).alias(n) for v, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)],
        e(6).alias("tx"), e(7).alias("ty"), e(8).alias("tz"),
        (F.abs(e(9)) + 0.1).alias("length"), (F.abs(e(10)) + 0.1).alias("width"), (F.abs(e(11)) + 0.1).alias("height"),
        e(13).alias("yaw"), e(14).alias("score"),
    )


BOXES = """e AS (SELECT vec_id, label, [CAST(v AS DOUBLE) FOR v IN embedding] AS e FROM embeddings),
n AS (SELECT *, sqrt(e[3]*e[3] + e[4]*e[4] + e[5]*e[5] + e[6]*e[6]) AS nn FROM e),
box AS (SELECT vec_id, 'log' || CAST(vec_id % 3 AS VARCHAR) AS log_id, CAST(vec_id % 4 AS BIGINT) AS timestamp_ns, label AS class,
  e[1] * 10 AS x, e[2] * 10 AS y, e[13] * 10 AS z, e[3] / nn AS qw, e[4] / nn AS qx, e[5] / nn AS qy, e[6] / nn AS qz,
  e[7] AS tx, e[8] AS ty, e[9] AS tz, abs(e[10]) + 0.1::DOUBLE AS length, abs(e[11]) + 0.1::DOUBLE AS width, abs(e[12]) + 0.1::DOUBLE AS height,
  e[14] AS yaw, e[15] AS score FROM n)"""
