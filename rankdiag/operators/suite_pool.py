"""Registered queries of pools, projection, alignment, the strict export and scorer inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalars as fn
from ..plans.base import BOXES, DOCS, GROUP, LINES, box_table, document_candidates, line_candidates, table
from . import align, audit, export, graph, pool, ranking
from .registry import query
from .suite import _CLASS_NAMES, _CORNERS, _R, _cornered, _side_name

# ---- Pools -------------------------------------------------------------------------------------------------------------

_ROI = f"{_CORNERS}, cell AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy FROM box WHERE vec_id % 3 = 0), inside AS (SELECT vec_id, bool_or(cell.cx IS NOT NULL) AS inside FROM corner LEFT JOIN cell ON CAST(floor(px) AS BIGINT) = cx AND CAST(floor(py) AS BIGINT) = cy GROUP BY vec_id)"


def _with_roi(spark, d):
    from ..sources.readers import inside_roi

    b = _cornered(spark, d)
    one = F.lit("map").alias("log_id")
    cells = b.where("vec_id % 3 = 0").select(one, F.floor("x").alias("cx"), F.floor("y").alias("cy")).distinct()
    hit = inside_roi(b.select(one, F.col("vec_id").alias("id"), "corners"), cells)
    return box_table(spark, d).join(hit.select(F.col("id").alias("vec_id"), "inside"), "vec_id")


@query("pool_filter_selected", f"WITH {BOXES}, {_ROI} SELECT vec_id, round(sqrt(x * x + y * y), 6) AS distance_m FROM box JOIN inside USING (vec_id) WHERE inside AND vec_id % 5 <> 0 AND sqrt(x * x + y * y) < 10 AND length > 0 AND width > 0 AND height > 0")
def _(spark, d):
    b = _with_roi(spark, d).withColumn("track_id", F.col("vec_id").cast("string"))
    chosen = b.where("vec_id % 5 <> 0").select("log_id", "track_id")
    return pool.strict_pool(b, 10.0, chosen, "inside").select("vec_id", F.round("distance_m", 6).alias("distance_m"))


@query("pool_filter_roi", f"WITH {BOXES}, {_ROI} SELECT vec_id, class FROM box JOIN inside USING (vec_id) WHERE inside AND class IN (0, 1, 2, 3) AND sqrt(x * x + y * y) < 50")
def _(spark, d):
    return pool.loose_pool(_with_roi(spark, d), [0, 1, 2, 3], roi="inside").select("vec_id", "class")


_GRP = "CASE class WHEN 0 THEN 'VEHICLE' WHEN 1 THEN 'VEHICLE' WHEN 2 THEN 'BICYCLE' WHEN 3 THEN 'BICYCLE' WHEN 4 THEN 'PEDESTRIAN' WHEN 5 THEN 'PEDESTRIAN' WHEN 6 THEN 'WHEELED_DEVICE' WHEN 7 THEN 'WHEELED_DEVICE' ELSE 'SIGN' END"


def _detections(spark, d):
    """Boxes as detections; some have an infinite size or none."""
    b = box_table(spark, d)
    size = F.when(F.col("vec_id") % 17 == 0, F.array(F.lit(float("inf")), "width", "height")).when(F.col("vec_id") % 19 != 0, F.array("length", "width", "height"))
    place = F.row_number().over(Window.partitionBy("log_id", "timestamp_ns").orderBy("vec_id")) - 1
    return b.select("log_id", "timestamp_ns", F.col("vec_id").alias("track_id"), place.alias("candidate_ordinal"), _side_name().alias("name"), F.col("class").alias("label"), "score", F.array("x", "y", "z").alias("translation_m"), size.alias("size"), "yaw", (F.col("vec_id") % 2 == 0).alias("roi"))


@query("candidate_pool", f"""WITH {BOXES}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY log_id, timestamp_ns ORDER BY vec_id) - 1 AS INTEGER) AS candidate_ordinal, {_GRP} AS taxonomy_group FROM box)
SELECT log_id, timestamp_ns, vec_id AS track_id, candidate_ordinal, taxonomy_group, CAST(class AS INTEGER) AS tracker_label, round(sqrt(x * x + y * y), 6) AS distance_m, CAST(NULL AS INTEGER) AS label, 'UNMATCHED_TRACK' AS match_status FROM o
WHERE vec_id % 17 <> 0 AND vec_id % 19 <> 0 AND vec_id % 2 = 0 AND taxonomy_group IN ('VEHICLE', 'PEDESTRIAN', 'SIGN') AND sqrt(x * x + y * y) < 2""")
def _(spark, d):
    p = pool.candidate_pool(_detections(spark, d), ["VEHICLE", "PEDESTRIAN", "SIGN"], 2.0, "roi")
    return p.select("log_id", "timestamp_ns", "track_id", "candidate_ordinal", "taxonomy_group", "tracker_label", F.round("distance_m", 6).alias("distance_m"), "label", "match_status")


@query("pool_problems", f"WITH {BOXES}, p AS (SELECT log_id, timestamp_ns, vec_id % 40 AS track_id, CASE WHEN vec_id = 7 THEN 'q' END AS prompt FROM box), k AS (SELECT count(*) AS n FROM p GROUP BY log_id, timestamp_ns, track_id) SELECT (SELECT count(*) FROM p) AS rows, (SELECT count(DISTINCT (log_id, timestamp_ns)) FROM p) AS groups, (SELECT count(prompt) > 0 FROM p) AS prompt_dependent, (SELECT count(*) FROM k WHERE n > 1) AS repeated_keys")
def _(spark, d):
    return pool.pool_problems(box_table(spark, d).select("log_id", "timestamp_ns", (F.col("vec_id") % 40).alias("track_id"), F.when(F.col("vec_id") == 7, "q").alias("prompt")))


_MICRO = "CAST(round({c} * 1e6) AS BIGINT)"
_VECTOR = "'3[' || " + pool.record_sql(*[_MICRO.format(c=c) for c in ("{a}", "{b}", "{c}")])


def _vector_sql(a: str, b: str, c: str) -> str:
    return _VECTOR.format(a=a, b=b, c=c)


def _whole(c):
    """Coordinates in millionths, so that any engine writes them alike."""
    return F.transform(c, lambda x: F.round(x * 1e6).cast("long"))


@query("candidate_pool_members", f"""WITH {BOXES}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY log_id, timestamp_ns ORDER BY vec_id) - 1 AS INTEGER) AS candidate_ordinal FROM box),
p AS (SELECT *, CASE class {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_CLASS_NAMES))} END AS name FROM o WHERE vec_id % 17 <> 0 AND vec_id % 19 <> 0 AND sqrt(x * x + y * y) < 50)
SELECT log_id, timestamp_ns, {pool.membership_sql(" || ".join([pool.record_sql("log_id", "timestamp_ns", "timestamp_ns", "vec_id", "candidate_ordinal", "name"), _vector_sql("x", "y", "z"), _vector_sql("length", "width", "height"), pool.record_sql(_MICRO.format(c="yaw"), _MICRO.format(c="score"), "vec_id % 2 = 0")]))} AS digest, count(*) AS members FROM p GROUP BY ALL""")
def _(spark, d):
    p = pool.candidate_pool(_detections(spark, d)).withColumns({"tracker_timestamp_ns": F.col("timestamp_ns"), "roi_eligible": F.col("track_id") % 2 == 0, "translation_m": _whole("translation_m"), "size": _whole("size"), "yaw": F.round(F.col("yaw") * 1e6).cast("long"), "tracker_score": F.round(F.col("tracker_score") * 1e6).cast("long")})
    return pool.membership(p, ["log_id", "timestamp_ns"], pool.POOL_FIELDS)


def _source_pool(spark, d):
    """Boxes as a source's pool, by track as text, with a rotation matrix."""
    b = box_table(spark, d)
    m = geo.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    return b.select("log_id", "timestamp_ns", F.col("vec_id").cast("string").alias("track_id"), F.concat(F.lit("K"), F.col("class").cast("string")).alias("name"), F.array("x", "y", "z").alias("translation_m"), F.array("length", "width", "height").alias("size"), F.array(*[F.array(*r) for r in m]).alias("rotation"), "score")


@query("source_pool_digest")
def _(spark, d):
    return pool.source_pool_digest(_source_pool(spark, d), ["log_id", "timestamp_ns"])


@query("source_pool_members", f"""WITH {BOXES}, {_R} SELECT log_id, timestamp_ns, {pool.membership_sql(" || ".join([pool.record_sql("log_id", "timestamp_ns", "vec_id", "'K' || class"), _vector_sql("x", "y", "z"), _vector_sql("length", "width", "height"), "'3['", *[_vector_sql(*[f"r{i}{j}" for j in range(3)]) for i in range(3)], pool.record_sql(_MICRO.format(c="score"))]))} AS digest, count(*) AS members FROM r GROUP BY ALL""")
def _(spark, d):
    p = _source_pool(spark, d).withColumns({"translation_m": _whole("translation_m"), "size": _whole("size"), "rotation": F.transform("rotation", _whole), "score": F.round(F.col("score") * 1e6).cast("long")})
    return pool.membership(p, ["log_id", "timestamp_ns"], pool.SOURCE_FIELDS)


@query("candidate_pool_digest")
def _(spark, d):
    p = pool.candidate_pool(_detections(spark, d)).withColumn("tracker_timestamp_ns", F.col("timestamp_ns"))
    return pool.candidate_pool_digest(p, ["log_id", "timestamp_ns"])


@query("tracker_rows", f"""WITH {BOXES}, {_R}, up AS (SELECT *, r00 * (x - tx) + r10 * (y - ty) + r20 * (z - tz) AS ex, r01 * (x - tx) + r11 * (y - ty) + r21 * (z - tz) AS ey, r02 * (x - tx) + r12 * (y - ty) + r22 * (z - tz) + height / 2 AS ez FROM r)
SELECT vec_id, round(r00 * ex + r01 * ey + r02 * ez + tx, 5) AS cx, round(r10 * ex + r11 * ey + r12 * ez + ty, 5) AS cy, round(r20 * ex + r21 * ey + r22 * ez + tz, 5) AS cz FROM up""")
def _(spark, d):
    c = lambda *n: tuple(F.col(x) for x in n)
    p = pool.raised(c("x", "y", "z"), geo.rotation(*c("qw", "qx", "qy", "qz")), c("tx", "ty", "tz"), F.col("height"))
    return box_table(spark, d).select("vec_id", *[F.round(v, 5).alias(n) for v, n in zip(p, ("cx", "cy", "cz"), strict=True)])


@query("truth_rows", f"""WITH {BOXES}, {_R} SELECT vec_id, round(r00 * x + r01 * y + r02 * z + tx, 5) AS cx, round(r10 * x + r11 * y + r12 * z + ty, 5) AS cy, CASE WHEN vec_id % 4 = 0 THEN 1.0::DOUBLE ELSE round(score, 6) END AS score, vec_id % 9 = 1 AS synthetic_ego FROM r""")
def _(spark, d):
    b = box_table(spark, d).withColumns({"score": F.when(F.col("vec_id") % 4 != 0, F.col("score")), "name": F.when(F.col("vec_id") % 9 == 1, "EGO_VEHICLE").when(F.col("vec_id") % 9 == 2, None).otherwise("BUS")})
    t = pool.truth_rows(b)
    return t.select("vec_id", F.round(F.get("translation_m", 0), 5).alias("cx"), F.round(F.get("translation_m", 1), 5).alias("cy"), F.round("score", 6).alias("score"), "synthetic_ego")


_SOURCES = {"custom": "vec_id % 2 = 0", "official": "vec_id % 3 <> 0", "causal": "vec_id % 5 < 3", "legacy": "class < 4", "truth": "true"}


@query("five_sources", f"WITH {BOXES} SELECT log_id, timestamp_ns, {', '.join(f'count(*) FILTER ({w}) AS {n}_count' for n, w in _SOURCES.items())}, count(*) FILTER ({_SOURCES['custom']} AND NOT ({_SOURCES['official']})) AS custom_only, count(*) FILTER ({_SOURCES['official']} AND NOT ({_SOURCES['custom']})) AS official_only FROM box GROUP BY ALL")
def _(spark, d):
    b = box_table(spark, d)
    return pool.source_counts({n: b.where(w).select("log_id", "timestamp_ns", "vec_id") for n, w in _SOURCES.items()}, ["log_id", "timestamp_ns"], "vec_id", "custom", "official")


# ---- Projection --------------------------------------------------------------------------------------------------------


@query("box_corners_rotated", f"""WITH {BOXES}, {_R}, k AS (SELECT r.*, i, length * (CASE WHEN i // 4 = 0 THEN -0.5 ELSE 0.5 END)::DOUBLE AS dx, width * (CASE WHEN (i // 2) % 2 = 0 THEN -0.5 ELSE 0.5 END)::DOUBLE AS dy, height * (CASE WHEN i % 2 = 0 THEN -0.5 ELSE 0.5 END)::DOUBLE AS dz FROM r, range(8) q(i))
SELECT vec_id, CAST(i AS INTEGER) AS i, round(x + r00 * dx + r01 * dy + r02 * dz, 5) AS px, round(y + r10 * dx + r11 * dy + r12 * dz, 5) AS py, round(z + r20 * dx + r21 * dy + r22 * dz, 5) AS pz FROM k""")
def _(spark, d):
    c = lambda *n: tuple(F.col(x) for x in n)
    p = geo.rotated_corners(c("x", "y", "z"), c("length", "width", "height"), geo.rotation(*c("qw", "qx", "qy", "qz")))
    return box_table(spark, d).select("vec_id", F.posexplode(p).alias("i", "c")).select("vec_id", "i", *[F.round(f"c.{n}", 5).alias(f"p{n}") for n in "xyz"])


_CAMERAS = {"front": 5.0, "near": 0.5, "behind": -50.0}


def _seen_sql(shift: str) -> str:
    u = lambda f, c, m: f"greatest(0, least({m}, {f}({c})))"
    return f"SELECT vec_id, {u('min', 'x * 100.0::DOUBLE / z + 96', 192)} AS x0, {u('min', 'y * 100.0::DOUBLE / z + 60', 120)} AS y0, {u('max', 'x * 100.0::DOUBLE / z + 96', 192)} AS x1, {u('max', 'y * 100.0::DOUBLE / z + 60', 120)} AS y1 FROM (SELECT vec_id, px AS x, py AS y, pz + {shift} AS z FROM corner) WHERE z > 0.1::DOUBLE GROUP BY vec_id"


@query("project_unclipped", f"WITH {BOXES}, {_CORNERS}, s AS ({_seen_sql('5.0::DOUBLE')}) SELECT vec_id, CASE WHEN (x1 - x0) * (y1 - y0) > 1 THEN round((x1 - x0) * (y1 - y0), 4) END AS area FROM box LEFT JOIN s USING (vec_id)")
def _(spark, d):
    ahead = F.transform("corners", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (c["z"] + 5).alias("z")))
    b = _cornered(spark, d).withColumn("ahead", ahead).withColumn("box", geo.project_unclipped(F.col("ahead"), 100.0, 100.0, 96.0, 60.0, 192.0, 120.0))
    return b.select("vec_id", F.when(F.col("box").isNotNull(), F.round(fn.box_area(F.col("box")), 4)).alias("area"))


#: Images lack for one box in eleven in front, and for all behind.
_ALL_SEEN = f"""cam AS ({' UNION ALL '.join(f"SELECT '{n}' AS camera, * FROM ({_seen_sql(f'({s})::DOUBLE')})" for n, s in _CAMERAS.items())}), every AS (SELECT b.vec_id, v.camera, CASE v.camera WHEN 'front' THEN b.vec_id % 11 <> 0 WHEN 'near' THEN true ELSE false END AS there FROM box b, (VALUES ('front'), ('near'), ('behind')) v(camera)),
entry AS (SELECT e.*, coalesce((x1 - x0) * (y1 - y0) > 1, false) AS seen, (x1 - x0) * (y1 - y0) AS area FROM every e LEFT JOIN cam USING (vec_id, camera)), sums AS (SELECT vec_id, count(*) FILTER (there AND seen) AS projected, count(*) FILTER (there) AS available, coalesce(sum(area) FILTER (there AND seen), 0) AS area FROM entry GROUP BY vec_id)"""


def _entries(spark, d):
    b = _cornered(spark, d)
    made = {}

    def ahead(shift):
        return F.transform("corners", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (c["z"] + shift).alias("z")))

    for n, shift in _CAMERAS.items():
        b = b.withColumn(f"_{n}", ahead(shift))
        there = F.col("vec_id") % 11 != 0 if n == "front" else F.lit(n == "near")
        made[n] = geo.projection_entry(n, geo.project_unclipped(F.col(f"_{n}"), 100.0, 100.0, 96.0, 60.0, 192.0, 120.0), there, F.concat(F.lit(f"{n}/"), F.col("vec_id").cast("string")), F.col("vec_id") % 7)
    return b.withColumn("entries", F.array(*made.values()))


@query("camera_counts", f"WITH {BOXES}, {_CORNERS}, {_ALL_SEEN} SELECT vec_id, CAST(projected AS INTEGER) AS projected_camera_count, CAST(available AS INTEGER) AS available_camera_count, projected > 0 AS any_projected, available = 3 AS all_assets, CASE WHEN projected > 0 THEN 'PROJECTED' WHEN available > 0 THEN 'OUT_OF_VIEW' ELSE 'MISSING_CAMERA_FRAMES' END AS projection_status FROM sums")
def _(spark, d):
    e = _entries(spark, d)
    return e.select("vec_id", *[c.alias(n) for n, c in geo.camera_counts(F.col("entries")).items()])


@query("projected_area_sum", f"WITH {BOXES}, {_CORNERS}, {_ALL_SEEN} SELECT vec_id, round(area, 4) AS area FROM sums")
def _(spark, d):
    return _entries(spark, d).select("vec_id", F.round(geo.area_sum(F.col("entries")), 4).alias("area"))


@query("fixed_camera_fields", f"WITH {BOXES}, {_CORNERS}, {_ALL_SEEN} SELECT vec_id, 'front' AS camera_name, CASE WHEN there THEN 'front/' || vec_id END AS image_path, CASE WHEN there THEN vec_id % 7 END AS camera_delta_ns, CASE WHEN there AND seen THEN round(area, 4) END AS area FROM entry WHERE camera = 'front'")
def _(spark, d):
    e = _entries(spark, d).select("vec_id", *[c.alias(n) for n, c in geo.fixed_camera(F.col("entries"), "front").items()])
    return e.select("vec_id", "camera_name", "image_path", "camera_delta_ns", F.when(F.col("projected_box").isNotNull(), F.round(fn.box_area(F.col("projected_box")), 4)).alias("area"))


# ---- Scalars -----------------------------------------------------------------------------------------------------------


@query("vector_checks", """SELECT vec_id, vec_id % 5 >= 2 AS sound, CASE WHEN vec_id % 5 >= 2 THEN round(CAST(embedding[1] AS DOUBLE) * CAST(embedding[2] AS DOUBLE) * CAST(embedding[3] AS DOUBLE), 8) END AS volume, 1 AS list_size,
  CASE WHEN vec_id % 2 = 0 THEN 'oracle' ELSE 'oracle:seed_1' END AS name FROM embeddings""")
def _(spark, d):
    at = lambda i: F.element_at("embedding", i).cast("double")
    v = F.when(F.col("vec_id") % 5 == 0, F.array(at(1), at(2))).when(F.col("vec_id") % 5 == 1, F.array(at(1), F.lit(float("nan")), at(3))).otherwise(F.array(at(1), at(2), at(3)))
    t = table(spark, d, "embeddings").withColumn("v", v)
    sound = fn.finite_vector(F.col("v"), 3)
    name = fn.drop_suffix(F.concat(F.lit("oracle:seed_"), (F.col("vec_id") % 2).cast("string")), ":seed_0")
    return t.select("vec_id", sound.alias("sound"), F.when(sound, F.round(fn.volume(F.col("v")), 8)).alias("volume"), F.size(fn.as_list(F.col("vec_id"), "bigint")).alias("list_size"), name.alias("name"))


# ---- Alignment ---------------------------------------------------------------------------------------------------------

_DAY = 86_400_000_000
_TIMES = f"""t AS (SELECT CAST(user_id AS VARCHAR) AS log_id, event_type, (epoch_us(ts) // {_DAY}) * {_DAY} AS timestamp_ns, epoch_us(ts) AS us FROM events),
w AS (SELECT DISTINCT log_id, (timestamp_ns // {_DAY}) % 3 AS prompt, timestamp_ns FROM t WHERE event_type = 'click'), r AS (SELECT w.* FROM w SEMI JOIN (SELECT * FROM t WHERE event_type = 'view') v USING (log_id, timestamp_ns)), p AS (SELECT r.* FROM r SEMI JOIN (SELECT * FROM t WHERE event_type <> 'error') v USING (log_id, timestamp_ns)),
usable AS (SELECT DISTINCT p.* FROM p JOIN t c ON c.log_id = p.log_id AND c.event_type = 'purchase' AND abs(c.us - p.timestamp_ns) <= {_DAY})"""


def _timed(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = table(spark, d, "events").select(F.col("user_id").cast("string").alias("log_id"), "event_type", (F.floor(us / _DAY) * _DAY).alias("timestamp_ns"), us.alias("us"))
    wanted = t.where("event_type = 'click'").select("log_id", (F.floor(F.col("timestamp_ns") / _DAY) % 3).alias("prompt"), "timestamp_ns").distinct()
    cameras = t.where("event_type = 'purchase'").select("log_id", F.col("us").alias("image_ns"))
    return wanted, align.usable_times(wanted, t.where("event_type = 'view'"), t.where("event_type <> 'error'"), cameras, _DAY)


@query("usable_times", f"WITH {_TIMES} SELECT log_id, prompt, timestamp_ns FROM usable")
def _(spark, d):
    return _timed(spark, d)[1]


@query("unusable_prompts", f"WITH {_TIMES} SELECT DISTINCT log_id, prompt FROM w ANTI JOIN usable USING (log_id, prompt)")
def _(spark, d):
    return align.unusable_prompts(*_timed(spark, d))


# ---- Prompts -----------------------------------------------------------------------------------------------------------


def _prompts(spark, d):
    """Benchmark texts, and copies of some of them with a number changed, a word replaced or the end cut off."""
    t = table(spark, d, "benchmark").select("item_id", "text")
    i = F.col("item_id")
    near = F.when(i % 4 == 0, F.concat(F.lit("7 "), F.upper("text"))).when(i % 4 == 1, F.concat(F.lit("the "), "text")).when(i % 4 == 2, F.expr("left(text, length(text) - 6)"))
    return t.select(F.concat(F.lit("7 "), "text").alias("prompt")).unionByName(t.where(i % 4 == 0).select(F.concat(F.lit("19 "), "text").alias("prompt"))).unionByName(t.select(near.alias("prompt")).where("prompt is not null"))


@query("template_plan")
def _(spark, d):
    return graph.template_plan(_prompts(spark, d))


@query("prompt_keys", """WITH p AS (SELECT DISTINCT lang || ' in ' || CAST(n_chars % 90 AS VARCHAR) || ' Source ' || coalesce(source, '') AS prompt FROM documents), k AS (SELECT prompt, trim(regexp_replace(regexp_replace(regexp_replace(lower(prompt), '[0-9]+(\\.[0-9]+)?', '#', 'g'), '[^a-z0-9# ]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM p)
SELECT prompt, key FROM k""")
def _(spark, d):
    p = table(spark, d, "documents").select(F.concat("lang", F.lit(" in "), (F.col("n_chars") % 90).cast("string"), F.lit(" Source "), F.coalesce("source", F.lit(""))).alias("prompt")).distinct()
    return p.select("prompt", fn.prompt_key(F.col("prompt")).alias("key"))


# ---- Export ------------------------------------------------------------------------------------------------------------


def _source(spark, d):
    """Boxes as a source's rows, with the groups, poses and tracker index that fit them."""
    b, on = box_table(spark, d), ["log_id", "timestamp_ns"]
    i = F.col("vec_id")
    front = F.struct(F.lit("front").alias("camera_name"), F.when(i % 3 != 0, F.array(F.lit(0.0), F.lit(0.0), i.cast("double"), F.lit(1.0))).alias("box"), F.concat(F.lit("img"), i.cast("string")).alias("image_path"), i.alias("image_timestamp_ns"), (i % 7).alias("timestamp_delta_ns"))
    left = F.struct(F.lit("left").alias("camera_name"), F.lit(None).cast("array<double>").alias("box"), F.lit(None).cast("string").alias("image_path"), F.lit(0).cast("long").alias("image_timestamp_ns"), F.lit(0).cast("long").alias("timestamp_delta_ns"))
    rows = b.select(*on, i.cast("string").alias("track_id"), F.concat(F.lit("K"), F.col("class").cast("string")).alias("name"), F.col("score"), F.array("x", "y", "z").alias("translation_m"), F.to_json(F.array(left, front)).alias("camera_projections"))
    shift = F.when(F.col("prompt") == "q1", 1).otherwise(0)
    g = rows.withColumn("prompt", F.explode(F.array(F.lit("q0"), F.lit("q1"))))
    label = (F.col("track_id").cast("long") + shift) % 4
    arr = F.array_sort(F.collect_list(F.struct(F.col("track_id").alias("k"), F.when(label != 3, label.cast("int")).alias("l"))))
    g = g.groupBy(*on, "prompt").agg(F.transform(arr, lambda x: x["l"]).alias("labels"), F.count("*").alias("candidate_count")).withColumn("split", F.when(F.col("log_id") == "log0", "test").otherwise("train"))
    g = g.join(pool.membership(rows, on, ["track_id", "name"]).select(*on, "digest"), on)
    poses = rows.select(*on).distinct().select(*on, F.lit(0.8).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.6).alias("qz"), F.col("timestamp_ns").cast("double").alias("tx"), F.lit(1.0).alias("ty"), F.lit(0.5).alias("tz"))
    index = rows.select(*on, "track_id", (F.length("name") + 1).alias("label"), "name", (F.col("score") + 5e-6).alias("score"))
    return rows, g, poses, index


_EXPORT = f"""{BOXES}, ex AS (SELECT box.*, p.prompt, CASE WHEN (vec_id + p.s) % 4 <> 3 THEN CAST((vec_id + p.s) % 4 AS INTEGER) END AS label, CASE WHEN log_id = 'log0' THEN 'test' ELSE 'train' END AS split, x - timestamp_ns AS dx, y - 1.0::DOUBLE AS dy, z - 0.5::DOUBLE AS dz FROM box, (VALUES ('q0', 0), ('q1', 1)) p(prompt, s))"""


@query("baseline_export", f"""WITH {_EXPORT} SELECT log_id, timestamp_ns, prompt, CAST(vec_id AS VARCHAR) AS track_id, split, label, CASE WHEN label IS NULL THEN 'UNKNOWN' ELSE 'MATCHED_ANNOTATED' END AS match_status, 3 AS raw_tracker_label, 'img' || vec_id AS image_path, vec_id % 7 AS camera_delta_ns, CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id AS DOUBLE) END AS box_width,
  round((1 - 2 * 0.36::DOUBLE) * dx + 2 * 0.48::DOUBLE * dy, 5) AS ex, round(-2 * 0.48::DOUBLE * dx + (1 - 2 * 0.36::DOUBLE) * dy, 5) AS ey, round(dz, 5) AS ez,
  CAST(row_number() OVER (PARTITION BY log_id, prompt, timestamp_ns ORDER BY sha256('0|' || log_id || '|' || prompt || '|' || timestamp_ns || '|' || vec_id), CAST(vec_id AS VARCHAR)) - 1 AS INTEGER) AS position FROM ex""")
def _(spark, d):
    x = export.export_rows(*_source(spark, d), camera="front")
    place = [F.round(F.get("translation_m", i), 5).alias(n) for i, n in enumerate(("ex", "ey", "ez"))]
    return x.select(*GROUP, "track_id", "split", "label", "match_status", "raw_tracker_label", "image_path", "camera_delta_ns", F.get("projected_box", 2).alias("box_width"), *place, "position")


@query("baseline_export_numpy")
def _(spark, d):
    return export.export_rows(*_source(spark, d), camera="front", shuffle="numpy").select(*GROUP, "track_id", "position")


@query("tracker_enrich", "SELECT vec_id, CAST(label % 3 AS INTEGER) AS raw_tracker_label FROM embeddings")
def _(spark, d):
    r = box_table(spark, d).select("log_id", "timestamp_ns", F.col("vec_id").alias("track_id"), F.col("class").cast("string").alias("name"), "score")
    index = r.withColumns({"label": (F.col("name").cast("int") % 3), "score": F.col("score") + F.when(F.col("track_id") % 2 == 0, 9e-6).otherwise(-9e-6)})
    return export.enrich(r, index).select(F.col("track_id").alias("vec_id"), "raw_tracker_label")


@query("image_size", "SELECT DISTINCT CAST(30 * len(embedding) AS INTEGER) AS width, CAST(18 * len(embedding) + 48 AS INTEGER) AS height FROM embeddings")
def _(spark, d):
    """Embeddings as images whose size is made of their length, which all of them share."""
    n = F.size("embedding")
    return export.single_image_size(table(spark, d, "embeddings").select((30 * n).alias("width"), (18 * n + 48).alias("height")))


@query("source_pool_build", f"""WITH {BOXES}, {_R}, o AS (SELECT *, 0.28::DOUBLE * (x - timestamp_ns) + 0.96::DOUBLE * (y - 1) AS ex, 0.28::DOUBLE * (y - 1) - 0.96::DOUBLE * (x - timestamp_ns) AS ey FROM r),
p AS (SELECT log_id, timestamp_ns, CAST(vec_id AS VARCHAR) AS track_id, 'K' || class AS name, x, r00, sqrt(ex * ex + ey * ey) AS distance_m, false AS synthetic_ego FROM o WHERE vec_id % 23 <> 0 AND vec_id % 7 <> 0 AND sqrt(ex * ex + ey * ey) < 6
  UNION ALL SELECT DISTINCT log_id, timestamp_ns, 'ego', 'EGO_VEHICLE', CAST(timestamp_ns AS DOUBLE), 0.28::DOUBLE, 0.0::DOUBLE, true FROM box)
SELECT log_id, timestamp_ns, track_id, name, round(x, 6) AS x, round(r00, 6) AS r00, round(distance_m, 6) AS distance_m, synthetic_ego, CAST(row_number() OVER (PARTITION BY log_id, timestamp_ns ORDER BY track_id) - 1 AS INTEGER) AS candidate_ordinal FROM p""")
def _(spark, d):
    """Boxes with a rotation matrix as a source's objects; some have an infinite size, some are outside the region."""
    i = F.col("track_id").cast("long")
    o = _source_pool(spark, d).withColumns({"size": F.when(i % 23 == 0, F.array(F.lit(float("inf")), F.lit(1.0), F.lit(1.0))).otherwise(F.col("size")), "roi": i % 7 != 0})
    poses = o.select("log_id", "timestamp_ns").distinct().select("*", *[F.lit(v).alias(c) for c, v in (("qw", 0.8), ("qx", 0.0), ("qy", 0.0), ("qz", 0.6))], F.col("timestamp_ns").cast("double").alias("tx"), F.lit(1.0).alias("ty"), F.lit(0.5).alias("tz"))
    p = pool.build_source_pool(o, poses, 6.0)
    return p.select("log_id", "timestamp_ns", "track_id", "name", F.round(F.get("translation_m", F.lit(0)), 6).alias("x"), F.round(F.get(F.get("rotation", F.lit(0)), F.lit(0)), 6).alias("r00"), F.round("distance_m", 6).alias("distance_m"), "synthetic_ego", "candidate_ordinal")


@query("scorer_inputs", f"""WITH {LINES}, v AS (SELECT name AS raw, row_number() OVER (ORDER BY substr(name, 2)) AS id FROM (SELECT DISTINCT name FROM cand WHERE timestamp_ns < 1994 AND name <> 'p3')), w AS (SELECT prompt, row_number() OVER (ORDER BY prompt) AS pid FROM (SELECT DISTINCT prompt FROM cand WHERE timestamp_ns < 1994 AND prompt <> 'AF'))
SELECT track_id, CAST(coalesce(v.id, 0) AS INTEGER) AS category, CAST(coalesce(w.pid, 0) AS INTEGER) AS prompt_id, round(least(area, 100) / 200, 6) AS box_right, round(distance_m / 50, 6) AS distance, round(score, 4) AS first_metadata, round(CAST(substr(name, 2) AS DOUBLE) / 10, 4) AS second_metadata, 1.0::DOUBLE AS image_norm, 1.0::DOUBLE AS text_norm FROM cand LEFT JOIN v ON name = raw LEFT JOIN w USING (prompt)""")
def _(spark, d):
    x = _inputs(spark, d)
    norm = lambda v: F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)), 6)
    return x.select("track_id", "category", "prompt_id", F.round(F.get("candidate", 2), 6).alias("box_right"), F.round(F.get("candidate", 5), 6).alias("distance"), F.round(F.get("metadata", 0), 4).alias("first_metadata"), F.round(F.get("metadata", 1), 4).alias("second_metadata"), norm("image").alias("image_norm"), norm("text").alias("text_norm"))


@query("scorer_scores")
def _(spark, d):
    """Every candidate's logit under the first weights of the mode that knows image and prompt."""
    from .scorer import score_inputs, start

    return score_inputs(_inputs(spark, d), start(12, 21, "task_id", 7, 2), "track_id")


@query("scorer_train_groups")
def _(spark, d):
    """Every candidate's logit after two epochs over all rankable groups of the earlier years."""
    from .scorer import score_inputs, start, train_rows

    x = _inputs(spark, d)
    w, _ = train_rows(x.where("timestamp_ns < 1994"), start(12, 21, "task_id", 7, 2), epochs=2, steps=4, rate=1e-2)
    return score_inputs(x, w, "track_id")


def _inputs(spark, d):
    c = line_candidates(spark, d).withColumns({"raw_tracker_label": F.expr("cast(substr(name, 2) as int)"), "image_path": F.concat(F.lit("i"), F.col("timestamp_ns").cast("string"))})
    c = c.withColumns({"projected_box": F.array(F.lit(0.0), F.lit(0.0), F.least(F.col("area"), F.lit(100.0)), F.lit(1.0)), "size": F.array(F.lit(1.0)), "translation_m": F.array(F.lit(1.0))})
    train = c.where("timestamp_ns < 1994")
    images = c.select("image_path").distinct().withColumn("image", F.array(F.lit(3.0), F.lit(4.0)))
    texts = c.select("prompt").distinct().withColumn("text", F.array(F.lit(1.0), F.lit(1.0)))
    return export.build_inputs(c, export.vocabulary(train.where("name <> 'p3'"), "raw_tracker_label"), export.vocabulary(train.where("prompt <> 'AF'"), "prompt"), images, texts, 200.0, 1.0)


@query("sample_groups_numpy")
def _(spark, d):
    return export.sample_groups(ranking.rankable(line_candidates(spark, d)), 50, 7)


_RANKABLE = "rk AS (SELECT log_id, prompt, timestamp_ns FROM cand GROUP BY ALL HAVING bool_or(label = 0) AND bool_or(label IN (1, 2)))"


@query("sample_groups_keyed", f"""WITH {LINES}, {_RANKABLE}, numbered AS (SELECT *, row_number() OVER (ORDER BY log_id, prompt, timestamp_ns) - 1 AS g, CAST(pow(2, greatest(1, ceil(log2((SELECT count(*) FROM rk)) / 2))) AS BIGINT) AS half FROM rk),
{export.permuted_sql('g', 7, 'half')} SELECT log_id, prompt, timestamp_ns, CAST(row_number() OVER (ORDER BY l, r) - 1 AS INTEGER) AS place FROM p{export.FEISTEL_ROUNDS} ORDER BY l, r LIMIT 50""")
def _(spark, d):
    return export.sample_groups_keyed(ranking.rankable(line_candidates(spark, d)), 50, 7)


@query("epoch_order", f"WITH {DOCS} SELECT track_id, sha256('3|1|' || track_id) AS place FROM cand")
def _(spark, d):
    return export.epoch_order(document_candidates(spark, d).select("track_id"), 3, 1, "track_id")


@query("forbidden_features", f"WITH {LINES} SELECT unnest([{', '.join(f"{{'field': '{f}', 'rows': count({f})}}" for f in ('label', 'name', 'timestamp_ns', 'track_id'))}], recursive := true) FROM cand")
def _(spark, d):
    return audit.forbidden_counts(line_candidates(spark, d))
