import json
import os
import pickle

import pyarrow as pa
import pyarrow.feather
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from rankdiag.operators import align
from rankdiag.sources import readers, writers

FRAME = {"timestamp_ns": 5, "track_id": [1, 2], "score": [0.5, 0.25], "label": [0, 2], "name": ["A", "B"], "translation_m": [[1.0, 2.0, 3.0]] * 2, "size": [[1.0, 1.0, 1.0]] * 2, "yaw": [0.0, 0.1]}


def test_pickle_frames(spark, tmp_path):
    p = str(tmp_path / "x.pkl")
    with open(p, "wb") as f:
        pickle.dump({("log", "q1"): [FRAME, FRAME], ("log", "q2"): [FRAME]}, f)
    with pytest.raises(ValueError):
        readers.load_records(spark, p)
    rows = readers.load_records(spark, p, trusted=True).collect()
    assert len(rows) == 6 and [r["label"] for r in rows[:2]] == ["0", "2"]


def test_bad_lengths():
    with pytest.raises(ValueError):
        list(readers.flatten_frames({("l", "p"): [FRAME | {"yaw": [0.0]}]}))


def test_json_tree(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"log1|find it": {"timestamp": 7, "rows": [{"id": 1, "track_id": "t", "confidence": 0.5, "label": "REFERRED"}]}}))
    r = readers.load_records(spark, str(p)).first()
    assert (r["log_id"], r["prompt"], r["timestamp_ns"], r["track_id"], r["score"], r["label"]) == ("log1", "find it", 7, "t", 0.5, "0")
    assert r["extra"] == {"id": "1"}


def test_feather(spark, tmp_path):
    p = str(tmp_path / "x.feather")
    pyarrow.feather.write_feather(pa.table({"log_id": ["a"], "tx_m": [1.0], "ty_m": [2.0], "tz_m": [3.0]}), p)
    assert readers.read_feather(spark, p).first()["translation_m"] == [1.0, 2.0, 3.0]


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        readers.load_records(spark, "x.xyz")


def test_camera_entry(spark):
    def row(delta):
        return [(json.dumps([{"camera_name": "left", "image_path": None}, {"camera_name": "front", "box": [3, 4, 20, 30], "image_path": "p", "timestamp_delta_ns": delta}]),)]

    got = readers.camera_entry(spark.createDataFrame(row(5), "c string"), "c", "front").first()["entry"]
    assert got["box"] == [3.0, 4.0, 20.0, 30.0]
    with pytest.raises(Exception, match="too far"):
        readers.camera_entry(spark.createDataFrame(row(100_000_001), "c string"), "c", "front").collect()


def test_tracker_index_conflict(spark):
    s = "log_id string, timestamp_ns long, track_id string, label int, name string, score double"
    same = [("a", 1, "t", 0, "n", 0.5)] * 2
    assert readers.tracker_index(spark.createDataFrame(same, s)).count() == 1
    with pytest.raises(Exception, match="conflicting"):
        readers.tracker_index(spark.createDataFrame([*same, ("a", 1, "t", 1, "n", 0.5)], s)).collect()


def test_config():
    assert readers.read_config("a: 1 # x\nb:\n  c: 0.5\n  d: true\ne:\n- x\n- 2\nf: null\n") == {"a": 1, "b": {"c": 0.5, "d": True}, "e": ["x", 2], "f": None}


def test_manifest(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"abc")
    m = writers.manifest([str(p), str(p)], {}, {})
    assert len(m["files"]) == 1 and m["files"][0]["bytes"] == 3
    assert writers.unset_provenance({"a": "UNAVAILABLE_X", "b": "ok", "c": None}) == ["a", "c"]


def test_write_splits(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("train", 2), ("test", 3)], "split string, x long")
    got = {r["split"]: r["rows"] for r in writers.write_splits(df, str(tmp_path / "o")).collect()}
    assert got == {"train": 2, "test": 1}


def test_nearest_ties(spark):
    left = spark.createDataFrame([("k", 10), ("k", 1000)], "k string, t long")
    right = spark.createDataFrame([("k", 5), ("k", 15)], "k string, t long")
    pick = lambda tie: [r["match"]["t"] for r in align.nearest(left, right, ["k"], "t", "t", 5, tie).collect()]
    assert pick("later") == [15] and pick("earlier") == [5]


def test_stream_partners(spark, tmp_path):
    from datetime import datetime

    from rankdiag.streaming.nearest import partners

    df = spark.createDataFrame([("u", datetime(2024, 1, 1, 0, i), i) for i in (0, 3, 30)], "u string, ts timestamp, i int")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = partners(stream(), stream(), ["u"], "ts", "5 minutes", "1 minute").writeStream.format("memory").queryName("near").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("near").count() == 5


def test_feather_reads_only_what_is_asked(spark, tmp_path):
    p = str(tmp_path / "x.feather")
    pyarrow.feather.write_feather(pa.table({"a": list(range(30_000)), "b": ["x"] * 30_000, "c": [0.5] * 30_000}), p, chunksize=7000)
    df = readers.read_feather(spark, p, columns=["c", "a"])
    assert df.columns == ["c", "a"] and df.count() == 30_000 and df.agg({"a": "max"}).first()[0] == 29_999


def test_feather_round_trip(spark, tmp_path):
    p = str(tmp_path / "y")
    df = spark.createDataFrame([(i, None if i % 3 else f"s{i}", [0.5 * i, None]) for i in range(25_000)], "x long, s string, v array<double>").repartitionByRange(3, "x")
    files = writers.write_feather(df, p)
    assert len(files) == 3 and sum(f["rows"] for f in files) == 25_000
    assert all(f["sha256"] == writers.sha256_file(f"{p}/{f['file']}") and f["bytes"] == os.path.getsize(f"{p}/{f['file']}") for f in files)
    got = readers.read_feather(spark, p, place="at").orderBy("at").collect()
    assert [r["x"] for r in got] == list(range(25_000)) and [(r["x"], r["s"], r["v"]) for r in got] == [tuple(r) for r in df.orderBy("x").collect()]
    with pytest.raises(Exception, match="holds files already"):
        writers.write_feather(df, p)
    assert sorted(os.listdir(p)) == sorted([f["file"] for f in files] + ["_manifest.json"])
    again = writers.write_feather(df.limit(5).coalesce(1), p, overwrite=True)
    assert sorted(os.listdir(p)) == sorted([f["file"] for f in again] + ["_manifest.json"]) and readers.read_feather(spark, p).count() == 5
    assert writers.write_feather(df.where("x < 0").coalesce(1), str(tmp_path / "none"))[0]["rows"] == 0


def test_a_failed_feather_run_leaves_nothing(spark, tmp_path):
    p = str(tmp_path / "z")
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        writers.write_feather(bad, p)
    assert not os.path.isdir(p) or os.listdir(p) == []


def test_pickles_hold_plain_data_alone(spark, tmp_path):
    frames = lambda t: [FRAME | {"timestamp_ns": t}, FRAME | {"timestamp_ns": t - 5}]
    for k, log in enumerate(("b", "a")):
        (tmp_path / f"{k}.pkl").write_bytes(pickle.dumps({log: frames(10 * k + 9)}))
    df = readers.read_pickle(spark, str(tmp_path), trusted=True, place="at")
    assert df.rdd.getNumPartitions() == 2
    got = [(r["log_id"], r["timestamp_ns"]) for r in df.orderBy("at").collect()]
    n = len(FRAME["track_id"])
    assert got == [("b", 4)] * n + [("b", 9)] * n + [("a", 14)] * n + [("a", 19)] * n

    class Foreign:
        def __reduce__(self):
            return os.getenv, ("HOME",)

    (tmp_path / "bad.pickle").write_bytes(pickle.dumps({"c": [FRAME | {"x": Foreign()}]}))
    with pytest.raises(Exception, match="may not be in a pickle"):
        readers.read_pickle(spark, str(tmp_path / "bad.pickle"), trusted=True).collect()


def test_rows_keep_their_places_over_splits(spark, tmp_path):
    """A folder of two Parquet files, each read in several splits."""
    n = 40_000
    row = lambda i: {"log_id": "l", "timestamp_ns": i, "track_id": str(i), "name": "n", "translation_m": [0.0], "size": [0.0], "rotation": [0.0], "score": 0.5, "distance_m": 1.0, "synthetic_ego": False, "camera_projections": "x" * (i % 50)}
    (tmp_path / "s_l.parquet").mkdir()
    for k in (1, 0):
        pyarrow.parquet.write_table(pa.Table.from_pylist([row(i) for i in range(k * n, (k + 1) * n)]), str(tmp_path / "s_l.parquet" / f"p{k} a.parquet"), row_group_size=3000)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = readers.read_source_rows(spark, str(tmp_path), ["l"], "s")
        assert df.rdd.getNumPartitions() > 2
        assert [r["timestamp_ns"] for r in df.orderBy("_row_ord").select("timestamp_ns").collect()] == list(range(2 * n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_tracker_frames_by_time():
    rows = list(readers.flatten_frames({"log": [FRAME | {"timestamp_ns": 9}, FRAME | {"timestamp_ns": 3}]}))
    assert [r["timestamp_ns"] for r in rows] == [3, 3, 9, 9]
    with pytest.raises(ValueError, match="twice"):
        list(readers.flatten_frames({"log": [FRAME, FRAME]}))


def test_discovery_and_groups(spark, tmp_path):
    (tmp_path / "d").mkdir()
    lines = [{"log_id": k, "timestamp_ns": t, "prompt": "p", "source": s} for k, t, s in (("b", 1, "s"), ("a", 2, "s"), ("a", 1, "s"), ("a", 0, "other"))]
    (tmp_path / "d" / "g.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    (tmp_path / "x.txt").write_text("")
    (tmp_path / "c.csv").write_text("log_id,score\na,0.5\n")
    assert readers.discover(str(tmp_path)) == [str(tmp_path / "c.csv"), str(tmp_path / "d" / "g.jsonl")]
    assert readers.discover(str(tmp_path), "c.csv") == [str(tmp_path / "c.csv")] and readers.discover(str(tmp_path), "no.csv") == []
    got = readers.read_groups(spark, str(tmp_path / "d" / "g.jsonl"), "s").collect()
    assert [(r["log_id"], r["timestamp_ns"]) for r in got] == [("a", 1), ("a", 2), ("b", 1)]
    assert readers.load_records(spark, str(tmp_path / "c.csv")).first()["score"] == "0.5"


def test_source_rows(spark, tmp_path):
    def write(log, own, drop=()):
        t = {"log_id": [own] * 2, "timestamp_ns": [1, 1], "track_id": ["b", "a"], "name": ["n"] * 2, "translation_m": [[0.0] * 3] * 2, "size": [[1.0] * 3] * 2, "rotation": [[1.0]] * 2, "score": [0.5] * 2, "distance_m": [1.0] * 2, "synthetic_ego": [False] * 2, "camera_projections": ["[]"] * 2}
        pyarrow.feather.write_feather(pa.table({k: v for k, v in t.items() if k not in drop}), str(tmp_path / f"s_{log}.feather"))

    write("l1", "l1")
    write("l2", "other")
    write("l3", "l3", ["size"])
    got = readers.read_source_rows(spark, str(tmp_path), ["l1"], "s").orderBy("_row_ord").collect()
    assert [r["track_id"] for r in got] == ["b", "a"]
    with pytest.raises(Exception, match="holds a row of"):
        readers.read_source_rows(spark, str(tmp_path), ["l2"], "s").collect()
    with pytest.raises(ValueError, match="lacks size"):
        readers.read_source_rows(spark, str(tmp_path), ["l3"], "s")
    with pytest.raises(FileNotFoundError):
        readers.read_source_rows(spark, str(tmp_path), ["l4"], "s")


def test_poses_regions_and_features(spark, tmp_path):
    pose = {"qw": [1.0], "qx": [0.0], "qy": [0.0], "qz": [0.0], "tx_m": [1.0], "ty_m": [2.0], "tz_m": [3.0]}
    pyarrow.feather.write_feather(pa.table({"timestamp_ns": [5], **pose}), str(tmp_path / "p.feather"))
    r = readers.pose_table(spark, str(tmp_path / "p.feather"), "log").first()
    assert (r["log_id"], r["timestamp_ns"], r["tx"], r["tz"]) == ("log", 5, 1.0, 3.0)
    pyarrow.feather.write_feather(pa.table({"timestamp_ns": [5, 5], **{k: v * 2 for k, v in pose.items()}}), str(tmp_path / "q.feather"))
    with pytest.raises(Exception, match="two poses"):
        readers.pose_table(spark, str(tmp_path / "q.feather"), "log").collect()
    (tmp_path / "roi").mkdir()
    (tmp_path / "roi" / "roi_a.csv").write_text("x,y\n0.5,0.5\n0.7,0.2\n-1.5,3\n")
    cells = readers.roi_cells(spark, str(tmp_path / "roi"), "a")
    assert {(r["cx"], r["cy"]) for r in cells.collect()} == {(0, 0), (-2, 3)}
    with pytest.raises(ValueError, match="one region file"):
        readers.roi_cells(spark, str(tmp_path / "roi"), "b")
    s = "kind string, key string, feature array<double>, config string, pretrained boolean"
    spark.createDataFrame([("image", "i", [1.0], "c", True), ("text", "t", [2.0], "c", True), ("text", "u", [2.0], "other", True)], s).write.parquet(str(tmp_path / "f"))
    assert readers.feature_cache(spark, str(tmp_path / "f"), "c", "image").first()["feature"] == [1.0]
    with pytest.raises(Exception, match="bad cache entry"):
        readers.feature_cache(spark, str(tmp_path / "f"), "c", "text").collect()


def test_camera_files_and_models(spark, tmp_path):
    (tmp_path / "front").mkdir()
    for t in (10, 20):
        (tmp_path / "front" / f"{t}.jpg").write_bytes(b"x")
    assert {(r["camera_name"], r["image_timestamp_ns"]) for r in readers.camera_files(spark, str(tmp_path)).collect()} == {("front", 10), ("front", 20)}
    one = spark.createDataFrame([("front", 1.0), ("left", 2.0)], "sensor_name string, fx double")
    assert readers.camera_models(one, spark.createDataFrame([("front", 0.5)], "sensor_name string, tx double")).count() == 1
    with pytest.raises(ValueError):
        readers.camera_models(one, spark.createDataFrame([("rear", 0.5)], "sensor_name string, tx double"))


def test_selected_columns_and_logs(spark, tmp_path):
    spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "log_id string, x long, y long").write.parquet(str(tmp_path / "t"))
    df = readers.load_selected(spark, str(tmp_path / "t"), ["b"], ["x"])
    assert [tuple(r) for r in df.collect()] == [(3,)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "y#" not in plan and "PushedFilters: [IsNotNull(log_id), EqualTo(log_id,b)]" in plan or "In(log_id" in plan


def test_reports_and_provenance(spark, tmp_path):
    import numpy as np

    writers.write_report({"b": np.float64(0.5), "a": np.arange(2)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [0, 1], "b": 0.5}
    with pytest.raises(ValueError):
        writers.write_report({"a": float("nan")}, str(tmp_path / "r.json"))
    writers.write_csv(spark.createDataFrame([(1, "x")], "a long, b string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["b"] == "x"
    p = writers.provenance([str(tmp_path / "r.json")], "u", "r", "l")
    assert p["files"][0]["sha256"] == writers.sha256_file(str(tmp_path / "r.json")) and p["license"] == "l"


def test_split_files_have_digests(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", "p", 1), ("test", "a", "p", 2), ("test", "a", "p", 2)], "split string, log_id string, prompt string, timestamp_ns long")
    got = {r["split"]: (r["rows"], r["groups"]) for r in writers.write_splits(df, str(tmp_path / "o")).collect()}
    assert got == {"train": (1, 1), "test": (2, 1)}
    files = writers.split_files(spark, str(tmp_path / "o")).collect()
    assert {(r["split"], r["kind"]) for r in files} >= {("train", "parquet"), ("test", "jsonl")}
    for r in files:
        assert r["sha256"] == writers.sha256_file(r["path"].removeprefix("file:"))


def test_json_config():
    assert readers.read_config('{"a": {"b": [1, null]}}') == {"a": {"b": [1, None]}}


def test_imports_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; import rankdiag.operators.export, rankdiag.streaming.nearest; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
