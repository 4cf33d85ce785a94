"""Readers that bring records of several formats into DataFrames."""

from __future__ import annotations

import itertools
import json
import os
import pickle
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import label_text

#: Old field names and the names they stand for (fixed values).
ALIASES = {
    "seq_id": "log_id",
    "timestamp": "timestamp_ns",
    "time_ns": "timestamp_ns",
    "track": "track_id",
    "confidence": "score",
    "object_label": "label",
    "translation": "translation_m",
    "position": "translation_m",
    "extent": "size",
    "heading": "yaw",
    "track_uuid": "track_id",
    "mining_category": "label",
}

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
_KINDS = {"log_id": _S, "prompt": _S, "timestamp_ns": _L, "track_id": _S, "score": _D, "label": _S, "name": _S, "translation_m": T.ArrayType(_D), "size": T.ArrayType(_D), "yaw": _D}
RECORD = T.StructType([T.StructField(n, k) for n, k in _KINDS.items()])
SUFFIXES = (".jsonl", ".json", ".csv", ".feather", ".parquet", ".pkl", ".pickle")


def normalize(df: DataFrame) -> DataFrame:
    """Aliases become their names only where the name is absent; labels are coerced where they can be; other columns stay."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "timestamp_ns" in df.columns:
        df = df.withColumn("timestamp_ns", F.col("timestamp_ns").try_cast("bigint"))
    if dict(df.dtypes).get("label") == "string":
        df = df.withColumn("label", label_text(F.col("label")))
    return df


def flatten_tree(value, context: dict | None = None) -> Iterator[dict]:
    """Rows of a JSON tree: a mapping with track_id, label or translation_m is a row; keys `a|b` give log_id and prompt."""
    context = dict(context or {})
    if isinstance(value, list):
        for v in value:
            yield from flatten_tree(v, context)
    elif isinstance(value, dict):
        if value.keys() & {"track_id", "label", "translation_m"}:
            yield {**context, **value}
            return
        own = context | {k: v for k, v in value.items() if not isinstance(v, (dict, list))}
        for k, v in value.items():
            if isinstance(v, (dict, list)):
                log, bar, prompt = k.partition("|")
                yield from flatten_tree(v, own | ({"log_id": log, "prompt": prompt} if bar else {}))


def flatten_frames(tree: dict) -> Iterator[dict]:
    """Rows of {(log_id, prompt): [frames]} or {log_id: [frames]}, frames holding one array for each field; lengths must agree.

    Frames of a log alone (a tracker's) are taken in order of time; a time that comes twice is an error.
    """
    for key, frames in tree.items():
        own = dict(zip(("log_id", "prompt"), key if isinstance(key, tuple) else (key,), strict=False))
        if "prompt" not in own:
            frames = sorted(frames, key=lambda f: int(f["timestamp_ns"]))
            times = [int(f["timestamp_ns"]) for f in frames]
            if again := [b for a, b in zip(times, times[1:], strict=False) if a == b]:
                raise ValueError(f"{key}: time {again[0]} comes twice")
        for index, frame in enumerate(frames):
            arrays = {k: list(v) for k, v in frame.items() if hasattr(v, "__len__") and not isinstance(v, (str, bytes))}
            n = len(arrays.get("track_id", ()))
            if bad := [k for k, v in arrays.items() if len(v) != n]:
                raise ValueError(f"{key} frame {index}: {', '.join(bad)} not of length {n}")
            rest = {k: v for k, v in frame.items() if k not in arrays}
            for i in range(n):
                yield own | rest | {k: v[i] for k, v in arrays.items()} | {"frame_index": index}


class _FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FeatherReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str], place: str | None):
        self.paths, self.names, self.place = paths, names, place

    def partitions(self):
        return [_FilePart(p) for p in self.paths]

    def read(self, partition):
        stored = [n for n in self.names if n != self.place]
        with pa.memory_map(partition.path) as f:
            file = pa.ipc.open_file(f, options=_only(pa.ipc.open_file(f).schema, stored))
            row = self.paths.index(partition.path) << 33
            for k in range(file.num_record_batches):
                batch = file.get_batch(k)
                for i in range(0, batch.num_rows, 10_000):
                    part = batch.slice(i, 10_000).select(stored)
                    if self.place in self.names:
                        at = pa.array(range(row, row + part.num_rows), pa.int64())
                        part = pa.RecordBatch.from_arrays([*part.columns, at], [*stored, self.place]).select(self.names)
                    yield part
                    row += part.num_rows


def _only(schema: pa.Schema, names: list[str]) -> pa.ipc.IpcReadOptions:
    return pa.ipc.IpcReadOptions(included_fields=sorted(schema.get_field_index(n) for n in names))


class FeatherSource(DataSource):
    """`feather`: one task a file, a record batch at a time. Options: paths, a JSON list; columns, a JSON list of those to read; place.

    The schema comes from the first file's footer. place names a column to be added: the row's place, counted on from the
    offsets of its file's record batches, files in their order.
    """

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(json.loads(self.options["paths"])[0]) as f:
            schema = pa.ipc.open_file(f).schema
        names = json.loads(self.options.get("columns", "null")) or schema.names
        made = [pa.field(self.options["place"], pa.int64())] if "place" in self.options else []
        return from_arrow_schema(pa.schema([*(schema.field(n) for n in names), *made]))

    def reader(self, schema):
        return _FeatherReader(json.loads(self.options["paths"]), schema.names, self.options.get("place"))


def _below(paths, suffix: str) -> list[str]:
    """Files as they are given, and of folders all files of a suffix in order of their names."""
    return [f"{p}/{x}" if os.path.isdir(p) else p for p in paths for x in (sorted(n for n in os.listdir(p) if n.endswith(suffix)) if os.path.isdir(p) else [p])]


def read_feather(spark: SparkSession, *paths: str, columns: list[str] | None = None, place: str | None = None) -> DataFrame:
    """Feather files or folders of them, or only some of their columns, with translation_m and size made from single columns where those are there; place names a column of the rows' places."""
    spark.dataSource.register(FeatherSource)
    source = spark.read.format("feather").option("paths", json.dumps(_below(paths, ".feather"))).option("columns", json.dumps(columns))
    df = (source.option("place", place) if place else source).load()
    for name, parts in (("translation_m", ("tx_m", "ty_m", "tz_m")), ("size", ("length_m", "width_m", "height_m"))):
        if name not in df.columns and set(parts) <= set(df.columns):
            df = df.withColumn(name, F.array(*parts))
    return df


def read_json_tree(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as trees, each flattened in a task of its own; `extra` maps the fields that the contract does not name to their JSON."""
    names = [f.name for f in RECORD]
    schema = T.StructType([*RECORD.fields, T.StructField("extra", T.MapType(_S, _S))])

    def run(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                rows = []
                for found in flatten_tree(json.loads(text)):
                    r = {new: found[old] for old, new in ALIASES.items() if old in found} | {k: v for k, v in found.items() if k not in ALIASES}
                    row = {n: r.get(n) for n in names} | {n: None if r.get(n) is None else str(r[n]) for n in ("track_id", "label", "log_id", "prompt", "name")}
                    row["timestamp_ns"] = None if row["timestamp_ns"] is None else int(row["timestamp_ns"])
                    row["extra"] = {k: json.dumps(v) for k, v in r.items() if k not in names}
                    rows.append(row)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))

    return spark.read.text(path, wholetext=True).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: What a pickle of frames may call: containers, numbers, and numpy's arrays (fixed values).
PICKLED = {
    ("builtins", "dict"), ("builtins", "list"), ("builtins", "tuple"), ("builtins", "set"), ("builtins", "frozenset"), ("builtins", "bytearray"), ("builtins", "complex"),
    ("collections", "OrderedDict"), ("collections", "defaultdict"), ("_codecs", "encode"), ("numpy", "ndarray"), ("numpy", "dtype"),
    *((f"numpy.{core}.{part}", name) for core in ("core", "_core") for part, name in (("multiarray", "_reconstruct"), ("multiarray", "scalar"), ("numeric", "_frombuffer"))),
}


class _Frames(pickle.Unpickler):
    """Loads plain containers and numpy arrays; any other class or function is an error, so that no code runs."""

    def find_class(self, module: str, name: str):
        if (module, name) in PICKLED:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} may not be in a pickle of frames")


_FRAMES = T.StructType([*RECORD.fields, T.StructField("frame_index", T.IntegerType())])


class _PickleReader(DataSourceReader):
    def __init__(self, paths: list[str], place: str | None):
        self.paths, self.place = paths, place

    def partitions(self):
        return [_FilePart(p) for p in self.paths]

    def read(self, partition):
        kinds = {f.name: f.dataType for f in RECORD}
        plain = lambda n, v: None if v is None else str(v) if isinstance(kinds[n], T.StringType) else [float(x) for x in v] if isinstance(kinds[n], T.ArrayType) else int(v) if isinstance(kinds[n], T.LongType) else float(v)
        with open(partition.path, "rb") as f:
            rows = flatten_frames(_Frames(f).load())
        row = self.paths.index(partition.path) << 33
        schema = _arrow(T.StructType([*_FRAMES.fields, *([T.StructField(self.place, _L)] if self.place else [])]))
        while held := list(itertools.islice(rows, 10_000)):
            made = [{n: plain(n, r.get(n)) for n in kinds} | {"frame_index": r["frame_index"]} | ({self.place: row + i} if self.place else {}) for i, r in enumerate(held)]
            yield pa.RecordBatch.from_pylist(made, schema=schema)
            row += len(made)


class PickleSource(DataSource):
    """`frames_pickle`: scenario or tracker pickles, one task a file. Options: paths, a JSON list; place, as for feather."""

    @classmethod
    def name(cls) -> str:
        return "frames_pickle"

    def schema(self):
        return T.StructType([*_FRAMES.fields, *([T.StructField(self.options["place"], _L)] if "place" in self.options else [])])

    def reader(self, schema):
        return _PickleReader(json.loads(self.options["paths"]), self.options.get("place"))


def read_pickle(spark: SparkSession, *paths: str, trusted: bool = False, place: str | None = None) -> DataFrame:
    """Scenario or tracker pickles, or folders of them, read by one task a file with an unpickler that knows plain data alone.

    A file is unpickled whole, by the task that reads it. Even so only for files whose origin is known: trusted=True.
    """
    if not trusted:
        raise ValueError("a pickle is read only with trusted=True")
    spark.dataSource.register(PickleSource)
    source = spark.read.format("frames_pickle").option("paths", json.dumps(_below(paths, (".pkl", ".pickle"))))
    return (source.option("place", place) if place else source).load()


def load_records(spark: SparkSession, path: str, schema: T.StructType | None = None, trusted: bool = False) -> DataFrame:
    """By suffix; an unknown one is an error."""
    kind = next((s for s in SUFFIXES if path.rstrip("/").endswith(s)), None)
    if kind == ".jsonl":
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    elif kind == ".json":
        df = read_json_tree(spark, path)
    elif kind == ".csv":
        df = spark.read.option("header", True).csv(path)
    elif kind == ".feather":
        df = read_feather(spark, path)
    elif kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind in (".pkl", ".pickle"):
        df = read_pickle(spark, path, trusted=trusted)
    else:
        raise ValueError(f"no reader for {path}")
    return normalize(df)


def load_selected(spark: SparkSession, path: str, logs: list[str], columns: list[str]) -> DataFrame:
    """Chosen columns and logs of a Parquet table; both reach the scan."""
    return spark.read.parquet(path).where(F.col("log_id").isin(logs)).select(*columns)


def camera_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, camera_name, image_timestamp_ns) of images named by their time; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(path).select("path")
    return f.select("path", F.regexp_extract("path", r"/([^/]+)/[0-9]+\.jpg$", 1).alias("camera_name"), F.regexp_extract("path", r"([0-9]+)\.jpg$", 1).try_cast("bigint").alias("image_timestamp_ns"))


def camera_models(intrinsics: DataFrame, extrinsics: DataFrame) -> DataFrame:
    """Both by sensor_name; sensors that lack one are left out, none at all is an error."""
    models = intrinsics.join(extrinsics, "sensor_name")
    if models.isEmpty():
        raise ValueError("no sensor has intrinsics and extrinsics")
    return models


def tracker_index(frames: DataFrame) -> DataFrame:
    """(log_id, timestamp_ns, track_id) -> label, name, score. Equal repeats are one row; differing ones fail."""
    value = F.struct("label", "name", "score")
    g = frames.groupBy("log_id", "timestamp_ns", "track_id").agg(F.count_distinct(value).alias("_n"), F.first(value).alias("v"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("conflicting rows of track "), F.col("track_id").cast("string")))).otherwise(F.col("v"))
    return g.select("log_id", "timestamp_ns", "track_id", checked.alias("v")).select("log_id", "timestamp_ns", "track_id", "v.label", "v.name", "v.score")


CAMERA = "array<struct<camera_name:string,status:string,box:array<double>,image_path:string,image_timestamp_ns:bigint,timestamp_delta_ns:bigint>>"


def camera_entry(df: DataFrame, column: str, camera: str, tolerance_ns: int = 100_000_000) -> DataFrame:
    """df with `entry`: the one projection of a camera out of a JSON list; anything else fails."""
    found = F.filter(F.from_json(column, CAMERA), lambda c: c["camera_name"] == camera)
    one = F.get(found, 0)
    problem = (
        F.when(F.size(found) != 1, "camera is not there exactly once")
        .when(one["image_path"].isNull(), "no image path")
        .when(F.abs(one["timestamp_delta_ns"]) > tolerance_ns, "image too far in time")
    )
    return df.withColumn("_found", found).withColumn("entry", F.when(F.size("_found").isNull() | problem.isNotNull(), F.raise_error(F.coalesce(problem, F.lit("no list")))).otherwise(one)).drop("_found")


def discover(path: str, explicit: str | None = None) -> list[str]:
    """Record files: the explicit one (as given, or under path), else all below path with a known suffix, sorted."""
    if explicit:
        found = next((p for p in (explicit, os.path.join(path, explicit)) if os.path.isfile(p)), None)
        return [found] if found else []
    if os.path.isfile(path):
        return [path]
    below = (os.path.join(at, name) for at, _, names in os.walk(path) for name in names)
    return sorted(p for p in below if p.endswith(SUFFIXES))


def read_groups(spark: SparkSession, path: str, source: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Group records of one source from JSON lines, in order of log, time and prompt."""
    lines = spark.read.schema(schema) if schema else spark.read
    g = lines.json(path).where(F.col("source") == source)
    return g.orderBy(F.col("log_id").cast("string"), F.col("timestamp_ns").cast("bigint"), F.col("prompt").cast("string"))


#: Columns that a source's rows must have (fixed values).
SOURCE_COLUMNS = ("log_id", "timestamp_ns", "track_id", "name", "translation_m", "size", "rotation", "score", "distance_m", "synthetic_ego", "camera_projections")


def placed_parquet(spark: SparkSession, path: str, place: str) -> DataFrame:
    """A Parquet file or folder with the rows' places: files in order of their names, rows as their file has them."""
    df = spark.read.parquet(path)
    names = sorted((os.path.basename(p) for p in df.inputFiles()), key=unquote)  # both as parts of URIs
    file = F.array_position(F.array(*map(F.lit, names)), F.col("_metadata.file_name")) - 1
    return df.select("*", (F.shiftleft(file, 33) + F.col("_metadata.row_index")).alias(place))


def read_source_rows(spark: SparkSession, folder: str, logs: list[str], source: str) -> DataFrame:
    """Rows of `<source>_<log>.parquet` or .feather, one file or folder a log, with _row_ord, their order within it.

    The order is that of the files' names and of the rows in them, however files are split among tasks. A file that is not there or lacks a column, and a row of another log than its file's, are errors.
    """
    out = None
    for log in sorted(map(str, logs)):
        at = next((p for p in (f"{folder}/{source}_{log}.parquet", f"{folder}/{source}_{log}.feather") if os.path.exists(p)), None)
        if at is None:
            raise FileNotFoundError(f"no rows of {source} for {log} in {folder}")
        df = placed_parquet(spark, at, "_row_ord") if at.endswith(".parquet") else read_feather(spark, at, place="_row_ord")
        if lacking := sorted(set(SOURCE_COLUMNS) - set(df.columns)):
            raise ValueError(f"{at} lacks {', '.join(lacking)}")
        own = F.when(F.col("log_id").cast("string") == log, F.col("log_id").cast("string")).otherwise(F.raise_error(F.concat(F.lit(f"{at} holds a row of "), F.col("log_id").cast("string"))))
        df = df.withColumn("log_id", own)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no logs")
    return out


def pose_table(spark: SparkSession, path: str, log_id: str) -> DataFrame:
    """(log_id, timestamp_ns, qw, qx, qy, qz, tx, ty, tz) of a log's pose file; a time that comes twice is an error."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else read_feather(spark, path)
    once = df.groupBy("timestamp_ns").agg(F.count("*").alias("n"), F.first(F.struct("qw", "qx", "qy", "qz", F.col("tx_m").alias("tx"), F.col("ty_m").alias("ty"), F.col("tz_m").alias("tz"))).alias("p"))
    pose = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two poses at "), F.col("timestamp_ns").cast("string")))).otherwise(F.col("p"))
    return once.select(F.lit(log_id).alias("log_id"), "timestamp_ns", pose.alias("p")).select("log_id", "timestamp_ns", "p.*")


def roi_cells(spark: SparkSession, folder: str, log_id: str, size: float = 1.0) -> DataFrame:
    """(log_id, cx, cy) of a log's region of interest: the one file of points (x, y) named for it, as cells of `size`."""
    files = sorted(p for p in discover(folder) if os.path.basename(p).startswith(f"roi_{log_id}"))
    if len(files) != 1:
        raise ValueError(f"one region file is wanted for {log_id}, {len(files)} are there")
    df = load_records(spark, files[0])
    return df.select(F.lit(log_id).alias("log_id"), F.floor(F.col("x").cast("double") / size).alias("cx"), F.floor(F.col("y").cast("double") / size).alias("cy")).distinct()


def inside_roi(corners: DataFrame, cells: DataFrame, size: float = 1.0) -> DataFrame:
    """(log_id, id, inside) of boxes (log_id, id, corners: an array of x, y structs): whether any corner is in a cell."""
    c = corners.select("log_id", "id", F.explode("corners").alias("c")).select("log_id", "id", F.floor(F.col("c.x") / size).alias("cx"), F.floor(F.col("c.y") / size).alias("cy"))
    hit = cells.withColumn("_hit", F.lit(True))
    return c.join(hit, ["log_id", "cx", "cy"], "left").groupBy("log_id", "id").agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("inside"))


def feature_cache(spark: SparkSession, path: str, config: str, kind: str) -> DataFrame:
    """(key, feature) of a cache of one kind (image or text), Parquet with columns kind, key, feature, config, pretrained.

    Another configuration, one that is not pretrained, a key without a feature and a key that comes twice are errors.
    """
    df = spark.read.parquet(path).where(F.col("kind") == kind)
    g = df.groupBy("key").agg(F.count("*").alias("n"), F.first("feature").alias("feature"), F.bool_and((F.col("config") == config) & F.col("pretrained")).alias("own"))
    ok = F.coalesce(F.col("own") & (F.col("n") == 1) & F.col("feature").isNotNull(), F.lit(False))
    return g.select("key", F.when(ok, F.col("feature")).otherwise(F.raise_error(F.concat(F.lit("bad cache entry: "), F.coalesce("key", F.lit("null"))))).alias("feature"))


def read_config(text: str) -> dict:
    """JSON, or scalars, flat lists and one level of nesting in a small part of YAML; # begins a comment there."""
    if text.lstrip()[:1] == "{":
        return json.loads(text)


    def atom(s: str):
        s = s.strip()
        if s[:1] in "\"'" and s[:1]:
            return s.strip(s[0])
        if s.lower() in ("null", "~", ""):
            return None
        if s.lower() in ("true", "false"):
            return s.lower() == "true"
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                continue
        return [atom(x) for x in s[1:-1].split(",") if x.strip()] if s[:1] == "[" else s

    out: dict = {}
    at: str | None = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        key, colon, value = line.strip().partition(":")
        if line.lstrip().startswith("- "):
            out[at] = [*(out[at] or []), atom(line.strip()[2:])]
        elif line[0] == " " and at is not None and colon:
            out[at] = (out[at] or {}) | {key: atom(value)}
        else:
            at = key
            out[key] = atom(value)
    return out
