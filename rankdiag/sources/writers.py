"""Writers of splits, reports and manifests with digests."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.base import GROUP


def write_splits(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Parquet and canonical JSON lines by split; returns rows, groups and an order-free digest of each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/parquet")
    line = F.to_json(F.struct(*sorted(c for c in df.columns if c != split)))
    df.select(split, line.alias("value")).write.mode("overwrite").partitionBy(split).text(f"{path}/jsonl")
    groups = F.count_distinct(*GROUP) if set(GROUP) <= set(df.columns) else F.lit(None).cast("long")
    digest = F.sum(F.conv(F.substring(F.sha2("v", 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.withColumn("v", line).groupBy(split).agg(F.count("*").alias("rows"), groups.alias("groups"), digest.alias("digest"))


def split_files(spark, path: str) -> DataFrame:
    """(split, kind, path, length, sha256) of the files that write_splits wrote."""
    split, kind = F.regexp_extract("path", r"/[^/=]+=([^/]+)/", 1), F.regexp_extract("path", r"/(parquet|jsonl)/[^/=]+=", 1)
    found = file_digests(spark, f"{path}/parquet").unionByName(file_digests(spark, f"{path}/jsonl"))
    return found.select(split.alias("split"), kind.alias("kind"), "path", "length", "sha256").where("kind <> ''")


class _Part(WriterCommitMessage):
    def __init__(self, path: str, rows: int, size: int, sha256: str):
        self.path, self.rows, self.size, self.sha256 = path, rows, size, sha256


class _FeatherWriter(DataSourceArrowWriter):
    """A task writes its rows, batch by batch, into a hidden file of its own; commit gives the files their names."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.run = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        at = f"{self.path}/.part-{task.partitionId():05d}-{self.run}-{task.taskAttemptId()}"
        schema, rows = to_arrow_schema(self.schema), 0
        with pa.OSFile(at, "wb") as f, pa.ipc.new_file(f, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            for b in iterator:
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(b.columns, schema, strict=True)], schema=schema))
                rows += b.num_rows
        return _Part(at, rows, os.path.getsize(at), sha256_file(at))

    def commit(self, messages: list[_Part | None]) -> None:
        """Name the files of the tasks that ended, put the manifest beside them, and clear what else is there."""
        parts = sorted((m for m in messages if m), key=lambda m: os.path.basename(m.path))
        older = [p for p in os.listdir(self.path) if p.endswith(".feather")] if os.path.isdir(self.path) else []
        if older and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds files already")
        os.makedirs(self.path, exist_ok=True)
        files = []
        for m in parts:
            name = f"part-{len(files):05d}-{self.run}.feather"
            os.replace(m.path, f"{self.path}/{name}")
            files.append({"file": name, "rows": m.rows, "bytes": m.size, "sha256": m.sha256})
        kept = {f["file"] for f in files}
        with open(f"{self.path}/.manifest-{self.run}", "w") as f:
            json.dump({"files": files}, f, indent=2)
        os.replace(f"{self.path}/.manifest-{self.run}", f"{self.path}/{MANIFEST}")
        for p in os.listdir(self.path):
            if p.startswith(".part-") and self.run in p or p.endswith(".feather") and p not in kept:
                os.remove(f"{self.path}/{p}")

    def abort(self, messages: list[_Part | None]) -> None:
        """Remove this run's files; those of other runs stay."""
        for p in os.listdir(self.path) if os.path.isdir(self.path) else []:
            if p.startswith(".part-") and self.run in p:
                os.remove(f"{self.path}/{p}")


class FeatherSink(DataSource):
    """`feather_files`: a folder of Feather files, one for each task. Option: path, a folder that all tasks see."""

    @classmethod
    def name(cls) -> str:
        return "feather_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> _FeatherWriter:
        return _FeatherWriter(self.options["path"], schema, overwrite)


#: The file that lists what a folder of Feather files holds.
MANIFEST = "_manifest.json"


def write_feather(df: DataFrame, path: str, overwrite: bool = False) -> list[dict]:
    """A folder of Feather files, one a task, and its manifest; returns the manifest's entries (file, rows, bytes, sha256).

    No row passes the driver. Nothing shows under its name before all tasks have ended; a run that fails leaves nothing.
    """
    df.sparkSession.dataSource.register(FeatherSink)
    df.write.format("feather_files").option("path", path).mode("overwrite" if overwrite else "append").save()
    with open(f"{path}/{MANIFEST}") as f:
        return json.load(f)["files"]


def provenance(paths: list[str], source_url: str, source_revision: str, license_name: str, version: str = "1") -> dict:
    """Where files come from, with their sizes and digests."""
    files = [{"path": os.path.abspath(p), "size_bytes": os.path.getsize(p), "sha256": sha256_file(p)} for p in paths]
    return {"version": version, "source_url": source_url, "source_revision": source_revision, "license": license_name, "files": files}


def write_report(report: Any, path: str) -> None:
    """A small result as indented JSON with sorted keys; NaN is an error."""
    with open(path, "w") as f:
        json.dump(plain(report), f, indent=2, sort_keys=True, allow_nan=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def plain(value: Any) -> Any:
    """numpy scalars and arrays as plain Python."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value.tolist() if hasattr(value, "tolist") else value


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(paths: list[str], config: dict, inspection: dict) -> dict:
    """Files once each, sorted, with size and digest."""
    files = [{"path": p, "sha256": sha256_file(p), "bytes": os.path.getsize(p)} for p in sorted(set(paths))]
    return {"files": files, "config": plain(config), "inspection": plain(inspection)}


def file_digests(spark, path: str) -> DataFrame:
    """(path, length, sha256) of many small files, in tasks."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unset_provenance(record: dict) -> list[str]:
    """Fields that are placeholders or unavailable."""
    return sorted(k for k, v in record.items() if v in (None, "") or str(v).upper().startswith(("UNAVAILABLE_", "TODO", "PLACEHOLDER")))
