"""Shared parts: table access, the shared work folder, grouped Arrow streams and vectorised byte hashing.

Column names that begin with an underscore are the operators' own.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
SPACE_RUN = rf"[{BLANKS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that the Python side handles at once; a longer document is handled alone.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}  # application id -> its temporary folder, where no shared one is set
_written: dict[str, list[str]] = {}  # application id -> tables that cut wrote and nobody removed


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="rankdiag-")
        _own[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankdiag-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    claim(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


_here = threading.local()  # paths that this thread claims within tracked()


def claim(spark: SparkSession, path: str) -> None:
    """Put a path among those that clean deletes."""
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    if getattr(_here, "paths", None) is not None:
        _here.paths.append(path)


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths that this thread claims meanwhile."""
    outer, _here.paths = getattr(_here, "paths", None), []
    try:
        yield _here.paths
    finally:
        own, _here.paths = _here.paths, outer
        if outer is not None:
            outer.extend(own)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.get(spark.sparkContext.applicationId, []).remove(path)


def remove(*tables: DataFrame) -> None:
    """Delete tables that cut wrote, once everything made from them is written."""
    for df in tables:
        _delete(df.sparkSession, df._cut_path)


def written(spark: SparkSession) -> set[str]:
    """Tables that cut wrote in this application and that are still there."""
    return set(_written.get(spark.sparkContext.applicationId, []))


def clean(spark: SparkSession, *keep: DataFrame, only: list[str] | None = None) -> None:
    """Delete all that cut wrote, or of it what is in `only`, but for `keep`; results made from it that are not written yet are lost."""
    gone = written(spark) if only is None else written(spark) & set(only)
    for path in gone - {df._cut_path for df in keep}:
        _delete(spark, path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_RUN), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """One value for all rows equal in id and text."""
    return F.xxhash64(doc_id, text)


def row_twin(doc_id: Column, text: Column) -> Column:
    """Beside row_key, a second value by another hash, so that the two together tell any rows apart."""
    return F.xxhash64(F.lit(7919), text, F.coalesce(doc_id, F.lit(-1)), F.octet_length(text))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


# ---- Arrow streams ---------------------------------------------------------------------------------------------------


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and len(arr) else np.zeros(0, np.uint8)
    return off - off[0], data


def pieces(off: np.ndarray, most: int = BATCH_BYTES, rows: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes and `rows` rows; a longer row makes a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, min(j, n)
        i = min(j, n)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From a stream sorted by keys: tables of whole groups, `least` rows or more but for the last, and the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            v = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        at = bounds(t)
        if len(at) > 2:
            yield t.slice(0, int(at[-2])), at[:-1]
            t = t.slice(int(at[-2]))
        held, rows = t.to_batches(), t.num_rows
        if len(at) <= 2:
            least = max(least, 2 * rows)
    if held:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)


def packed(df: DataFrame, column: str) -> DataFrame:
    """df with a text column replaced by `_packed`, its zstd-compressed bytes (null stays null): less to shuffle."""
    rest = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            col = b.column(b.num_columns - 1)
            off, data = flat(col)
            data = data.tobytes()
            there = col.is_valid().to_numpy(zero_copy_only=False)
            out = [press.compress(data[off[i] : off[i + 1]]) if there[i] else None for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*rest, "_packed"])

    schema = ", ".join(f"`{c}` {k}" for c, k in df.select(*rest).dtypes) + ", _packed binary"
    return df.select(*rest, column).mapInArrow(run, schema)


def unpacked(arr: pa.Array) -> list[bytes | None]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [None if v is None else d.decompress(v) for v in arr.to_pylist()]


# ---- Hashing of bytes ------------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _pow or len(_pow["up"]) <= n:
        size = max(n + 1, BATCH_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[name] = np.cumprod(p)
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2^64 of any substrings of a byte array."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words; no word crosses a row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[data]
    left, right = np.ones(len(data), bool), np.ones(len(data), bool)
    left[1:] = ~ink[:-1]
    right[:-1] = ~ink[1:]
    inner = off[:-1][off[:-1] < len(data)]
    left[inner] = True
    right[off[1:][off[1:] > 0] - 1] = True
    start = np.flatnonzero(ink & left)
    return start, np.flatnonzero(ink & right) + 1, np.searchsorted(off, start, "right") - 1
