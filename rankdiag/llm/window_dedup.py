"""Substring dedup: word windows that start in an earlier document, found behind a count-min prefilter.

Words are runs of characters other than ASCII white space, unchanged. A window is SIZE consecutive words of one document.
A word goes when a window that covers it also starts in a document with a smaller doc_id, judged on the input; the
smallest doc_id that has a window decides, so no pair of documents is ever formed.

Pieces. A window is filed under its anchor, the smallest hashed run of GRAM words in it (leftmost on ties); consecutive
windows of one anchor make a piece, of SIZE - GRAM + 1 windows at most. Equal windows have equal anchors.

First pass, the sketch. Each partition counts its pieces' anchors in a count-min sketch; partition sketches are merged by
sums. A window's estimate is its anchor's, which is never below the window's own count. The sketch is dealt into blocks
of DEPTH rows of WIDTH counters, each anchor's counters in one block, and blocks into sections; a partition's sketch
travels as the counters it touched, a row for each section, sections are merged one by one, and blocks meet the pieces by
a join: nothing is broadcast, and a task holds one section at a time. The number of blocks follows the number of pieces (PER_BLOCK to a block), so the share of false
repeats is the same at every size. Counters stop at 2, which is all that "repeated" asks.

Second pass, exact. Pieces of anchors estimated once leave. The others are grouped by two 64-bit hashes of the whole
piece: all documents of a piece but the first lose it wholly. Where an anchor has several different pieces, the windows of one
copy of each (its first document's) are grouped by two 64-bit hashes in turn, and the first document of a piece loses the
windows that an earlier document has in another piece.

Defined cases: null and empty texts have 0 words. A null doc_id is neither smaller nor greater than any other: such rows
lose nothing and take nothing from others. Rows that share a doc_id are one document: they take nothing from each other.
Repeated rows stay. Extra columns pass through `dedup_windows`; the added ones replace columns of the same name. Memory
grows with the longest document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, cut, flat, mix, packed, pieces, remove, table, unpacked, word_spans
from .suffix_dedup import cover, merged

SIZE, GRAM = 50, 16
DEPTH, WIDTH, PER_BLOCK = 4, 256, 64
SECTION = 4096  # blocks that travel and are merged together: 4 MB of counters in a task
SKETCHED = 1 << 20  # anchors that a partition counts before it passes a sketch on

_OTHER = mix(np.arange(1, 257, dtype=np.uint64))


def hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, and the offsets of rows in words."""
    start, end, row = word_spans(data, off)
    first = np.searchsorted(row, np.arange(len(off)))
    if not len(start):
        z = np.zeros(0, np.uint64)
        return z, z, first
    n = (end - start).astype(np.uint64)
    return mix(Rolling(data).of(start, end) + n), mix(Rolling(_OTHER[data]).of(start, end) + n), first


PIECES = "doc_id long, text_hash long, start int, windows int, anchor long, piece long, twin long"


def _cover(size: int, gram: int):
    """(doc_id, hash of the text, text) -> the pieces of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(2))
            doc, text = b.column(0), b.column(1)
            for i, j in pieces(off):
                one, two, first = hashed(data[off[i] : off[j]], off[i : j + 1] - off[i])
                row, start, n, anchor, piece = cover(one, first, size, gram)
                if not len(row):
                    continue
                at = first[row] + start
                twin = Rolling(two).of(at, at + n - 1 + size)
                row = pa.array(row + i)
                cols = [doc.take(row), text.take(row), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x.view(np.int64)) for x in (anchor, piece, twin))], [c.split()[0] for c in PIECES.split(", ")])

    return run


# ---- The sketch ------------------------------------------------------------------------------------------------------


def block_of(anchor: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(anchor), F.lit(blocks))


def counters_of(anchor: Column) -> Column:
    """DEPTH bytes, the anchor's counter in each row of its block, as one number."""
    return F.xxhash64(anchor, F.lit(1)).bitwiseAND(F.lit((1 << 8 * DEPTH) - 1))


def partial(block: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections touched, and for each its counters in order, one that was met twice or more written twice: bounds, values."""
    cells = np.stack([(counters >> (8 * r) & (WIDTH - 1)) + WIDTH * r for r in range(DEPTH)], 1)
    key, n = np.unique((block[:, None] * (DEPTH * WIDTH) + cells).ravel(), return_counts=True)
    key = np.repeat(key, np.minimum(n, 2))
    own, at = np.unique(key // (SECTION * DEPTH * WIDTH), return_index=True)
    return own, np.append(at, len(key)), (key % (SECTION * DEPTH * WIDTH)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, counters) of pieces -> sketches of the partition: (section, cells)."""
    held: list[np.ndarray] = []

    def made() -> pa.RecordBatch:
        section, at, cells = partial(*np.concatenate(held, 1))
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(section), [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(cells)])
        return pa.RecordBatch.from_arrays([pa.array(section), out.cast(pa.binary())], ["section", "cells"])

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
        if sum(x.shape[1] for x in held) >= SKETCHED:
            yield made()
            held.clear()
    if held and sum(x.shape[1] for x in held):
        yield made()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches sorted by section -> for each block a bit for each counter that is 2 or more; blocks without one go."""
    per = DEPTH * WIDTH
    section, n = None, np.zeros(0, np.uint8)

    def told() -> pa.RecordBatch:
        bits = np.packbits((n >= 2).reshape(SECTION, per), axis=1, bitorder="little").view(np.int64)
        some = np.flatnonzero(bits.any(1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (per // 64), pa.int32()), pa.array(bits[some].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(section * SECTION + some), values], ["block", "bits"])

    for b in batches:
        for i in range(b.num_rows):
            if b.column(0)[i].as_py() != section:
                if section is not None:
                    yield told()
                section, n = b.column(0)[i].as_py(), np.zeros(SECTION * per, np.uint8)
            cells = np.frombuffer(b.column(1)[i].as_buffer(), np.uint32)
            twice = cells[1:][cells[1:] == cells[:-1]]
            n[cells] = np.minimum(n[cells] + 1, 2)
            n[twice] = 2
    if section is not None:
        yield told()


def estimated_repeated(found: DataFrame) -> DataFrame:
    """The rows whose anchor the merged sketch puts at 2 or more; found: a written table with a column anchor."""
    blocks = max(1, -(-found.count() // PER_BLOCK))
    keyed = found.select(block_of(F.col("anchor"), blocks).alias("block"), counters_of(F.col("anchor")).alias("counters"))
    parts = keyed.mapInArrow(_sketch, "section long, cells binary")
    sketch = parts.repartition("section").sortWithinPartitions("section").mapInArrow(_merge, "block long, bits array<long>")
    sketch = cut(sketch, "sketch")
    both = found.withColumn("block", block_of(F.col("anchor"), blocks)).join(sketch.hint("merge"), "block")
    both = both.withColumn("_c", counters_of(F.col("anchor")))
    for r in range(DEPTH):
        c = f"(shiftright(_c, {8 * r}) & {WIDTH - 1})"
        both = both.where(F.expr(f"getbit(bits[cast({r * WIDTH // 64} + shiftright({c}, 6) as int)], cast({c} & 63 as int)) = 1"))
    out = cut(both.select(*found.columns), "repeated")
    remove(sketch)
    return out


# ---- The second pass -------------------------------------------------------------------------------------------------

WINDOWS = "pid long, place int, doc_id long, one long, two long"


def _windows(size: int):
    """(doc_id, packed text, pieces asked of it) -> a row for each window of those pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(2)
            at, vals = wanted.offsets.to_numpy(), wanted.values
            start, windows, pid = (vals.field(x).to_numpy() for x in ("start", "windows", "pid"))
            doc = b.column(0).to_numpy()
            for i in range(b.num_rows):
                text = unpacked(b.column(1).slice(i, 1))[0]
                one, two, _ = hashed(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                roll = Rolling(one), Rolling(two)
                for k in range(at[i], at[i + 1], 4096):
                    g = np.arange(k, min(k + 4096, at[i + 1]))
                    n = windows[g].astype(np.int64)
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    x = np.repeat(start[g], n) + place
                    h = [pa.array(mix(r.of(x, x + size)).view(np.int64)) for r in roll]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pid[g], n)), pa.array(place, pa.int32()), pa.array(np.full(len(x), doc[i])), *h], [c.split()[0] for c in WINDOWS.split(", ")])

    return run


def _remove(at_text: int, name: str):
    """(packed text, spans, other columns) -> the input's columns, counts, digest and the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                yield part(b.slice(k, 512))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = unpacked(b.column(0)), b.column(1)
        at, vals = spans.offsets.to_numpy(), spans.values
        lo, hi = (vals.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi"))
        n_words, n_removed, digest, kept_text = [], [], [], []
        for i, text in enumerate(texts):
            words = (text or b"").split()  # of bytes: at ASCII white space
            kept = words
            if at[i + 1] > at[i]:
                p, q = merged(lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]])
                edge = [0, *np.stack([p, q], 1).ravel().tolist(), len(words)]
                kept = [w for a, z in zip(edge[0::2], edge[1::2], strict=True) for w in words[a:z]]
            joined = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(joined).hexdigest())
            kept_text.append(joined.decode())
        own, names = list(b.columns[2:]), list(b.schema.names[2:])
        own.insert(at_text, pa.array([None if t is None else t.decode() for t in texts], pa.string()))
        names.insert(at_text, name)
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())]
        return pa.RecordBatch.from_arrays([*own, *made], [*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def earlier_windows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """docs: doc_id, text_hash, text. The words to remove: doc_id, text_hash, spans (lo, hi) in words; a written table."""
    found = cut(docs.mapInArrow(_cover(size, gram), PIECES), "pieces")
    rows = estimated_repeated(found)
    remove(found)
    piece = ["anchor", "piece", "twin"]
    own = rows.groupBy(*piece).agg(F.min(F.struct("doc_id", "text_hash", "start", "windows")).alias("own"))
    own = cut(own.withColumn("pid", F.monotonically_increasing_id()), "own")
    rivals = cut(own.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "rivals")
    asked = own.join(rivals.hint("merge"), "anchor", "left_semi").select("own.doc_id", "own.text_hash", F.struct("own.start", "own.windows", "pid").alias("w"))
    asked = asked.groupBy("doc_id", "text_hash").agg(F.collect_list("w").alias("w"))
    # One row for all that are equal, made distinct before they move.
    once = packed(docs, "text").groupBy("doc_id", "text_hash").agg(F.first("_packed").alias("_packed"))
    windows = cut(once.join(asked, ["doc_id", "text_hash"]).select("doc_id", "_packed", "w").mapInArrow(_windows(size), WINDOWS), "windows")
    least = windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = cut(least.select("one", "two", "least"), "least")
    lost = windows.join(least.hint("merge"), ["one", "two"]).where("least < doc_id").select("pid", "place")
    lost = lost.groupBy("pid").agg(F.collect_list("place").alias("lost"))  # a piece has size - gram + 1 windows at most
    told = own.select(*piece, "pid", F.col("own.doc_id").alias("owner")).join(lost, "pid", "left").select(*piece, "owner", "lost")
    told = cut(told, "told")
    whole = F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("windows") + (size - 1)).alias("hi")))
    some = F.transform("lost", lambda x: F.struct((F.col("start") + x).alias("lo"), (F.col("start") + x + size).alias("hi")))
    spans = rows.join(told.hint("merge"), piece).where("doc_id > owner or lost is not null").select("doc_id", "text_hash", F.explode(F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(some)).alias("s"))
    spans = cut(spans.groupBy("doc_id", "text_hash").agg(F.collect_set("s").alias("spans")), "spans")
    remove(rows, own, rivals, windows, least, told)
    return spans


def dedup_windows(docs: DataFrame, size: int = SIZE, gram: int = GRAM, text: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text (the kept words, joined by one space)."""
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text")
    text_hash = F.xxhash64(F.col(text))
    slim = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_hash.alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = earlier_windows(slim, size, gram).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("spans").alias("_s"))
    keyed = packed(docs.withColumns({"_id": F.col("doc_id"), "_hash": text_hash}), text)
    joined = keyed.join(spans, (F.col("_id") == F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    ready = joined.select("_packed", F.coalesce("_s", empty).alias("_spans"), *[c for c in docs.columns if c != text])
    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", n_words long, n_removed long, kept_sha256 string, kept_text string"
    return ready.mapInArrow(_remove(docs.columns.index(text), text), schema)


def op13_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM words WHERE len(w) >= 50
), digests AS (
  SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM windows
), firsts AS (
  SELECT h, min(doc_id) AS least FROM digests GROUP BY h HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT DISTINCT r, i FROM digests JOIN firsts USING (h) WHERE least < doc_id
), tokens AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), marked AS (
  SELECT t.r, t.i, t.word, count(h.i) OVER (PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM tokens t LEFT JOIN hits h ON t.r = h.r AND t.i = h.i
), kept AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS k FROM marked GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""
