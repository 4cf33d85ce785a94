"""Ranked lexical search over dual-sorted wavelet trees.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A query's terms weigh what is rare,
a document's occurrences count with falling gain, less in long documents (see `impact` and `weight`; all integers).

Index. Documents are dealt into shards of about SHARD_BYTES of text as Spark reads them; a shard is one row of a table.
Its postings lie list after list, each list ordered by impact, highest first. The documents along that sequence are kept
as a wavelet tree (as a matrix: at each level the bit of the document's number, zeros first, in the order they had), so the
lists are ordered twice: along the sequence by impact, down the tree by document. A node of the tree is a range of
documents; a list's share of it is a range of positions, got from its parent's by two ranks, and the first position
of it holds the list's highest impact below that node.

Search. A node's bound is the sum over the query's terms of weight times that first impact; at a leaf it is the
document's score. Nodes are opened best bound first, BATCH at a time, and dropped once their bound is below the k-th
score found so far, which a task carries from shard to shard; so the k best are exact, ties by doc_id included. Tasks
return k rows a query at most, which a ranking by parts and then by query brings down to k.

Queries are met in blocks of about BLOCK_BYTES of text: a block goes to the executors, whatever the number of queries.
A block's document frequencies come from the index's dictionaries alone, as sums; nothing else comes to the driver. The
index is written once and read by each block.

Defined cases: null and empty texts have no terms; such documents are never found, such items find nothing. A null doc_id
ranks after all others of its score; rows that share a doc_id are documents of their own. Items equal in item_id and text
are one item; a null item_id is an id like any other. Extra columns are not carried. An empty table on either side gives no
rows. Memory grows with the longest document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, flat, table, word_spans

TOP = 50
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 1 << 20
BATCH = 64
PARTS = 32

_PLAIN = np.full(256, 32, np.uint8)
for _r in (range(48, 58), range(97, 123), range(128, 256)):
    _PLAIN[list(_r)] = list(_r)
_PLAIN[65:91] = np.arange(97, 123)


def terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of some rows of text in order, and the row of each."""
    x = _PLAIN[data]
    start, end, row = word_spans(x, off)
    at = np.concatenate([[0], np.cumsum(end - start)])
    ink = x[x != 32]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ink)]), row


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of tf occurrences in a document of n terms, in millionths."""
    m = 100 - 50 + (50 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Wavelet:
    """Wavelet matrix of numbers below 2^levels: packed bits by level, with ones counted before each 64."""

    def __init__(self, bits: np.ndarray, length: int):
        self.bits, self.levels, self.length = bits, len(bits), length
        ones = np.bitwise_count(bits).astype(np.int32)
        self.before = np.zeros((len(bits), bits.shape[1] + 1), np.int32)
        np.cumsum(ones, 1, out=self.before[:, 1:])
        self.zeros = length - self.before[:, -1].astype(np.int64)

    @classmethod
    def of(cls, values: np.ndarray, levels: int) -> Wavelet:
        rows = []
        for k in range(levels):
            bit = (values >> (levels - 1 - k) & 1).astype(bool)
            packed = np.zeros(-(-(len(values) + 1) // 64) * 8, np.uint8)
            packed[: -(-len(values) // 8)] = np.packbits(bit, bitorder="little")
            rows.append(packed.view(np.uint64))
            values = np.concatenate([values[~bit], values[bit]])
        return cls(np.stack(rows) if rows else np.zeros((0, 1), np.uint64), len(values))

    def carried(self, first: np.ndarray) -> np.ndarray:
        """Values along the sequence, along every level."""
        out = np.empty((self.levels + 1, self.length), first.dtype)
        out[0] = first
        for k in range(self.levels):
            bit = np.unpackbits(self.bits[k].view(np.uint8), count=self.length, bitorder="little").view(bool)
            z = int(self.zeros[k])
            out[k + 1, :z], out[k + 1, z:] = out[k][~bit], out[k][bit]
        return out

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before a position of a level."""
        word = at >> 6
        part = self.bits[level, word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level, word] + np.bitwise_count(part)


class Best:
    """The k best of (score, doc_id) so far; null ids last among equals."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.none, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must score to come in or to tie."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        score, none, doc = np.concatenate([self.score, score]), np.concatenate([self.none, none]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.none, self.doc = score[order], none[order], doc[order]


class Shard:
    """The index of some documents."""

    def __init__(self, docs: pa.Array, names: pa.Array, starts: np.ndarray, tree: Wavelet, impacts: np.ndarray):
        self.docs, self.names, self.starts, self.tree = docs, names, starts, tree
        self.none = docs.is_null().to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(docs, 0).to_numpy()
        self.first = impacts

    @classmethod
    def build(cls, docs: pa.Array, words: pa.Array, row: np.ndarray, n_docs: int, n_terms: int) -> Shard:
        coded = words.dictionary_encode()
        d = max(1, len(docs))
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * d + row, return_counts=True)
        term, doc = key // d, key % d
        gain = impact(tf.astype(np.int64), np.bincount(row, minlength=d)[doc], n_docs, n_terms)
        order = np.argsort((term << 20) + (1_000_000 - gain), kind="stable")
        starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
        return cls(docs, coded.dictionary, starts, Wavelet.of(doc[order].astype(np.int32), (d - 1).bit_length()), gain[order].astype(np.int32))

    def row(self) -> list:
        return [self.docs, self.names.cast(pa.binary()), self.starts.astype(np.int32), self.tree.bits.tobytes(), self.first.tobytes()]

    @classmethod
    def read(cls, b: pa.RecordBatch, i: int) -> Shard:
        docs, names, starts = (b.column(k)[i].values for k in range(3))
        first = np.frombuffer(b.column(4)[i].as_buffer(), np.int32)
        levels = (max(1, len(docs)) - 1).bit_length()
        bits = np.frombuffer(b.column(3)[i].as_buffer(), np.uint64).reshape(levels, -(-(len(first) + 1) // 64))
        return cls(docs, names, starts.to_numpy(), Wavelet(bits, len(first)), first)

    def prepare(self) -> None:
        self.impacts = self.tree.carried(self.first)

    def search(self, lists: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Bring the documents of this shard into the best of a query, given its terms' lists; nodes opened."""
        tree, deep, opened = self.tree, self.tree.levels, 0
        lo, hi = self.starts[lists].astype(np.int64)[None, :], self.starts[lists + 1].astype(np.int64)[None, :]
        level, code = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int((weights * self.first[lo[0]]).sum())])
        take = BATCH
        while True:
            leaf = level == deep
            if leaf.any():
                at = code[leaf]
                best.add(bound[leaf], self.none[at], self.ids[at])
                take *= 2
            going = ~leaf & (bound >= best.least)
            lo, hi, level, code, bound = lo[going], hi[going], level[going], code[going], bound[going]
            if not len(bound):
                return opened
            top = np.argpartition(-bound, take)[:take] if len(bound) > take else np.arange(len(bound))
            opened += len(top)
            rest = np.ones(len(bound), bool)
            rest[top] = False
            at = level[top][:, None]
            a, b = tree.ones(at, lo[top]), tree.ones(at, hi[top])
            zero = tree.zeros[at]
            new_lo, new_hi = np.concatenate([lo[top] - a, zero + a]), np.concatenate([hi[top] - b, zero + b])
            new_level, new_code = np.tile(level[top] + 1, 2), np.concatenate([code[top] * 2, code[top] * 2 + 1])
            held = new_lo < new_hi
            new_bound = (np.where(held, self.impacts[new_level[:, None], np.minimum(new_lo, tree.length - 1)], 0) * weights).sum(1)
            some = new_bound >= best.least
            lo, hi = np.concatenate([lo[rest], new_lo[some]]), np.concatenate([hi[rest], new_hi[some]])
            level, code, bound = (np.concatenate([x[rest], y[some]]) for x, y in ((level, new_level), (code, new_code), (bound, new_bound)))


# ---- The index as a table --------------------------------------------------------------------------------------------


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = total = 0
    for b in batches:
        off, data = flat(b.column(0))
        for lo in range(0, b.num_rows, 1024):
            hi = min(lo + 1024, b.num_rows)
            _, _, row = word_spans(_PLAIN[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo])
            some += len(np.unique(row))
            total += len(row)
    yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], ["some", "total"])


SHARDS = "docs array<long>, names array<binary>, starts array<int>, bits binary, impacts binary"
_SHARDS = pa.schema([("docs", pa.list_(pa.int64())), ("names", pa.list_(pa.binary())), ("starts", pa.list_(pa.int32())), ("bits", pa.binary()), ("impacts", pa.binary())])


def _build(n_docs: int, n_terms: int):
    """(doc_id, text) -> a row for each shard."""

    def made(ids: list[pa.Array], words: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        cols = Shard.build(pa.concat_arrays(ids), pa.concat_arrays(words), np.concatenate(rows), n_docs, n_terms).row()
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cols, _SHARDS, strict=True)], schema=_SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        words: list[pa.Array] = []
        rows: list[np.ndarray] = []
        n = size = 0
        for b in batches:
            off, data = flat(b.column(1))
            i = 0
            while i < b.num_rows:
                j = min(b.num_rows, max(i + 1, int(np.searchsorted(off, off[i] + SHARD_BYTES - size, "right")) - 1))
                w, row = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ids.append(b.column(0).slice(i, j - i))
                words.append(w)
                rows.append(row + n)
                n, size, i = n + j - i, size + int(off[j] - off[i]), j
                if size >= SHARD_BYTES or j < b.num_rows:
                    yield made(ids, words, rows)
                    ids, words, rows, n, size = [], [], [], 0, 0
        if n:
            yield made(ids, words, rows)

    return run


def build_index(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """The shards of docs as a written table, and the number of documents with a term."""
    told = docs.select(text).mapInArrow(_sizes, "some long, total long").agg(F.sum("some"), F.sum("total")).first()
    n_docs, n_terms = told[0] or 0, told[1] or 0
    return cut(docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_build(n_docs, n_terms), SHARDS), "shards"), n_docs


# ---- Search ----------------------------------------------------------------------------------------------------------


class Queries:
    """A block of items: their vocabulary, and each item's distinct terms as places in it."""

    def __init__(self, block: pa.Table):
        off, data = flat(block["text"])
        words, row = terms(data, off)
        coded = words.cast(pa.binary()).dictionary_encode()
        self.names = coded.dictionary
        self.ids = block["item_id"].to_pylist()
        code = coded.indices.to_numpy()
        self.terms = [np.unique(code[a:b]) for a, b in zip(*(np.searchsorted(row, np.arange(block.num_rows), s) for s in ("left", "right")), strict=True)]


def query_blocks(items: DataFrame, text: str) -> Iterator[Queries]:
    items = items.select("item_id", F.col(text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // BLOCK_BYTES))
    for k in range(many):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).toArrow()
        if block.num_rows:
            yield Queries(block)


def _frequencies(q: Queries):
    """(names, starts) of shards -> documents by term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(q.names), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                starts = b.column(1)[i].values.to_numpy()
                at = pc.index_in(q.names, value_set=b.column(0)[i].values)
                there = at.is_valid().to_numpy(zero_copy_only=False)
                t = at.drop_null().to_numpy()
                n[there] += starts[t + 1] - starts[t]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "df"])

    return run


def _search(q: Queries, weights: np.ndarray, k: int):
    """Shards -> (item, doc_id, score): the task's k best of each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in q.terms]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard.read(b, i)
                if not len(shard.first):
                    continue
                shard.prepare()
                lists = pc.fill_null(pc.index_in(q.names, value_set=shard.names), -1).to_numpy()
                for own, top in zip(q.terms, best, strict=True):
                    some = own[(lists[own] >= 0) & (weights[own] > 0)]
                    if len(some):
                        shard.search(lists[some], weights[some], top)
        for i, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.score), i)), pa.array(top.doc, mask=top.none), pa.array(top.score)], ["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", item_text: str = "text") -> DataFrame:
    """The k best documents of each item that score above 0: item_id, rank, doc_id, score. items: item_id and text."""
    spark = docs.sparkSession
    shards, n_docs = build_index(docs, text)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for n, q in enumerate(query_blocks(items, item_text)):
        df = np.zeros(len(q.names), np.int64)
        for r in shards.select("names", "starts").mapInArrow(_frequencies(q), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms
            df[r["term"]] = r["df"]
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        found = shards.mapInArrow(_search(q, weights, k), "item long, doc_id long, score long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        some = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(q.ids)), pa.int64()), "item_id": pa.array(q.ids, pa.int64())}))
        named = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # the block's items
        out = out.unionByName(named) if n else named
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS (
  SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), total AS (
  SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d
), tf AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term
), df AS (
  SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term
), m AS (
  SELECT r, doc_id, 100 - 50 + (50 * CAST(len(t) AS BIGINT) * n_docs) // n_terms AS m FROM d, total WHERE len(t) > 0
), scored AS (
  SELECT item_id, text, r, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m USING (r), total GROUP BY item_id, text, r
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
