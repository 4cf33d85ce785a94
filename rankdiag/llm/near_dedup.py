"""MinHash near-duplicates by a multi-index Hamming join.

Sets. A document's set holds its distinct shingles of five words (A-Z lower-cased); with fewer words the whole
sequence is its one shingle; without words it is empty and linked with nothing. Shingles are 64-bit hashes.

Signatures. k values of 16 bits, each from the minimum of another hash function over the set. Two sets of Jaccard
similarity s differ in about k * (1 - s) values. The values form chunks of equal width; if two signatures differ in at
most 2 * chunks - 1 values, some chunk has at most one error (pigeonhole), so each chunk is entered once for each of its
values, each time without that value. All pairs within that distance share an entry. Width and number of chunks follow
from the similarity, so that a pair at it is farther apart with a probability of MISS at most (binomial tail): 12 chunks
of five values at 0.85, 20 at 0.80. Far below 0.5 no plan of MOST values does, which is an error.

Steps: (1) equal sets collapse into a class with one representative, the smallest doc_id; (2) representatives that
share an entry are compared by signature distance in the task that holds the entry; a task keeps a union-find and
returns a spanning forest, never all pairs; an entry of more than BUCKET members is dealt out as pairs of blocks;
(3) components of those candidate links are families, whose links exact intersections of whole sets confirm: a family of
at most FAMILY members in one task, a larger one first along two candidate links of each member, and only where that
leaves it in several parts in pairs of blocks; again spanning forests come back; (4) components of confirmed links.

Defined cases: null text is empty; a document with an empty set is its own component, of 0 shingles. A null doc_id
has a null component and is kept. Rows that share a doc_id are one document to the links (any of their sets links).
Repeated rows stay. Extra columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, cut, flat, groups, mix, pieces, remove, table, word_spans

SHINGLE = 5
MISS = 1e-5
BUCKET, FAMILY = 2000, 256
MOST = 256

_A = mix(np.arange(1, MOST + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_B = mix(np.arange(1, MOST + 1, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
_STEP = np.uint64(0xA0761D6478BD642F)


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes."""
    data = LOWER[data]
    start, end, row = word_spans(data, off)
    h = mix(Rolling(data).of(start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    first = np.searchsorted(row, np.arange(len(off)))
    run = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        run = run * _STEP + h[k : len(h) - size + 1 + k]
    run = mix(run)
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            u = np.sort(run[a : b - size + 1])
            yield u[np.concatenate([[True], u[1:] != u[:-1]])]
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x * _STEP + h[k : k + 1])
            yield x
        else:
            yield np.zeros(0, np.uint64)


def plan_for(percent: int) -> tuple[int, int]:
    """Values in a chunk, and chunks, so that a pair at the similarity is beyond the distance with a chance of MISS at most.

    The distance, 2 * chunks - 1 of width * chunks values, is a share of 2 / width at most; wide chunks leave fewer
    false candidates, so the widest that does is taken. An error for similarities that no plan of MOST values reaches.
    """
    for width in (5, 4, 3):
        for chunks in range(2, MOST // width + 1):
            k = width * chunks
            if k % 2 == 0 and beyond(k, percent / 100, 2 * chunks - 1) <= MISS:
                return width, chunks
    raise ValueError(f"no signature of {MOST} values finds pairs of similarity {percent} %")


def beyond(k: int, same: float, distance: int) -> float:
    """Chance that more than `distance` of k values differ, each being equal with chance `same`."""
    return sum(comb(k, i) * (1 - same) ** i * same ** (k - i) for i in range(distance + 1, k + 1))


def signature(u: np.ndarray, k: int) -> np.ndarray:
    """k values of 16 bits, well mixed."""
    best = np.full(k, np.uint64(2**64 - 1))
    for i in range(0, len(u), 4096):
        x = u[i : i + 4096, None] * _A[None, :k]
        x += _B[:k]
        np.minimum(best, x.min(axis=0), out=best)
    return mix(best) & np.uint64(0xFFFF)


def entries(sigs: np.ndarray, width: int) -> np.ndarray:
    """For n signatures of k values, n x k keys: each chunk of `width` values without each of its values in turn."""
    n, chunks = len(sigs), sigs.shape[1] // width
    parts = sigs.reshape(n, chunks, width)
    out = np.zeros((n, chunks, width), np.uint64)
    for skip in range(width):
        key = np.broadcast_to(np.arange(chunks, dtype=np.uint64) * np.uint64(width) + np.uint64(skip + 1), (n, chunks)).copy()
        for k in range(width):
            if k != skip:
                key = mix(key * _STEP + parts[:, :, k])
        out[:, :, skip] = key
    return out.reshape(n, chunks * width)


def _describe(k: int, width: int):
    """(doc_id, text) -> (doc_id, n_shingles, digest, keys, low): low holds four bits of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(1))
            for i, j in pieces(off):
                n, digest, sigs = [], [], []
                for u in shingles(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    n.append(len(u))
                    x = np.array([len(u), mix(u).sum(dtype=np.uint64), mix(u ^ _STEP).sum(dtype=np.uint64)], np.uint64)
                    digest.append(x.tobytes())
                    sigs.append(signature(u, k))
                s = np.array(sigs, np.uint64).reshape(-1, k)
                low = (s & np.uint64(15)).astype(np.uint8)
                low = (low[:, 0::2] << 4 | low[:, 1::2]).tobytes()
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * k, k), pa.int32()), pa.array(entries(s, width).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), keys, pa.array([low[x : x + k // 2] for x in range(0, len(low), k // 2)], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "keys", "low"],
                )

    return run


class Forest:
    """Union-find over arrays; a root is the smallest index of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            far = ra != rb
            if not far.any():
                return
            a, b = a[far], b[far]
            np.minimum.at(self.root, np.maximum(ra[far], rb[far]), np.minimum(ra[far], rb[far]))
            self.flatten()


def _near(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by entry -> (a, b): a spanning forest of pairs in one entry within `distance`, for each run of rows."""
        for t, at in groups(batches, ["key", "p", "q"], 1 << 17):
            rep = t["rep"].combine_chunks().to_numpy()
            ids, local = np.unique(rep, return_inverse=True)
            _, data = flat(t["low"])
            low = data.reshape(len(rep), -1)
            forest = Forest(len(ids))
            group_end = np.repeat(at[1:], np.diff(at))
            i = np.arange(len(rep))
            step = 1
            while True:
                i = i[i + step < group_end[i]]
                if not len(i):
                    break
                j = i + step
                apart = forest.root[local[i]] != forest.root[local[j]]
                x, y = i[apart], j[apart]
                for k in range(0, len(x), 1 << 17):
                    p, q = x[k : k + (1 << 17)], y[k : k + (1 << 17)]
                    d = low[p] ^ low[q]
                    close = ((d & 15) != 0).sum(1) + ((d >> 4) != 0).sum(1) <= distance
                    forest.link(local[p[close]], local[q[close]])
                if step >= 8:  # leave groups that have become one tree
                    one = np.maximum.reduceat(forest.root[local], at[:-1]) == np.minimum.reduceat(forest.root[local], at[:-1])
                    i = i[~np.repeat(one, np.diff(at))[i]]
                step += 1
            far = np.flatnonzero(forest.root != np.arange(len(ids)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[forest.root[far]])], ["a", "b"])

    return run


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with 100 * intersection >= percent * union, by exact counts."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
    else:
        every, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = count[inv] > 1
        rank = np.cumsum(count > 1) - 1
        col, row = rank[inv[shared]], row[shared]
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        both = np.zeros((len(sets), len(sets)))
        width = 8192
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, [lo, lo + width])
            m = np.zeros((len(sets), width), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            both += m @ m.T
    x, y = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1) & (n[:, None] > 0) & (n[None, :] > 0))
    return x, y


def _confirm(percent: int, keys: tuple[str, ...]):
    """(keys..., rep, text) sorted by keys -> a spanning forest of the pairs of each group that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, list(keys), 64):
            ids = t["rep"].combine_chunks().to_numpy()
            off, data = flat(t["text"])
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = {(ids[i], data[off[i] : off[i + 1]].tobytes()): i for i in range(a, b)}  # repeated rows once
                rows = sorted(own.values())
                if len(rows) < 2:
                    continue
                sets: list[np.ndarray] = []
                for i in rows:
                    sets += shingles(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                forest = Forest(len(rows))
                forest.link(*linked(sets, percent))
                far = np.flatnonzero(forest.root != np.arange(len(rows)))
                if len(far):
                    kept = ids[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(kept[far]), pa.array(kept[forest.root[far]])], ["a", "b"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, hash, text) -> (rep, text) without the rows that repeat an earlier one of the partition."""
    seen: set[tuple] = set()
    for b in batches:
        new = []
        for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            new.append(x not in seen)
            seen.add(x)
        yield b.filter(pa.array(new, pa.bool_())).select([0, 2])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): alternating large and small stars until nothing changes; a written table.

    Least neighbours are written before they join the links, so that both sides stand on exchanges of their own, which
    Spark can split where a star has many members. Each round's tables go once the next round's are written.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, f"{name}-links")
    last = None
    for k in range(60):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low{k}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, f"{name}-large{k}")
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(near, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, cut(small, f"{name}-star{k}")
        remove(old, low, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out = cut(out, f"{name}-roots")
            remove(e)
            return out
        last = now
    raise RuntimeError("components still change after 60 rounds")


def blocks(df: DataFrame, by: str, size: int) -> DataFrame:
    """Rows with a count n of their group -> each with the pairs of blocks (p, q) that it belongs to."""
    many = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64(by), many).cast("int")
    pair = F.transform(F.sequence(F.lit(0), many - 1), lambda o: F.struct(F.least(o, own).alias("p"), F.greatest(o, own).alias("q")))
    pairs = F.when(F.col("n") <= size, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(pair)
    return df.withColumn("_b", F.explode(pairs)).select("*", F.col("_b.p").alias("p"), F.col("_b.q").alias("q")).drop("_b")


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text") -> DataFrame:
    """A row for each of docs: doc_id, n_shingles, component_id, kept."""
    width, chunks = plan_for(percent)
    told = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_describe(chunks * width, width), "doc_id long, n_shingles long, digest binary, keys array<long>, low binary")
    told = cut(told, "signatures")
    reps = told.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("low").alias("low"))
    reps = cut(reps, "classes")  # written, so that joins by digest stand on exchanges of their own, which Spark can split where copies are many
    rows = reps.select("rep", "low", F.explode("keys").alias("key"))
    # Counted by sums and joined with a written table, so that no task gets all members of a frequent entry.
    met = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "entries")
    rows = rows.join(met.hint("merge"), "key")
    rows = blocks(rows, "rep", BUCKET).select("key", "p", "q", "rep", "low").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    near = cut(rows.mapInArrow(_near(2 * chunks - 1), "a long, b long"), "candidates")
    # Sets that share a doc_id are one document. Its aggregate is by doc_id alone, so Spark can split the join before it.
    own = told.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest").join(reps.select("digest", "rep"), "digest")
    same = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    family = components(near, "near")
    member = family.select(F.col("node").alias("rep"), F.col("root").alias("family"))
    sizes = cut(member.groupBy("family").agg(F.count("*").alias("n")), "families")
    whole = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).mapInArrow(_once, "rep long, text string")
    # A large family is confirmed first along two candidate links of each member, at two texts a link; only what that leaves in parts is dealt in blocks.
    large = member.join(sizes.where(F.col("n") > FAMILY).hint("merge"), "family")
    pairs = near.join(large.select(F.col("rep").alias("a")).hint("merge"), "a", "left_semi")
    pairs = pairs.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select("a", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("b"))
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("rep")).hint("merge").join(whole, "rep").select("a", "b", "rep", "text")
    along = cut(ends.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_confirm(percent, ("a", "b")), "a long, b long"), "along")
    part = components(along, "along")
    parts = large.join(part.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left").groupBy("family").agg(F.min(F.coalesce("root", "rep")).alias("lo"), F.max(F.coalesce("root", "rep")).alias("hi"))
    whole_family = cut(parts.where("lo = hi").select("family"), "one-part")
    left = sizes.join(whole_family.hint("merge"), "family", "left_anti")
    dealt = blocks(member.join(left.hint("merge"), "family"), "rep", FAMILY).select("family", "p", "q", "rep")
    # A merge at every size: whether the ids could be broadcast depends on the size of the corpus.
    texts = dealt.hint("merge").join(whole, "rep").select("family", "p", "q", "rep", "text")
    sure = texts.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q").mapInArrow(_confirm(percent, ("family", "p", "q")), "a long, b long").unionByName(along)
    roots = components(sure.unionByName(same.select("a", "b")), "sure")
    named = reps.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("_c"))
    named = cut(named, "named")
    remove(family, roots, reps, met, near, sizes, along, part, whole_family)
    out = told.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("_c")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
