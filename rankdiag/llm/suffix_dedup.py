"""Exact removal of long repeated byte strings by run-length indexes.

A byte goes when a string of `length` bytes that covers it also starts anywhere else in the table (same document
included, overlaps counted), judged on the input. Matches never cross documents.

The index. A run-length Burrows-Wheeler transform is kept with samples at its run ends: at the first and last
position of each run, the text position and its common prefix with the neighbour before or after it in suffix order.
(Each index is built from a suffix array of its text with the ranks of all doublings, which are then dropped: while it
is built, a task holds up to ten numbers a letter, CHUNK letters at most; what stays follows the number of runs.)
Inside a run, going one letter back in the text lengthens that common prefix by exactly one, so the samples alone
give the matching statistics: streaming the text from left to right, the match at position i is the sample at i, or
else the match at i - 1 less one. A position is marked where its match with the suffix before or after reaches
`length`.

Cutting the corpus. Every window of `length` bytes is named by its smallest hashed string of ANCHOR bytes (leftmost on
ties), so equal windows have the same anchor at the same place. Consecutive windows of one anchor make a piece; each
window lies in exactly one piece. Pieces are counted before any text moves: an anchor with one piece that occurs once matches
nothing and leaves first, a piece that occurs twice is wholly repeated. Only distinct pieces of anchors with two or more
of them need an index. Their text goes to the task of its anchor, where indexes of at most CHUNK letters are built
over whole anchors. An anchor with more bytes than HOT would be a hot group: its windows are instead counted by their
hashes, each window in one row, with partial sums, so no text is copied and no task holds an unbounded group. Marks
return as intervals per document; the last step merges and removes them. Documents are known by two 64-bit hashes of id
and text; the text of rows equal in both is fetched once, so an index gets no more bytes than were counted for it.

Pieces, and windows of busy anchors, are counted by two 64-bit hashes (anchor and the whole of it); other matches
between different pieces are found on the bytes themselves.

Defined cases: null and empty texts have 0 bytes and nothing removed. Rows equal in id and text are copies of each
other. A null doc_id is an id like any other. Extra columns pass through `dedup_text`; the added ones replace columns
of the same name. Memory grows with the longest single document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, cut, flat, groups, mix, packed, pieces, remove, row_key, row_twin, table, unpacked

LENGTH, ANCHOR = 400, 128
CHUNK = 1 << 20  # so that two ranks and a position fit into 63 bits
HOT = 300_000


def cover(data: np.ndarray, off: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Pieces of rows: row, start in the row, number of windows, anchor hash, piece hash."""
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    roll = Rolling(data)
    gram = mix(roll.all(anchor))
    w, m = length - anchor + 1, len(gram)
    # The smallest of w neighbours: prefix and suffix minima of blocks of w; the low bits hold the place, so that the leftmost wins.
    # As many low bits everywhere (but for texts of 2^24 letters or more), so that equal windows tie alike in any batch.
    bits = np.uint64(max(24, int(m).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    z = np.full(-(-m // w) * w, np.uint64(2**64 - 1))
    z[:m] = (gram >> bits << bits) | np.arange(m, dtype=np.uint64)
    z = z.reshape(-1, w)
    up = np.minimum.accumulate(z, 1).ravel()
    down = np.minimum.accumulate(z[:, ::-1], 1)[:, ::-1].ravel()
    n = m - w + 1
    at = (np.minimum(down[:n], up[w - 1 : w - 1 + n]) & low).astype(np.int64)
    start = np.arange(n)
    row = np.searchsorted(off, start, "right") - 1
    inside = start + length <= off[row + 1]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new & inside)
    stop = np.append(np.flatnonzero(new | ~inside), n)
    end = stop[np.searchsorted(stop, head, "right")]
    return row[head], head - off[row[head]], end - head, gram[at[head]], roll.of(head, end - 1 + length)


PIECES = "key long, twin long, start long, windows long, anchor long, piece long"


def _cover(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(2))
            key, twin = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in pieces(off):
                row, start, n, a, p = cover(data[off[i] : off[j]], off[i : j + 1] - off[i], length, anchor)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i:j][row]), pa.array(twin[i:j][row]), pa.array(start), pa.array(n), pa.array(a.view(np.int64)), pa.array(p.view(np.int64))], ["key", "twin", "start", "windows", "anchor", "piece"])

    return run


FETCHED = "anchor long, key long, twin long, start long, copies long, text binary, window long"


def _fetch(length: int):
    """Documents with the list of pieces asked of them -> those pieces' bytes, or (hot) a row for each of their windows."""
    names = [c.split()[0] for c in FETCHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(3)
            at, vals = wanted.offsets.to_numpy(), wanted.values
            f = {x: vals.field(x).to_numpy(zero_copy_only=False) for x in ("start", "windows", "anchor", "copies", "hot")}
            for i in range(b.num_rows):
                text = unpacked(b.column(2).slice(i, 1))[0] or b""
                own, other = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for k in range(at[i], at[i + 1], 1024):
                    g = np.arange(k, min(k + 1024, at[i + 1]))
                    cold, hot = g[~f["hot"][g]], g[f["hot"][g]]
                    if len(cold):
                        cut_ = [text[x : x + y + length - 1] for x, y in zip(f["start"][cold].tolist(), f["windows"][cold].tolist(), strict=True)]
                        key, twin = (pa.array(np.full(len(cold), v, np.int64)) for v in (own, other))
                        yield pa.RecordBatch.from_arrays([pa.array(f["anchor"][cold]), key, twin, pa.array(f["start"][cold]), pa.array(f["copies"][cold]), pa.array(cut_, pa.binary()), pa.nulls(len(cold), pa.int64())], names)
                    for j in hot.tolist():
                        x, n = int(f["start"][j]), int(f["windows"][j])
                        h = Rolling(np.frombuffer(text[x : x + n + length - 1], np.uint8)).all(length)
                        same = lambda v, n=n: pa.array(np.full(n, v, np.int64))
                        yield pa.RecordBatch.from_arrays([same(f["anchor"][j]), same(own), same(other), pa.array(np.arange(x, x + n)), same(f["copies"][j]), pa.nulls(n, pa.binary()), pa.array(mix(h).view(np.int64))], names)

    return run


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of a text of integers below 512, with samples at run ends."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        if n > CHUNK:
            raise ValueError(f"{n} letters; an index holds {CHUNK}")
        b = np.uint64(20)
        mask = np.uint64((1 << 20) - 1)
        place = np.arange(n, dtype=np.uint64)
        t = np.concatenate([text.astype(np.uint64), np.zeros(4, np.uint64)])
        key = ((t[:n] << np.uint64(27) | t[1 : n + 1] << np.uint64(18) | t[2 : n + 2] << np.uint64(9) | t[3 : n + 3]) << b) | place
        levels: list[tuple[int, np.ndarray]] = []
        h = 4
        while True:  # prefix doubling: ranks by the first h letters
            key.sort()
            order = (key & mask).astype(np.int64)
            top = key >> b
            new = np.zeros(n, np.int64)
            new[1:] = top[1:] != top[:-1]
            rank_sorted = np.cumsum(new)
            rank = np.empty(n + 1, np.int64)
            rank[order] = rank_sorted
            rank[n] = -1
            levels.append((h, rank.astype(np.int32)))
            if rank_sorted[-1] == n - 1 or h >= n:
                break
            ahead = np.full(n, 0, np.uint64)
            ahead[: n - h] = rank[h:n] + 1
            # 20 bits for each of two ranks and the place; a rank of n ahead of n letters stays below 2^20 + 1.
            key = (rank[:n].astype(np.uint64) << np.uint64(41)) | (ahead << b) | place
            h *= 2
        before = text[order - 1]  # the transform; position 0 gets the last letter
        before = np.where(order == 0, -1, before)
        change = before[1:] != before[:-1]
        heads, tails = np.concatenate([[True], change]), np.concatenate([change, [True]])
        self.letters, self.lengths = before[heads], np.diff(np.append(np.flatnonzero(heads), n))
        self.levels, self.text = levels, text
        h, t_ = np.flatnonzero(heads), np.flatnonzero(tails)
        self.first = (order[h], self._common(order[h[1:]], order[h[1:] - 1], 0))
        self.last = (order[t_], self._common(order[t_[:-1]], order[t_[:-1] + 1], 1))
        del self.levels

    def _common(self, x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
        """Common prefixes of suffix pairs by the ranks of all doublings; the outermost run has none (0)."""
        got = np.zeros(len(x), np.int64)
        for h, rank in reversed(self.levels):
            while True:
                a, b = np.minimum(x + got, self.n), np.minimum(y + got, self.n)
                ok = (a + h <= self.n) & (b + h <= self.n) & (rank[a] == rank[b])
                if not ok.any():
                    break
                got[ok] += h
                if h != self.levels[-1][0]:
                    break
        for _ in range(3):  # what is left is shorter than the first level's four letters
            a, b = x + got, y + got
            ok = (a < self.n) & (b < self.n)
            ok[ok] = self.text[a[ok]] == self.text[b[ok]]
            # stop at the first difference
            got += ok
            if not ok.any():
                break
        return np.concatenate([[0], got] if side == 0 else [got, [0]])

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match of its suffix with any other suffix."""
        place = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for at, sample in (self.first, self.last):
            held = np.full(self.n, -1, np.int64)
            held[at] = np.arange(len(at))
            src = np.maximum.accumulate(np.where(held >= 0, place, -1))
            ok = src >= 0
            value = np.zeros(self.n, np.int64)
            value[ok] = sample[held[src[ok]]] - (place[ok] - src[ok])
            best = np.maximum(best, value)
        return best


def repeats(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each text a mask of the starts of `length`-byte strings that start elsewhere in the texts too."""
    size = np.array([len(x) for x in texts])
    whole = np.zeros(int(size.sum()) + len(texts), np.int64)  # 0 ends a text
    at = np.concatenate([[0], np.cumsum(size + 1)])
    for x, a in zip(texts, at, strict=False):
        whole[a : a + len(x)] = x
        whole[a : a + len(x)] += 1
    m = RunLengthIndex(whole).matching_statistics()
    return [m[a : a + max(0, n - length + 1)] >= length for a, n in zip(at, size, strict=False)]


def _index(length: int):
    """Pieces sorted by anchor -> intervals (key, twin, lo, hi) of pieces that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_n = 0

        def mark() -> Iterator[pa.RecordBatch]:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for (key, twin, start, copies, _), hit in zip(held, repeats([x[4] for x in held], length), strict=True):
                if copies == 1 and hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    out[0].extend([key] * (len(edge) // 2))
                    out[1].extend([twin] * (len(edge) // 2))
                    out[2].extend((start + edge[0::2]).tolist())
                    out[3].extend((start + edge[1::2] - 1 + length).tolist())
            held.clear()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["key", "twin", "lo", "hi"])

        for t, at in groups(batches, ["anchor"], 256):
            off, data = flat(t["text"])
            key, twin, start, copies = (t[c].combine_chunks().to_numpy() for c in ("key", "twin", "start", "copies"))
            for a, b in zip(at[:-1], at[1:], strict=True):
                n = int(off[b] - off[a] + b - a)
                if held and held_n + n > CHUNK - 8:
                    yield from mark()
                    held_n = 0
                held += [(int(key[i]), int(twin[i]), int(start[i]), int(copies[i]), data[off[i] : off[i + 1]]) for i in range(a, b)]
                held_n += n
        if held:
            yield from mark()

    return run


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that do not touch, in order."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:] - 1, len(hi) - 1)]


def _remove(at_text: int, name: str, least_words: int):
    """(packed text, spans, other columns) -> the input's columns, digest columns and the kept bytes as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                yield part(b.slice(k, 512))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = unpacked(b.column(0)), b.column(1)
        at, vals = spans.offsets.to_numpy(), spans.values
        lo, hi = (vals.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi"))
        cols: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for i, text in enumerate(texts):
            x = text or b""
            p, q = merged(lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]]) if at[i + 1] > at[i] else (lo[:0], hi[:0])
            if least_words and len(p):
                long = np.array([len(x[a:z].split()) >= least_words for a, z in zip(p.tolist(), q.tolist(), strict=True)])
                p, q = p[long], q[long]
            edge = [0, *np.stack([p, q], 1).ravel().tolist(), len(x)]
            kept = b"".join(x[a:z] for a, z in zip(edge[0::2], edge[1::2], strict=True))
            for c, v in zip(cols, (len(x), len(x) - len(kept), len(p), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                c.append(v)
        whole = pa.array([None if t is None else t.decode() for t in texts], pa.string())
        kept_text = pa.array([v.decode("utf-8", "ignore") for v in cols[4]], pa.string())
        own, names = list(b.columns[2:]), list(b.schema.names[2:])
        own.insert(at_text, whole)
        names.insert(at_text, name)
        return pa.RecordBatch.from_arrays([*own, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), kept_text], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def dedup_text(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, text: str = "text", least_words: int = 0) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_text (the kept bytes; a broken character at a cut goes).

    With least_words, runs of fewer words (parts of words at their ends count) stay.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    docs = docs.drop(*made)
    own = [row_key(F.col("doc_id"), F.col(text)), row_twin(F.col("doc_id"), F.col(text))]
    slim = docs.select(own[0].alias("key"), own[1].alias("twin"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = cut(slim.mapInArrow(_cover(length, anchor), PIECES), "pieces")
    # An anchor that one piece has, once, matches nothing; most are of that kind, and only the others are looked at further.
    busy = cut(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    # Dealt by document, so that no file holds most rows of a frequent anchor and joins with them can be split.
    shared = cut(found.join(busy.hint("merge"), "anchor", "left_semi").repartition("key"), "shared")
    remove(found, busy)
    counted = shared.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("key", "twin", "start", "windows")).alias("own"))
    counted = cut(counted, "counted")
    whole = shared.join(counted.where("copies > 1").select("anchor", "piece"), ["anchor", "piece"], "left_semi").select("key", "twin", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + length - 1).alias("hi"))
    anchors = counted.groupBy("anchor").agg(F.count("*").alias("_pieces"), F.sum(F.col("own.windows") + length).alias("_bytes")).where("_pieces > 1")
    anchors = cut(anchors, "rivals")  # as above: a join with a written table can be split
    rival = counted.join(anchors.hint("merge"), "anchor").select("own.key", "own.twin", F.struct("own.start", "own.windows", "anchor", "copies", (F.col("_bytes") > HOT).alias("hot")).alias("w"))
    wanted = rival.groupBy("key", "twin").agg(F.collect_list("w").alias("w"))
    # One row for all that are equal, made distinct before they move: each piece is fetched once, as _bytes counted it.
    once = packed(slim, "text").groupBy("key", "twin").agg(F.first("_packed").alias("_packed"))
    fetched = cut(once.join(wanted, ["key", "twin"]).select("key", "twin", "_packed", "w").mapInArrow(_fetch(length), FETCHED), "fetched")
    dealt = fetched.where("text is not null").select("anchor", "key", "twin", "start", "copies", "text").repartition("anchor").sortWithinPartitions("anchor")
    partly = dealt.mapInArrow(_index(length), "key long, twin long, lo long, hi long")
    windows = fetched.where("text is null").select("anchor", "window", "key", "twin", "start")
    again = cut(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window"), "windows")
    met = windows.join(again.hint("merge"), ["anchor", "window"], "left_semi").select("key", "twin", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))
    partly = partly.unionByName(met)
    # Spans of equal rows are equal; they become one before they are gathered.
    spans = whole.unionByName(partly).groupBy("key", "twin").agg(F.collect_set(F.struct("lo", "hi")).alias("_s"))
    spans = cut(spans.select(F.col("key").alias("_k"), F.col("twin").alias("_t"), "_s"), "spans")
    remove(shared, counted, anchors, fetched, again)
    keyed = packed(docs.withColumns({"_key": own[0], "_twin": own[1]}), text)
    joined = keyed.join(spans, (F.col("_key") == F.col("_k")) & (F.col("_twin") == F.col("_t")), "left")
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    ready = joined.select("_packed", F.coalesce("_s", empty).alias("_spans"), *[c for c in docs.columns if c != text])
    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return ready.mapInArrow(_remove(docs.columns.index(text), text, least_words), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_text(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
