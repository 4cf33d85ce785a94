"""Benchmark decontamination: word n-grams seed local alignments of passages with test items.

Words are runs of letters, digits and non-ASCII bytes of the lower-cased text. A document with enough different seeds
of an item close together is a candidate; the passage around them is aligned with the item by Smith-Waterman over
words (match 1, mismatch and gap -1). The score is the best alignment's sum over the item's number of words; pairs of
THRESHOLD or more are leaks. A copy with one word in four replaced scores 0.5.

Seeds are an item's runs of N words, and no leak is lost to them: an alignment with x errors breaks its m matched words
into x + 1 parts at most, so it keeps m - x - 1 runs of two words or more, and m - x is the score. A leak of an item of
L words thus holds L / 2 - 1 of its runs, within L + L / 2 words. Of runs so frequent that chance alone (the product of
their words' shares of all words of the table) would make them more than RATE of all runs, the most frequent are left
out, at most half as many as a leak holds, and as many fewer are asked for.

The benchmark is dealt into blocks of about BLOCK_BYTES of text; each goes to the executors and meets all documents.
Word shares are counted over all whole documents. Nothing is shuffled but sums by word.

Null and empty texts have no words. An item with fewer than LEAST words has too few runs to tell a leak from chance: it
leaks where it is all of a document (score 1). A null doc_id or item_id stays null in the pairs. Repeated rows give repeated pairs. An empty table on either side gives no pairs.
Extra columns pass through `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, flat, mix, pieces, table, word_spans

N = 2
LEAST = 3
RATE = 1e-6
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
HITS = 1 << 20
_STEP = np.uint64(0xA0761D6478BD642F)

_PLAIN = np.full(256, 32, np.uint8)
for _r in (range(48, 58), range(97, 123), range(128, 256)):
    _PLAIN[list(_r)] = list(_r)
_PLAIN[65:91] = np.arange(97, 123)


def hashed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    x = _PLAIN[data]
    start, end, row = word_spans(x, off)
    return (mix(Rolling(x).of(start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)), row


def runs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of N words, and where they begin."""
    m = max(0, len(h) - N + 1)
    out = h[:m].copy()
    for k in range(1, N):
        out = out * _STEP + h[k : m + k]
    at = np.flatnonzero(row[:m] == row[N - 1 :]) if m else np.zeros(0, np.int64)
    return mix(out[at]), at


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment of two word sequences, and where it ends in the passage."""
    ramp = np.arange(len(passage) + 1)
    h = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        fresh = np.zeros_like(h)
        fresh[1:] = np.maximum(h[:-1] + np.where(passage == w, 1, -1), h[1:] - 1)
        np.maximum(fresh, 0, out=fresh)
        h = np.maximum.accumulate(fresh + ramp) - ramp
        k = int(h.argmax())
        if h[k] > best:
            best, end = int(h[k]), k
    return best / len(item), end


class Seeds:
    """The items of one block and their seeds."""

    def __init__(self, ids: list, hashes: list[np.ndarray], share: dict[int, float]):
        self.ids, self.items = ids, hashes
        seed, item, place, self.need = [], [], [], np.zeros(len(ids), np.int64)
        self.short: dict[bytes, list[int]] = {}
        for i, h in enumerate(hashes):
            g, at = runs(h, np.zeros(len(h), np.int64))
            if len(h) < LEAST:
                if len(h):
                    self.short.setdefault(h.tobytes(), []).append(i)
                continue
            p = np.array([share.get(int(w), 0.0) for w in h])
            chance = np.prod([p[at + k] for k in range(N)], axis=0)
            bound = max(1, int(np.ceil(THRESHOLD * len(h))) - 1)  # runs that every leak of the item holds
            gone = min(int((chance > RATE).sum()), bound // 2)
            keep = np.argsort(np.argsort(chance, kind="stable"), kind="stable") < len(g) - gone
            self.need[i] = bound - gone
            seed.append(g[keep])
            item.append(np.full(int(keep.sum()), i))
            place.append(at[keep])
        seed_ = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
        order = np.argsort(seed_, kind="stable")
        self.seed = seed_[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.seed & np.uint64(0xFFFF)).astype(np.int64)] = True

    def leaks(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """Row, item, score, seeds and the word at which the alignment ends, for the pairs that reach THRESHOLD."""
        h, row = hashed_words(data, off)
        if self.short:
            start = np.searchsorted(row, np.arange(len(off)))
            for k in np.flatnonzero((np.diff(start) > 0) & (np.diff(start) < LEAST)).tolist():
                for i in self.short.get(h[start[k] : start[k + 1]].tobytes(), ()):
                    yield k, i, 1.0, 1, int(start[k + 1] - start[k])
        yield from self._aligned(data, off, h, row)

    def _aligned(self, data: np.ndarray, off: np.ndarray, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """As leaks, for items that have seeds."""
        g, at = runs(h, row)
        some = np.flatnonzero(self.sieve[(g & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seed, g[some]), np.searchsorted(self.seed, g[some], "right")
        n = hi - lo
        if not n.sum():
            return
        if n.sum() > HITS and len(off) > 2:
            half = len(off) // 2
            mid = int(np.searchsorted(row, half))
            yield from self._aligned(data[off[0] : off[half]], off[: half + 1] - off[0], h[:mid], row[:mid])
            for k, *rest in self._aligned(data[off[half] : off[-1]], off[half:] - off[half], h[mid:], row[mid:] - half):
                yield k + half, *rest
            return
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pos, item, place = np.repeat(at[some], n), self.item[entry], self.place[entry]
        r = row[pos]
        order = np.lexsort((pos, item, r))
        pos, item, place, r = pos[order], item[order], place[order], r[order]
        length = np.array([len(x) for x in self.items])[item]
        own = np.ones(len(pos), bool)  # words of a row that hit an item, however often the item has the seed
        own[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (pos[1:] != pos[:-1])
        u = np.flatnonzero(own)
        i, j = np.arange(len(u)), np.arange(len(u)) + self.need[item[u]] - 1
        i, j = i[j < len(u)], j[j < len(u)]
        x, y = u[i], u[j]
        close = (r[x] == r[y]) & (item[x] == item[y]) & (pos[y] - pos[x] <= length[x] + length[x] // 2)
        edge = np.zeros(len(u) + 1, np.int64)
        np.add.at(edge, i[close], 1)
        np.add.at(edge, j[close] + 1, -1)
        dense = (np.cumsum(edge)[:-1] > 0)[np.cumsum(own) - 1]  # hits in a window that could hold a leak
        pos, item, place, r, length = pos[dense], item[dense], place[dense], r[dense], length[dense]
        if not len(pos):
            return
        new = np.ones(len(pos), bool)  # a passage: hits of one row and item, each near the one before
        new[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > length[1:] + length[1:] // 2 + 4)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1
        start = np.searchsorted(row, np.arange(len(off)))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            i, k = int(item[a]), int(r[a])
            seeds = len(set(place[a : b + 1].tolist())) if b > a else 1
            if seeds < self.need[i]:
                continue
            pad = int(length[a]) // 2 + 2
            x = max(start[k], int(pos[a]) - int(length[a]) - pad)
            y = min(start[k + 1], int(pos[b]) + int(length[a]) + pad)
            score, end = smith_waterman(self.items[i], h[x:y])
            if score >= THRESHOLD and score > best.get((k, i), (0.0,))[0]:
                best[k, i] = (score, seeds, int(x + end - start[k]))
        for (k, i), v in sorted(best.items()):
            yield k, i, *v


def _count(wanted: np.ndarray):
    """(text) -> counts of the wanted words, and of all words under hash 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(wanted), np.int64), 0
        sieve = np.zeros(1 << 16, bool)
        sieve[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
        for b in batches:
            off, data = flat(b.column(0))
            for i, j in pieces(off):
                h, _ = hashed_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                total += len(h)
                h = h[sieve[(h & np.uint64(0xFFFF)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                n += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(wanted, np.uint64(0)).view(np.int64)), pa.array(np.append(n, total))], ["word", "n"])

    return run


def seed_blocks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Iterator[Seeds]:
    items = benchmark.select("item_id", F.lower(F.col(text)).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // BLOCK_BYTES))
    lowered = docs.select(F.lower(F.col(text)).alias("text"))
    for k in range(many):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).toArrow()
        off, data = flat(block["text"])
        h, row = hashed_words(data, off)
        if not len(h):
            continue
        found = lowered.mapInArrow(_count(np.unique(h)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the block's words
        count = {r["word"] & (2**64 - 1): r["n"] for r in found}
        total = max(1, count.get(0, 0))
        first = np.searchsorted(row, np.arange(len(off)))
        yield Seeds(block["item_id"].to_pylist(), [h[first[i] : first[i + 1]] for i in range(len(off) - 1)], {w: n / total for w, n in count.items()})


def _pairs(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(1))
            ids = b.column(0)
            for i, j in pieces(off):
                found = list(seeds.leaks(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                if found:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([i + f[0] for f in found])), pa.array([seeds.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found]), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())], ["doc_id", "item_id", "score", "n_seeds", "end_word"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """A row for each pair of a document and an item that it holds: doc_id, item_id, score, n_seeds, end_word."""
    schema = "doc_id long, item_id long, score double, n_seeds long, end_word long"
    lowered = docs.select("doc_id", F.lower(F.col(text)).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for k, seeds in enumerate(seed_blocks(docs, benchmark, text)):
        found = lowered.mapInArrow(_pairs(seeds), schema)
        out = out.unionByName(found) if k else found
    return out


def _drop(seeds: Seeds, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(b.num_columns - 1))
            clean = np.ones(b.num_rows, bool)
            for i, j in pieces(off):
                for k, *_ in seeds.leaks(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    clean[i + k] = False
            yield b.filter(pa.array(clean)).select(range(at))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that hold an item."""
    out = docs
    for seeds in seed_blocks(docs, benchmark, text):
        out = out.select(*docs.columns, F.lower(F.col(text)).alias("_lowered")).mapInArrow(_drop(seeds, len(docs.columns)), docs.schema)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
