"""Phrase collocations from depth-limited count tries.

Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line breaks, and pieces into words at spaces and tabs.
Everything is by language. A phrase of 2 to `longest` words that occurs `least` times or more within pieces is a candidate;
its score is the lowest, over its cuts in two, of floor(1000 * a * n / (l * r)): a, l and r count the phrase, its first
and its last part, n all words. Candidates that lie in a longer one which occurs as often are dropped.

Tries. Each shard of about SHARD_BYTES of text builds a trie of its phrases: a level holds each node's parent, word and
count, in the order of the words, and is written as sorted rows (language, path, count). The shards' runs are exchanged
by ranges of the path and summed there, so a range meets all shards' rows of its prefixes, and a frequent prefix is
spread over ranges by what follows it. What occurs less than `least` times is no part of any candidate and goes.

Depth by depth. A phrase is frequent only if its words and its pairs of words are, so there are three rounds: words, pairs
of frequent words, and longer phrases all of whose pairs are frequent. A round knows the last one's phrases by a filter of
CELLS bits, one for each hash that occurs. The first round also sketches pairs: each shard adds up its pairs by such
a cell, the shards' sums meet by sections of the filter, and a pair is looked at further only if its cell has `least` or
more. Filters are of a fixed size; where they fill up they let more through, never less. The counts stay exact, since
each round counts by the phrases themselves.

Parts. A node's first parts are its ancestors (the trie walked upwards), its last parts are its suffix links followed
as often as words are cut off; both are joins with the node table on the shortened path. Products are decimals of 38
digits, so they are exact up to counts of 10^17.

Defined cases: null and empty texts have no words; a null language is `und`, together with rows that say `und`. Repeated rows
count as often as they come. Extra columns are not carried. An empty table gives no rows. Memory grows with the longest
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Rolling, cut, flat, mix, pieces, remove, table, word_spans

LEAST, LONGEST, TOP = 100, 5, 2000
SHARD_BYTES = 12 << 20
CELLS = 1 << 26
SECTION = 1 << 16
_STEP = np.uint64(0xA0761D6478BD642F)

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_PLAIN = LOWER.copy()
_PLAIN[_BREAK | (LOWER == 9)] = 32


def hashes(words: pa.Array) -> np.ndarray:
    """A hash of each string."""
    off, data = flat(words)
    return mix(Rolling(data).of(off[:-1], off[1:]) + np.diff(off).astype(np.uint64)) if len(words) else np.zeros(0, np.uint64)


def cells(parts: list[np.ndarray]) -> np.ndarray:
    """Where the filter has its bit for a language and words, given their hashes."""
    x = parts[0]
    for p in parts[1:]:
        x = mix(x * _STEP + p)
    return (x & np.uint64(CELLS - 1)).astype(np.int64)


class Shard:
    """The words of some rows, coded in the order of the words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lang: pa.Array):
        x = _PLAIN[data]
        ink = x[x != 32]
        start, end, row = word_spans(x, off)
        at = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ink))
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.names = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.code = rank[coded.indices.to_numpy()]
        spoken = lang.dictionary_encode()
        self.langs = spoken.dictionary
        self.lang = spoken.indices.to_numpy()[row]
        stops = np.concatenate([[0], np.cumsum(_BREAK[data], dtype=np.int32)])
        self.joined = (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])

    def places(self, depth: int) -> np.ndarray:
        """The filter's cell for the phrase of `depth` words at each position."""
        h, spoken = hashes(self.names), hashes(self.langs)
        n = max(0, len(self.code) - depth + 1)
        return cells([spoken[self.lang[:n]], *(h[self.code[k : n + k]] for k in range(depth))])

    def pairs(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Sections of the filter, with the steps from one cell that a pair of words has here to the next and its count, `least` at most."""
        at, n = np.unique(self.places(2)[self.joined], return_counts=True)
        bound = np.searchsorted(at, np.arange(0, CELLS + SECTION, SECTION))
        for k in np.flatnonzero(np.diff(bound)).tolist():
            a, b = bound[k], bound[k + 1]
            yield k, np.diff(at[a:b] - k * SECTION, prepend=0).astype(np.uint16), np.minimum(n[a:b], least).astype(np.uint32)

    def valid(self, longest: int, filters: dict[int, np.ndarray]) -> list[np.ndarray]:
        """For 1 to `longest` words: the positions where a phrase may start, by pieces and by the filters of words and pairs."""
        passed = lambda m, seen: (seen[(at := self.places(m)) >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        out = [passed(1, filters[1]) if 1 in filters else np.ones(len(self.code), bool)]
        pair = out[0][:-1] & out[0][1:] & self.joined
        if 2 in filters:
            pair &= passed(2, filters[2])
        for m in range(2, longest + 1):
            n = max(0, len(self.code) - m + 1)
            out.append(out[-1][:n] & pair[m - 2 : m - 2 + n])
        return out

    def trie(self, shortest: int, longest: int, filters: dict[int, np.ndarray]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """Language, path and count of the nodes of each level from `shortest` to `longest`, in order."""
        valid, size = self.valid(longest, filters), max(1, len(self.names))
        at = np.flatnonzero(valid[shortest - 1])
        node, lang, path = self.lang[at].astype(np.int64), np.arange(len(self.langs)), None
        for m in range(1, longest + 1):
            if m > shortest:
                keep = np.zeros(len(self.code), bool)
                keep[: len(valid[m - 1])] = valid[m - 1]
                at, node = at[keep[at]], node[keep[at]]
            key, node, n = np.unique(node * size + self.code[at + m - 1], return_inverse=True, return_counts=True)
            parent, word = key // size, self.names.take(pa.array(key % size))
            lang = lang[parent]
            path = word if path is None else pc.binary_join_element_wise(path.take(pa.array(parent)), word, pa.scalar(" ", pa.large_string()))
            if m >= shortest:
                yield self.langs.take(pa.array(lang)), path, n


NODES = "lang string, phrase string, n long"
ROWS = NODES + ", section int, cells binary, counts binary"
_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("section", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def _tries(shortest: int, longest: int, filters: dict, least: int = 0):
    """(text, lang) -> the rows of a trie for each shard; with `least` also the rows of its sketch of pairs. filters: Spark's broadcasts by depth."""

    def told(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(0))
            for i, j in pieces(off, SHARD_BYTES, 1 << 30):
                shard = Shard(data[off[i] : off[j]], off[i : j + 1] - off[i], b.column(1).slice(i, j - i))
                if not len(shard.code):
                    continue
                for lang, path, n in shard.trie(shortest, longest, {m: x.value for m, x in filters.items()}):
                    for k in range(0, len(n), 1 << 16):
                        at = slice(k, k + (1 << 16))
                        yield told(lang=lang[at].cast(pa.string()), phrase=path[at].cast(pa.string()), n=n[at].astype(np.int64))
                if least:
                    made = list(shard.pairs(least))
                    if made:
                        yield told(section=[x[0] for x in made], cells=[x[1].tobytes() for x in made], counts=[x[2].tobytes() for x in made])

    return run


def _sums(least: int):
    """Sketches sorted by section -> the section's bits: cells whose counts add up to `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section, n = None, np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([section], pa.int32()), pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())], ["section", "bits"])

        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() != section:
                    if section is not None:
                        yield told()
                    section, n = b.column(0)[i].as_py(), np.zeros(SECTION, np.int64)
                at = np.cumsum(np.frombuffer(b.column(1)[i].as_buffer(), np.uint16), dtype=np.int64)
                n[at] += np.frombuffer(b.column(2)[i].as_buffer(), np.uint32)
        if section is not None:
            yield told()

    return run


def pairs_filter(tries: DataFrame, least: int) -> np.ndarray:
    """The filter of pairs that may be frequent, from the shards' sketches: CELLS bits, gathered by sections."""
    seen = np.zeros(CELLS // 64, np.uint64)
    rows = tries.where("section is not null").select("section", "cells", "counts").repartition("section").sortWithinPartitions("section")
    got = rows.mapInArrow(_sums(least), "section int, bits binary").toArrow()
    for section, bits in zip(got["section"].to_pylist(), got["bits"].to_pylist(), strict=True):
        part = np.frombuffer(bits, np.uint64)
        seen[section * len(part) : (section + 1) * len(part)] = part
    return seen


def _cells(depth: int):
    """(lang, phrase) of `depth` words -> slots of the filter and their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = hashes(pc.split_pattern(b.column(1), " ").values) if b.num_rows else np.zeros(0, np.uint64)
            at = cells([hashes(b.column(0)), *words.reshape(-1, depth).T])
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["slot", "bits"])

    return run


def filter_of(nodes: DataFrame, depth: int) -> np.ndarray:
    """The filter of the phrases of `depth` words in nodes: CELLS bits, gathered as CELLS / 64 rows at most."""
    seen = np.zeros(CELLS // 64, np.uint64)
    made = nodes.select("lang", "phrase").mapInArrow(_cells(depth), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    got = made.toArrow()
    seen[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return seen


def merged(tries: DataFrame, least: int) -> DataFrame:
    """The shards' nodes met by ranges of the path and summed; those of `least` or more, written."""
    rows = tries.where("section is null").select("lang", "phrase", "n")
    return cut(rows.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "nodes")


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    share = lambda bits: spark.sparkContext.broadcast(bits)  # noqa: E731  of CELLS bits, whatever the input
    tries = cut(slim.mapInArrow(_tries(1, 1, {}, least), ROWS), "tries")
    every = words = merged(tries, least)
    total = cut(tries.where("section is null").groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    filters = {1: share(filter_of(words, 1)), 2: share(pairs_filter(tries, least))}
    remove(tries)
    for shortest, deepest in ((2, min(2, longest)), (3, longest)):
        if shortest > longest:
            break
        tries = cut(slim.mapInArrow(_tries(shortest, deepest, filters), ROWS), "tries")
        level = merged(tries, least)
        remove(tries)
        every = every.unionByName(level)
        if deepest == 2:
            filters = {2: share(filter_of(level, 2))}
    scored = score_phrases(every, total)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def score_phrases(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates that no longer one stands for, with their lowest cut: lang, phrase, a, l, r, n, score."""
    words = F.split("phrase", " ")
    held = nodes.withColumns({"w": words, "m": F.size(words)}).where("m > 1").withColumnRenamed("n", "a")
    join = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    # One word less at either end is enough: what occurs as often in a longer phrase does so in those between, too.
    longer = held.where("m > 2").select("lang", F.explode(F.array(join(F.lit(1), F.col("m") - 1), join(F.lit(2), F.col("m") - 1))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = held.join(longer.hint("merge"), ["lang", "phrase"], "left").where("most is null or most < a").drop("most")
    kept = cut(kept, "candidates")
    cuts = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.col("m") - k), " ").alias("right")))
    parts = kept.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", "c.left", "c.right")
    for side, count in (("left", "l"), ("right", "r")):
        parts = parts.join(nodes.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)).hint("merge"), ["lang", side])
    parts = cut(parts.select("lang", "phrase", "a", "k", "l", "r"), "parts").join(totals.hint("merge"), "lang")
    big = lambda c: f"cast({c} as decimal(17, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {big('a')} * {big('total')}) div ({big('l')} * {big('r')})")
    best = parts.withColumn("score", score).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", F.col("total").alias("n"), "b.score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM starts, range(1, 6) AS t(m) WHERE i + m - 1 <= len(w)
), f AS (
  SELECT lang, m, phrase, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY lang, m, phrase
), total AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), candidate AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 100
), inner_phrase AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, max(a) AS most FROM candidate, range(1, 6) AS s(i), range(2, 5) AS t(k) WHERE k < m AND i + k - 1 <= m GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidate c LEFT JOIN inner_phrase o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.most IS NULL OR 100 * o.most < 100 * c.a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y FROM kept, range(1, 5) AS t(k) WHERE k < m
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, fx.a AS l, fy.a AS r, n, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(fx.a AS HUGEINT) * fy.a) AS BIGINT) AS score
  FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = c.x JOIN f fy ON fy.lang = c.lang AND fy.phrase = c.y JOIN total t ON t.lang = c.lang
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1
), ranked AS (
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM best
)
SELECT * FROM ranked WHERE rank <= 2000
"""
