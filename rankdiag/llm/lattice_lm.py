"""Language-model scores by a subword lattice.

A text is a sequence of words (A-Z lower-cased), each with a leading mark, and one end. A word's lattice has an arc for
each piece of an existing vocabulary and for each single byte, with unigram scores; a forward recursion in log space
sums over all ways to cut the word into pieces. So every text has a probability above 0, and its score is the log10 of
the product over its words and its end.

Piece scores are the vocabulary's own; where they are ranks (byte-pair vocabularies), a piece of rank r weighs
1 / (r + 10). The vocabulary itself stays as it is.

Options, all off unless asked for (the query asks for all of them, with two rounds):
- rounds: so many rounds of expectation-maximisation over the word counts of all training texts replace the piece scores
  by expected counts (PRIOR pseudo-counts keep the first ones alive).
- word_arcs: one more arc for each whole word. P(w) = max(c - D, 0) / N + D * V / N * lattice(w), with D = n1 / (n1 + 2 *
  n2) from the words seen once and twice.
- lang (needs word_arcs): where training rows name a language, the CLASSES - 1 most frequent ones and the rest are
  classes with word arcs of their own, P_k(w) = max(c_k - D, 0) / N_k + D * V_k / N_k * P(w), and piece scores of their
  own (the expected counts of the last round by class, with PRIOR pseudo-counts of the common ones). A text's probability
  is the classes' mixture by their shares of training texts. A scored text's own language is never read.

base_score is the add-one word model: sum over tokens of log10((c + 1) / (N + V + 1)).

All counts cover whole texts of all training rows. Words with 1 / 65,536 or more of all tokens (so 65,536 words at
most) reach the executors as a bounded table; only rarer words are shuffled, so no word is a hot key. The lattice runs
once for each distinct word of the table, in time and memory that grow with the longest word.

Null and empty texts are an end alone. A null doc_id counts as empty text for the split, so it is trained on. Rows
equal in id and text are scored once and returned as often as they occur. Without training rows N and V are 0 and the
pieces' first scores alone weigh the lattice. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, cut, flat, id_crc, mix, pieces, remove, row_key, table, word_spans

HOT = 1 << 16
CLASSES = 5
PRIOR = 2000.0
CELLS = 1 << 18  # letters in one lattice batch
BYTE_WEIGHT = 1e-6
MARK = b" "


class Vocabulary:
    """Pieces as byte strings, the word mark as a space; then 256 single bytes; the last entry is the end."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                b = sp.id_to_piece(i).replace("▁", " ").encode()
                if b and b" " not in b[1:] and not any("A" <= c <= "Z" for c in b.decode()):  # no other can match
                    found[b] = max(found.get(b, -np.inf), sp.get_score(i))
        self.pieces = sorted(found)
        score = np.array([found[b] for b in self.pieces])
        ranks = len(score) > 1 and float(score.min()) < -1000
        weight = 1 / (10 - score) if ranks else np.exp(score)
        n = len(self.pieces)
        self.first = np.concatenate([weight / weight.sum(), np.full(256, BYTE_WEIGHT), [0.02]])
        self.first /= self.first.sum()
        self.longest = max(map(len, self.pieces))
        # An open table from a piece's hash to its number.
        data = np.frombuffer(b"".join(self.pieces), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(b) for b in self.pieces])])
        h = self.hash(Rolling(data).of(off[:-1], off[1:]), np.diff(off))
        self.size = 1 << 19
        self.keys, self.ids = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32)
        at, left, self.probes = (h & np.uint64(self.size - 1)).astype(np.int64), np.arange(n), 0
        while len(left):
            slot = (at[left] + self.probes) % self.size
            free = self.ids[slot] < 0
            u, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[u], self.ids[u] = h[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            self.probes += 1

    @staticmethod
    def hash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(h + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.size - 1)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], np.int32(-1))
        for k in range(1, self.probes):
            miss = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
            if not len(miss):
                break
            slot = (at[miss] + k) % self.size
            out[miss] = np.where(self.keys[slot] == h[miss], self.ids[slot], out[miss])
        return out

    def lattice(self, data: np.ndarray, off: np.ndarray, logp: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of words (each with its mark) under each row of logp: words x rows.

        With `expected` (classes x entries) and one row of logp, adds the expected piece counts of words that occur
        as often as `counts` (words x classes) says.
        """
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        kinds = len(logp)
        out = np.zeros((len(size), kinds))
        roll = Rolling(data)
        n_pieces = len(self.pieces)
        with_edge = np.concatenate([logp[:, :n_pieces], np.full((kinds, 1), -np.inf)], 1)
        i = 0
        while i < len(order):
            width = int(size[order[i]])
            part = order[i : i + max(1, CELLS // max(1, width * kinds))]
            i += len(part)
            start, length = off[part], size[part]
            alive = np.searchsorted(-length, -np.arange(width + 1), "right")  # words of length t or more come first
            a = np.full((kinds, len(part), width + 1), -np.inf)
            a[:, :, 0] = 0
            steps = []
            for t in range(1, width + 1):
                m = alive[t]
                back = np.arange(1, min(t, self.longest) + 1)
                lo = start[:m, None] + t - back[None, :]
                hi = np.broadcast_to(start[:m, None] + t, lo.shape)
                ids = self.find(self.hash(roll.of(lo, hi), np.broadcast_to(back, lo.shape)).ravel()).reshape(lo.shape)
                used = (ids >= 0).any(0)
                ids, back = ids[:, used], back[used]
                byte = data[start[:m] + t - 1].astype(np.int64) + n_pieces
                v = np.concatenate([with_edge[:, ids] + a[:, :m, t - back], (logp[:, byte] + a[:, :m, t - 1])[:, :, None]], 2)
                top = v.max(2)
                a[:, :m, t] = top + np.log(np.exp(v - top[:, :, None]).sum(2))
                if expected is not None:
                    steps.append((ids, back, byte, v[0]))
            z = a[:, np.arange(len(part)), length]
            out[part] = z.T
            if expected is not None:
                b = np.full((len(part), width + 1), -np.inf)
                b[np.arange(len(part)), length] = 0
                for t in range(width, 0, -1):
                    ids, back, byte, v = steps[t - 1]
                    m = len(ids)
                    ahead = b[:m, t]
                    share = np.exp(v + (ahead - z[0, :m])[:, None])
                    known = ids >= 0
                    for c in range(counts.shape[1]):
                        weight = share * counts[part[:m], c][:, None]
                        expected[c, :n_pieces] += np.bincount(ids[known], weights=weight[:, :-1][known], minlength=n_pieces)
                        expected[c, n_pieces : n_pieces + 256] += np.bincount(byte - n_pieces, weights=weight[:, -1], minlength=256)
                    cols = t - back
                    b[:m, cols] = np.logaddexp(b[:m, cols], with_edge[0, ids] + ahead[:, None])
                    b[:m, t - 1] = np.logaddexp(b[:m, t - 1], logp[0, byte] + ahead)
        return out


_held: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the given spans, one after another."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    return off, data[np.repeat(start - off[:-1], size) + np.arange(off[-1])]


def strings(off: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Rolling(data).of(start, end) + (end - start).astype(np.uint64))


def _count(classes: int):
    """(text, class or -1 if held out) -> (word, train by class, n): counts of a few MB of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(0))
            kind = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64) % (classes + 1)  # held-out rows are the last
            for i, j in pieces(off, 1 << 22, 1 << 20):
                x = LOWER[data[off[i] : off[j]]]
                start, end, row = word_spans(x, off[i : j + 1] - off[i])
                if not len(start):
                    continue
                _, first, which = np.unique(_hashes(x, start, end), return_index=True, return_inverse=True)
                n = np.bincount(which * (classes + 1) + kind[i:j][row], minlength=len(first) * (classes + 1)).reshape(-1, classes + 1)
                yield pa.RecordBatch.from_arrays([strings(*gather(x, start[first], end[first])), *[pa.array(n[:, k]) for k in range(classes)], pa.array(n.sum(1))], ["word", *[f"t{k}" for k in range(classes)], "n"])

    return run


def _marked(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words with their mark in front."""
    off, data = flat(arr)
    n = len(off) - 1
    out = np.full(len(data) + n, MARK[0], np.uint8)
    keep = np.ones(len(out), bool)
    keep[off[:-1] + np.arange(n)] = False
    out[keep] = data
    return off + np.arange(n + 1), out


def _expect(path: str, logp: np.ndarray):
    """(word, train by class) -> expected counts of entries by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = None
        for b in batches:
            v = vocabulary(path)
            counts = np.stack([c.to_numpy() for c in b.columns[1:]], 1).astype(float)
            expected = np.zeros((counts.shape[1], len(logp))) if expected is None else expected
            v.lattice(*reversed(_marked(b.column(0))), logp[None], counts, expected)
        if expected is not None:
            kind, at = np.nonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(expected[kind, at])], ["k", "entry", "n"])

    return run


class Arcs:
    """Log10 probabilities of words in each class from their counts and their piece lattice."""

    def __init__(self, discount: float, tokens: list[int], types: list[int], all_tokens: int, all_types: int, words: bool = True):
        self.words = words
        self.d, self.n, self.v = discount, np.array(tokens, float), np.array(types, float)
        self.all_n, self.all_v = all_tokens, all_types

    def rate(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """counts and lattice (natural logs): words x classes."""
        if not self.all_n or not self.words:
            return lattice / np.log(10)
        with np.errstate(divide="ignore"):
            whole = np.logaddexp(np.log(np.maximum(counts.sum(1) - self.d, 0) / self.all_n)[:, None], np.log(self.d * self.all_v / self.all_n) + lattice)
            own = np.log(np.maximum(counts - self.d, 0) / self.n)
            return np.logaddexp(own, np.log(self.d * self.v / self.n) + whole) / np.log(10)


def _rate(path: str, logp: np.ndarray, arcs: Arcs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lattice = vocabulary(path).lattice(*reversed(_marked(b.column(0))), logp)
            counts = np.stack([c.to_numpy() for c in b.columns[1:-1]], 1)
            lp = arcs.rate(counts, lattice)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts.sum(1)), b.columns[-1], *[pa.array(v) for v in lp.T]], ["word", "train", "n", *[f"lp{k}" for k in range(lp.shape[1])]])

    return run


def _sums(hot: np.ndarray, value: np.ndarray):
    """(key, doc_id, text) -> per document the sums over frequent words, and a row for each of its rarer words, whose n says how often."""
    names = ["key", "doc_id", "word", "rows", "n", "known", "base", *[f"lp{k}" for k in range(value.shape[1] - 2)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(2))
            for i, j in pieces(off):
                x = LOWER[data[off[i] : off[j]]]
                start, end, row = word_spans(x, off[i : j + 1] - off[i])
                h = _hashes(x, start, end) if len(start) else np.zeros(0, np.uint64)
                at = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
                is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                own = [np.bincount(row[is_hot], weights=value[at[is_hot], k], minlength=j - i) for k in range(value.shape[1])]
                n = np.bincount(row, minlength=j - i)
                one = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.nulls(j - i, pa.string()), pa.array(np.ones(j - i, np.int64)), pa.array(n.astype(np.int64)), pa.array(own[0].astype(np.int64)), *[pa.array(v.astype(float)) for v in own[1:]]], names)
                cold = np.flatnonzero(~is_hot)
                cold = cold[np.lexsort((h[cold], row[cold]))]
                new = np.ones(len(cold), bool)  # each document's words once, with how often (in the column n)
                new[1:] = (h[cold][1:] != h[cold][:-1]) | (row[cold][1:] != row[cold][:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(cold)))
                cold = cold[new]
                for k in range(0, len(cold), 1 << 15):
                    c = cold[k : k + (1 << 15)]
                    zero, z = pa.array(np.zeros(len(c), np.int64)), pa.array(np.zeros(len(c)))
                    who = pa.array(row[c])
                    yield pa.RecordBatch.from_arrays([one.column(0).take(who), one.column(1).take(who), strings(*gather(x, start[c], end[c])), zero, pa.array(times[k : k + (1 << 15)]), zero, *[z] * (value.shape[1] - 1)], names)

    return run


def score_texts(docs: DataFrame, held_out, vocabulary_path: str, rounds: int = 0, text: str = "text", lang: str | None = None, word_arcs: bool = False) -> DataFrame:
    """A row for each of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if lang and not word_arcs:
        raise ValueError("classes by language need word arcs")
    slim = docs.select("doc_id", held_out.alias("held_out"), row_key(F.col("doc_id"), F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
    trained = slim.where("not held_out")
    top = trained.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES - 1).collect() if lang else []
    classes = len(top) + 1  # the last is the rest
    kind = F.lit(len(top))
    for k, r in enumerate(top):
        kind = F.when(F.col("lang") == r["lang"], k).otherwise(kind)
    ends_by = {r["k"]: r["count"] for r in trained.groupBy(kind.alias("k")).count().collect()}
    ends = [ends_by.get(k, 0) for k in range(classes)]
    t = [f"t{k}" for k in range(classes)]
    schema = "word string, " + ", ".join(f"{c} long" for c in t) + ", n long"
    counts = slim.select("text", F.when(F.col("held_out"), -1).otherwise(kind).alias("k")).mapInArrow(_count(classes), schema)
    counts = cut(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in t], F.sum("n").alias("n")), "words")
    train = sum((F.col(c) for c in t[1:]), F.col(t[0]))
    got = counts.agg(F.sum("n"), F.sum(train), F.count_if(train > 0), F.count_if(train == 1), F.count_if(train == 2), *[F.sum(c) for c in t], *[F.count_if(F.col(c) > 0) for c in t]).first()
    tokens, words_n, distinct_words, once, twice = (v or 0 for v in got[:5])
    all_ends = sum(ends)
    total, distinct = words_n + all_ends, distinct_words + (all_ends > 0)
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    shares = [e / max(1, all_ends) for e in ends]
    arcs = Arcs(discount, [max(1, (got[5 + k] or 0) + ends[k]) for k in range(classes)], [max(1, got[5 + classes + k] + (ends[k] > 0)) for k in range(classes)], total, distinct, word_arcs)
    first = vocabulary(vocabulary_path).first
    p, by_class = first, np.repeat(first[None], classes, 0)
    for _ in range(rounds if total else 0):
        found = counts.where(train > 0).select("word", *t).mapInArrow(_expect(vocabulary_path, np.log(p)), "k long, entry long, n double").groupBy("k", "entry").agg(F.sum("n").alias("n")).collect()  # as many as classes times entries of the vocabulary
        expected = np.zeros_like(by_class)
        for r in found:
            expected[r["k"], r["entry"]] = r["n"]
        expected[:, -1] += ends
        p = expected.sum(0) + PRIOR * first
        p /= p.sum()
        by_class = expected + PRIOR * p
        by_class /= by_class.sum(1, keepdims=True)
    lps = [f"lp{k}" for k in range(classes)]
    lp_schema = ", ".join(f"{c} double" for c in lps)
    rated = cut(counts.mapInArrow(_rate(vocabulary_path, np.log(by_class), arcs), f"word string, train long, n long, {lp_schema}"), "rated")
    remove(counts)
    is_hot = F.col("n") * HOT >= F.lit(tokens)
    hot = rated.where(is_hot).toArrow()  # HOT rows at most
    off, data = flat(hot["word"])
    h = _hashes(data, off[:-1], off[1:]) if len(data) else np.zeros(0, np.uint64)
    order = np.argsort(h)
    c = hot["train"].to_numpy()[order]
    value = np.stack([(c > 0).astype(float), np.log10(c + 1.0), *[hot[k].to_numpy()[order] for k in lps]], 1)
    parts = slim.select("key", "doc_id", "text").mapInArrow(_sums(h[order], value), f"key long, doc_id long, word string, rows long, n long, known long, base double, {lp_schema}")
    rare = rated.where(~is_hot).select("word", F.col("train").alias("_c"), *[F.col(k).alias(f"_{k}") for k in lps])
    # Documents' own rows have no word: with a value of their own they find no partner and are spread evenly.
    spread = parts.withColumn("_w", F.coalesce("word", F.concat(F.lit(" "), F.col("key").cast("string"))))
    joined = spread.join(rare.hint("merge"), F.col("_w") == rare["word"], "left")
    own_row = F.col("rows") > 0
    sums = joined.groupBy("key", "doc_id").agg(
        F.sum("rows").alias("m"),
        F.sum(F.when(own_row, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.col("known") + F.when(F.col("_c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.when(F.col("_c").isNotNull(), F.col("n") * F.log10(F.col("_c") + 1.0)).otherwise(0.0)).alias("base"),
        *[F.sum(F.col(k) + F.when(own_row, 0.0).otherwise(F.col("n") * F.coalesce(f"_{k}", F.lit(0.0)))).alias(k) for k in lps],
    )
    n = (F.col("n") / F.col("m")).cast("long") + 1
    end = arcs.rate(np.array([ends], float), np.log(by_class[None, :, -1]))[0]
    live = [k for k in range(classes) if shares[k] > 0] or [0]
    own = {k: F.col(lps[k]) / F.col("m") + F.lit(float(end[k] + np.log10(shares[k] or 1.0))) for k in live}
    most = F.greatest(*own.values()) if len(own) > 1 else own[live[0]]
    mixed = most + F.log10(sum((F.pow(F.lit(10.0), v - most) for v in own.values()), F.lit(0.0)))
    out = sums.select(
        "doc_id",
        n.alias("n_tokens"),
        ((F.col("known") / F.col("m")).cast("long") + F.lit(int(all_ends > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("m") + F.lit(float(np.log10(all_ends + 1.0))) - n * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"),
        mixed.alias("score"),
        F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int"))).alias("_row"),
    )
    return out.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_texts(docs, id_crc(F.col("doc_id")) % 7 == 2, public_tokenizers.path("piece_bpe_32k.model"), rounds=2, lang="lang", word_arcs=True)
