"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier over hashed byte n-grams (one to four bytes, letters
lower-cased where ASCII, other ASCII characters as one separator) predicts each bit. Decoding weighs each bit's
logistic loss: the language whose codeword has the least total loss wins. `score` is its share among all languages
when losses are turned into probabilities, and `ambiguous` is true where the nearest two codewords differ in loss by
less than MARGIN a bit.

Codewords are rows of a pseudo-random matrix, 16 bits or more; each bit parts the languages in halves. The matrix is
drawn again, with more and more bits, until all rows differ in a quarter of the bits or more.

Training fits all bits at once by gradient descent on at most SAMPLE labelled rows (of each language's rows those with
the smallest hash, an equal share for each language and at least one), the documented bound of the training sample.
Executors turn their whole texts into vectors of FEATURES numbers, and those alone come to the driver. Prediction
reads every whole text.

Null texts and texts without a letter give lang_pred `und`, score 0. If there is nothing to learn from, all rows are
`und`. Rows with a null lang are not learned from. Repeated rows stay; an empty table gives an empty result. Extra
columns are not carried. Ties go to the language first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, id_crc, pieces, table

FEATURES = 1 << 12
SAMPLE = 2000
MARGIN = 0.05

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def features(data: np.ndarray, off: np.ndarray, size: int = FEATURES) -> np.ndarray:
    """A row of hashed n-gram frequencies (square roots, unit length) for each text."""
    n = len(off) - 1
    out = np.zeros((n, size), np.float32)
    if not len(data):
        return out
    x = _LETTER[data].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(off))
    for k in range(1, 5):
        if len(x) < k:
            break
        gram = np.zeros(len(x) - k + 1, np.uint32)
        for j in range(k):
            gram |= x[j : len(x) - k + 1 + j] << np.uint32(8 * j)
        gram = (gram + np.uint32(k)) * np.uint32(0x9E3779B1)
        gram ^= gram >> np.uint32(15)
        at = ((gram * np.uint32(0x85EBCA6B)) >> np.uint32(8)) % np.uint32(size)
        own = row[: len(gram)] == row[k - 1 :]
        if n == 1:
            out[0] += np.bincount(at, minlength=size)
        else:
            out += np.bincount(row[: len(gram)][own] * size + at[own], minlength=n * size).reshape(n, size).astype(np.float32)
    out = np.sqrt(out)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1 that differ pairwise in a quarter of the bits or more."""
    half = np.where(np.arange(n) < n // 2, 1.0, -1.0)
    for k in count():
        bits = max(16, 4 * int(np.ceil(np.log2(max(2, n)))) + 4) + 4 * (k // 8)
        draw = np.random.default_rng([n, k])
        code = np.stack([draw.permutation(half) for _ in range(bits)], 1)
        agree = code @ code.T - 2 * bits * np.eye(n)
        if agree.max() <= bits / 2:  # agreements less differences
            return code.astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 150, rate: float = 60.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (features + 1) x bits of all binary classifiers; languages count alike."""
    sign = code[y]
    weight = (1 / np.bincount(y, minlength=len(code)))[y].astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    for _ in range(steps):
        g = -sign / (1 + np.exp(np.clip(sign * (x @ w + b), -30, 30))) * weight[:, None]
        w -= rate * (x.T @ g + decay * w)
        b -= rate / 10 * g.sum(0)
    return np.vstack([w, b])


def decode(x: np.ndarray, w: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, score and ambiguity."""
    m = x @ w[:-1] + w[-1]
    bits = code.shape[1]
    loss = np.logaddexp(0, -m) @ (code.T > 0) + np.logaddexp(0, m) @ (code.T < 0)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    best = loss.argmin(1)
    score = 1 / p.sum(1)
    near = np.partition(loss, 1, axis=1)[:, :2] if code.shape[0] > 1 else np.stack([loss[:, 0], loss[:, 0] + bits], 1)
    return best, score, near[:, 1] - near[:, 0] < MARGIN * bits


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, data = flat(b.column(1))
        for i, j in pieces(off, 1 << 18, 256):
            x = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([v.tobytes() for v in x], pa.binary()), b.column(2).slice(i, j - i), b.column(3).slice(i, j - i)], ["lang", "vector", "_at", "doc_id"])


def _predict(w: np.ndarray, code: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(2))
            letters = b.column(3).to_numpy(zero_copy_only=False)
            for i, j in pieces(off, 1 << 18, 256):
                best, score, vague = decode(features(data[off[i] : off[j]], off[i : j + 1] - off[i], len(w) - 1), w, code)
                known = letters[i:j].astype(bool)
                lang = [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(lang), pa.array(np.where(known, np.clip(score, 0, 1), 0.0).astype(np.float64)), pa.array(~known | vague)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, held_out, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each of docs: doc_id, held_out, lang_pred, score, ambiguous. Learns from labelled rows that are not held out."""
    slim = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"))
    labelled = slim.where("not held_out and lang is not null and text <> ''")
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") / float(1 << 53)
    labelled = labelled.withColumn("_at", place)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("_at").alias("least")).collect()  # a row a language, as the model itself has
    share = max(1, sample // max(1, len(counts)))
    ample = share + 6 * share**0.5 + 10  # expected rows to draw from, so that share or more are drawn
    listed = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], min(1.0, ample / r["n"]))) for r in counts], "_l string, p double")
    odds = F.broadcast(listed)
    chosen = labelled.join(odds, F.col("lang") == F.col("_l")).where("_at <= p")
    vectors = chosen.select("lang", "text", "_at", "doc_id").mapInArrow(_vectors, "lang string, vector binary, _at double, doc_id long")
    own = F.row_number().over(Window.partitionBy("lang").orderBy("_at", "doc_id"))
    rows = vectors.withColumn("_k", own).where(F.col("_k") <= share).orderBy("_at", "doc_id").select("lang", "vector").toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    if not names:
        return slim.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    code = codewords(len(names))
    x = np.frombuffer(flat(rows["vector"])[1].tobytes(), np.float32).reshape(-1, FEATURES)
    w = train(x, np.array([names.index(v) for v in rows["lang"].to_pylist()]), code)
    letter = F.col("text").rlike(r"\p{L}")
    return slim.select("doc_id", "held_out", "text", letter.alias("letters")).mapInArrow(_predict(w, code, names), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, id_crc(F.col("doc_id")) % 4 == 2)
