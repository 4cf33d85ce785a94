"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words and pairs of neighbouring words, A-Z lower-cased, hashed into
BUCKETS): one of the target texts (rows that a label table calls good), one of all raw texts. A text's log weight is
the sum over its n-grams of log p_target - log p_raw. Adding Gumbel noise to the log weights and taking the k
largest draws k texts without replacement with odds in proportion to the weights.

The weight is the plain ratio of the two probabilities. With `sharpness` the log weight that is sampled is instead its
mean over the n-grams times that number, so that length does not count. k is a share of all rows. Both models count all
rows and whole texts. The noise is a function of id, text and seed, so reruns agree. The k-th largest key is found by
narrowing a histogram over a written table of keys; no sort of all rows and nothing that grows comes to the driver. Ties
at the border go by smaller doc_id, then by the row's hash; of rows equal in both as many are taken as make k.

Null and empty texts have no n-grams and log weight 0. Documents with several labels count once for each good label.
A null doc_id matches no label. If no row is good the target model equals the raw model. Repeated rows stay. An
empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, cut, flat, mix, pieces, table, word_spans

BUCKETS = 1 << 14
SHARE = 0.8
_STEP = np.uint64(0xA0761D6478BD642F)


def ngrams(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word and each pair of words."""
    data = LOWER[data]
    start, end, row = word_spans(data, off)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z
    h = mix(Rolling(data).of(start, end) + (end - start).astype(np.uint64))
    two = row[1:] == row[:-1]
    pair = mix(h[:-1] * _STEP + h[1:])[two]
    return np.concatenate([row, row[:-1][two]]), (np.concatenate([h, pair]) % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    """(text, times in the target) -> counts by bucket over the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets), np.zeros(buckets)
        for b in batches:
            off, data = flat(b.column(0))
            times = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in pieces(off):
                row, at = ngrams(data[off[i] : off[j]], off[i : j + 1] - off[i], buckets)
                raw += np.bincount(at, minlength=buckets)
                good += np.bincount(at, weights=times[i:j][row].astype(float), minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used].astype(np.int64)), pa.array(good[used].astype(np.int64))], ["bucket", "raw", "good"])

    return run


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = flat(b.column(2))
            for i, j in pieces(off):
                row, at = ngrams(data[off[i] : off[j]], off[i : j + 1] - off[i], len(ratio))
                n = np.bincount(row, minlength=j - i)
                total = np.bincount(row, weights=ratio[at], minlength=j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(total)], ["doc_id", "row_hash", "n_ngrams", "log_ratio"])

    return run


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column of finite doubles; None if k is 0 or the table has fewer rows."""
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 0 < k <= n:
        return None
    above = 0
    while lo < hi:
        width = (hi - lo) / 1024
        narrow = not width or lo + width == lo or hi - width == hi  # at most some thousand doubles lie in between: count each
        here = keys.where((F.col(column) >= lo) & (F.col(column) <= hi))
        at = F.col(column) if narrow else F.least(F.lit(1023), F.floor((F.col(column) - lo) / width))
        bins = here.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b["b"]):  # at most some thousand rows
            if above + b["n"] >= k:
                lo, hi = b["lo"], b["hi"]
                break
            above += b["n"]
    return lo


def resample(docs: DataFrame, good_ids: DataFrame, share: float = SHARE, sharpness: float | None = None, buckets: int = BUCKETS, seed: int = 1, text: str = "text") -> DataFrame:
    """A row for each of docs: doc_id, n_ngrams, log_ratio, gumbel_key, kept. good_ids: a table (doc_id) of the target."""
    slim = docs.select("doc_id", F.col(text).alias("text"))
    good = good_ids.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_times"))
    # A merge at every size: whether the labels could be broadcast depends on the size of the corpus.
    marked = slim.join(good.hint("merge"), slim["doc_id"] == good["_id"], "left").select("text", F.coalesce("_times", F.lit(0)).alias("times"))
    parts = marked.mapInArrow(_count(buckets), "bucket long, raw long, good long")
    counts = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # a row a bucket
    raw, target = np.ones(buckets), np.ones(buckets)
    for c in counts:
        raw[c["bucket"]] += c["raw"]
        target[c["bucket"]] += c["good"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if not any(c["good"] for c in counts):
        ratio[:] = 0
    weighed = slim.select("doc_id", F.xxhash64("doc_id", "text", F.lit(seed)).alias("row_hash"), "text").mapInArrow(_weigh(ratio), "doc_id long, row_hash long, n_ngrams long, log_ratio double")
    uniform = (F.shiftrightunsigned(F.col("row_hash"), 11).cast("double") + 0.5) / float(1 << 53)
    mean = F.col("log_ratio") if sharpness is None else F.when(F.col("n_ngrams") > 0, sharpness * F.col("log_ratio") / F.col("n_ngrams")).otherwise(F.lit(0.0))
    # Written with a number of its own for each row, so that of equal rows at the border as many are taken as there is room for.
    weighed = cut(weighed.withColumn("gumbel_key", mean - F.log(-F.log(uniform))).withColumn("_n", F.monotonically_increasing_id()), "weights")
    n = weighed.count()
    k = round(share * n)
    shown = ["doc_id", "n_ngrams", "log_ratio", "gumbel_key"]
    edge = kth_largest(weighed, "gumbel_key", k)
    if edge is None:
        return weighed.select(*shown, F.lit(k > 0).alias("kept"))
    sure = weighed.where(F.col("gumbel_key") > edge).count()
    tied = weighed.where(F.col("gumbel_key") == edge)
    left = k - sure
    for last in tied.groupBy("doc_id", "row_hash").count().orderBy(F.col("doc_id").asc_nulls_last(), "row_hash").toLocalIterator():
        if last["count"] >= left:
            break
        left -= last["count"]
    place = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "row_hash")
    border = F.struct(F.lit(last["doc_id"] is None), F.lit(last["doc_id"] or 0).cast("long"), F.lit(last["row_hash"]).cast("long"))
    most = -kth_largest(tied.where(place == border).select((-F.col("_n")).cast("double").alias("m")), "m", left)
    first = (place < border) | ((place == border) & (F.col("_n") <= most))
    return weighed.select(*shown, ((F.col("gumbel_key") > edge) | ((F.col("gumbel_key") == edge) & first)).alias("kept"))


def op1_ngram_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good)
