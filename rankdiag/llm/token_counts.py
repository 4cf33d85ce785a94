"""Token counts by a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens). `tokenizer` is the SHA-256 of the tokenizer's file, so
another version never reads this one's counts; `digest` is the SHA-256 of the normalised content. The normal form
must not change counts: null becomes empty, nothing else changes. Contents are made distinct by digest, those whose
digest the cache holds are left out before contents move, the misses alone are encoded, and their counts are appended. Then every row is
joined to its count by digest.

A byte-level BPE tokenizer cuts a text before it merges, always where white space follows another character. So its
texts are cut there, equal parts of a few MB are encoded once, and counts of short parts are kept within a task.

Equal contents in the input are encoded once. A failed append leaves no partial rows (Parquet's commit), and a digest
that two runs appended both is read once. Null and empty texts count 0 tokens. Whole texts are encoded, a few MB at
a time. Repeated rows stay, extra columns pass through, and n_bytes, n_tokens and over_limit replace columns of the
same name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, cut, flat, pieces, shared_dir, table

#: Bytes of text whose equal parts are encoded once, and counts of parts that a task keeps.
PART_BYTES, KEPT_PARTS = 4 << 20, 200_000

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _counter(path: str):
    """From texts to their token counts, without added tokens, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def _cut_by_blanks(path: str) -> bool:
    """Whether a tokenizer's file says that counts of a text are those of its parts, cut before white space that follows another character."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre, model = t.get("pre_tokenizer") or {}, t["model"]
    plain = all(not re.search(r"\s", a["content"]) and not (a["single_word"] or a["lstrip"] or a["rstrip"]) for a in t.get("added_tokens") or [])
    return plain and t.get("normalizer") is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True) and model.get("type") == "BPE" and not model.get("dropout")


def _parts(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where parts start in bytes of texts, ends included, and the first part of each text that is not empty.

    A part starts at an ASCII blank after another character. Characters whose first byte other blanks share (no-break
    spaces and such) start none after them, which makes parts longer, never wrong.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data), bool)
    cut[1:] = blank[1:] & ~blank[:-1] & ((data[:-1] < 28) | (data[:-1] > 31))  # some take these for blanks
    cut[2:] &= data[:-2] != 0xC2
    cut[3:] &= (data[:-3] < 0xE1) | (data[:-3] > 0xE3)
    first = off[:-1][off[1:] > off[:-1]]
    cut[first] = True
    at = np.flatnonzero(cut)
    return np.append(at, len(data)), np.searchsorted(at, first)


def _part_counter(path: str):
    """From offsets and bytes of texts to their token counts by parts; counts of short parts are kept, up to KEPT_PARTS of them."""
    count = _counter(path)
    kept: dict[str, int] = {}

    def of(off: np.ndarray, data: np.ndarray) -> np.ndarray:
        n = np.zeros(len(off) - 1, np.int64)
        if not len(data):
            return n
        at, first = _parts(off, data)
        parts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        each = parts.dictionary.to_pylist()
        new = [p for p in each if p not in kept]
        known = dict(zip(new, count(new), strict=True)) if new else {}
        tokens = np.array([kept[p] if p in kept else known[p] for p in each], np.int64)
        if len(kept) < KEPT_PARTS:
            kept.update((p, k) for p, k in known.items() if len(p) <= 32)
        n[off[1:] > off[:-1]] = np.add.reduceat(tokens[parts.indices.to_numpy()], first)
        return n

    return of


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, by_parts = None, _cut_by_blanks(path)
        for b in batches:
            count = count or (_part_counter(path) if by_parts else _counter(path))
            off, data = flat(b.column(1))
            n: list[int] = []
            for i, j in pieces(off, PART_BYTES) if by_parts else pieces(off):
                n += count(off[i : j + 1] - off[i], data[off[i] : off[j]]).tolist() if by_parts else count(b.column(1).slice(i, j - i).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * b.num_rows), b.column(0), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. `tokenizer` is a file that every executor has; `cache` a shared folder."""
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    held = docs.withColumns({"_content": F.coalesce(F.col(text), F.lit(""))})
    held = held.withColumns({"_digest": F.unhex(F.sha2("_content", 256)), "n_bytes": F.octet_length("_content").cast("long")})

    def stored() -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    asked = held.select("_digest", "_content")
    if (have := stored()) is not None:
        # Digests alone meet the cache; where few miss, Spark sends those to the contents, and contents that hit never move.
        new = cut(held.select("_digest").distinct().join(have, F.col("_digest") == F.col("digest"), "left_anti"), "misses")
        asked = asked.join(new, "_digest", "left_semi")
    misses = asked.groupBy("_digest").agg(F.first("_content").alias("_content"))
    misses.mapInArrow(_encode(tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    # Written, so that the join by digest stands on exchanges of its own, which Spark can split where a content is very frequent.
    counts = cut(stored().select(F.col("digest").alias("_digest"), F.col("n_tokens").alias("_n")), "counts")
    out = held.drop("_content", "n_tokens", "over_limit").join(counts, "_digest", "left")
    return out.withColumns({"n_tokens": F.col("_n"), "over_limit": F.col("_n") > limit}).drop("_digest", "_n")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so every distinct content is encoded in this run; `clean` deletes it."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/rankdiag-token-cache-{uuid.uuid4().hex}"
    claim(spark, cache)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")
