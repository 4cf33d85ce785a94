"""The corpus pipeline: quality rules, near-dedup, repeated passages, decontamination, source mix.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdiag.llm import decontaminate as leaks
from rankdiag.llm import mixing, near_dedup, suffix_dedup
from rankdiag.llm import quality_rules as rules
from rankdiag.llm.common import clean, cut, table, tracked

#: Texts whose sets of five-word shingles reach this similarity are near-duplicates.
SIMILARITY = 80

#: A passage that goes has more than 50 words; strings of this many bytes are matched, four for each of fifty words.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_ANCHOR = 51, 200, 48


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule; null and empty texts break one. Each row is judged alone, repeated rows alike."""
    return rules.good_rows(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null ids, and texts without words, have no partners and stay. Rows that share a kept id all stay.
    """
    gone = near_dedup.near_duplicates(docs, SIMILARITY).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of PASSAGE_WORDS words or more that repeat; n_chars follows the text.

    Null texts stay null. Rows equal in id and text are copies of each other. A text that is all passage becomes empty.
    """
    left = suffix_dedup.dedup_text(docs, PASSAGE_BYTES, PASSAGE_ANCHOR, least_words=PASSAGE_WORDS)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    n = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumns({"text": text, "n_chars": n}).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Repeated rows are judged alike."""
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken at least once, with how often and how many words.

    Texts without words count as 0 words; null sources are one source, the last. Repeated rows are drawn one by one.
    """
    return mixing.mix_sources(docs).where("copies > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with tracked() as made:  # by this run alone; others may write at the same time
        for name, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
            clean(spark, docs, only=made)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-duplicate components, alignments and the cube method are not expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None
