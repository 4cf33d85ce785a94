"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, lattice_lm, mixing, near_dedup, ngram_resample, phrases, quality_rules, ranked_search, suffix_dedup, token_counts, url_filter, window_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_resample": ngram_resample.op1_ngram_resample,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_lattice_lm": lattice_lm.op5_lattice_lm,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_phrases": phrases.op11_phrases,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_window_dedup": window_dedup.op13_window_dedup,
}

SQL = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
    "op13_window_dedup": window_dedup.OP13_SQL,
}
