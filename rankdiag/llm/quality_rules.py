"""Quality rules: a threshold table compiled into one projection, evaluated without user functions.

The measures of a text are SQL expressions over its words and lines; RULES names a measure, its lowest and highest
allowed value, and the smallest number of words from which the rule applies. `compile_rules` turns the table into
one boolean column and a list of the rules that a text broke.

Null and empty texts have no words: all measures are 0, base_failed is true and kept is false. Repeated rows each get
their own result. Very long texts cost n log n in their words. Other columns pass through; the added ones replace
columns of the same name. Windows of three words are compared by 64-bit hashes within their text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, table, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for on with as are this be at or by an was from have not "
    "le la les de des du et en un une que qui est pour dans sur au avec par pas "
    "der die das und ist von zu den mit im ein eine auf für nicht dem sich auch "
    "el los las que y del se por con una para es su al como más no"
).split()

#: (rule, measure, lowest, highest, from so many words)
RULES = (
    ("too_few_words", "n_words", 50, None, 0),
    ("word_length", "mean_word_chars", 2, 14, 1),
    ("symbols_per_word", "symbol_ratio", None, 0.10, 1),
    ("repeated_words", "repeat_ratio", None, 0.50, 1),
    ("repeated_lines", "dup_line_ratio", None, 0.50, 1),
    ("stop_words", "stop_ratio", 0.01, None, 1),
    ("capitals", "upper_ratio", None, 0.40, 1),
    ("letters", "letter_ratio", 0.60, None, 1),
)


def measures(text: str) -> list[dict[str, Column]]:
    """Projections, each on top of the one before, that end in all measures of the column."""
    size = lambda c: F.size(c).cast("long")
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    t, w, n = F.col("_t"), F.col("_words"), F.col("n_words")
    # Windows' hashes with their places in the low bits, so that sorting plain numbers brings equal windows together.
    h, m = F.col("_hashes"), (n - 2).cast("int")
    two = F.zip_with(F.slice(h, F.lit(1), m), F.slice(h, F.lit(2), m), lambda a, b: F.xxhash64(a, b))
    windows = F.when(n >= 3, F.zip_with(two, F.slice(h, F.lit(3), m), lambda a, b: F.xxhash64(a, b)))
    low = F.col("_low")  # one less than a power of two above the number of words
    packed = F.transform("_windows", lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    s, at = F.col("_sorted"), lambda x: x.bitwiseAND(low).cast("int")
    near = lambda a, b: F.when(F.coalesce(a.bitwiseXOR(b).between(0, low), F.lit(False)), F.array(at(a), at(b)))
    pairs = F.when(F.size(s) >= 2, F.filter(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), near), lambda x: x.isNotNull()))
    equal = F.filter("_pairs", lambda x: F.get("_windows", x[0]) == F.get("_windows", x[1]))
    places = F.flatten(F.transform(equal, lambda x: F.array(*[x[i] + k for i in (0, 1) for k in range(3)])))
    inked = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^{BLANKS}]"))
    short = max(len(w.encode()) for w in STOP_WORDS)
    return [
        {"_t": F.coalesce(F.col(text), F.lit(""))},
        {"_words": words(t), "_lines": inked},
        {"n_words": size(w), "_hashes": F.transform(w, lambda x: F.xxhash64(x))},
        {"_windows": windows, "_low": F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1.0))).cast("long") - 1},
        {"_sorted": F.sort_array(packed)},
        {"_pairs": pairs},
        {
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, rf"[^{re.escape(SYMBOLS)}]+", "")).cast("long"),
            "n_lines": size(F.col("_lines")),
            "n_dup_lines": size(F.col("_lines")) - size(F.array_distinct("_lines")),
            "n_repeat_words": F.when(F.size("_pairs") > 0, size(F.array_distinct(places))).otherwise(F.lit(0).cast("long")),
            "n_stop_words": size(F.filter(w, lambda x: (F.octet_length(x) <= short) & ascii_lower(x).isin(STOP_WORDS))),
            "_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
            "_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        },
        {
            "mean_word_chars": ratio(F.col("word_chars"), n),
            "symbol_ratio": ratio(F.col("n_symbols"), n),
            "repeat_ratio": ratio(F.col("n_repeat_words"), n),
            "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "stop_ratio": ratio(F.col("n_stop_words"), n),
            "upper_ratio": ratio(F.col("_upper"), F.col("_letters")),
            "letter_ratio": ratio(F.col("_letters"), F.col("word_chars")),
        },
    ]


def compile_rules(rules: Sequence[tuple]) -> Column:
    """The names of the rules that a row breaks."""
    broken = []
    for name, measure, low, high, least in rules:
        c, out = F.col(measure), F.lit(False)
        out = out | (c < low) if low is not None else out
        out = out | (c > high) if high is not None else out
        broken.append(F.when((F.col("n_words") >= least) & out, F.lit(name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules: Sequence[tuple] = RULES, text: str = "text") -> DataFrame:
    """docs with all measures, base_failed, broken (rule names) and kept."""
    out = docs
    for step in measures(text):
        out = out.withColumns(step)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumns({"base_failed": base, "broken": compile_rules(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("_t", "_words", "_lines", "_hashes", "_windows", "_low", "_sorted", "_pairs", "_upper", "_letters")


def good_rows(docs: DataFrame, rules: Sequence[tuple] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs.

    The row number in the condition keeps the optimizer from moving the condition below the measures, where each of
    them would be worked out anew wherever another uses it.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    judged = apply_rules(rows, rules, "_text").withColumn("_at", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COUNTS)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_SP = r"[\x20\x09-\x0D]"

#: kept and the counts for a table `documents`, as a CTE named judged that holds its columns too.
JUDGED_SQL = rf"""
t AS (SELECT *, row_number() OVER () AS _r, coalesce(text, '') AS _t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(_t, '{_SP}+'), lambda x: x <> '') AS _w,
  list_filter(string_split(_t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS _l FROM t),
g AS (SELECT _r, i, _w[i] || chr(10) || _w[i+1] || chr(10) || _w[i+2] AS tri FROM (SELECT _r, _w, unnest(range(1, len(_w) - 1)) AS i FROM w)),
d AS (SELECT _r, i FROM (SELECT _r, i, count(*) OVER (PARTITION BY _r, tri) AS n FROM g) WHERE n > 1),
c AS (SELECT _r, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) AS v(k) GROUP BY _r),
m AS (SELECT w.*, len(_w)::BIGINT AS n_words, length(regexp_replace(_t, '{_SP}', '', 'g'))::BIGINT AS word_chars,
  (length(_t) - length(translate(_t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(_l) - len(list_distinct(_l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(_l) AS _nl,
  len(list_filter(_w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOP}))) AS _stop,
  length(_t) - length(regexp_replace(_t, '\p{{Lu}}', '', 'g')) AS _up, length(_t) - length(regexp_replace(_t, '\p{{L}}', '', 'g')) AS _let
  FROM w LEFT JOIN c USING (_r)),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_words >= 50
  AND NOT (100 * n_repeat_words > 50 * n_words) AND word_chars / n_words BETWEEN 2 AND 14
  AND n_symbols / n_words <= 0.10::DOUBLE AND n_dup_lines / _nl <= 0.50::DOUBLE AND _stop / n_words >= 0.01::DOUBLE
  AND NOT (_let > 0 AND _up / _let > 0.40::DOUBLE) AND _let / word_chars >= 0.60::DOUBLE AS kept FROM m)
"""

OP3_SQL = f"WITH {JUDGED_SQL} SELECT doc_id, {', '.join(COUNTS)} FROM judged"
