"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a host, a path prefix and an action. It fits its host and all subdomains of it when the url's path starts
with the rule's path. Its literal tokens are the labels of its host and those segments of its path that a slash ends;
of these the token that the fewest urls hold is its index entry. A url's own tokens fetch the rules indexed under
them, and only those rules' regular expressions run. The longest fitting rule (then the longer host, then the larger
text) decides; without one the verdict is `default`.

Up to MAX_RULES rules the index is a literal with a proven bound, so everything is one projection of SQL functions
after one small count, without a shuffle of urls. Larger rule sets are a table: distinct urls' tokens join the rules
indexed under them, and the best rule of each url joins back.

Null, empty and malformed urls have empty host and path, fit no rule and get the default. Hosts and paths may hold any
other character, line feeds too. Rules equal in host and path: the larger action text decides. Repeated rows stay, an
empty table gives an empty result, and no rules leave every url the default. Other columns of the input pass through;
the added ones replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, table

MAX_RULES = 2000

#: (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def literal_tokens(host: str, path: str) -> list[str]:
    """Tokens that any url that the rule fits must hold."""
    return [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in path.split("/")[:-1] if x]


def patterns(host: str, path: str) -> tuple[str, str]:
    """The rule as regular expressions over host and path."""
    return rf"(?s)^(?:.*\.)?{re.escape(host)}\z", rf"(?s)^{re.escape(path)}"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty where there is no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    of = lambda c, by, mark: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(of(host, r"\.", "h:"), of(path, "/", "p:")))


def _entry(action: Column, host: Column, path: Column, host_regex: Column, path_regex: Column) -> Column:
    """A rule's index entry; of the fitting ones the greatest decides."""
    rule = F.concat(host, path)
    return F.struct(F.length(rule).alias("size"), F.length(host).alias("host_size"), rule.alias("rule"), action.alias("action"), host_regex.alias("host_regex"), path_regex.alias("path_regex"))


def _fits(r: Column) -> Column:
    return F.regexp_like(F.col("host"), r["host_regex"]) & F.regexp_like(F.col("path"), r["path_regex"])


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """df with host, path, rule, verdict and n_candidates (rules whose expressions ran)."""
    for _, h, p in rules:
        if not literal_tokens(h, p):
            raise ValueError(f"a rule needs a literal token: {h!r} {p!r}")
    host, path = url_parts(F.col(url))
    base = df.withColumns({"host": host, "path": path})
    base = base.withColumn("_tokens", _tokens(F.col("host"), F.col("path")))
    if not rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "n_candidates": F.lit(0)}).drop("_tokens")
    base = _by_literal(base, rules) if len(rules) <= MAX_RULES else _by_table(base, rules)
    return base.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.action", F.lit(default)), "n_candidates": F.coalesce("_n", F.lit(0)).cast("int")}).drop("_tokens", "_best", "_n")


def _by_literal(base: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """base with _best and _n, by an index that is a literal."""
    known = sorted({t for _, h, p in rules for t in literal_tokens(h, p)})
    held = base.select([F.count_if(F.array_contains("_tokens", t)).alias(f"n{i}") for i, t in enumerate(known)]).first()
    count = {t: held[i] for i, t in enumerate(known)}
    index: dict[str, list[Column]] = {}
    for action, h, p in rules:
        entry = _entry(*map(F.lit, (action, h, p, *patterns(h, p))))
        index.setdefault(min(literal_tokens(h, p), key=lambda t: (count[t], t)), []).append(entry)
    lookup = F.create_map(*[x for t, entries in sorted(index.items()) for x in (F.lit(t), F.array(*entries))])
    fetched = F.flatten(F.transform(F.array_intersect("_tokens", F.array(*map(F.lit, sorted(index)))), lambda t: lookup[t]))
    base = base.withColumn("_fetched", fetched)
    return base.withColumns({"_best": F.array_max(F.filter("_fetched", _fits)), "_n": F.size("_fetched")}).drop("_fetched")


def _by_table(base: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """As _by_literal, by joins on tokens; the rules may be many."""
    spark = base.sparkSession
    rows = [(i, *r, *patterns(r[1], r[2]), literal_tokens(r[1], r[2])) for i, r in enumerate(rules)]
    listed = spark.createDataFrame(rows, "id long, action string, h string, p string, host_regex string, path_regex string, tokens array<string>")
    own = listed.select("id", F.explode("tokens").alias("_t"))
    urls = base.groupBy("host", "path").agg(F.count("*").alias("_m"), F.first("_tokens").alias("_tokens")).select("host", "path", "_m", F.explode("_tokens").alias("_t"))
    held = urls.join(own.select("_t").distinct(), "_t", "left_semi").groupBy("_t").agg(F.sum("_m").alias("_held"))
    rarest = own.join(held, "_t", "left").groupBy("id").agg(F.min_by("_t", F.struct(F.coalesce("_held", F.lit(0)), "_t")).alias("_t"))
    entry = _entry(*[F.col(c) for c in ("action", "h", "p", "host_regex", "path_regex")])
    index = listed.withColumn("_r", entry).select("id", "_r").join(rarest, "id").select("_t", "_r")
    met = urls.join(index, "_t").groupBy("host", "path").agg(F.max(F.when(_fits(F.col("_r")), F.col("_r"))).alias("_best"), F.count("*").alias("_n"))
    return base.join(met, ["host", "path"], "left").select(*base.columns, "_best", "_n")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(.*?)://(.*)$', 2, 's') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT p.*, r.action, h || pre AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC NULLS LAST, length(h) DESC, h || pre DESC) AS k
  FROM p LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
