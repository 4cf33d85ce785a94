"""Connected components and greedy plans over small graphs of prompts and logs."""

from __future__ import annotations

import re
import tempfile
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, prompt_key, split_bucket
from .prompts import sequence_ratio


def _checkpoint(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="rankdiag-"))
    return df.checkpoint()


def clean_checkpoints(spark: SparkSession) -> None:
    """Delete what operators have checkpointed in this application; results made from it that are not written yet are lost."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(at.get())
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.listStatus(path) if files.exists(path) else []:
            files.delete(found.getPath(), True)


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, root) of the nodes in edges (a, b): the least node that each reaches, by alternating large and small stars.

    Rounds grow with the logarithm of the number of nodes; labels that still change after `most` rounds are an error.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    nodes, e = _checkpoint(nodes), _checkpoint(e)
    last = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = _checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return nodes.join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("root"))
        last = now
    raise RuntimeError(f"components still change after {most} rounds")


def _prefix_pairs(sets: DataFrame, least_shared) -> DataFrame:
    """(a, b) candidates among sets (id, items: distinct texts) that may share least_shared(n) of their n items.

    Items go by rarity. Two sets that share so many must meet among each one's n - least_shared(n) + 1 rarest (prefix
    filter), so frequent items join nothing.
    """
    one = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("w"))
    rare = one.groupBy("w").agg(F.count("*").alias("f"))
    ranked = one.join(rare, "w").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("f", "w")))
    first = ranked.where(F.col("k") <= F.col("n") - least_shared(F.col("n")) + 1)
    x, y = first.select(F.col("id").alias("a"), "w"), first.select(F.col("id").alias("b"), "w")
    return x.join(y, "w").where("a < b").select("a", "b").distinct()


def similar_prompts(prompts: DataFrame, jaccard_least: float = 0.85, ratio_least: float = 0.90) -> DataFrame:
    """(a, b) of normalised prompts (id, key) that are equal, whose token sets reach a Jaccard similarity, or whose texts a ratio.

    Candidates lose no pair: tokens meet by prefixes of token sets, ratios by prefixes of counted pairs of characters (texts
    of ratio r leave (1 - r) of both unmatched, which breaks that many pairs more at most). Ratios need 0.75 or more.
    """
    if ratio_least < 0.9:
        raise ValueError("candidates by ratio are whole from 0.9 on")
    equal = prompts.groupBy("key").agg(F.min("id").alias("a"), F.collect_list("id").alias("ids")).select("a", F.explode("ids").alias("b")).where("a <> b")
    once = prompts.groupBy("key").agg(F.min("id").alias("id"))
    tokens = once.select("id", "key", F.array_distinct(F.split("key", " ")).alias("items"))
    t = _prefix_pairs(tokens, lambda n: F.ceil(jaccard_least * n - 1e-9))
    x = tokens.select(F.col("id").alias("a"), F.col("items").alias("ta"), F.col("key").alias("ka"))
    y = tokens.select(F.col("id").alias("b"), F.col("items").alias("tb"), F.col("key").alias("kb"))
    by_token = t.join(x, "a").join(y, "b").where(jaccard(F.col("ta"), F.col("tb")) >= jaccard_least).select("a", "b")
    # Pairs of characters with how often each came before, so that shared ones count as in multisets. Of two texts of T
    # letters, those matched (r * T / 2) lie in at most (1 - r) * T + 1 runs; the shorter text has r / (2 - r) of the longer.
    n_pairs = F.greatest(F.lit(1), F.length("key") - 1)
    grams = once.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), n_pairs), lambda i: F.substring(F.col("key"), i, F.lit(2)))).alias("i", "g"))
    grams = grams.withColumn("c", F.row_number().over(Window.partitionBy("id", "g").orderBy("i")))
    sets = grams.groupBy("id").agg(F.collect_list(F.concat_ws("#", "g", "c")).alias("items"))
    share = ratio_least / 2 - (1 - ratio_least)  # of T, less one
    least = lambda n: F.greatest(F.lit(1), F.floor(share * (1 + ratio_least / (2 - ratio_least)) * (n + 1)) - 1)
    g = sets.join(once, "id").select("id", "items", F.length("key").alias("n"))
    r = _prefix_pairs(sets, least).join(g.select(F.col("id").alias("a"), F.col("items").alias("ga"), F.col("n").alias("na")), "a").join(g.select(F.col("id").alias("b"), F.col("items").alias("gb"), F.col("n").alias("nb")), "b")
    # The same bound for the two lengths at hand; few pairs are left for the ratio itself.
    r = r.where(2 * F.least("na", "nb") >= ratio_least * (F.col("na") + F.col("nb")) - 1e-6).where(F.size(F.array_intersect("ga", "gb")) >= share * (F.col("na") + F.col("nb")) - 1 - 1e-6).select("a", "b")
    by_ratio = r.join(x, "a").join(y, "b").where(sequence_ratio(F.least("ka", "kb"), F.greatest("ka", "kb")) >= ratio_least).select("a", "b")
    return equal.unionByName(by_token).unionByName(by_ratio).distinct()


def template_plan(prompts: DataFrame, jaccard_least: float = 0.85, ratio_least: float = 0.90) -> DataFrame:
    """(prompt, root, split) of a table (prompt): near-duplicates share a root, the least normalised text, whose digest picks the split."""
    p = prompts.select("prompt").distinct()
    p = _checkpoint(p.select("prompt", prompt_key(F.col("prompt")).alias("key"), F.xxhash64("prompt").alias("id")))
    links = components(similar_prompts(p.select("id", "key"), jaccard_least, ratio_least))
    own = p.join(links, F.col("id") == F.col("node"), "left").withColumn("_c", F.coalesce("root", "id")).drop("root", "node")
    root = own.groupBy("_c").agg(F.min("key").alias("root"))
    return own.join(root, "_c").select("prompt", "root", split_bucket(F.col("root")).alias("split"))


def log_triplets(pairs: DataFrame) -> DataFrame:
    """Counts of prompts by three logs (a, b, c) that share them, of a table (prompt, log)."""
    p = pairs.distinct()
    one = p.select("prompt", F.col("log").alias("a"))
    two = one.join(p.select("prompt", F.col("log").alias("b")), "prompt").where("a < b")
    three = two.join(p.select("prompt", F.col("log").alias("c")), "prompt").where("b < c")
    return three.groupBy("a", "b", "c").agg(F.count("*").alias("shared"))


def disjoint_triplets(pairs: DataFrame, count: int = 3, least: int = 2) -> list[tuple[str, str, str]]:
    """Greedy choice of triplets without a log in common, most shared prompts first, then by name.

    Reads the ranked list from Spark a part at a time, so the driver holds no more than it looks at.
    """
    if count < 1 or least < 1:
        raise ValueError("count and least must be 1 or more")
    used: set[str] = set()
    out: list[tuple[str, str, str]] = []
    ranked = log_triplets(pairs).where(F.col("shared") >= least).orderBy(F.desc("shared"), "a", "b", "c")
    for r in ranked.toLocalIterator():
        t = (r["a"], r["b"], r["c"])
        if not used & set(t):
            out.append(t)
            used |= set(t)
            if len(out) == count:
                break
    return out


def check_disjoint(splits: dict[str, list[str]]) -> list[str]:
    """Messages for splits that share logs."""
    return [f"{a}/{b}: {', '.join(both)}" for a, b in combinations(splits, 2) if (both := sorted(set(splits[a]) & set(splits[b])))]


def three_way_plan(triplets: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    """The first log of each sorted triplet trains, the second validates, the third tests."""
    if any(len(set(t)) != 3 for t in triplets):
        raise ValueError("a triplet needs three logs")
    plan = {name: sorted(sorted(t)[i] for t in triplets) for i, name in enumerate(("train", "validation", "test"))}
    if problems := check_disjoint(plan):
        raise ValueError("; ".join(problems))
    return plan
