"""The mix and the language model replayed row by row without Spark."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankdiag.llm import language_id, mixing

# ---- Mixing ----------------------------------------------------------------------------------------------------------


def levels(sizes, share=1.5, most=2.0):
    """Targets by giving the excess back until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        w = sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * left / w >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * left / w for s in names}
        full |= over
        if len(full) == len(names):
            return {s: most * sizes[s] for s in names}


def replay(spark, docs, seed, block):
    rows = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("key")).collect()
    size = [len((r["text"] or "").split()) for r in rows]
    ordered = spark.createDataFrame([(i, r["key"], r["doc_id"], n) for i, (r, n) in enumerate(zip(rows, size, strict=True))], "i long, key long, doc_id long, size long")
    order = {r["i"]: r["o"] for r in ordered.select("i", F.xxhash64("key", "doc_id", "size", F.lit(seed)).alias("o")).collect()}
    sources = collections.defaultdict(list)
    for i, r in enumerate(rows):
        sources[r["source"]].append(i)
    goal = levels({s: sum(size[i] for i in own) for s, own in sources.items()})
    out = {}
    for s, own in sources.items():
        all_ = sum(size[i] for i in own)
        ratio = goal[s] / all_ if all_ else 0.0
        base = math.floor(ratio + 1e-12)
        part = max(0.0, ratio - base)
        pi = {i: part if size[i] and part > 1e-9 else 0.0 for i in own}
        open_ = [i for i in own if 0 < pi[i] < 1]
        many = max(1, math.ceil(sum(size[i] > 0 for i in own) / block))
        for k in range(1, 20):
            blocks = collections.defaultdict(list)
            for i in open_:
                blocks[order[i] % many].append(i)
            for part_ in blocks.values():
                part_.sort(key=lambda i: (-size[i], order[i], rows[i]["doc_id"]))
                rng = np.random.default_rng([seed * 100 + k, order[part_[0]] & 0xFFFFFFFF])
                pi |= dict(zip(part_, mixing.flight(np.array([pi[i] for i in part_]), np.array([size[i] for i in part_], float), rng).tolist(), strict=True))
            open_ = [i for i in open_ if 0 < pi[i] < 1]
            if len(open_) <= 2:
                break
            many = math.ceil(len(open_) / block)
        if open_:
            open_.sort(key=lambda i: (order[i], rows[i]["doc_id"], size[i]))
            short = goal[s] - sum(size[i] * (base + pi[i]) for i in own if i not in open_) - sum(size[i] * base for i in open_)
            best = min((abs(short - sum(size[i] for i, b in zip(open_, bits, strict=True) if b)), bits) for bits in ([(a,) for a in (0, 1)] if len(open_) == 1 else [(a, b) for a in (0, 1) for b in (0, 1)]))
            pi |= dict(zip(open_, best[1], strict=True))
        for i in own:
            out[i] = (rows[i]["doc_id"], s, size[i], all_, round(goal[s], 6), size[i] * (base + int(pi[i])))
    return collections.Counter(out.values())


def mixed(df):
    return collections.Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())


def test_the_mix_of_single_documents(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.choice((0, 1, 3, 20, 20, 57)))) if i % 17 else None, f"s{min(5, int(r.expovariate(0.7)))}" if i % 13 else None) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    for block in (2000, 15):  # one flight a source, and several that meet
        assert mixed(mixing.mix_sources(docs, block=block)) == replay(spark, docs, 8, block)


def test_flights_keep_both_totals():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 400):
        pi, size = np.full(n, 0.37), r.integers(1, 90, n).astype(float)
        out = mixing.flight(pi, size, np.random.default_rng(n))
        assert ((out >= 0) & (out <= 1)).all() and ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - pi.sum()) < 1e-6 and abs(out @ size - pi @ size) < 1e-4


# ---- Language ID -----------------------------------------------------------------------------------------------------


def letters(text):
    return [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]


def vector(text, size):
    x, out = letters(text), np.zeros(size)
    mask = 2**32 - 1
    for k in range(1, 5):
        for i in range(len(x) - k + 1):
            g = sum(x[i + j] << 8 * j for j in range(k))
            g = (g + k) * 0x9E3779B1 & mask
            g ^= g >> 15
            out[((g * 0x85EBCA6B & mask) >> 8) % size] += 1
    out = np.sqrt(out)
    return out / max(1e-9, np.linalg.norm(out))


def test_languages_end_to_end(spark):
    """Features, sample, training and decoding of all rows anew, in doubles and row by row."""
    r = random.Random(2)
    stems = {"aa": "kala mata suo vei nan".split(), "bb": "thorp gund wix blat grim".split(), "cc": "éclé ñandu oçon üble ßra".split()}
    rows = [(i, " ".join(r.choice(stems[k]) + r.choice(("", "a", "is")) for _ in range(r.randint(1, 12))), k) for i in range(60) for k in [r.choice(list(stems))]]
    rows += [(60, None, "aa"), (61, "123 ...", "bb"), (62, "", None), (63, "thorp grim", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: x for x in language_id.identify(docs, F.col("doc_id") % 4 == 2).collect()}
    names = sorted(stems)
    code = language_id.codewords(3).astype(float)
    known = [(t, names.index(k)) for i, t, k in rows if i % 4 != 2 and t and k]  # fewer than the sample, so all are drawn
    x, y = np.array([vector(t, language_id.FEATURES) for t, _ in known]), np.array([k for _, k in known])
    share = np.array([1 / (y == k).sum() for k in y])
    share /= share.sum()
    w, b = np.zeros((language_id.FEATURES, code.shape[1])), np.zeros(code.shape[1])
    for _ in range(150):
        slope = np.array([[-code[k, j] / (1 + math.exp(code[k, j] * m)) * s for j, m in enumerate(row)] for row, k, s in zip(x @ w + b, y, share, strict=True)])
        w -= 60.0 * (x.T @ slope + 1e-5 * w)
        b -= 6.0 * slope.sum(0)
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["ambiguous"]) == ("und", 0.0, True)
            continue
        m = vector(t, language_id.FEATURES) @ w + b
        loss = [sum(math.log1p(math.exp(-c * v)) for c, v in zip(word, m, strict=True)) for word in code]
        odds = [math.exp(min(loss) - v) for v in loss]
        assert got[i]["lang_pred"] == names[loss.index(min(loss))] and abs(got[i]["score"] - 1 / sum(odds)) < 2e-3
        assert got[i]["held_out"] == (i % 4 == 2)
