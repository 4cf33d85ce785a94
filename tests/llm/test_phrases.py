"""Phrases from count tries, against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rankdiag.llm import phrases

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counted(rows, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def brute(rows, least, longest, top):
    f, n = counted(rows, longest)
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, w), a in some.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(a, inside[lang, w[i : i + m]])
    out = collections.defaultdict(list)
    for (lang, w), a in some.items():
        if inside[lang, w] < a:
            cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-cut[0], -a, " ".join(w).encode(), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    return collections.Counter((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top]))


def found(df):
    return collections.Counter(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(n, seed):
    r = random.Random(seed)
    words = ["the", "THE", "of", "a", "über", "x\x0by", "one.two", "end!", "\x01c", "\tq", "中文", "no", "new york city", "in the end of a day"]
    return [(" ".join(r.choice(words) for _ in range(r.randint(0, 60))).replace(" no ", r.choice((" no ", "\n", "  \t"))), r.choice(("en", "fr", "und", None))) for _ in range(n)]


@pytest.mark.parametrize("least,longest,top", [(3, 5, 2000), (8, 5, 7), (3, 3, 40), (5, 2, 50)])
def test_phrases(spark, least, longest, top):
    rows = made(120, least)
    d = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert found(phrases.mine_phrases(d, least, longest, top)) == brute(rows, least, longest, top)


def test_small_shards_and_a_full_filter(spark, monkeypatch):
    """Many shards in a task, and a filter of so few bits that nearly everything passes it."""
    rows = made(80, 1)
    monkeypatch.setattr(phrases, "CELLS", 64)
    monkeypatch.setattr(phrases, "SECTION", 32)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    batch = pa.table({"text": [t for t, _ in rows], "lang": [x or "und" for _, x in rows]}).to_batches()
    full = type("B", (), {"value": np.full(1, 2**64 - 1, np.uint64)})()
    f, _ = counted(rows)
    got = collections.Counter()
    for shortest, longest, filters in ((1, 1, {}), (2, 2, {1: full, 2: full}), (3, 5, {2: full})):
        shards = list(phrases._tries(shortest, longest, filters)(iter(batch)))
        assert len(shards) > 5
        for b in shards:
            assert b.column(1).to_pylist() == sorted(b.column(1).to_pylist(), key=lambda p: [w.encode() for w in p.split(" ")]) or len(set(b.column(0).to_pylist())) > 1
            for r in b.to_pylist():
                got[r["lang"], tuple(r["phrase"].split(" "))] += r["n"]
    assert got == f
    sketch = [r for b in phrases._tries(1, 1, {}, 7)(iter(batch)) for r in b.to_pylist() if r["section"] is not None]
    sums = np.zeros(64, int)
    for r in sketch:
        np.add.at(sums, r["section"] * 32 + np.cumsum(np.frombuffer(r["cells"], np.uint16)), np.frombuffer(r["counts"], np.uint32))
    batches = [pa.table({"section": [r["section"]], "cells": [r["cells"]], "counts": [r["counts"]]}).to_batches()[0] for r in sorted(sketch, key=lambda r: r["section"])]
    for b in phrases._sums(9)(iter(batches)):
        section = b.column(0)[0].as_py()
        assert np.unpackbits(np.frombuffer(b.column(1)[0].as_py(), np.uint8), bitorder="little").tolist() == (sums[32 * section : 32 * section + 32] >= 9).astype(int).tolist()


def test_messy_and_empty(spark, messy, empty, docs, texts):
    rows = [(r["text"], r["lang"]) for r in messy.collect()]
    assert found(phrases.mine_phrases(messy, 2, 5, 500)) == brute(rows, 2, 5, 500)
    assert phrases.mine_phrases(empty).count() == 0
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert found(phrases.mine_phrases(docs, 10)) == brute(rows, 10, 5, 2000)


def test_products_beyond_64_bits(spark):
    big = 9 * 10**16
    nodes = [("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 7), ("en", "c", 10**9), ("en", "a b c", 10**9), ("en", "b c", 10**9)]
    total = 10**17 - 1
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in phrases.score_phrases(spark.createDataFrame(nodes, phrases.NODES), spark.createDataFrame([("en", total)], "lang string, total long")).collect()}
    f = {p: n for _, p, n in nodes}
    assert got["a b"] == (f["a b"], f["a"], f["b"], 1000 * f["a b"] * total // (f["a"] * f["b"]))
    cuts = [(1000 * f["a b c"] * total // (f[x] * f[y]), f[x], f[y]) for x, y in (("a", "b c"), ("a b", "c"))]
    best = min(cuts, key=lambda c: c[0])
    assert got["a b c"] == (10**9, best[1], best[2], best[0]) and "b c" not in got


def test_a_text_beyond_a_shard(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 1000)
    rows = [("one two three " * 3000, "en"), ("one two", "en"), (None, "fr")]
    d = spark.createDataFrame(rows, "text string, lang string")
    assert found(phrases.mine_phrases(d, 100)) == brute(rows, 100, 5, 2000)
