"""Word windows behind the count-min prefilter, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from rankdiag.llm import window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """Counter of (doc_id, n_words, n_removed, kept_sha256)."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                least[tuple(w[k : k + size])] = min(i, least.get(tuple(w[k : k + size]), i))
    out = collections.Counter()
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone[k : k + size] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def found(df):
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("size,gram", [(50, 16), (8, 3)])
def test_windows(docs, texts, size, gram):
    out = window_dedup.dedup_windows(docs, size, gram)
    assert found(out) == brute(list(texts.items()), size)
    for r in out.collect():
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest() and len(r["kept_text"].split()) <= r["n_words"] - r["n_removed"]


def test_messy_and_empty(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    out = window_dedup.dedup_windows(messy, 8, 3)
    assert out.columns[: len(messy.columns)] == messy.columns and set(out.columns[len(messy.columns) :]) == {"n_words", "n_removed", "kept_sha256", "kept_text"}
    assert found(out) == brute(rows, 8)
    assert window_dedup.dedup_windows(empty).count() == 0


def test_hot_passages_and_repeated_rows(spark, vocabulary):
    """A passage in nine of ten rows, rows that repeat, and ids that several texts share."""
    r = random.Random(2)
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = make(14)
    rows = [(i // 2 if i % 7 == 0 else i, " ".join(make(r.randint(0, 9)) + passage * (i % 10 > 0) + make(r.randint(0, 9)))) for i in range(300)]
    rows += rows[:40] * 5 + [(500, " ".join(passage * 30))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(window_dedup.dedup_windows(d, 8, 3)) == brute(rows, 8)


def test_the_sketch_never_underestimates(spark):
    r = np.random.default_rng(4)
    anchors = [int(x) for x in r.integers(0, 3000, 6000)]
    n = collections.Counter(anchors)
    df = spark.createDataFrame([(a,) for a in anchors], "anchor long").repartition(5).cache()
    kept = collections.Counter(x["anchor"] for x in window_dedup.estimated_repeated(df).collect())
    assert all(kept[a] == k for a, k in n.items() if k > 1)
    assert set(kept) <= set(n) and sum(kept[a] for a, k in n.items() if k == 1) < 0.2 * sum(k == 1 for k in n.values())


def test_partial_sketches_by_hand():
    block, at, cells = window_dedup.partial(np.array([7, 3, 7, 7, 4099]), np.array([0x01020304, 0, 0x01020304, 0x01020304, 0]))
    assert block.tolist() == [0, 1] and at.tolist() == [0, 12, 16]
    three, seven = [3 * 1024 + x for x in (0, 256, 512, 768)], [7 * 1024 + x for x in (4, 4, 259, 259, 514, 514, 769, 769)]
    assert cells.tolist() == [*three, *seven, *three]


def test_a_text_beyond_a_batch(spark):
    r = random.Random(1)
    long = " ".join(str(r.randint(0, 10**6)) for _ in range(200_000))
    rows = [(1, long), (2, "a b " + long), (3, "x" * 20_000)]
    got = {x["doc_id"]: x["n_removed"] for x in window_dedup.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 200_000, 3: 0}
