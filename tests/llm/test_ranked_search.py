"""Exact ranked search by wavelet trees, against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from rankdiag.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEM = "item_id long, text string"


def split(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(rows, items, k):
    """(item_id, text) -> the k best as (rank, doc_id, score)."""
    docs = [(i, collections.Counter(split(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = collections.Counter(w for _, c in docs for w in c)
    out = {}
    for item, text in set(items):
        found = []
        for i, c in docs:
            n = c.total()
            m = 50 + (50 * n * n_docs) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(split(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out[item, text] = [(r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


def check(spark, docs, rows, items, k):
    got = collections.Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked_search.search(docs, spark.createDataFrame(items, ITEM), k).collect())
    assert got == collections.Counter((item, *x) for (item, _), found in brute(rows, items, k).items() for x in found)


def test_search(spark, docs, texts, vocabulary):
    r = random.Random(3)
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(12)]
    items += [(20, texts[3]), (21, "no-such-term"), (22, ""), (23, None), (24, "Été ONE, one!"), (None, texts[60][:200])]
    check(spark, docs, list(texts.items()), items, 7)


def test_messy_and_empty(spark, messy, empty, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 300)  # several blocks of items
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    items = [(1, rows[0][1]), (1, rows[0][1]), (1, rows[1][1]), (2, rows[9][1] or "x")]
    check(spark, messy, rows, items, 5)
    assert ranked_search.search(empty, spark.createDataFrame(items, ITEM)).count() == 0
    assert ranked_search.search(messy, spark.createDataFrame([], ITEM)).count() == 0


def test_ties_over_shards(spark, monkeypatch):
    """Equal scores in many small shards: the smallest ids win, null ids come last."""
    rows = [(i if i % 11 else None, ("a b c", "a b d", "c c b")[i % 3]) for i in range(200, 0, -1)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(spark, d, rows, [(1, "a"), (2, "c d"), (3, "b")], 9)
    shards = list(ranked_search._build(200, 600)(iter(pa.table({"d": [x[0] for x in rows], "t": [x[1] for x in rows]}).to_batches())))
    assert len(shards) == 1


def test_shards_hold_all_rows_and_agree(monkeypatch):
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.6)) % 500}" for _ in range(3000)]
    rows = [" ".join(r.choice(words) for _ in range(r.choice((0, 1, 5, 40, 300)))) for _ in range(400)]
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 20_000)
    batches = pa.table({"d": pa.array(range(400)), "t": rows}).to_batches(max_chunksize=130)
    made = list(ranked_search._build(400, 20_000)(iter(batches)))
    assert len(made) > 3 and [x for b in made for x in b.column(0)[0].as_py()] == list(range(400))
    for b in made:
        shard = ranked_search.Shard.read(b, 0)
        shard.prepare()
        n = len(shard.docs)
        # The tree gives back the documents of each list, by impact; bounds along the tree are those of single documents.
        leaf = shard.tree.carried(np.arange(shard.tree.length))[-1]
        assert sorted(leaf.tolist()) == list(range(shard.tree.length))
        lists = np.arange(min(20, len(shard.names)))
        best = ranked_search.Best(n)
        opened = shard.search(lists, np.ones(len(lists), np.int64), best)
        assert opened <= 2 * n and len(best.score) <= n and (np.diff(best.score) <= 0).all()
        few = ranked_search.Best(3)
        assert shard.search(lists, np.ones(len(lists), np.int64), few) <= opened
        assert few.score.tolist() == best.score[:3].tolist() and few.doc.tolist() == best.doc[:3].tolist()


def test_wavelet_by_hand():
    v = np.array([5, 0, 3, 7, 3, 6, 1], np.int32)
    t = ranked_search.Wavelet.of(v, 3)
    assert t.carried(v).tolist() == [[5, 0, 3, 7, 3, 6, 1], [0, 3, 3, 1, 5, 7, 6], [0, 1, 5, 3, 3, 7, 6], [0, 6, 1, 5, 3, 3, 7]]
    assert t.ones(np.array([0, 0, 1]), np.array([0, 7, 3])).tolist() == [0, 3, 2] and t.zeros.tolist() == [4, 3, 2]
    one = ranked_search.Wavelet.of(np.zeros(4, np.int32), 0)
    assert one.levels == 0 and one.carried(np.arange(4)).tolist() == [[0, 1, 2, 3]]
