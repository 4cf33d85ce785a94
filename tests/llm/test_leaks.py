"""Every pair that Smith-Waterman scores at the threshold or more is found, whatever its words and edits."""

import random

import numpy as np
import pytest

from rankdiag.llm import decontaminate as dc


def hashes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return dc.hashed_words(data, np.array([0, len(data)]))[0]


def edited(r, words, share, alphabet):
    out = []
    for w in words:
        kind = r.choice(("replace", "insert", "drop")) if r.random() < share else ""
        out += [] if kind == "drop" else [r.choice(alphabet)] if kind == "replace" else [w, r.choice(alphabet)] if kind == "insert" else [w]
    return out


@pytest.mark.parametrize("frequent", [True, False])
def test_no_leak_is_lost(spark, vocabulary, frequent, monkeypatch):
    monkeypatch.setattr(dc, "HITS", 2000, raising=False)
    r = random.Random(11)
    alphabet = vocabulary[:10] if frequent else vocabulary
    items = [" ".join(r.choice(alphabet) for _ in range(n)) for n in (40, 40, 40, 25, 16, 12, 9, 8, 8, 5, 4, 3)]
    docs = [" ".join(r.choice(vocabulary) for _ in range(200)) for _ in range(10)]
    for k in range(180):
        w = edited(r, items[k % len(items)].split(), (0.05, 0.1, 0.25, 0.4)[k // len(items) % 4], vocabulary if k % 2 else alphabet)
        noise = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120)))
        docs.append(f"{noise()} {' '.join(w)} {noise()}")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in dc.find_leaks(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    hi, hd = [hashes(t) for t in items], [hashes(t) for t in docs]
    want = {(a, b): s for a in range(len(docs)) for b in range(len(items)) if (s := dc.smith_waterman(hi[b], hd[a])[0]) >= dc.THRESHOLD}
    assert got == want and len(want) > 100
