"""Each operator against a brute-force version, and over empty, messy and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankdiag.llm import decontaminate as dc
from rankdiag.llm import language_id, lattice_lm, mixing, near_dedup, ngram_resample, quality_rules, suffix_dedup, token_counts, url_filter
from rankdiag.llm.common import id_crc

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


# 1


def test_resample_counts_and_share(spark, docs, texts):
    good = docs.where("doc_id < 30").select("doc_id")
    got = ngram_resample.resample(docs, good, share=0.5).toPandas()
    assert len(got) == len(texts) and got["kept"].sum() == round(0.5 * len(texts))
    assert got[got.kept].gumbel_key.min() >= got[~got.kept].gumbel_key.max()
    again = ngram_resample.resample(docs.repartition(3), good, share=0.5).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    n = {i: max(0, 2 * len(words(t)) - 1) for i, t in texts.items()}
    assert all(n[r.doc_id] == r.n_ngrams for r in got.itertuples())


def test_resample_prefers_the_target(spark, docs, vocabulary):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(vocabulary[:100] if i % 2 else vocabulary[100:]) for _ in range(80))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_resample.resample(d, d.where("doc_id % 4 = 1").select("doc_id"), share=0.5).toPandas()
    assert (got[got.kept].doc_id % 2).mean() > 0.95


@pytest.mark.parametrize("k", [1, 5, 40, 99, 100])
def test_kth_largest(spark, k):
    v = [float(i // 3) for i in range(100)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    assert ngram_resample.kth_largest(df, "x", k) == sorted(v, reverse=True)[k - 1]


# 2


def test_urls(spark):
    urls = ["http://Example.ORG/es/x?q", "http://a.example.org/en/12", "http://example.org/en/21", "http://notexample.org/es/", "x.com/fr/", None, "", "http://b.com/de/#t", "http://com/fr/", "http://q.org", "ftp://h.net/?://x", "a://b://c.org/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3] == ("notexample.org", "/es/", "org/", "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("b.com", "/de/", "com/de/", "block") and got[8][2] == "com/fr/"
    assert got[9] == ("q.org", "", None, "allow") and got[10][:2] == ("h.net", "/") and got[11] == ("b:", "//c.org/", None, "allow")
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert url_filter.filter_urls(df, []).where("verdict = 'allow'").count() == len(urls)


# 3


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, texts):
    extra = {1000: "a b c a b c d", 1001: "x\ny\nx\n\n \nx", 1002: "#a $b <c> 𝒳é", 1003: "a a a a"}
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    for r in quality_rules.apply_rules(d).collect():
        want = brute_quality({**texts, **extra}[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_messy(messy, empty):
    assert quality_rules.apply_rules(messy).count() == messy.count()
    assert quality_rules.good_rows(messy).columns == messy.columns
    assert quality_rules.good_rows(empty).count() == 0


# 4


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens(spark, messy, tmp_path, name):
    cache = str(tmp_path / "cache")
    path = P.path(name)
    extra = spark.createDataFrame([(7000, "a <|endoftext|> b"), (7001, " \n x")], "doc_id long, text string")
    d = messy.unionByName(extra, allowMissingColumns=True)
    got = token_counts.count_tokens(d, path, cache).collect()
    assert len(got) == d.count()
    if name.endswith("json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda x: len(sp.encode(x))
    for r in got:
        x = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(x.encode()), n(x), n(x) > 1024)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r["text"] or "" for r in got})
    token_counts.count_tokens(d.limit(5), path, cache).count()
    assert spark.read.parquet(cache).count() == stored.count()  # all were hits


def test_tokens_of_parts_are_those_of_whole_texts():
    """Odd blanks, special strings and runs, in batches of any cut; equal parts go to the library once."""
    path = P.path("byte_bpe_50k.json")
    rnd = random.Random(1)
    bits = ["a", "B", "'s", "'", "!", "12", "\u00e9", "\u6f22", "\U0001f600", "<|endoftext|>", "\x00", *" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u200b\u3000", " ", " ", "  "]
    texts = ["", "x", " ", *("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(3000))]
    want = token_counts._counter(path)(texts)
    assert token_counts._cut_by_blanks(path) and not token_counts._cut_by_blanks(P.path("piece_bpe_32k.model"))
    for size in (1, 7, 3003):
        some = texts[: 200 * size]
        batches = (pa.RecordBatch.from_arrays([pa.array([b""] * len(x)), pa.array(x)], ["digest", "content"]) for x in (some[i : i + size] for i in range(0, len(some), size)))
        assert [n for b in token_counts._encode(path, "v")(batches) for n in b.column(2).to_pylist()] == want[: len(some)]


def test_equal_parts_are_encoded_once(monkeypatch):
    asked: list[str] = []
    monkeypatch.setattr(token_counts, "_counter", lambda path: lambda texts: [asked.append(x) or 1 for x in texts])
    b = pa.RecordBatch.from_arrays([pa.array([b"", b""]), pa.array(["the cat the cat the cat", "a cat"])], ["digest", "content"])
    got = [n for x in token_counts._encode(P.path("byte_bpe_50k.json"), "v")(iter([b, b])) for n in x.column(2).to_pylist()]
    assert got == [6, 2, 6, 2] and sorted(asked) == [" cat", " the", "a", "the"]


def test_tokens_empty(empty, tmp_path):
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json"), str(tmp_path / "c")).count() == 0


# 5


def test_lattice_by_hand():
    v = lattice_lm.vocabulary(P.path("piece_bpe_32k.model"))
    logp = np.log(v.first)
    index = {b: i for i, b in enumerate(v.pieces)}
    ws = [b" the", b" zthti", " é".encode(), b" $"]

    def brute(w):
        a = [1.0]
        for t in range(1, len(w) + 1):
            a.append(sum(a[s] * math.exp(logp[index[w[s:t]]]) for s in range(t) if w[s:t] in index) + a[t - 1] * math.exp(logp[len(v.pieces) + w[t - 1]]))
        return math.log(a[-1])

    off = np.concatenate([[0], np.cumsum([len(w) for w in ws])])
    e = np.zeros((1, len(logp)))
    got = v.lattice(np.frombuffer(b"".join(ws), np.uint8), off, logp[None], np.ones((len(ws), 1)), e)
    assert np.allclose(got[:, 0], [brute(w) for w in ws])
    spelled = sum(n * (len(v.pieces[i]) if i < len(v.pieces) else 1) for i, n in enumerate(e[0]))
    assert abs(spelled - off[-1]) < 1e-6  # expected pieces spell the words


@pytest.mark.parametrize("options", [{}, {"rounds": 2, "lang": "lang", "word_arcs": True}])
def test_scores(spark, messy, empty, options):
    held = id_crc(F.col("doc_id")) % 7 == 2
    got = lattice_lm.score_texts(messy, held, P.path("piece_bpe_32k.model"), **options).collect()
    rows = messy.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, ends = collections.Counter(), 0
    for r in rows:
        if not out(r["doc_id"]):
            c.update(words(r["text"]))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = sorted((str(r["doc_id"]), len(words(r["text"])) + 1, sum(c[w] > 0 for w in words(r["text"])) + 1, round(sum(math.log10((k + 1) / (n + v + 1)) for k in [*(c[w] for w in words(r["text"])), ends]), 6)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["held_out"] == out(r["doc_id"]) and r["score"] < 0 for r in got)
    assert lattice_lm.score_texts(empty, held, P.path("piece_bpe_32k.model")).count() == 0


# 6


def test_leaks(spark, vocabulary, empty):
    r = random.Random(2)
    items = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (15, 20, 40, 8)]
    rows, truth = [], set()
    for k in range(40):
        i = k % 4
        w = items[i].split()
        for q in r.sample(range(len(w)), len(w) // 6):
            w[q] = r.choice(vocabulary)
        noise = lambda: " ".join(r.choice(vocabulary) for _ in range(100))
        rows.append((k, f"{noise()} {' '.join(w).upper()}, {noise()}"))
        truth.add((k, i))
    rows += [(100 + k, " ".join(r.choice(vocabulary) for _ in range(300))) for k in range(40)] + [(None, items[0]), (300, None), (301, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([*enumerate(items), (8, None), (9, ""), (10, "one two")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in dc.find_leaks(d, b).collect()}
    assert got == truth | {(None, 0)}
    assert {x["doc_id"] for x in dc.decontaminate(d, b).collect()} == {100 + k for k in range(40)} | {300, 301}
    assert dc.find_leaks(empty, b).count() == dc.find_leaks(d, b.limit(0)).count() == 0
    assert dc.decontaminate(d, b.limit(0)).count() == len(rows)


def test_smith_waterman():
    r = random.Random(3)
    for _ in range(50):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(1, 9))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (1 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        got = dc.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64))[0]
        assert got == max(map(max, h)) / len(a)


# 7


def brute_components(rows, percent):
    def s(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, s(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}, {i: len(x) for i, x in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near(spark, docs, texts, percent):
    want, n = brute_components(list(texts.items()), percent)
    for r in near_dedup.near_duplicates(docs, percent).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n[r["doc_id"]], want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_in_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 4)
    monkeypatch.setattr(near_dedup, "FAMILY", 4)
    want, _ = brute_components(list(texts.items()), 85)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == want


def test_near_with_large_families_and_repeated_rows(spark, vocabulary, monkeypatch):
    """Families beyond FAMILY that are one along their forest, one that is not, and rows that come many times."""
    monkeypatch.setattr(near_dedup, "FAMILY", 8)
    r = random.Random(12)
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base, chain = make(300), make(200)
    rows = {}
    for i in range(30):
        w = list(base)
        w[r.randrange(300)] = "edit"
        rows[100 + i] = " ".join(w)
    for i in range(24):  # neighbours are near, ends are not
        chain[8 * i % 200] = f"step{i}"
        rows[200 + i] = " ".join(chain)
    want, _ = brute_components(list(rows.items()), 85)
    d = spark.createDataFrame([*rows.items()] + [(100, rows[100])] * 300 + [(120, rows[120])] * 40, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(d).collect()
    assert len(got) == len(rows) + 340 and {x["doc_id"]: x["component_id"] for x in got} == want


def test_near_messy(messy, empty):
    got = near_dedup.near_duplicates(messy).collect()
    assert len(got) == messy.count() and all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_with_shared_ids(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (3, "q r s t u v"), (9, "A b c d e f"), (7, "k l m n o p"), (7, "k l m n o p")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (9, 3)]


# 8


def test_mix(docs, texts):
    got = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs.repartition(2)).toPandas()
    assert len(got) == len(texts) and got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert all(len(words(texts[r.doc_id])) == r.size for r in got.itertuples()) and (got.taken <= 2 * got["size"]).all()
    t = got.assign(source=got.source.fillna("~")).groupby("source").agg(size=("size", "sum"), s=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (t["size"] == t.s).all() and abs(t.target.sum() - 1.5 * t["size"].sum()) < 1e-6 and (t.target <= 2 * t["size"] + 1e-9).all()
    weight = dict(zip(sorted(t.index), [5, 2, 1, 5, 2], strict=True))  # null, here ~, is last
    cap = {k: 2 * v for k, v in t["size"].items()}
    full: set = set()
    while True:
        level = (1.5 * t["size"].sum() - sum(cap[k] for k in full)) / sum(w for k, w in weight.items() if k not in full)
        over = {k for k, w in weight.items() if k not in full and w * level > cap[k]}
        if not over:
            break
        full |= over
    assert all(abs(t.target[k] - (cap[k] if k in full else weight[k] * level)) < 1e-6 for k in weight)
    assert ((t.taken - t.target).abs() <= 0.05 * t.target + 5).all()


def test_flight_keeps_totals():
    r = np.random.default_rng(0)
    size = np.sort(r.integers(1, 500, 1000))[::-1].astype(float)
    pi = np.full(1000, 0.37)
    x = mixing.flight(pi, size, r)
    assert ((x > 0) & (x < 1)).sum() <= 2 and abs(x.sum() - pi.sum()) < 1e-6 and abs((x * size).sum() - (pi * size).sum()) < 1e-3
    assert abs(np.mean([mixing.flight(np.full(9, 0.4), np.arange(9.0), np.random.default_rng(k))[3] for k in range(400)]) - 0.4) < 0.08


def test_mix_messy(messy, empty):
    assert mixing.mix_sources(messy).count() == messy.count() and mixing.mix_sources(empty).count() == 0


# 9


def brute_removed(rows, length):
    c = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if c[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length,anchor", [(400, 128), (60, 20)])
def test_repeats(docs, texts, length, anchor):
    got = suffix_dedup.dedup_text(docs, length, anchor).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removed(list(texts.items()), length)


def test_repeats_in_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 500)
    got = suffix_dedup.dedup_text(docs, 60, 20).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removed(list(texts.items()), 60)


def test_repeats_messy(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    out = suffix_dedup.dedup_text(messy, 60, 20)
    assert out.columns[: len(messy.columns)] == messy.columns
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()) == brute_removed(rows, 60)
    assert suffix_dedup.dedup_text(empty).count() == 0


@pytest.mark.parametrize("length,anchor,passage,rows", [(400, 128, 300, 420), (200, 48, 150, 900)])
def test_repeats_of_rows(spark, length, anchor, passage, rows):
    """Rows that come 25 times under an anchor that most of them share, beside rows that come once."""
    r = random.Random(9)
    make = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared, long = make(passage), make(2 * length)
    many = [(i, make(250) + shared + make(250)) for i in range(rows)]
    few = [(rows + i, make(250) + (shared if i % 2 else long) + make(250)) for i in range(12)]
    d = spark.createDataFrame(many, "doc_id long, text string").selectExpr("doc_id", "text", "explode(sequence(1, 25)) as x").drop("x").unionByName(spark.createDataFrame(few, "doc_id long, text string"))
    got = collections.Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.dedup_text(d, length, anchor).collect())
    nothing = hashlib.sha256(b"").hexdigest()
    want = brute_removed(few, length) + collections.Counter({(i, len(t), len(t), 1, nothing): 25 for i, t in many})
    assert got == want


@pytest.mark.parametrize("size,removed", [(399, 0), (400, 400)])
def test_a_passage_goes_by_its_bytes_not_its_words(spark, tmp_path, size, removed):
    """The query's contract fixes strings of 400 bytes: 67 words of 399 bytes stay where they repeat, though more than 50; n_bytes is the input's."""
    r = random.Random(13)
    make = lambda n: "".join(r.choice("bcdefghij") for _ in range(n))
    passage = " ".join(make(5) for _ in range(80))[: size - 1] + "k"
    rows = [(i, f"{make(300)}{side}{passage}{side}{make(300)}") for i, side in enumerate("XYZ")]
    assert len(passage) == size and len(passage.split()) > 50
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op9_suffix_dedup(spark, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, got)) == brute_removed(rows, 400)
    assert {(x["n_bytes"], x["n_removed"]) for x in got} == {(602 + size, removed)}


def test_run_length_index():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 50, 300):
        t = r.integers(1, 4, n)
        m = suffix_dedup.RunLengthIndex(np.append(t, 0)).matching_statistics()
        x = [*t.tolist(), 0]
        want = [max((next((k for k in range(len(x) - max(i, j)) if x[i + k] != x[j + k]), len(x) - max(i, j)) for j in range(len(x)) if j != i), default=0) for i in range(len(x))]
        assert m.tolist() == want
    index = suffix_dedup.RunLengthIndex(np.tile([1, 2, 3], 200))
    assert len(index.letters) < 30 and index.lengths.sum() == 600  # repetitive texts have few runs


# 10


def test_language(spark, messy, empty):
    r = random.Random(4)
    of = {"en": "the and of to in is".split(), "fr": "été le la des où ça".split(), "de": "der die über und größe".split()}
    rows = [(i, " ".join(r.choice(of[k]) for _ in range(r.randint(5, 60))), k if i % 5 else None) for i, k in enumerate(r.choice(list(of)) for _ in range(300))]
    kinds = {i: t for i, t, _ in rows}
    rows += [(1000, None, "en"), (1001, "123 !?", "fr"), (1002, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = id_crc(F.col("doc_id")) % 4 == 2
    got = {x["doc_id"]: x for x in language_id.identify(d, held).collect()}
    true = {i: next(k for k, w in of.items() if t.split()[0] in w) for i, t in kinds.items()}
    assert np.mean([got[i]["lang_pred"] == k for i, k in true.items()]) > 0.98
    assert all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002)) and all(0 <= x["score"] <= 1 for x in got.values())
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    assert language_id.identify(messy, held).count() == messy.count() and language_id.identify(empty, held).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 30])
def test_codewords_are_apart(n):
    c = language_id.codewords(n)
    assert all((c[i] != c[j]).sum() >= c.shape[1] / 4 for i in range(n) for j in range(i))
