"""Final results against brute force, border cases, very long texts, and what is left in storage."""

import collections
import math
import os
import random
import re
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankdiag.llm import common, decontaminate, language_id, lattice_lm, mixing, near_dedup, ngram_resample, quality_rules, suffix_dedup, token_counts, url_filter

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


# 1


def buckets_of(t, buckets):
    data = np.frombuffer((t or "").encode(), np.uint8)
    return ngram_resample.ngrams(data, np.array([0, len(data)]), buckets)[1]


@pytest.mark.parametrize("sharpness", [None, 20.0])
def test_resample_by_brute_force(spark, messy, sharpness):
    """Nulls, repeated rows and clashing columns included."""
    good = spark.createDataFrame([(0,), (0,), (7,), (None,)], "doc_id long")
    got = ngram_resample.resample(messy, good, share=0.4, sharpness=sharpness, buckets=64).collect()
    hashed = messy.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(1)).alias("h")).collect()
    raw, target, times = np.ones(64), np.ones(64), {0: 2, 7: 1}
    for r in hashed:
        n = np.bincount(buckets_of(r["text"], 64), minlength=64)
        raw += n
        target += n * times.get(r["doc_id"], 0)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = []
    for r in hashed:
        b = buckets_of(r["text"], 64)
        total = float(ratio[b].sum())
        mean = total if sharpness is None else sharpness * total / len(b) if len(b) else 0.0
        u = (((r["h"] & (2**64 - 1)) >> 11) + 0.5) / 2**53
        want.append((str(r["doc_id"]), len(b), round(total, 6), round(mean - math.log(-math.log(u)), 6)))
    assert sorted((str(r["doc_id"]), r["n_ngrams"], round(r["log_ratio"], 6), round(r["gumbel_key"], 6)) for r in got) == sorted(want)
    edge = sorted((w[3] for w in want), reverse=True)[round(0.4 * len(want)) - 1]
    assert all(r["kept"] == (round(r["gumbel_key"], 6) >= edge) for r in got)


def test_resample_ties_and_empty(spark, empty):
    """Equal rows share their noise: of those at the border just as many are kept as make k."""
    rows = [(1, "a b")] * 6 + [(2, "c d e")] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for share in (0.25, 0.5, 0.875, 1.0):
        got = collections.Counter((r["doc_id"], r["kept"]) for r in ngram_resample.resample(d, d.where("doc_id = 1").select("doc_id"), share=share).collect())
        assert sum(n for (_, kept), n in got.items() if kept) == 8 * share and sum(got.values()) == 8
    assert ngram_resample.resample(empty, empty.select("doc_id")).count() == 0


def test_kth_largest_of_neighbouring_doubles(spark):
    v = [1.0, 1 + 2**-52, 1 + 2**-51] + [float(x) for x in np.nextafter(np.full(40, 1e6), 2e6)] + [1e6]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for k in (1, 2, 41, 42, 43, 44):
        assert ngram_resample.kth_largest(df, "x", k) == sorted(v, reverse=True)[k - 1]
    few = spark.createDataFrame([(x,) for x in v[:3]], "x double")
    assert [ngram_resample.kth_largest(few, "x", k) for k in (1, 2, 3, 4)] == [v[2], v[1], v[0], None]


# 2


def test_url_line_feeds(spark):
    d = spark.createDataFrame([(1, "http://a\n.example.org/es/x"), (2, "http://example.org\n/es/x"), (3, "http://b.org/\n/es/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(d).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: ("org/", "allow")}


def test_url_rules_as_a_table(spark, monkeypatch):
    r = random.Random(6)
    hosts = ["org", "example.org", "a.example.org", "com", "b.com", "net"]
    rules = sorted({(r.choice(("allow", "block")), r.choice(hosts), r.choice(("", "/", "/es/", "/es/x", "/en/1"))) for _ in range(20)})
    urls = [f"http://{r.choice(('', 'www.', 'A.'))}{r.choice(hosts)}{r.choice(('', '/', '/es/x', '/en/12', '/q?es'))}" for _ in range(60)]
    rows = [(i % 50, u, "k", "p", "v", 1, "t") for i, u in enumerate([*urls, None, "", "x"])]
    d = spark.createDataFrame(rows + rows[:5], "page_id long, url string, host string, path string, verdict string, n_candidates int, _id string")
    small = url_filter.filter_urls(d, rules)
    monkeypatch.setattr(url_filter, "MAX_RULES", 0)
    large = url_filter.filter_urls(d, rules)
    assert sorted(small.columns) == sorted(large.columns)
    key = lambda f: collections.Counter(map(str, f.select(*sorted(f.columns)).collect()))
    assert key(small) == key(large) and small.count() == len(rows) + 5

    def brute(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, "allow")

    assert all((x["rule"], x["verdict"]) == brute(x["url"]) for x in large.collect())
    assert url_filter.filter_urls(d.limit(0), rules).count() == 0


# 5


def test_plain_lattice_scores(spark, messy):
    v = lattice_lm.vocabulary(P.path("piece_bpe_32k.model"))
    index, longest = {b: i for i, b in enumerate(v.pieces)}, v.longest

    def word(w):
        b, a = b" " + w.encode(), [1.0]
        for t in range(1, len(b) + 1):
            a.append(sum(a[s] * v.first[index[b[s:t]]] for s in range(max(0, t - longest), t) if b[s:t] in index) + a[t - 1] * v.first[len(v.pieces) + b[t - 1]])
        return math.log10(a[-1])

    d = messy.where("doc_id is null or length(text) < 400")
    got = sorted((str(r["doc_id"]), round(r["score"], 5)) for r in lattice_lm.score_texts(d, F.lit(False), P.path("piece_bpe_32k.model")).collect())
    assert got == sorted((str(r["doc_id"]), round(sum(map(word, words(r["text"]))) + math.log10(v.first[-1]), 5)) for r in d.collect())


# 6


def test_leaks_at_the_threshold_and_short_items(spark):
    item = [f"w{k}" for k in range(1, 13)]
    copy = [f"x{k}" if k in (3, 6, 9) else f"w{k}" for k in range(1, 13)]
    b = spark.createDataFrame([(0, " ".join(item)), (1, "one two"), (2, "solo"), (3, "one two")], "item_id long, text string")
    d = spark.createDataFrame([(0, "a b c " + " ".join(copy) + " d e"), (1, "One, TWO!"), (2, "one two three"), (3, " solo"), (4, "two one"), (None, "solo")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.find_leaks(d, b).collect()}
    assert got == {(0, 0, 0.5), (1, 1, 1.0), (1, 3, 1.0), (3, 2, 1.0), (None, 2, 1.0)}


def test_leaks_messy(spark, messy, texts):
    b = spark.createDataFrame([(5, texts[7]), (5, texts[7]), (None, texts[14]), (6, None)], "item_id long, text string")
    pairs = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(messy, b).collect())
    times = collections.Counter(r["doc_id"] for r in messy.where("text is not null").collect() if r["text"] in (texts[7], texts[14]))
    assert pairs[7, 5] == 2 * times[7] and pairs[14, None] == times[14]
    left = decontaminate.decontaminate(messy, b)
    assert left.columns == messy.columns and not {7, 14} & {r["doc_id"] for r in left.collect()}


# 7


@pytest.mark.parametrize("percent", [70, 60])
def test_looser_similarities(spark, vocabulary, percent):
    r = random.Random(9)
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(120), i % 12):
            w[k] = f"{r.choice(vocabulary)}{i}"
        rows.append((i, " ".join(w)))
    root = list(range(60))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(d, percent).collect()} == {i: find(i) for i in range(60)}


def test_signature_plans():
    for percent in range(50, 101):
        width, chunks = near_dedup.plan_for(percent)
        assert near_dedup.beyond(width * chunks, percent / 100, 2 * chunks - 1) <= near_dedup.MISS
    with pytest.raises(ValueError):
        near_dedup.plan_for(20)


# 9


def test_short_runs_stay(spark):
    r = random.Random(3)
    make = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    short, long = make(30), make(60)
    d = spark.createDataFrame([(i, f"{make(40)} {short} {make(40)} {long} {make(40)}") for i in range(4)], "doc_id long, text string")
    plain = suffix_dedup.dedup_text(d, 100, 40).collect()
    got = suffix_dedup.dedup_text(d, 100, 40, least_words=51).collect()
    assert all(x["n_spans"] == 2 for x in plain) and all(x["n_spans"] == 1 and short in x["kept_text"] and long not in x["kept_text"] for x in got)


# 10


def test_decoding_by_hand():
    r = np.random.default_rng(0)
    code = language_id.codewords(5)
    x, w = r.normal(size=(20, 7)).astype(np.float32), r.normal(size=(8, code.shape[1])).astype(np.float32)
    best, score, vague = language_id.decode(x, w, code)
    for i in range(20):
        m = x[i] @ w[:-1] + w[-1]
        loss = [sum(math.log1p(math.exp(-c * v)) for c, v in zip(row, m, strict=True)) for row in code]
        order = sorted(loss)
        assert best[i] == loss.index(order[0]) and abs(score[i] - 1 / sum(math.exp(order[0] - v) for v in loss)) < 1e-4
        assert vague[i] == (order[1] - order[0] < language_id.MARGIN * code.shape[1])


@pytest.mark.parametrize("n", [1, 2, 3, 40, 300])
def test_codewords_never_fall_short(n):
    c = language_id.codewords(n)
    apart = [(c[i] != c[:i]).sum(1).min() for i in range(1, n)]
    assert c.shape[0] == n and min(apart, default=99) >= c.shape[1] / 4
    assert n == 1 or (np.abs(c.sum(0)) < n).all()  # each bit parts the languages


# All: very long texts and words


def test_very_long_texts(spark, tmp_path):
    """A text beyond a batch, and a long unbroken word, beside small ones."""
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    long = " ".join(r.choice(vocabulary) for _ in range(200_000))
    assert len(long) > common.BATCH_BYTES
    rows = [(1, long, "en", "a", 1), (2, long + " end", "en", "a", 1), (3, "x" * 20_000, "fr", "b", 1), (4, "plain words here", "fr", None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache()
    assert ngram_resample.resample(d, d.where("doc_id = 1").select("doc_id")).count() == 4
    q = {x["doc_id"]: x for x in quality_rules.apply_rules(d).collect()}
    assert q[1]["n_words"] == 200_000 and q[3]["n_words"] == 1
    t = {x["doc_id"]: x["n_bytes"] for x in token_counts.count_tokens(d, P.path("piece_bpe_32k.model"), str(tmp_path / "c")).collect()}
    assert t == {i: len(x.encode()) for i, x, *_ in rows}
    s = {x["doc_id"]: x for x in lattice_lm.score_texts(d, F.lit(False), P.path("piece_bpe_32k.model")).collect()}
    assert s[1]["n_tokens"] == 200_001 and all(math.isfinite(x["score"]) for x in s.values())
    b = spark.createDataFrame([(9, " ".join(long.split()[150_000:150_030]))], "item_id long, text string")
    assert {x["doc_id"] for x in decontaminate.find_leaks(d, b).collect()} == {1, 2}
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert mixing.mix_sources(d).count() == 4
    gone = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.dedup_text(d).collect()}
    assert gone == {1: len(long), 2: len(long), 3: 20_000, 4: 0}
    assert language_id.identify(d, F.lit(False)).count() == 4


# The pipeline


def test_stages_over_messy_and_empty_tables(messy, empty, spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for df in (messy, empty, empty.selectExpr("*", "1 as key", "'a' as size")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            rows = out.collect()
            assert len(rows) <= df.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns, name


def test_passages_of_over_fifty_words_go(spark):
    r = random.Random(8)
    make = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n))
    passage, shorter = make(51), make(40)
    rows = [(i, f"{make(80)} {passage if i < 3 else make(9)} {make(50)} {shorter} {make(30)}", "en", "s", 1) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for x in corpus_pipeline.suffix_array_dedup(spark, d, SF).collect():
        assert passage not in x["text"] and shorter in x["text"] and (len(x["text"]) < len(rows[x["doc_id"]][1])) == (x["doc_id"] < 3)
        assert x["n_chars"] == (len(x["text"]) if x["doc_id"] < 3 else 1)


# Storage


def test_a_cluster_needs_a_shared_folder():
    fake = lambda master: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master=master, applicationId=f"fake-{master}", getConf=lambda: {}))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(fake(master))
    at = common.shared_dir(fake("local[4]"))
    assert os.path.isdir(at) and common.shared_dir(fake("local[4]")) == at
    os.rmdir(at)


def test_written_tables_are_removed(spark, docs):
    with common.tracked() as made:
        first, second = common.cut(spark.range(3).toDF("x"), "t"), common.cut(spark.range(4).toDF("x"), "t")
        assert made == [first._cut_path, second._cut_path]
        common.remove(first)
        assert not os.path.exists(first._cut_path) and second.count() == 4
        near_dedup.near_duplicates(docs).count()
    other = common.cut(spark.range(2).toDF("x"), "t")  # as another thread's
    common.clean(spark, second, only=made)
    assert common.written(spark) >= {second._cut_path, other._cut_path} and not common.written(spark) & set(made) - {second._cut_path}
    common.clean(spark, other)
    assert common.written(spark) == {other._cut_path} and os.path.isdir(other._cut_path) and not os.path.exists(second._cut_path)
    common.clean(spark)


def test_the_token_cache_of_a_query_is_cleaned(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    with common.tracked() as made:
        assert token_counts.op4_token_counts(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    cache = [p for p in made if "token-cache" in p]
    assert len(cache) == 1 and os.path.isdir(cache[0])
    common.clean(spark, only=made)
    assert not any(map(os.path.exists, made))
