import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "key long, size string, kept int, n_tokens string, spans string, score string, label string, rows int, digest string"


@pytest.fixture(scope="session")
def vocabulary():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(vocabulary):
    """doc_id -> text: plain texts, exact and near copies, shared passages, empty, null, short and long ones."""
    r = random.Random(7)
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out: dict[int, str | None] = {}
    passage = make(120)
    for i in range(60):
        w = make(r.randint(60, 200))
        if i % 5 == 0:
            w[20:20] = passage
        out[i] = " ".join(w)
    base = make(300)
    for i in range(60, 80):
        w = list(base)
        for k in r.sample(range(300), r.randint(0, 8)):
            w[k] = r.choice(vocabulary)
        out[i] = " ".join(w)
    for i in range(80, 86):
        out[i] = out[i - 80]
    out |= {86: None, 87: "", 88: " \n\t", 89: "one", 90: "one two three", 91: "ONE two three", 92: "é" * 900, 93: "ab " * 900, 94: "x" * 3000, 95: "Été " + " ".join(base[:50]) + "\u3000\xa0 z"}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs = ["en", "fr", None]
    return spark.createDataFrame([(i, t, langs[i % 3], f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in texts.items()], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def messy(spark, texts):
    """Nulls in all columns, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 1, 1, "x", 5, "y", "z", "w", "l", 2, "d") for i, t in list(texts.items())[::7]]
    rows += rows[:3] + [(None,) * 14, (None, texts[0], None, None, None) + (None,) * 9, (None, texts[0], None, None, None) + (None,) * 9]
    return spark.createDataFrame(rows, f"{SCHEMA}, {EXTRA}").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
