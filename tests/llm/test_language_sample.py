"""Every language is learned from, the rarest too."""

from pyspark.sql import functions as F

from rankdiag.llm import language_id


def test_each_language_has_its_share(spark, monkeypatch):
    seen = []
    real = language_id.train

    def train(x, y, code, *more):
        seen.append((sorted(y.tolist()), len(code)))
        return real(x, y, code, *more)

    monkeypatch.setattr(language_id, "train", train)
    n = {f"l{k:02}": 60 if k < 20 else 2 for k in range(40)}
    rows = [(1000 * i + k, f"word{lang} x{k}y", lang) for i, (lang, many) in enumerate(n.items()) for k in range(many)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language_id.identify(d, F.lit(False), sample=80).count()
    assert seen == [(sorted([*range(40)] * 2), 40)]  # two rows of each of 40 languages
