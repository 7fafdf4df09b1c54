"""Naive Bayes language ID: a plain version of the same model, and accuracy on held-out rows."""

import zlib
from collections import Counter
from math import exp, log

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import language_id as L
from fieldspark.llm import registry
from fieldspark.llm.common import table
from fieldspark.llm.letters import letters

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    cleaned = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    codes = letters(text)
    assert "".join(map(chr, codes)) == (f" {cleaned} " if cleaned else " ")
    return [int(b) for order in L.ORDERS for b in L._buckets(codes, order)]


def test_model_matches_a_plain_one(spark):
    rows = [("en", "The cat, the HAT!"), ("en", "a hat"), ("fr", "le chât — là"), ("de", "die Straße 12 ist"), (None, "x"), ("fr", None)]
    model = L.train(spark.createDataFrame(rows, "lang string, text string").repartition(2))
    assert model.languages == ("de", "en", "fr")
    counts = {lang: Counter() for lang in model.languages}
    for lang, text in rows:
        if lang and text:
            counts[lang].update(plain_grams(text))
    texts = ["the hat", "", None, "123 !?", "straße", "là", "a", "le chat the", "x" * 50, "é"]
    priors = {"de": 1 / 4, "en": 2 / 4, "fr": 1 / 4}
    for text, name, score in zip(texts, *model.predict_batch(texts)):
        assert (name, score) == pytest.approx(model.predict(text)) if text is None else model.predict(text)[0] == name
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        scores = {lang: log(priors[lang]) + sum(log((c[b] + 0.5) / (c.total() + 0.5 * L.BUCKETS)) for b in plain_grams(text)) for lang, c in counts.items()}
        best = max(scores, key=scores.get)
        assert name == best
        assert score == pytest.approx(1 / sum(exp(s - scores[best]) for s in scores.values()), rel=1e-3)
        assert model.predict(text)[1] == pytest.approx(score, rel=1e-3)


def test_held_out_accuracy_and_shape(spark):
    docs = table(spark, SF, "documents")
    got = registry.QUERIES["op8_language_id"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    joined = got.join(docs, "doc_id").where("held_out").toPandas()
    assert 150 < len(joined) < 250
    assert (joined.lang_pred == joined.lang).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in joined.doc_id)
    assert got.count() == docs.count()


def test_nothing_but_text_decides(spark):
    model = L.train(table(spark, SF, "documents").where("doc_id < 300"))
    one = spark.createDataFrame([(1, "the and of", "fr", "s"), (None, "the and of", None, None), (1, "the and of", "de", "t")], "doc_id long, text string, lang string, source string")
    assert len({(r.lang_pred, r.score) for r in L.identify(one.withColumn("lang_pred", F.lit(0)), model).collect()}) == 1


def test_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(empty)
    assert L.identify(empty, model).collect() == []
    assert L.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_very_long_text_in_pieces(spark, monkeypatch):
    model = L.train(table(spark, SF, "documents").where("doc_id < 300"))
    text = "the of and être là " * 300
    whole = model.scores(letters(text))
    monkeypatch.setattr(L, "PIECE", 97)
    assert model.scores(letters(text)) == pytest.approx(whole)


def test_keeping_rows_in_their_language(spark):
    model = L.train(table(spark, SF, "documents"))
    text = table(spark, SF, "documents").where("lang = 'fr' and n_chars > 500").first().text
    rows = [(1, text, "fr"), (2, text, "en"), (3, text, None), (4, text, "xx"), (5, "12 34", "fr"), (6, None, "fr"), (7, "a", "fr"), (1, text, "fr")]
    kept = L.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3, 4, 7]
    docs = table(spark, SF, "documents")
    assert L.keep_identified(docs, model).count() > 0.97 * docs.count()
