"""Ordinal regression: gradients, ordered thresholds, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import toxicity
from fieldspark.llm.common import table

SF = "/root/testdata/sf0.1"


def plain_features(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return {("w", w) for w in words} | {("p", k, w[:k]) for w in words for k in toxicity.PREFIXES if len(w) > k}


def test_features_are_those_of_the_words():
    texts = ["The Idiots, idiot!", None, "", "1 2", "überlangeswortmitende überlangeswortmitanfang a"]
    rows, hashes = toxicity.features(texts)
    for k, text in enumerate(texts):
        assert len(set(hashes[rows == k].tolist())) == len(plain_features(text or ""))
    assert set(toxicity.features(["idiot"])[1].tolist()) == set(toxicity.features(["IDIOT."])[1].tolist())
    one, two = (set(toxicity.features([t])[1].tolist()) for t in ("idiot", "what idiots"))
    assert len(one & two) == 2  # the first three and four letters
    one, two = (set(toxicity.features([t])[1].tolist()) for t in ("abcdefghijklmnop", "abcdefghijklxxxx"))
    assert len(one ^ two) == 2  # whole words, which share all prefixes
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdé", k=rng.randrange(1, 40))) for _ in range(3000)}
    assert len(set(toxicity.features([" ".join(words)])[1].tolist())) == len(plain_features(" ".join(words)))
    assert len(toxicity.features(["x" * 300_000 + " y"])[1]) == len(toxicity.PREFIXES) + 2


def test_fit_recovers_an_ordinal_model():
    rng = np.random.default_rng(0)
    true, cuts, n = np.array([2.0, -1.5, 0.0, 1.0]), np.array([-0.5, 1.5]), 20_000
    x = rng.random((n, 4)) < 0.5
    grades = ((x @ true)[:, None] + rng.logistic(size=(n, 1)) > cuts).sum(1)
    rows, places = np.nonzero(x)
    weights, thresholds = toxicity.fit(rows, places, grades, 4, ridge=0.0)
    assert weights == pytest.approx(true, abs=0.12) and thresholds == pytest.approx(cuts, abs=0.12)


def test_fit_without_contrast():
    weights, thresholds = toxicity.fit(np.array([0]), np.array([0]), np.array([0, 0]), 2)
    assert not weights.any() and thresholds[0] > 10


def test_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    train = labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("grade"))
    model = toxicity.train(docs, train)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    said = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 2 = 0"), "doc_id").toPandas()
    caught = said[said.toxic == 1].said.mean()
    alarms = said[said.toxic == 0].said.mean()
    assert caught > 0.85 and alarms < 0.004, (caught, alarms)
    kept = toxicity.keep_clean(docs.withColumn("grade", F.lit("clash")), model)
    assert kept.columns == [*docs.columns, "grade"]
    assert kept.count() == toxicity.score(docs, model).where("not toxic").count()


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot idiot"), (2, "hello dear"), (3, None), (4, ""), (None, "idiot"), (1, "you idiot idiot"), (5, "hello idiots"), (6, "1 2 3")] * 5, "doc_id long, text string")
    graded = spark.createDataFrame([(1, 2), (2, 0), (3, 1), (4, 0), (None, 1), (5, None), (99, 2), (1, 2)], "doc_id long, grade int")
    model = toxicity.train(docs, graded)
    said = toxicity.score(docs, model)
    assert said.columns == ["doc_id", "grade", "expected_severity", "p_toxic", "toxic"]
    got = {r.doc_id: r for r in said.collect()}
    assert said.count() == 40
    assert got[1].toxic and got[1].grade == 2 and got[1].expected_severity > 1.2, got[1]
    assert not got[2].toxic and got[3].p_toxic == got[4].expected_severity == got[6].p_toxic == 0
    clashing = docs.withColumn("grade", F.lit("x")).withColumn("p_toxic", F.lit(None)).withColumn("mark", F.lit(0))
    assert toxicity.score(clashing, model).exceptAll(said).count() == 0
    long = spark.createDataFrame([(1, "dear " * 400_000 + "you idiot idiot")], "doc_id long, text string")
    assert toxicity.score(long, model).first().toxic
    nothing = toxicity.train(docs, graded.limit(0))
    assert toxicity.score(docs, nothing).where("toxic").count() == 0
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_every_labelled_row_counts(spark, monkeypatch):
    """More rows than a sample would have, and ids that repeat: the fit has them all, and its sums do not depend on tasks."""
    n = 20_500
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 10 = 0, 'you vile idiot', concat('dear friend ', id % 7)) as text")
    graded = docs.selectExpr("doc_id", "cast(doc_id % 10 = 0 as int) as grade")
    seen = {}

    def watched(rows, n_features, totals, found=toxicity.fit_rows):
        kept = rows.toPandas()
        lengths = kept.places.map(len).to_numpy()
        again = np.repeat(np.arange(len(kept)), kept.n)  # each row as often as it counts
        places = np.concatenate([np.asarray(kept.places[k], np.int64) for k in again])
        plain = toxicity.fit(np.repeat(np.arange(len(again)), lengths[again]), places, kept.grade.to_numpy()[again].astype(np.int64), n_features)
        seen.update(totals=totals, rows=kept.n.sum(), plain=plain, found=found(rows.repartition(5), n_features, totals))
        return seen["found"]

    monkeypatch.setattr(toxicity, "fit_rows", watched)
    model = toxicity.train(docs, graded.union(graded.where("doc_id < 3")))
    assert seen["rows"] == seen["totals"].sum() == n + 3
    for found, plain in zip(seen["found"], seen["plain"]):
        assert found == pytest.approx(plain, abs=1e-3)
    assert toxicity.score(docs, model).where("toxic").count() == n // 10


def test_cuts_are_quantiles():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 400):
        values, counts = np.unique(rng.integers(0, 9, size), return_counts=True)
        whole = np.repeat(values, counts)
        assert toxicity._cuts(values.astype(float), counts, 3) == pytest.approx(np.unique(np.quantile(whole, [1 / 3, 2 / 3])))
    assert not len(toxicity._cuts(np.empty(0), np.empty(0), 3))


def test_what_is_left_uncounted_could_not_be_chosen():
    rng = np.random.default_rng(4)
    for totals in (np.array([900.0, 100.0]), np.array([50.0, 400.0, 20.0]), np.array([0.0, 30.0, 70.0]), np.array([500.0, 0.0, 40.0, 9.0])):
        higher = np.stack([rng.integers(0, t + 1, 40) if g else np.zeros(40) for g, t in enumerate(totals)], 1).astype(float)
        higher = higher[higher.sum(1) > 0]
        most, reached = toxicity._most_g(higher, totals), np.zeros(len(higher))
        for n in range(int(totals[0]) + 1):
            reached = np.maximum(reached, toxicity._g(higher + np.eye(len(totals))[0] * n, totals))
        assert (most >= reached - 1e-6).all()
        assert (toxicity._most_g(higher + np.eye(len(totals))[0] * 7, totals) == most).all()


def test_vocabulary_is_that_of_all_counts(spark, monkeypatch):
    """Labels are not broadcast, few features are counted in grade 0, and those chosen are those of plain counts."""
    rng = random.Random(8)
    common, telling = [f"{rng.choice('bcdfg')}{''.join(rng.choices('aeioulmn', k=5))}" for _ in range(400)], ["idiot", "vile", "stupid"]
    rows = []
    for k in range(600):
        grade = 0 if k % 6 else 1 + k // 6 % 2
        rows.append((k, " ".join(rng.choices(common, k=12) + (rng.choices(telling, k=grade) if rng.random() < (0.9 if grade else 0.05) else [])), grade))
    docs, kept = spark.createDataFrame(rows, "doc_id long, text string, grade int"), []
    monkeypatch.setattr(toxicity, "checkpointed", lambda df, f=toxicity.checkpointed: kept.append((df._jdf.queryExecution().executedPlan().toString(), made := f(df))) or made)
    model = toxicity.train(docs.drop("grade"), docs.drop("text"))
    sets = [set(toxicity.features([text])[1].tolist()) for _, text, _ in rows]
    found = sorted(set().union(*sets))
    counts = np.array([[sum(h in s for s, r in zip(sets, rows) if r[2] == g) for g in range(3)] for h in found], float)
    told = toxicity._g(counts, np.array([500.0, 50.0, 50.0]))
    assert model.vocabulary.tolist() == [h for h, t, n in zip(found, told, counts.sum(1)) if t >= toxicity.LEAST_G and n >= toxicity.LEAST_ROWS] != []
    assert "BroadcastHashJoin" not in kept[0][0]
    higher = next(made for _, made in kept if "feature" in made.columns)
    assert len(model.vocabulary) <= higher.count() < len(found) / 10
