"""The pipeline's stages on a small table: each keeps the columns, drops what it should and leaves the rest."""

import random

import corpus_pipeline
import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import byte_bpe, decontamination

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, made = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made.append(docs)
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
    return [*made, docs]


def test_stages_keep_columns_and_rows(results):
    for before, after in zip(results, results[1:-1]):
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0
        assert 0.7 * before.count() < after.count() <= before.count()


def test_no_copies_stay(results):
    assert results[3].count() == results[3].select("text").distinct().count()


def test_toxic_documents_go(results):
    labels = duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall()
    kept = {r.doc_id for r in results[1].select("doc_id").collect()}
    assert sum(d in kept for d, t in labels if not t) > 0.99 * sum(not t for _, t in labels)


def test_tokens_of_what_is_left(results):
    bpe = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text for r in results[4].collect()}
    assert results[5].count() == len(texts)
    for row in results[5].limit(50).collect():
        assert bpe.decode(row.ids).decode() == texts[row.doc_id]


def test_run_gives_the_last_stage(spark, results):
    made = corpus_pipeline.run(spark, SF)
    assert made.exceptAll(results[5]).count() == 0 == results[5].exceptAll(made).count()


def test_documents_in_another_language_go(results):
    """Only texts without a letter, or that the model calls another language than the stated one, are rejected."""
    gone = results[1].exceptAll(results[2]).collect()
    assert all(r.text is None or not any(c.isalpha() for c in r.text) or r.lang is not None for r in gone)
    assert not [r for r in results[2].collect() if not any(c.isalpha() for c in r.text or "")]


def test_whole_items_go(spark, results):
    plain = lambda t: b" " + b" ".join(decontamination.words(t)) + b" "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in results[3].collect() if any(i in plain(r.text) for i in items)}
    assert held and {r.doc_id for r in results[3].select("doc_id").collect()} - {r.doc_id for r in results[4].select("doc_id").collect()} == held


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls in every column, empty, wordless, very long and repeated texts, a repeated row, and columns that clash."""
    folder = tmp_path_factory.mktemp("awkward")
    rng = random.Random(2)
    words = lambda n, letters: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n))
    item = words(30, "abcdefghij")
    rows = [(k, words(40, "abcdefghij"), "en", None) for k in range(20)] + [(20 + k, words(40, "klmnopqrst"), "de", "s") for k in range(20)]
    rows += [(50, None, "en", None), (51, "", None, None), (52, "123 !!", "en", "s"), (53, None, None, None), (None, "no id " + words(20, "abcdefghij"), "en", None), (None, None, None, None)]
    rows += [(60, rows[3][1], "en", "s"), rows[4], rows[4], (70, words(150_000, "abcdefghij"), "en", None), (80, words(50, "abcdefghij") + " " + item, "en", None), (81, rows[21][1], None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for clash in ("grade", "row", "row_key", "id", "fp", "digest", "first", "gone_key", "item_id", "ids", "p_toxic", "mark"):
        frame = frame.withColumn(clash, F.lit("clash"))
    frame = frame.withColumn("n_chars", F.length("text").cast("long"))
    frame.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, "a b"), (3, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame([(0, 0, 0), (1, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_awkward_rows_by_stage(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    whole = ids(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["toxicity"](spark, docs, awkward)) == whole  # nothing is labelled toxic among the documents
    kept = stages["language_id"](spark, docs, awkward)
    assert kept.columns == docs.columns and set(whole) - set(ids(kept)) >= {"50", "51", "52", "53"} and {"70", "80"} <= set(ids(kept))
    single = stages["simhash_dedup"](spark, docs, awkward)
    left = ids(single)
    assert single.columns == docs.columns and "60" not in left and "81" not in left and left.count("4") == 1 and left.count("50") + left.count("51") + left.count("53") == 1
    assert {"3", "21", "70", "80"} <= set(left)
    clean = stages["decontamination"](spark, docs, awkward)
    assert clean.columns == docs.columns and set(whole) - set(ids(clean)) == {"80"} and ids(clean).count("None") == 2
    coded = stages["byte_bpe"](spark, docs, awkward)
    assert ids(coded) == whole and {r.doc_id: len(r.ids) for r in coded.collect() if r.doc_id in (50, 51, 53)} == {50: 0, 51: 0, 53: 0}


def test_awkward_rows_and_empty_tables_whole(spark, awkward, tmp_path):
    made = corpus_pipeline.run(spark, awkward)
    assert made.columns == ["doc_id", "ids"] and made.count() > 30
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{awkward}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_language_model_learns_from_all_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(corpus_pipeline.language_id, "train", lambda rows, found=corpus_pipeline.language_id.train: seen.append(rows.count()) or found(rows))
    assert corpus_pipeline.reject_other_languages(spark, docs, "").count() == 40 and seen == [40]
