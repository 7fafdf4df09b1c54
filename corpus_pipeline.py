"""A training-data pipeline over documents: stages of fieldspark.llm, each written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import byte_bpe, decontamination, language_id, registry, simhash, toxicity
from fieldspark.llm.common import shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model holds for toxic, P(grade > 0) > 1/2, go. Null and empty texts and those without a
    letter stay; repeated rows stay or go alike; labels of null ids, or of none of the documents, are not used; without
    labels all stay. All columns, of any names, are kept as they are."""
    return toxicity.keep_clean(docs, registry.toxicity_model(spark, docs, sf_dir))


def reject_other_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty texts among them, go, and those that are certainly in another language than
    the one they state. A null or unknown stated language is no reason to go; without any stated language only texts
    without a letter go. The model learns from all rows. Repeated rows stay or go alike; all columns are kept."""
    return language_id.keep_identified(docs, language_id.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (fingerprints within four bits, or five-word shingles of similarity 0.8 or
    more) stays, the one with the smallest id, null ids last. A row that repeats an
    id and its text goes; texts without a word are one group. All columns are kept."""
    return simhash.simhash_dedup(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, copied or paraphrased, go; an item of a word or two counts only where it is the whole
    document. Null and empty texts stay; repeated rows stay or go alike; without items all stay. All columns are kept."""
    return decontamination.keep_uncontaminated(docs, decontamination.prepare(docs, table(spark, sf_dir, "benchmark")), evidence=decontamination.EVIDENCE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of every document that is left: none for a null or empty text, a row for each repeated row."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_other_languages),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: No stage but the last could be said in SQL, and that one only with a table of all pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet in the shared folder and read as the next input."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
