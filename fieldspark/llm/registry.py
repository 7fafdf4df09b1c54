"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import byte_bpe, collocations, decontamination, divergence, language_id, license_scan, media, oracles, sharding, simhash, suffix_dedup, token_counts, toxicity, url_filter
from fieldspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


#: Verdict, host and path prefix of the rules that op1 judges by.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SHARDS = 24


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and rule for every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.OrdinalModel:
    """The model that the labels of the documents give."""
    return toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade, expected severity and probability of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents")
    return decontamination.contaminated(docs, decontamination.prepare(docs, table(spark, sf_dir, "benchmark")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of a document that is similar to a licence or notice."""
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.templates_table(spark))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by language, source and length along a Hilbert curve."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "lang", "source", "n_chars",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.hilbert_shards(rows, "doc_id", ["lang", "source", "n_chars"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = byte_bpe.decode_documents(byte_bpe.encode_documents(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    said = language_id.identify(docs, model)
    return said.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's payload, stored as an image in an archive and read back."""
    stored = media.media_columns(table(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's terms differ from every other source of its language, and which terms it favours."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and spans of every document that repeat a string of 50 bytes of an earlier one, and a digest of the rest."""
    docs = table(spark, sf_dir, "documents")
    rows = suffix_dedup.text_rows(docs)
    found = suffix_dedup.repeats(docs, rows).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    kept = F.when(F.col("copied"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
    return suffix_dedup.for_documents(rows, found).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_media_columns": op10_media_columns,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": oracles.OP1_URL_FILTER,
    "op4_license_scan": oracles.OP4_LICENSE_SCAN,
    "op11_source_divergence": oracles.OP11_SOURCE_DIVERGENCE,
    "op12_collocations": oracles.OP12_COLLOCATIONS,
    "op13_suffix_dedup": oracles.OP13_SUFFIX_DEDUP,
}
