"""Byte-level BPE and token counts against the public libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from fieldspark.llm import byte_bpe, registry, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
ALPHABETS = ["ab", "abcdefgh ", " \n\t\r", "éàü ñ", "日本語の文", "0123456789.,", "thein the and ", "▁ a", "\x00\x1c\x1f\x85   x", "\U0001f600‍́a", "'sre't "]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    made = ["", " ", "  ", "\n", "a", "don't we'll", "<s> </s> <unk> <0x0A>", "<|endoftext|>", " lead", "trail ", "trail  ", "a\n\nb", "x" * 3000, " " * 500, "ab" * 2000]
    for _ in range(n):
        parts = ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 12))]
        made.append(rng.choice(["", " ", "\n"]).join(parts))
    return made


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (5_000, None), (3, "a"), (3, "a")]
    return made, spark.createDataFrame(made, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1)).repartition(3)


def test_ids_match_the_library(spark, rows):
    made, docs = rows
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    got = sorted((tuple(r) for r in byte_bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()), key=str)
    wanted = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in made), key=str)
    assert [(i, ids, bytes(d)) for i, ids, d in got] == wanted


def test_lists_decode_at_once():
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    ids = [[], bpe.encode("hello world"), None, bpe.encode("日本 \U0001f600"), []]
    lists = pa.array([[1], *ids], pa.list_(pa.int32()))
    assert bpe.decode_lists(lists.slice(1)).to_pylist() == [bpe.decode(i or []) for i in ids]
    for wrong in (-1, len(bpe.ranks)):
        with pytest.raises(KeyError):
            bpe.decode_lists(pa.array([[5, wrong]], pa.list_(pa.int32())))


def test_linear_encoding_of_long_pieces():
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    ranks = bpe.ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(60):
        piece = "".join(rng.choices(rng.choice(["abc", "thein", "reations", "aaab"]), k=rng.randrange(1, 400)))
        assert bpe.encode_piece(piece.encode()) == library.encode_ordinary(piece)
        assert bpe.encode_piece(piece[:40].encode()) in ([ranks.get(piece[:40].encode())], byte_bpe.merged(piece[:40].encode(), ranks))


def test_counts_match_the_library(spark, rows):
    made, docs = rows
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(map(tuple, token_counts.count_tokens(docs, PIECES).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in made), key=str)


def test_the_shortcut_is_used():
    proof = token_counts.prove(PIECES)
    assert proof.cuts and proof.prefix
    assert len(proof.singles) > 31_000


@pytest.mark.parametrize("name", ["op6_byte_bpe", "op9_token_counts"])
def test_queries_on_an_empty_table(spark, name, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_digests(spark, tmp_path):
    spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.QUERIES["op6_byte_bpe"](spark, str(tmp_path)).collect()}
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, bpe.encode("hello world"))).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == got[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
