"""Media columns: exact round trips, ranges, damage and retries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import media, registry


def rows():
    rng = random.Random(2)
    texts = ["", "a", "x" * 63, "y" * 64, "z" * 65, "é" * 32, "\x00", "日本" * 500, "same", "same"]
    texts += ["".join(rng.choices("abc \né", k=rng.randrange(3000))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (70, None), (-5, "negative"), (-5, "negative")]


def plain(i, text):
    data = (text or "").encode()
    payload = data + bytes(64 * max(1, -(-len(data) // 64)) - len(data))
    image = media.encode_image(data)
    return i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(payload)


def test_query_matches_a_plain_version(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumn("media", F.lit("clash")).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op10_media_columns"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(*r) for r in rows()), key=str)


def test_small_ranges_read_each_member_once(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").coalesce(1)
    media.write_archives(docs, str(tmp_path / "a"))
    spark.dataSource.register(media.MediaArchive)
    read = spark.read.format("media_archive").option("rangebytes", 700).load(str(tmp_path / "a"))
    assert read.rdd.getNumPartitions() > 5
    assert read.count() == read.select("offset").distinct().count() == len(rows())


def test_a_member_is_read_again_on_its_own(spark, tmp_path, monkeypatch):
    media.write_archives(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string").coalesce(1), str(tmp_path / "a"))
    reader = media.ArchiveReader({"path": str(tmp_path / "a")})
    calls, decode = [], media.decode_image

    def flaky(data):
        calls.append(data)
        if len(calls) == 1:
            raise OSError("lost connection")
        return decode(data)

    monkeypatch.setattr(media, "decode_image", flaky)
    found = [n for p in reader.partitions() for batch in reader.read(p) for n in batch["n_bytes"].to_pylist()]
    assert found == [3, 3] and len(calls) == 3


def test_damage_is_an_error(spark, tmp_path):
    media.write_archives(spark.createDataFrame([(1, "one" * 99)], "doc_id long, text string").coalesce(1), str(tmp_path / "a"))
    (archive,) = (tmp_path / "a").glob("*.zip")
    data = bytearray(archive.read_bytes())
    data[120] ^= 1
    archive.write_bytes(data)
    reader = media.ArchiveReader({"path": str(tmp_path / "a"), "attempts": "2"})
    with pytest.raises(OSError, match="member at byte 0"):
        list(reader.read(reader.partitions()[0]))


def test_unfinished_archives_and_empty_folders_are_not_read(spark, tmp_path):
    media.write_archives(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "a"))
    (tmp_path / "a" / ".half").write_bytes(b"PK")
    assert media.read_archives(spark, str(tmp_path / "a")).collect() == []
