"""Words of texts as codes, slice by slice, and sets of hashes in a fixed number of bits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import text_blocks

SEED = 42
#: A byte that no UTF-8 text holds: it stands between pieces.
BREAK = b"\xff"
SLICE_BYTES = 4 << 20
FILTER_BITS = 26
#: The primes of XXH64.
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def byte_table(blank: Iterable[int], cut: Iterable[int] = ()) -> bytes:
    """For bytes.translate: A-Z in lower case, ``blank`` bytes as spaces, ``cut`` bytes as line ends."""
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    for b in blank:
        table[b] = 32
    for b in cut:
        table[b] = 10
    return bytes(table)


def tokenised(texts: Sequence[bytes], table: bytes) -> tuple[list[bytes], np.ndarray]:
    """The different words of the texts and the code of each word in order; texts, and pieces at line ends, are parted by
    the word BREAK."""
    data = b"\n".join(texts).translate(table).replace(b"\n", b" " + BREAK + b" ")
    offsets = np.array([0, len(data)], np.int64)
    text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = pc.list_flatten(pc.ascii_split_whitespace(text)).dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy()
    if b"" in words:  # before the first and after the last word
        keep = codes != words.index(b"")
        codes = codes[keep]
    return words, codes


def slices(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[str, ...], list[bytes]]]:
    """The texts (last column, binary) of rows with equal values in the first ``keys`` columns, a bounded slice at a time."""
    for rows in text_blocks(batches, SLICE_BYTES, "text"):
        texts, by = rows.column(keys).to_pylist(), {}
        for k, key in enumerate(zip(*(rows.column(i).to_pylist() for i in range(keys)))):
            by.setdefault(key, []).append(texts[k])
        yield from by.items()


def summed(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def hashes(words: Iterable[bytes], lang: str) -> np.ndarray:
    """What xxhash64(lang, word) gives in Spark, as unsigned numbers."""
    seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def hashed_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What xxhash64(a, b) gives in Spark for two longs, as unsigned numbers."""
    seed = np.full(len(a), SEED, np.uint64)
    for value in (a, b):
        h = seed + _PRIMES[4] + np.uint64(8)
        h ^= _turned(value * _PRIMES[1], 31) * _PRIMES[0]
        h = _turned(h, 27) * _PRIMES[0] + _PRIMES[3]
        h = (h ^ h >> np.uint64(33)) * _PRIMES[1]
        h = (h ^ h >> np.uint64(29)) * _PRIMES[2]
        seed = h ^ h >> np.uint64(32)
    return seed


def hash_filter(rows: DataFrame, hashed: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set of 2^bits bits, as unsigned words, with two bits for each hash (a long): a Bloom filter whose size does
    not depend on the rows. What is in it answers yes; with many rows others do too, which costs time and loses nothing."""
    size = F.lit(1 << bits)
    places = F.array(F.pmod(hashed, size), F.pmod(F.shiftright(hashed, 32), size))
    set_ = rows.select(F.explode(places).alias("p")).selectExpr("shiftright(p, 6) as word", "shiftleft(1L, cast(p % 64 as int)) as bit")
    found = set_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << bits >> 6, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def in_filter(words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    size = np.uint64(len(words) * 64)
    held = np.ones(len(hashed), bool)
    for place in (hashed % size, (hashed.view(np.int64) >> 32).view(np.uint64) % size):
        held &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return held
