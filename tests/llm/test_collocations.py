"""Phrases in tiles against counting every phrase; sets in bits; hashes."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fieldspark.llm import collocations, vocabulary

SCHEMA = "doc_id long, text string, lang string, w1 string, n string"


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)] + ["É", "和", "x" * 70]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(260):
        chosen = list(rng.choice(words, size=rng.integers(0, 40), p=weights / weights.sum()))
        for at in range(0, len(chosen), 9):
            chosen[at] += [".", ",", "\n", "\t", "!", "\r"][k % 6]
        text = ("New  York\tCity " if k % 2 else "rare Pair, ") + " ".join(chosen)
        rows.append((k, text, ["en", "de", None][k % 3], "a", "b"))
    return [*rows, (1, None, "en", None, None), (2, "", "fr", None, None), (3, " .\t,", "fr", None, None), *rows[:20]]


def plain(rows, top, least):
    """The contract, word for word."""
    counts, total = {1: Counter(), 2: Counter(), 3: Counter()}, Counter()
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    counts[size][lang, *words[k : k + size]] += 1
    found = {}
    for size in (2, 3):
        for (lang, *words), a in counts[size].items():
            if a < least:
                continue
            if size == 2 and any(n >= least and 100 * n >= 50 * a and words in (t[:2], t[1:]) for (other, *t), n in counts[3].items() if other == lang):
                continue
            cuts = []
            for k in range(1, size):
                left, right = counts[k][lang, *words[:k]], counts[size - k][lang, *words[k:]]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    made = []
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            made.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(made)


def test_every_number_of_heads_gives_the_same(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wanted = plain(rows, 50, 10)
    assert len(wanted) > 60
    for head in (1 << 18, 12, 1):
        assert sorted(map(tuple, collocations.collocations(docs, top=50, head=head).collect())) == wanted


def test_dense_and_sparse_tiles_and_salts(spark):
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 3, 4000) << 40 | (rng.zipf(1.3, 4000) % 90000) << 20 | rng.zipf(1.3, 4000) % 90000, return_counts=True) for _ in range(6)]
    sums = Counter()
    rows = []
    for salt, (keys, counts) in enumerate(parts):
        sums.update(dict(zip(keys.tolist(), counts.tolist())))
        rows += list(collocations.tiled(keys, counts, 4, salt % 2))
    assert {r[1] for r in rows} == {-1, 0, 1, 2}
    taken = []
    run = collocations._sums(1, lambda keys, counts: taken.extend(zip(keys.tolist(), counts.tolist())) or True)
    rows.sort(key=lambda r: r[:4])
    list(run([collocations._tile_rows(rows[:50]), collocations._tile_rows(rows[50:])]))
    added = Counter()
    for key, n in taken:
        added[key] += n
    assert added == sums


def test_a_tile_that_ends_with_a_full_buffer():
    keys = np.arange(1 << 18) // 512 << 20 | np.arange(1 << 18) % 512
    rows = [r for _ in range(3) for r in collocations.tiled(keys, np.full(len(keys), 2), 1, 0)]
    assert {r[2:4] for r in rows} == {(0, 0)}
    taken = []
    list(collocations._sums(6, lambda keys, counts: taken.append((keys, counts)) or True)([collocations._tile_rows(rows)]))
    assert len(taken) == 1 and (taken[0][0] == keys).all() and (taken[0][1] == 6).all()


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).count() == 0


def test_hashes_and_bits_agree_with_spark(spark):
    rows = spark.createDataFrame([("en", "word", -5, 7), ("", "é", 1 << 62, -(1 << 63))], "lang string, word string, a long, b long")
    said = rows.select(F.xxhash64("lang", "word"), F.xxhash64("a", "b")).collect()
    assert [r[0] for r in said] == [int(vocabulary.hashes([w.encode()], lang).view(np.int64)[0]) for lang, w in (("en", "word"), ("", "é"))]
    a, b = np.array([-5, 1 << 62]).view(np.uint64), np.array([7, -(1 << 63)]).view(np.uint64)
    assert [r[1] for r in said] == vocabulary.hashed_pairs(a, b).view(np.int64).tolist()
    bits = vocabulary.hash_filter(rows, F.xxhash64("a", "b"), 12)
    assert vocabulary.in_filter(bits, vocabulary.hashed_pairs(a, b)).all() and not vocabulary.in_filter(bits, np.arange(50, dtype=np.uint64)).all()
