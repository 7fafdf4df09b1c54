"""Removal of repeated strings against a plain version over all windows."""

import random

import numpy as np
import pytest

from fieldspark.llm import suffix_dedup

SCHEMA = "doc_id long, text string, spans string"


def plain(rows, length):
    """Per row: removed spans, by a dictionary of every window's smallest id."""
    big = float("inf")
    data = [(big if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for id_, text in data:
        for k in range(len(text) - length + 1):
            w = text[k : k + length]
            first[w] = min(first.get(w, big), id_)
    found = []
    for id_, text in data:
        gone = np.zeros(len(text) + 2, bool)
        for k in range(len(text) - length + 1):
            if first[text[k : k + length]] < id_:
                gone[k + 1 : k + length + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        found.append([tuple(p) for p in edges.reshape(-1, 2).tolist()])
    return found


def spans_of(spark, rows, length, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = suffix_dedup.text_rows(docs)
    found = suffix_dedup.for_documents(texts, suffix_dedup.repeats(docs, texts, length=length, **options), length)
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], [(s["start"], s["stop"]) for s in r["spans"]]) for r in found.collect()), key=repr)


def expected(rows, length):
    made = []
    for (id_, text, _), spans in zip(rows, plain(rows, length)):
        made.append((id_, len((text or "").encode()), sum(b - a for a, b in spans), spans))
    return sorted(made, key=repr)


def corpus(seed, count):
    rng = random.Random(seed)
    words = ["ab", "ébc", "the", "of,", "和", "x", "thing", "and"]
    passage = " ".join(rng.choices(words, k=40))
    rows = []
    for k in range(count):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 60)))
        if k % 3 == 0:
            cut = rng.randrange(len(passage) - 35)
            text = text[: len(text) // 2] + passage[cut : cut + rng.randrange(20, 90)] + text[len(text) // 2 :]
        if k % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((rng.randrange(count), text, "x"))
    rows += [(None, passage, None), (None, passage, None), (3, None, None), (4, "", None), (5, "he " * 400, None), (6, "e he " + "he " * 90, None), (6, "e he " + "he " * 90, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length, hot, chunk, block_bytes", [(50, 4096, 2 << 20, 16 << 20), (30, 2, 500, 1 << 10), (25, 0, 1, 1 << 12)])
def test_spans_are_those_of_all_windows(spark, length, hot, chunk, block_bytes):
    rows = corpus(length, 150)
    assert spans_of(spark, rows, length, hot=hot, chunk=chunk, block_bytes=block_bytes) == expected(rows, length)


def test_texts_longer_than_a_step(spark):
    rng = random.Random(5)
    long_ = "".join(rng.choices("abcdefgh ", k=(1 << 18) + 5000))
    rows = [(1, long_, None), (2, "start " + long_[(1 << 18) - 60 : (1 << 18) + 40] + " end", None), (3, long_[::-1], None), (0, long_[-50:], None)]
    assert spans_of(spark, rows, 50) == expected(rows, 50)


def test_shared_windows_by_increasing_prefixes():
    rng = random.Random(2)
    for length in (3, 7, 25, 50):
        texts = ["".join(rng.choices("ab\0", k=length + rng.randrange(40))).encode() for _ in range(60)]
        texts = sorted({t + b"a" * 9 for t in texts})
        ids = np.arange(len(texts))
        first = {}
        for k, t in enumerate(texts):
            for at in range(len(t) - length + 1):
                first.setdefault(t[at : at + length], k)
        wanted = [first[t[at : at + length]] for t in texts for at in range(len(t) - length + 1)]
        assert suffix_dedup.shared_windows(texts, ids, length).tolist() == wanted


def test_what_is_left_takes_the_text_s_place(spark):
    shared = "a passage that two documents of this little table share, word by word"
    rows = [(1, f"first {shared} one", "p"), (2, f"second {shared} two", "q"), (9, f"first {shared} one", "r"), (2, "short", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `kept.n` string")
    left = {r["kept.n"]: bytes(r["text"]).decode() for r in suffix_dedup.remove_repeats(docs).collect()}
    assert left["p"] == rows[0][1] and left["s"] == "short" and left["r"] == ""
    assert left["q"] == "secondtwo"  # the blanks around it are shared too


def test_empty_tables_and_short_strings(spark):
    assert spans_of(spark, [], 50) == []
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        spans_of(spark, [], 24)
