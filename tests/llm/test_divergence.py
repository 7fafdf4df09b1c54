"""The divergence of sources against the contract's arithmetic in whole numbers."""

import re
from collections import Counter

import numpy as np

from fieldspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string"


def corpus(sources=9):
    rng = np.random.default_rng(8)
    words = [f"t{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(90)] + ["Été", "和平", "it's"]
    rows = []
    for k in range(400):
        weights = rng.random(len(words)) ** (1 + k % 5)
        text = " ".join(rng.choice(words, size=rng.integers(0, 30), p=weights / weights.sum())) + ["?", "\n9", "", "_ONE"][k % 4]
        rows.append((k, text, ["en", "de", None][k % 3], f"s{rng.integers(sources)}" if k % 11 else None, "x", "y"))
    return [*rows, (1, None, "en", "empty", None, None), (2, "few words", "xx", "a", None, None), (2, None, "xx", "b", None, None), (3, "alone", "yy", None, None, None), *rows[:30]]


def plain(rows, least, ranks):
    count, docs, groups = {}, Counter(), set()
    for _, text, lang, source, _, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        docs.update((lang, t) for t in set(terms))
        count.setdefault((lang, source), Counter()).update(terms)
    made = []
    for lang in {g[0] for g in groups}:
        kept = [t for (other, t), n in docs.items() if other == lang and n >= least]
        own = {s: count[lang, s] for other, s in groups if other == lang}
        own[None] = sum(own.values(), Counter())
        p = {}
        for s, c in own.items():
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 1000000000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            if s is None:
                continue
            parts = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o not in (s, None)]}
            parts["term"] = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, items in parts.items():
                for rank, (value, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= ranks:
                        made.append((lang, s, part, item.decode(), -value, rank))
    return sorted(made)


def test_all_ranks_and_terms(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == plain(rows, 10, 10)


def test_several_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COLUMNS", 16)
    rows = corpus(sources=170)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, divergence.source_divergence(docs, least_docs=3, ranks=2).collect())) == plain(rows, 3, 2)


def test_joint_sums_of_sparse_tiles():
    rng = np.random.default_rng(4)
    columns = 1500
    padded = -(-columns // 512) * 512
    sides = []
    for share in (0.00005, 0.02):
        zero = rng.integers(1, 1000, divergence.MEMBERS)
        p = np.ones((divergence.MEMBERS, padded), np.int64)
        p[:, :columns] = zero[:, None]
        counted = np.zeros(p.shape, bool)
        counted[:, :columns] = rng.random((divergence.MEMBERS, columns)) < share
        p[counted] = rng.integers(1, 10**9, counted.sum())
        sides.append((p, zero, divergence.zero_tree(counted)))
    (p, p0, a), (q, q0, b) = sides
    assert not a[2].all()  # whole quadrants are zero
    wanted = np.array([divergence.divergence(row[None], q)[:, :columns].sum(1) for row in p])
    assert (divergence.joint_sums(p, q, p0, q0, (a, b), columns, False) == wanted).all()


def test_empty_tables(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None, None), (2, "", "", "b", None, None)], SCHEMA)
    assert sorted(map(tuple, divergence.source_divergence(nothing).collect())) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]
