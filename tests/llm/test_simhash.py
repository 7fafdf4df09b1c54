"""SimHash against a brute-force version over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldspark.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, words):
    parts = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, most=4):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                parent[root(b)] = root(a)
    return {p: root(p) for p in parent}


def expected(rows, words=4):
    prints = [plain_fingerprint(t, words) for _, t in rows]
    roots = plain_groups(set(prints))
    first = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            first[roots[p]] = min(first.get(roots[p], i), i)
    return sorted(((i, f"{p:016x}", first.get(roots[p])) for (i, _), p in zip(rows, prints)), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA", "delta", "é", "Éa", "x y", "zeta"] + [f"w{i}" for i in range(60)]
    made = []
    for _ in range(n):
        if made and rng.random() < 0.5:
            base = (rng.choice(made) or "").split(" ")
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            made.append(" ".join(base))
        else:
            made.append(rng.choice([" ", "\n", "\t\x0b"]).join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 40, 300]))))
    return made + ["", None, " \t\x0c", "A", "a", " ", "same words " * 3000]


def test_components_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 250))]
    rows += [rows[3], rows[3], (None, "null id"), (None, rows[5][1]), (10_001, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = sorted(map(tuple, simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == expected(rows)


def test_all_links_of_random_fingerprints_are_found(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    prints = set(base.tolist())
    for p in base.tolist():
        for flips in (3, 4, 5):
            q = p
            for b in rng.choice(64, flips, replace=False):
                q ^= 1 << int(b)
            prints.add(q)
    wanted = plain_groups(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = {p: p for p in prints}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for a, b in simhash.links(frame).collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        found[root(max(a, b))] = root(min(a, b))
    groups = lambda f: sorted(sorted(p for p in prints if f(p) == r) for r in {f(p) for p in prints})
    assert groups(root) == groups(wanted.get)


def test_large_run_yields_a_spanning_forest():
    prints = np.array([1 << b for b in range(60)] + [0, (1 << 50) - 1], np.uint64)
    keys = np.zeros(len(prints), np.int64)
    a, b = simhash.bucket_links(keys, prints, 2)
    assert len(a) == 60
    assert all((int(x) ^ int(y)).bit_count() <= 2 for x, y in zip(a, b))


def test_every_word_is_within_three_bits_of_one_anchor():
    tables, table, counts = simhash.golay_anchors(1)
    assert sorted(np.unique(counts).tolist()) == [1, 6]
    assert (counts == 6).sum() == 1771


def test_same_hash_as_spark(spark):
    row = spark.createDataFrame([("naïve text",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("naïve text", 42)


@pytest.mark.parametrize("schema", ["doc_id long, text string, row string"])
def test_dedup_keeps_one_of_each_group(spark, schema):
    words = " ".join(f"word{i}" for i in range(200))
    rows = [(4, words, "a"), (2, words, "b"), (2, words, "b"), (3, "other text here", "c"), (None, words, "d"), (None, None, "e"), (9, None, "f"), (7, "", "g"), (None, "lonely one", "h")]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(2, words, "b"), (3, "other text here", "c"), (7, "", "g"), (None, "lonely one", "h")]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(empty).collect() == []
    assert simhash.simhash_dedup(empty).collect() == []


def plain_similar_groups(rows, words=5, similarity=0.8):
    """First id of each row's group, by all pairs of fingerprints and of sets of shingles."""
    def shingles(text):
        parts = WORD.findall((text or "").lower())
        return {" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)} or ({" ".join(parts)} if parts else set())

    prints, sets = [plain_fingerprint(t, words) for _, t in rows], [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity
            if alike or (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(j)] = root(i)
    firsts = {}
    for k, (i, _) in enumerate(rows):
        firsts[root(k)] = min(firsts.get(root(k), i), i)
    return {i: firsts[root(k)] for k, (i, _) in enumerate(rows)}


def copies(seed, bases, length, changes):
    """Texts of which each base comes with copies that have some words replaced."""
    rng = random.Random(seed)
    made = []
    for b in range(bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        made.append(" ".join(base))
        for n in changes:
            other = list(base)
            for at in rng.sample(range(length), n):
                other[at] = f"x{rng.randrange(10**6)}"
            made.append(" ".join(other))
    return list(enumerate(made))


def test_groups_by_similarity_match_brute_force(spark):
    rows = copies(3, 60, 150, (1, 2, 3, 3, 4, 6, 9))
    rows += [(5001, None), (5000, ""), (5002, " \t"), (5003, "two words"), (5004, "Two  WORDS"), (5005, "two other"), (5006, "a " * 4000), (5007, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))
    wanted = plain_similar_groups(rows)
    got = {r.id: r.first.id for r in simhash.simhash_groups(docs, words=5, similarity=0.8).collect()}
    assert all(wanted[i] == wanted[first] for i, first in got.items())  # nothing that is not similar
    near = [i for i, first in wanted.items() if first != i]
    assert sum(got[i] == wanted[i] for i in near) >= 0.97 * len(near)
    by_bits = {r.id: r.first.id for r in simhash.simhash_groups(docs, words=5).collect()}
    assert sum(by_bits[i] == wanted[i] for i in near) < 0.9 * len(near)
    kept = {r.doc_id for r in simhash.simhash_dedup(docs).select("doc_id").collect()}
    assert kept == {first for first in got.values()}


def test_one_large_group_of_different_near_copies(spark):
    rows = copies(4, 1, 200, [2 + k % 6 for k in range(400)])
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=0.8).collect()
    wanted = plain_similar_groups(rows)
    assert sum(r.first.id == wanted[r.id] for r in got) >= 0.97 * len(rows)


def test_similarity_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty, words=5, similarity=0.8).collect() == []


def bucketed(rows, similarity=0.8, words=5, **sizes):
    """Texts of one bucket each: what the pairs of members are, by all pairs, and what the units pass on."""
    sets = [np.unique(simhash.shingle_hashes(t, words)) for _, t in rows]
    prints = np.array([simhash.fingerprint(t, words) for _, t in rows], np.uint64)
    sketches = np.stack([simhash.minima(s)[1] for s in sets])
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= similarity * len(np.union1d(sets[i], sets[j]))}
    return prints, sketches, sets, alike


def connected(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        root = [root[i] if r == root[j] else r for r in root]
    return {frozenset(k for k in range(n) if root[k] == r) for r in root}


def test_pairs_of_a_unit_are_checked_where_they_meet():
    """Copies only just similar: as many links as a forest has, and none lost though the sketches let many others pass."""
    prints, sketches, sets, alike = bucketed(copies(8, 1, 200, [1 + k % 3 for k in range(150)]))
    by_bits = {(i, j) for i in range(len(prints)) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4}
    found = list(simhash.unit_links(prints, sketches, sets, np.arange(len(sets)), 0.8, 4))
    assert {(max(p), min(p)) for p in found} <= alike and len(found) < len(sets) < len(alike) / 4
    assert connected(len(sets), found + list(by_bits)) == connected(len(sets), alike | by_bits)


def test_buckets_in_parts_connect_the_same(spark):
    """Rows of one part that find no partner there meet the other parts."""
    rows = copies(9, 2, 200, [1 + k % 9 for k in range(150)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.with_fingerprints(docs, "doc_id", "text", 5, sketched=True).cache()
    linked = simhash.links(prints.select("fp").distinct())
    fps = {r.fp for r in prints.select("fp").collect()}
    number = {fp: k for k, fp in enumerate(sorted(fps))}
    by_bits = [(number[r.a], number[r.b]) for r in linked.collect()]
    got = []
    for sizes in ({}, {"unit_rows": 7}, {"unit_hashes": 900}):
        found = simhash.similar_links(docs, prints, "text", 5, 0.8, 4, linked, **sizes).collect()
        got.append(connected(len(fps), [(number[r.a], number[r.b]) for r in found] + by_bits))
    assert got[0] == got[1] == got[2] and len(got[0]) < len(fps) / 2


def test_links_become_components_without_rounds(spark, monkeypatch):
    """Chains, a group of all pairs, links both ways, loops: one part of links takes no rounds, several parts give the same."""
    rng = random.Random(12)
    pairs = [(k, k + 1) for k in range(-60, 60) if k % 20] + [(i, j) for i in range(100, 140) for j in range(100, i)] + [(200, 200), (7, 3), (3, 7), (-(1 << 63), (1 << 63) - 1)]
    pairs = [p if rng.random() < 0.5 else p[::-1] for p in pairs]
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({x for p in pairs for x in p})
    number = {x: k for k, x in enumerate(nodes)}
    groups = connected(len(nodes), [(number[a], number[b]) for a, b in pairs])
    wanted = sorted((nodes[k], nodes[min(g)]) for g in groups for k in g if k != min(g))
    rounds = []
    monkeypatch.setattr(simhash, "components", lambda edges, found=simhash.components: rounds.append(edges.count()) or found(edges))
    assert sorted(map(tuple, simhash.rooted(links).collect())) == wanted and rounds == []
    assert sorted(map(tuple, simhash.rooted(links, most=90).collect())) == wanted and len(rounds) == 1
    assert simhash.rooted(links.limit(0)).collect() == []
    rounds.clear()
    docs = spark.createDataFrame(copies(6, 3, 200, (1, 2)), "doc_id long, text string")
    assert {(r.id, r.first.id) for r in simhash.simhash_groups(docs, similarity=0.8).collect()} == {(k, k - k % 3) for k in range(9)}
    assert rounds == []
