"""Decontamination: exact passages by brute force, paraphrases, the decomposition and the subsequence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import decontamination as D
from fieldspark.llm import registry
from fieldspark.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for k, y in enumerate(b):
            previous, row[k + 1] = row[k + 1], previous + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_lcs():
    rng = random.Random(0)
    for _ in range(200):
        a, b = rng.choices(range(6), k=rng.randrange(1, 70)), rng.choices(range(8), k=rng.randrange(0, 90))
        assert D.lcs(D._masks(np.array(a)), len(a), b) == plain_lcs(a, b)


def test_all_whole_passages_are_found_and_nothing_else(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = registry.QUERIES["op3_decontamination"](spark, SF)
    assert got.columns == ["doc_id", "item_id", "kind", "first_word", "n_words", "cosine", "share", "answer"]
    rows = got.collect()
    plain = lambda t: b" " + b" ".join(D.words(t)) + b" "
    sought = [(r.item_id, plain(r.text)) for r in items.collect()]
    wanted = {(d.doc_id, i) for d in docs.collect() for i, t in sought if t in plain(d.text)}
    assert len(wanted) > 10
    assert {(r.doc_id, r.item_id) for r in rows} == wanted
    assert len(rows) == len(wanted)


def shuffled(rng, vocabulary, n):
    return rng.choices(vocabulary, k=n)


@pytest.fixture(scope="module")
def planted(spark):
    """Items within random documents: whole, with words replaced, without the answer, halves only, one in most documents."""
    rng = random.Random(7)
    common, rare = [f"the{i}" for i in range(60)], [f"rare{i}" for i in range(3000)]
    text = lambda n: [rng.choice(rare) if rng.random() < 0.4 else rng.choice(common) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate([40, 17, 64, 33, 50, 90, 24, 300])}
    answer = text(6)
    items[2] += ["."] + answer
    blurred = lambda ws, p: [w if rng.random() > p else rng.choice(rare) for w in ws]
    docs, wanted = [], set()
    for d in range(160):
        ws = text(rng.randrange(30, 400))
        at = rng.randrange(len(ws))
        if d < 80:  # an item that half of the documents hold
            ws[at:at] = items[0]
            wanted.add((d, 0))
        if d % 8 in (1, 2, 3, 4, 5, 7):
            ws[at:at] = blurred(items[d % 8], 0.1)
            wanted.add((d, d % 8))
        if d % 16 == 6:
            ws[at:at] = items[6][:9]
        if d % 16 == 14:
            ws[at:at] = blurred(items[2][:-7], 0.3) + rng.choices(rare, k=7)
        docs.append((d, " ".join(ws)))
    frame = spark.createDataFrame(docs + [(900, None), (901, ""), (None, " ".join(items[1])), (902, "... !!"), (902, "... !!")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    benchmark = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()] + [(50, None), (51, ""), (52, "too short"), (None, "a b c d e f g")], "item_id long, text string")
    return frame, benchmark, wanted | {(None, 1)}


def test_planted_items(spark, planted):
    docs, benchmark, wanted = planted
    searches = D.prepare(docs, benchmark)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, searches).collect()}
    assert not got - wanted
    assert len(wanted - got) <= 0.03 * len(wanted), wanted - got
    kept = D.keep_uncontaminated(docs, searches)
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in {d for d, _ in got})


def test_blocks_and_pieces_find_the_same(spark, planted, monkeypatch):
    docs, benchmark, _ = planted
    whole = {(r.doc_id, r.item_id) for r in D.contaminated(docs, D.prepare(docs, benchmark)).collect()}
    monkeypatch.setattr(D, "BLOCK_ITEMS", 4)
    searches = D.prepare(docs, benchmark)
    assert len(searches) == 3
    parts = {(r.doc_id, r.item_id) for r in D.contaminated(docs, searches).collect()}
    assert whole == parts
    search = D.prepare(docs, benchmark)[0].value
    long_text = " ".join(r.text or "" for r in docs.limit(60).collect())
    once = {h[0] for h in search.hits([long_text])[0]}
    monkeypatch.setattr(D, "LONG", 512)
    assert {h[0] for h in search.hits([long_text])[0]} == once


def test_basis_spans_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [rng.choice(40, 12, p=(p := rng.dirichlet(np.full(40, 0.1)))).tolist() for _ in range(300)]
    weights = rng.uniform(1, 5, 40)
    dense = np.zeros((300, 40))
    for k, ids in enumerate(rows):
        value = weights[ids] / np.linalg.norm(weights[ids])
        np.add.at(dense[k], ids, value)
    frame = spark.createDataFrame([(r, 1.0) for r in rows], "ids array<int>, length double").repartition(3)
    basis = D.latent_basis(frame, weights, rank=30)
    kept = np.linalg.norm(dense @ basis) ** 2
    best = (np.linalg.svd(dense, compute_uv=False)[:30] ** 2).sum()
    assert kept > 0.995 * best


@pytest.mark.parametrize("order", [1, -1])
def test_all_texts_of_a_repeated_id_are_found(spark, order):
    rng = random.Random(11)
    filler = [f"fill{i}" for i in range(400)]
    long, short = [f"left{i}" for i in range(40)], [f"right{i}" for i in range(20)]
    made = [(d, rng.choices(filler, k=60) + copy + rng.choices(filler, k=60)) for d, copy in enumerate([long, short, [], short, long])][::order]
    docs = spark.createDataFrame([(d, " ".join(ws)) for d, ws in made], "doc_id long, text string").coalesce(1)  # one task meets both texts
    benchmark = spark.createDataFrame([(7, " ".join(long)), (7, " ".join(short))], "item_id long, text string")
    searches = D.prepare(docs, benchmark)
    got = {(r.doc_id, r.item_id): (r.kind, r.share) for r in D.contaminated(docs, searches).collect()}
    assert got == {(d, 7): ("copy", 1.0) for d in (0, 1, 3, 4)}
    assert [r.doc_id for r in D.keep_uncontaminated(docs, searches).collect()] == [2]


def test_short_items_are_found_as_sequences(spark):
    texts = ["one two three four", "x one two y", "two one", None, "", "a" + " b" * 3000 + " one two", "three", "One, TWO!"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "one two"), (None, "one two")], "doc_id long, text string").withColumn("kind", F.lit(0))
    benchmark = spark.createDataFrame([(1, "one two"), (2, "three"), (1, "three four"), (3, "..."), (None, "x"), (1, "one two")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.kind, r.first_word, r.n_words) for r in D.contaminated(docs, D.prepare(docs, benchmark)).collect()), key=str)
    wanted = [(0, 1, "copy", 0, 2), (0, 2, "copy", 2, 1), (1, 1, "copy", 1, 2), (5, 1, "copy", 3001, 2), (6, 2, "copy", 0, 1), (7, 1, "copy", 0, 2), (None, 1, "copy", 0, 2), (None, 1, "copy", 0, 2)]
    assert got == sorted(wanted, key=str)
    both = benchmark.union(spark.createDataFrame([(9, "a b b b b b b b")], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, D.prepare(docs, both)).collect()}
    assert {(d, i) for d, i, *_ in wanted} <= found and (5, 9) in found
    assert sorted(str(r.doc_id) for r in D.keep_uncontaminated(docs, D.prepare(docs, benchmark)).collect()) == ["2", "3", "4"]


def test_long_answers_count_whole():
    assert D.answer_words("What is it? " + "word " * 40) == 40
    assert D.answer_words("one. two three.") == 2 and D.answer_words("") == D.answer_words("...") == 0


def test_a_benchmark_with_too_many_words_is_refused(monkeypatch):
    monkeypatch.setattr(D, "MAX_WORDS", 3)
    with pytest.raises(ValueError):
        D.Vocabulary([(1, "a b"), (2, "c d")])


def test_nothing_to_find(spark, planted):
    docs, benchmark, _ = planted
    assert D.contaminated(docs, D.prepare(docs, benchmark.limit(0))).collect() == []
    assert D.contaminated(docs, D.prepare(docs, benchmark.where("item_id >= 50"))).collect() == []
    assert D.contaminated(docs.limit(0), D.prepare(docs.limit(0), benchmark)).collect() == []


def test_scripts_without_spaces_and_their_punctuation(spark):
    items = {
        1: "今天天气很好，我们去公园玩。", 2: "東京の桜は三月の終わりに咲き始めます。", 3: "ประเทศไทยมีอากาศร้อนตลอดทั้งปี",
        4: "¿Cuál es la capital de Francia? «París», dijo la maestra.",
    }
    around = {1: ("前言：", "然后回家。"), 2: ("はじめに、", "以上です。"), 3: ("คำนำ", "จบ"), 4: ("Dice:", "Fin.")}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = [(k, around[k][0] + text + around[k][1]) for k, text in items.items()] + [(9, "昨天下雨了，他们在家看书。")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = D.contaminated(docs, D.prepare(docs, benchmark)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in found) == [(k, k, "copy") for k in items]
    assert D.words("«A—b» 和平…é2") == ["a".encode(), b"b", "和".encode(), "平".encode(), "é2".encode()]


def test_items_of_a_word_or_two_are_no_evidence(spark):
    benchmark = spark.createDataFrame([(1, "yes"), (2, "not now"), (3, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the committee said yes to the plan", "a"), (2, "Yes!", "b"), (3, "not now, they said", "c"), (4, "count one two three four", "d"), (5, "no", "e")], "doc_id long, text string, `a.b` string")
    searches = D.prepare(docs, benchmark)
    kinds = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in D.contaminated(docs, searches).collect())
    assert kinds == [(1, 1, "copy"), (2, 1, "copy"), (3, 2, "copy"), (4, 3, "copy")]
    assert sorted(r["doc_id"] for r in D.keep_uncontaminated(docs, searches, evidence=D.EVIDENCE).collect()) == [1, 3, 5]
    assert sorted(r["doc_id"] for r in D.keep_uncontaminated(docs, searches).collect()) == [5]


def test_blocks_share_one_space(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    benchmark = spark.createDataFrame([(k, f"question {k} about a matter of number {k} and nothing else. answer {k}.") for k in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(3, "x " * 20 + "question 3 about a matter of number 3 and nothing else. answer 3." + " y" * 20)], "doc_id long, text string")
    searches = D.prepare(docs, benchmark)
    assert len(searches) == 4 and len({id(s.space) for s in searches}) == 1
    assert [(r["item_id"], r["kind"]) for r in D.contaminated(docs, searches).collect() if r["share"] == 1.0] == [(3, "copy")]


def test_the_decomposition_is_that_of_all_documents(spark, monkeypatch):
    """Every passage of every document is a row of the matrix, and the product over them is the dense one."""
    rng = np.random.default_rng(7)
    vocabulary = [f"term{k}" for k in range(30)]
    items = spark.createDataFrame([(0, " ".join(vocabulary[:12])), (1, " ".join(vocabulary[12:]))], "item_id long, text string")
    texts = [" ".join(w for k in range(40) for w in (rng.choice(vocabulary), f"other{d}")) for d in range(2_300)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "no known word"])), "doc_id long, text string")
    seen = {}

    def watched(rows, weights, rank, found=D.latent_basis):
        block = np.eye(len(weights))
        seen.update(rows=rows.select("ids").collect(), weights=weights, products=[D._product(rows, weights, block, most) for most in (0, D.GRAM)], length=rows.agg({"length": "min"}).first()[0])
        return found(rows, weights, rank)

    monkeypatch.setattr(D, "latent_basis", watched)
    assert D.prepare(docs, items)
    matrix = []
    for passage in [p for t in texts for ws in [t.split()] for p in (ws[at : at + D.PASSAGE] for at in range(0, len(ws), D.PASSAGE))]:
        row = np.bincount([vocabulary.index(w) for w in passage if w in vocabulary], minlength=30) * seen["weights"]
        value = np.sqrt((seen["weights"] ** 2 * np.bincount([vocabulary.index(w) for w in passage if w in vocabulary], minlength=30)).sum())
        matrix.append(row / value * seen["length"])
    for k in (slice(0, 12), slice(12, 30)):
        row = np.zeros(30)
        row[k] = seen["weights"][k] / np.linalg.norm(seen["weights"][k])
        matrix.append(row)
    dense = np.array(matrix)
    assert sum(i >= 0 for r in seen["rows"] for i in r.ids) == 2_300 * 40 + 30
    for product in seen["products"]:
        assert product == pytest.approx(dense.T @ dense, rel=1e-4, abs=1e-4)


def test_words_of_texts_are_numbered_together():
    texts = [None, "", " ", "a", "Ünïcode 東京タワー x　y z", "a\x1cb\x85c", "ÿ \xff", "\n\nB", "tail ", "one, two"]
    number = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in D.words(t) if w not in (b"z", b"one")))}
    got = D.numbered(D.known_words(number), texts)
    assert [g.tolist() for g in got] == [[number.get(w, -1) for w in D.words(t)] for t in texts]
    assert D.numbered(D.known_words(number), []) == []


def test_sums_of_runs():
    rng = np.random.default_rng(3)
    values, rows = rng.integers(-9, 9, (50, 4)).astype(np.float32), rng.integers(0, 50, 400)
    counts = rng.integers(1, 9, 60)
    starts = rng.integers(0, 390, 60)
    counts = np.minimum(counts, 400 - starts)
    assert (D._summed(values, rows, starts, counts) == np.stack([values[rows[s : s + n]].sum(0) for s, n in zip(starts, counts)])).all()
    assert D._summed(values, rows, starts[:0], counts[:0]).shape == (0, 4)


def test_windows_without_an_items_words_are_not_compared(monkeypatch):
    """A window that lacks too many of an item's words cannot hold it in order; what is confirmed is what subsequences say."""
    rng, compared = random.Random(11), []
    monkeypatch.setattr(D, "lcs", lambda masks, size, sequence, f=D.lcs: compared.append(size) or f(masks, size, sequence))
    vocabulary = D.Vocabulary([(1, " ".join(f"w{k}" for k in rng.choices(range(40), k=30)) + ". " + " ".join(f"w{k}" for k in range(40, 44)))])
    (item,) = vocabulary.items
    search = D.Search(D.Space(vocabulary, np.ones(len(vocabulary)), np.eye(len(vocabulary), dtype=np.float32)), [item], [])
    kinds = []
    for share in (0.0, 0.2, 0.5, 0.6, 0.7, 0.85, 1.0) * 6:
        ids = np.where(np.array([rng.random() < share for _ in item.ids]), item.ids, -1)
        full = plain_lcs(item.ids.tolist(), ids.tolist()) / len(item.ids)
        answer = plain_lcs(item.ids[len(item.ids) - item.answer :].tolist(), ids.tolist()) / item.answer
        wanted = "copy" if full >= D.COPY else "paraphrase" if full >= D.PARAPHRASE and answer >= D.ANSWER else None
        compared.clear()
        got = search.confirm(item, ids, 0, len(ids))
        assert got[2] == wanted and got[0] >= full - 1e-12
        assert wanted is None or got == (full, answer, wanted)
        kinds.append(wanted)
        assert share or not compared
    assert {"copy", None} <= set(kinds)
    compared.clear()
    assert search.confirm(item, np.full(40, -1), 0, 40) == (0.0, 0.0, None) and not compared
