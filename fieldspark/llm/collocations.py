"""Collocations of two and three words by language, counted in tiles of pairs of frequency-ranked numbers.

* Words are counted once; only words that occur often enough can be in a candidate. The most frequent of them,
  ``HEAD`` at most over all languages, get their rank within the language as number, and this bounded list is broadcast.
* Neighbouring words with numbers are pairs of a matrix that is cut into tiles of ``TILE`` x ``TILE``. Tiles near the
  frequent corner, which the rule of ``dense`` names from their place alone, are counted in dense arrays (numpy.bincount)
  at the offset that the pair's numbers give; all others as sorted coordinates with counts. Tasks add up their own text
  before they send anything, and a dense tile is dealt to several tasks where very many send it.
* Pairs that are frequent are ranked again, and a pair with the word after it is counted in tiles in the same way. So a
  phrase of three words is looked at only where both its pairs are frequent.
* Words and pairs beyond the numbered ones are few and rare. They pass if a bit set of fixed size may hold them, and are
  counted by their strings. Counts are exact for every word and pair, numbered or not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import checkpointed
from fieldspark.llm.vocabulary import BREAK, byte_table, hash_filter, hashed_pairs, hashes, in_filter, slices, summed, tokenised

LEAST = 10
#: What parts pieces (. , ; : ! ? and line ends), and what parts words.
TABLE = byte_table(b"\t", b".,;:!?\n\x0b\x0c\r")
HEAD = 1 << 18
MOST_BYTES = 64  # of a numbered word
TILE_BITS = 9
TILE = 1 << TILE_BITS
#: A tile is dense if the product of its numbers, from 1, is at most this: counts fall about as ranks grow.
DENSE = 32
FLUSH = 4 << 20
BLOB = 1 << 17  # entries
SALTED = 512  # tasks that send to one task of a dense tile
_ID = 20  # bits of a number in a key
_TILES = "part int, lang int, down int, across int, data binary"


# -- words -------------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[bytes | None, int]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            words = sorted(w for w in counts if w is not None)
            names = pa.array([None, *words], pa.binary()).cast(pa.string())
            n = pa.array([counts[None], *(counts[w] for w in words)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), names, n], ["lang", "word", "n"])

    for (lang,), texts in slices(batches, 1):
        words, codes = tokenised(texts, TABLE)
        counts = held.setdefault(lang, {None: 0})
        size -= len(counts)
        for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
            if word != BREAK and n:
                counts[word] = counts.get(word, 0) + n
                counts[None] += n
        size += len(counts)
        if size > 1 << 20:
            yield from sent()
            held.clear()
            size = 0
    yield from sent()


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """lang, word, n of the words that occur ``least`` times or more, and for each language a row with a null word: all its
    words."""
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return checkpointed(counted.where((F.col("n") >= least) | F.col("word").isNull()))


@dataclass
class Numbered:
    """Words, or pairs of words, by language in the order of their frequency, and the bit set that holds the hashes of all
    further frequent ones; ``more`` tells whether there are any."""

    langs: list[str]
    words: list[list[bytes]]
    pairs: list[tuple[np.ndarray, np.ndarray]]  # keys in order, and the rank of each
    other: np.ndarray
    more: bool

    @classmethod
    def head(cls, counted: DataFrame, names: list[str], bounded: Column, hashed: Column, head: int) -> tuple[pa.Table, np.ndarray, bool]:
        """The most frequent rows, ``head`` at most, and the bit set of the others."""
        order = [F.desc("n"), F.col("lang"), *map(F.col, names)]
        top = counted.where(bounded).orderBy(*order).limit(head).toArrow()
        others = counted.where(~bounded)
        if top.num_rows == head:
            least = {c: top.column(c)[head - 1].as_py() for c in ("n", "lang", *names)}
            after, same = F.lit(False), F.lit(True)
            for c in ("n", "lang", *names):
                mine, last = F.col(c), F.lit(least[c])
                after = after | same & ((mine < last) if c == "n" else (mine > last))
                same = same & (mine == last)
            others = counted.where(~bounded | after)
        bits = hash_filter(others, hashed)
        return top, bits, bool(bits.any())

    @classmethod
    def of_words(cls, counted: DataFrame, head: int) -> Numbered:
        top, other, more = cls.head(counted, ["word"], F.octet_length("word") <= MOST_BYTES, F.xxhash64("lang", "word"), head)
        langs, ranked = [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()], {}
        for lang, word in zip(top.column("lang").to_pylist(), top.column("word").to_pylist()):
            ranked.setdefault(lang, []).append(word.encode())
        return cls(langs, [ranked.get(lang, []) for lang in langs], [], other, more)

    def with_pairs(self, counted: DataFrame, head: int) -> Numbered:
        """These words and the pairs of them that ``counted`` (lang, w1, w2, n) holds most often."""
        top, other, more = self.head(counted, ["w1", "w2"], (F.octet_length("w1") <= MOST_BYTES) & (F.octet_length("w2") <= MOST_BYTES), F.xxhash64(F.xxhash64("lang", "w1"), F.xxhash64("lang", "w2")), head)
        ranks = {lang: {w: k for k, w in enumerate(words)} for lang, words in zip(self.langs, self.words)}
        keys, left = {lang: [] for lang in self.langs}, []
        for lang, a, b in zip(*(top.column(c).to_pylist() for c in ("lang", "w1", "w2"))):
            i, j = (ranks[lang].get(w.encode(), -1) for w in (a, b))
            if i < 0 or j < 0:
                left.append((lang, a, b))
            else:
                keys[lang].append(i << _ID | j)
        if left:  # frequent pairs of words without a number: sought by their hashes
            rows = counted.sparkSession.createDataFrame(left, "lang string, w1 string, w2 string")
            other = other | hash_filter(rows, F.xxhash64(F.xxhash64("lang", "w1"), F.xxhash64("lang", "w2")))
        pairs = []
        for lang in self.langs:
            own = np.array(keys[lang], np.int64)
            order = np.argsort(own)
            pairs.append((own[order], order))
        return Numbered(self.langs, self.words, pairs, other, more or bool(left))


# -- tiles -------------------------------------------------------------------------------------------------------------


def dense(down: np.ndarray, across: np.ndarray) -> np.ndarray:
    return (down + 1) * (across + 1) <= DENSE


def tiled(keys: np.ndarray, counts: np.ndarray, parts: int, salt: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Rows of _TILES for keys (language, left and right number) in order, each once."""
    left, right = keys >> _ID & (1 << _ID) - 1, keys & (1 << _ID) - 1
    down, across = left >> TILE_BITS, right >> TILE_BITS
    tile = keys >> 2 * _ID << 24 | down << 12 | across
    mixed = (tile.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    near = dense(down, across)
    offset = (left & TILE - 1) << TILE_BITS | right & TILE - 1
    for which, group in ((np.flatnonzero(near), tile), (np.flatnonzero(~near), (mixed % np.uint64(parts)).astype(np.int64))):
        which = which[np.argsort(group[which], kind="stable")]
        edges = np.flatnonzero(np.diff(group[which])) + 1
        for s, e in zip([0, *edges], [*edges, len(which)]):
            for at in range(s, e, BLOB):
                some = which[at : min(e, at + BLOB)]
                one = some[0]
                n = counts[some].astype(np.uint32).tobytes()
                if near[one]:
                    yield int((int(mixed[one]) + salt) % parts), int(keys[one] >> 2 * _ID), int(down[one]), int(across[one]), offset[some].astype(np.uint32).tobytes() + n
                else:
                    yield int(group[one]), -1, -1, -1, keys[some].tobytes() + n


def _tile_rows(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["part", "lang", "down", "across", "data"])


def _sums(least: int, decode) -> object:
    """Adds up rows of _TILES in the order of their part and tile, and gives those that reach ``least`` as words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, held, size = None, None, [], 0

        def settle() -> None:
            nonlocal table, held, size
            if not held:
                return
            if now[1] >= 0:
                at, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
                table += np.bincount(at, n, TILE * TILE).astype(np.int64)
                held, size = [], 0
            else:
                held = [summed(held)]
                size = len(held[0][0])

        def closed() -> pa.RecordBatch:
            settle()
            if now[1] >= 0:
                at = np.flatnonzero(table >= least)
                keys = now[1] << 2 * _ID | (now[2] << TILE_BITS | at >> TILE_BITS) << _ID | now[3] << TILE_BITS | at & TILE - 1
                return decode(keys, table[at])
            keys, counts = held[0]
            return decode(keys[counts >= least], counts[counts >= least])

        for batch in batches:
            for part, lang, down, across, data in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (part, lang, down, across):
                    if now is not None:
                        yield closed()
                    now, table, held, size = (part, lang, down, across), np.zeros(TILE * TILE, np.int64) if lang >= 0 else None, [], 0
                width = 4 if lang >= 0 else 8
                n = len(data) // (width + 4)
                held.append((np.frombuffer(data, np.uint32 if lang >= 0 else np.int64, n), np.frombuffer(data, np.uint32, n, n * width).astype(np.int64)))
                size += n
                if size > (1 << 18 if lang >= 0 else 1 << 22):
                    settle()
        if now is not None:
            yield closed()

    return run


class _Marked:
    """A slice's words by code: number (-1 without one), whether they may be in a phrase, hash."""

    def __init__(self, numbered: Numbered, ranks: list[dict[bytes, int]], lang: str, texts: list[bytes]):
        self.words, self.codes = tokenised(texts, TABLE)
        self.lang = numbered.langs.index(lang)
        rank = ranks[self.lang]
        self.number = np.array([rank.get(w, -1) for w in self.words], np.int64)
        self.hashed = hashes(self.words, lang) if numbered.more else np.zeros(len(self.words), np.uint64)
        fits = self.number >= 0
        if numbered.more:
            rest = ~fits & np.array([w != BREAK for w in self.words], bool)
            fits |= rest & self.held(numbered)
        self.mine, self.fits = self.number[self.codes], fits[self.codes]

    def held(self, numbered: Numbered) -> np.ndarray:
        return in_filter(numbered.other, self.hashed)


def _phrases(numbered: Numbered, previous: Numbered | None, lang: str, texts: list[bytes], ranks: list[dict[bytes, int]]):
    """The marked slice; places of phrases; their left and right numbers, -1 where they have none."""
    words = previous or numbered
    slice_ = _Marked(words, ranks, lang, texts)
    both = slice_.fits[:-1] & slice_.fits[1:]
    if previous is None:
        at = np.flatnonzero(both)
        return slice_, at, slice_.mine[at], slice_.mine[at + 1]
    at = np.flatnonzero(both)
    a, b = slice_.mine[at], slice_.mine[at + 1]
    known, order = numbered.pairs[slice_.lang]
    rank = np.full(len(at), -1)
    plain = np.flatnonzero((a >= 0) & (b >= 0))
    if len(known):
        key = a[plain] << _ID | b[plain]
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        rank[plain] = np.where(known[place] == key, order[place], -1)
    frequent = rank >= 0
    if numbered.more:
        rest = np.flatnonzero(~frequent)
        hashed = slice_.hashed if words.more else hashes(slice_.words, lang)
        code = slice_.codes
        frequent[rest] = in_filter(numbered.other, hashed_pairs(hashed[code[at[rest]]], hashed[code[at[rest] + 1]]))
    whole = np.zeros(len(slice_.codes) + 1, bool)
    whole[at[frequent]] = True
    number = np.full(len(slice_.codes) + 1, -1)
    number[at] = rank
    found = np.flatnonzero(whole[:-1] & whole[1:])
    return slice_, found, number[found], slice_.mine[found + 2]


def _spread(shared: Broadcast, words_of: Broadcast | None, size: int, parts: int, salts: int, strings: bool):
    """Phrases of ``size`` words: rows of _TILES of those with both numbers, or, with ``strings``, lang, w1, w2, ... and n of
    the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, previous = shared.value, words_of.value if words_of else None
        ranks = [{w: k for k, w in enumerate(words)} for words in numbered.words]
        salt = TaskContext.get().partitionId() % salts
        held, total = [], 0
        for (lang,), texts in slices(batches, 1):
            if lang not in numbered.langs:
                continue  # none of its words is frequent
            slice_, at, left, right = _phrases(numbered, previous, lang, texts, ranks)
            plain = (left >= 0) & (right >= 0)
            if strings:
                rest = at[~plain]
                codes = np.stack([slice_.codes[rest + k] for k in range(size)], axis=1)
                different, counts = np.unique(codes, axis=0, return_counts=True)
                names = pa.array(slice_.words, pa.binary())
                columns = [names.take(pa.array(c.copy())).cast(pa.string()) for c in different.T]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), *columns, pa.array(counts, pa.int64())], ["lang", *(f"w{k + 1}" for k in range(size)), "n"])
                continue
            keys, counts = np.unique(slice_.lang << 2 * _ID | left[plain] << _ID | right[plain], return_counts=True)
            held.append((keys, counts))
            total += len(keys)
            if total > FLUSH:
                yield _tile_rows(tiled(*summed(held), parts, salt))
                held, total = [], 0
        if held:
            yield _tile_rows(tiled(*summed(held), parts, salt))

    return run


def _decoded(shared: Broadcast, size: int):
    def decode(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        numbered, rows = shared.value, []
        by_rank = {}
        for lang, left, right, n in zip((keys >> 2 * _ID).tolist(), (keys >> _ID & (1 << _ID) - 1).tolist(), (keys & (1 << _ID) - 1).tolist(), counts.tolist()):
            words = numbered.words[lang]
            if size == 2:
                rows.append((numbered.langs[lang], words[left], words[right], n))
            else:
                if lang not in by_rank:
                    known, order = numbered.pairs[lang]
                    by_rank[lang] = np.empty(len(known), np.int64)
                    by_rank[lang][order] = known
                pair = int(by_rank[lang][left])
                rows.append((numbered.langs[lang], words[pair >> _ID], words[pair & (1 << _ID) - 1], words[right], n))
        columns = list(zip(*rows)) or [()] * (size + 2)
        named = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns[1:-1]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *named, pa.array(columns[-1], pa.int64())], ["lang", *(f"w{k + 1}" for k in range(size)), "n"])

    return decode


def _counted(texts: DataFrame, numbered: Numbered, previous: Numbered | None, size: int, least: int) -> DataFrame:
    session = texts.sparkSession
    shared = session.sparkContext.broadcast(numbered)
    before = session.sparkContext.broadcast(previous) if previous else None
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    salts = 1 + texts.rdd.getNumPartitions() // SALTED
    names = [f"w{k + 1}" for k in range(size)]
    schema = f"lang string, {', '.join(f'{w} string' for w in names)}, n long"
    sent = texts.mapInArrow(_spread(shared, before, size, parts, salts, False), _TILES)
    tiles = sent.repartition(parts, "part").sortWithinPartitions("part", "lang", "down", "across")
    found = tiles.mapInArrow(_sums(least if salts == 1 else 1, _decoded(shared, size)), schema)
    if numbered.more or previous and previous.more:
        found = found.union(texts.mapInArrow(_spread(shared, before, size, parts, salts, True), schema))
    return checkpointed(found.groupBy("lang", *names).agg(F.sum("n").alias("n")).where(F.col("n") >= least))


# -- the operator ------------------------------------------------------------------------------------------------------


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, head: int = HEAD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by language of words (lang, word, n; a null word has all), pairs (lang, w1, w2, n) and triples (lang, w1, w2, w3,
    n) that occur ``least`` times or more within pieces. A null language is "und", a null text empty; texts are UTF-8
    and count whole; repeated rows count as often as they occur; an empty table gives no rows."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")
    counted = word_counts(texts, least)
    words = Numbered.of_words(counted.where("word is not null"), head)
    pairs = _counted(texts, words, None, 2, least)
    triples = _counted(texts, words.with_pairs(pairs, head), words, 3, least)
    return counted, pairs, triples


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 2000, least: int = LEAST, head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of two or three words of each language.

    a counts the phrase, n all words of the language; of the cuts into a first and a last part with counts l and r the one
    with the lowest floor(10^6 a^2 / (l r)) is the score, of equal ones the first. A pair is dropped if a triple with half
    its count or more holds it. Equal scores are ordered by a, then by the phrase's bytes. What ``phrases`` says of nulls,
    long texts, repeated rows and empty tables holds; columns of any other names are not read.
    """
    counted, pairs, triples = phrases(docs, text_col, lang_col, least, head)
    words, totals = counted.where("word is not null"), counted.where("word is null").select("lang", F.col("n").alias("total"))
    one = lambda name, count: words.select("lang", F.col("word").alias(name), F.col("n").alias(count))
    two = lambda a, b, count: pairs.select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("n").alias(count))
    within = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "n")
    longest = within.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("n").alias("longer"))
    score = "cast((cast(n as decimal(16,0)) * cast(n as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast({0} as decimal(18,0)) * cast({1} as decimal(18,0))) as long)"
    kept = pairs.join(longest, ["lang", "w1", "w2"], "left").where("longer is null or 100 * longer < 50 * n")
    kept = kept.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    best = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", F.expr(score.format("l", "r")).alias("score"))
    cut = triples.join(one("w1", "l1"), ["lang", "w1"]).join(two("w2", "w3", "r1"), ["lang", "w2", "w3"])
    cut = cut.join(two("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(one("w3", "r2"), ["lang", "w3"])
    cut = cut.withColumn("s1", F.expr(score.format("l1", "r1"))).withColumn("s2", F.expr(score.format("l2", "r2")))
    pick = lambda a, b: F.when(F.col("s1") <= F.col("s2"), F.col(a)).otherwise(F.col(b))
    best = best.union(cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3"), "n", pick("l1", "l2"), pick("r1", "r2"), pick("s1", "s2")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
