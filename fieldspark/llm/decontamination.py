"""Benchmark decontamination by latent semantic retrieval.

The words of the benchmark items are the vocabulary. Passages are windows of words of several sizes, powers of two: an
item of m words is sought among windows of the least size that is not below m, which begin at every half window.

1. Occurrences of the vocabulary are counted over all passages of all documents. Words with more than ``MOST_FREQUENT``
   of them a passage weigh nothing, unless an item would lose most of its weight.
2. A truncated singular value decomposition of the TF-IDF matrix of passages is found by randomised subspace iteration:
   each round multiplies the matrix, whose rows stay distributed, with a thin block and adds up the products. Its rows are
   all items and, with as much weight together, all passages of all documents, whose known words are written once and
   read in each round. Its rank grows with the number of items.
3. Every window of every document is projected: sums of short blocks make those of all window sizes. Windows shorter
   than ``LEAST_PART`` of the shortest item of their size are passed over; the others are compared with all items of
   their size in matrix products. Those with a cosine of ``LEAST_COSINE`` that have ``LEAST_PART`` of the item's length in
   its direction are candidates.
4. A candidate is confirmed by the longest common subsequence of words of the item and the window with half an item on
   either side: if it has ``COPY`` of the item's words it is a copy; if it has ``PARAPHRASE`` of them and the item's answer,
   its last sentence, is there to the extent of ``ANSWER``, a paraphrase.

Items of fewer than ``SHORT_WORDS`` words have no paraphrase, and too few words for a direction of their own: they are
sought as exact sequences of words. Those of fewer than ``EVIDENCE`` words are in many texts that have nothing to do with
the benchmark; where a text is more than the item, a filter may take such copies for no reason to drop the document.

Vocabulary, frequencies and decomposition are those of all items. The comparison takes items in blocks of
``BLOCK_ITEMS``, one pass over the documents each, and finds the same for every size of a block; documents are not
shuffled at all. What is broadcast is bounded: ``MAX_WORDS`` different words of a benchmark, which is checked, times the
rank, once for all blocks, and for each block its items.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import checkpointed, kept_rows, text_blocks
from fieldspark.llm.vocabulary import BREAK

RANKS, EXTRA, ROUNDS = (64, 256), 8, 2
BLOCK_ITEMS, MAX_WORDS = 20_000, 1 << 18
MOST_FREQUENT, LEAST_WEIGHT, LEAST_PART, LEAST_COSINE = 0.05, 0.1, 0.4, 0.5
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
#: Words from which an item is sought by its direction, and of a passage when frequencies are counted.
SHORT_WORDS, PASSAGE = 5, 32
#: An item of fewer words says too little to be evidence, unless a text is nothing but the item.
EVIDENCE = 3
SLICE, LONG, PRODUCT = 2 << 20, 1 << 17, 1 << 22
#: Words whose rows of a product are added up in one task, and numbers that a task multiplies at once.
WORDS, NUMBERS = 4096, 1 << 19
#: Words up to which a task of a product holds a number for each pair of them.
GRAM = 4096
SEED = 20_240_901

#: Bytes between words: what ASCII has beside letters and digits. Bytes of other characters belong to words.
_GAPS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_sentences = re.compile(r"[.!?\n\u3002\uff01\uff1f\uff0e\u0964]+").split
#: Blocks of scripts that are written without spaces between words (first and last code points).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))


#: Bytes of texts that need no further look: ASCII, and Latin letters from U+00C0 to U+027F (among them, as letters, the
#: signs of multiplication and division).
_PLAIN = bytes([*range(0x80), *range(0x80, 0xC0), *range(0xC3, 0xCA)])


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For code points below 0x40000: 1 for punctuation and the like, 2 for characters of unspaced scripts, else 0."""
    kinds = np.array([c >= 0x80 and unicodedata.category(chr(c))[0] not in "LMNC" and c not in (0xD7, 0xF7) for c in range(0x40000)], np.uint8)
    for first, last in UNSPACED:
        own = kinds[first : last + 1]
        own[own == 0] = 2
    return kinds


def _parted(text: str) -> str:
    """text with a space for punctuation of any script, and spaces around each character of an unspaced one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = np.where(codes < 0x40000, _kinds()[np.minimum(codes, 0x3FFFF)], 0)
    width = np.where(kind == 2, 3, 1)
    made = np.full(int(width.sum()), 32, np.uint32)
    made[np.cumsum(width) - width + (kind == 2)] = np.where(kind == 1, 32, codes)
    return made.tobytes().decode("utf-32-le")


def _spaced(text: str | None) -> bytes:
    """The lower-cased text in UTF-8, with spaces for what is between words."""
    text = (text or "").lower()
    data = text.encode()
    if not text.isascii() and data.translate(None, _PLAIN):
        data = _parted(text).encode()
    return data.translate(_GAPS)


def words(text: str | None) -> list[bytes]:
    """The lower-cased runs of letters, marks and digits of any script; characters of ``UNSPACED`` scripts are words."""
    return _spaced(text).split()


def known_words(number: dict[bytes, int]) -> pa.Array:
    """The words in the order of their numbers, and after them the end of a text and what is before its first word."""
    return pa.array([*sorted(number, key=number.get), BREAK, b""], pa.large_binary())


def numbered(known: pa.Array, texts: Iterable[str | None]) -> list[np.ndarray]:
    """The numbers of each text's words, -1 for those without one. The texts are split together."""
    data = b"".join(_spaced(text) + b" " + BREAK + b" " for text in texts)
    text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
    parts = pc.list_flatten(pc.ascii_split_whitespace(text)).cast(pa.large_binary())
    ids = pc.index_in(parts, value_set=known).fill_null(-1).to_numpy()
    ids = ids[ids <= len(known) - 2]
    ends = np.flatnonzero(ids == len(known) - 2)
    return [ids[s:e] for s, e in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]


def answer_words(text: str) -> int:
    """How many words at the item's end are its answer: the last sentence."""
    return next((n for s in reversed(_sentences(text.lower())) if (n := len(words(s)))), 0)


def lcs(masks: dict[int, int], size: int, sequence: Iterable[int]) -> int:
    """Length of the longest common subsequence of a sequence and one of ``size`` elements, of which masks has the
    places by element: a row of the dynamic programme is one integer."""
    full = (1 << size) - 1
    row = full
    for mask in filter(None, map(masks.get, sequence)):
        both = row & mask
        row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def _masks(ids: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, x in enumerate(ids.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    return masks


@dataclass(frozen=True)
class Item:
    place: int  #: among the vocabulary's items; an item_id may come with several texts
    item_id: int
    ids: np.ndarray
    answer: int

    @property
    def scale(self) -> int:
        return max(8, 1 << (len(self.ids) - 1).bit_length())


class Vocabulary:
    """Numbers of the items' words, and the items as such numbers: those sought by their direction and the short ones."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        self.number: dict[bytes, int] = {}
        self.items: list[Item] = []
        self.short: list[Item] = []
        for item_id, text in items:
            found = words(text)
            if found:
                ids = np.array([self.number.setdefault(w, len(self.number)) for w in found], np.int32)
                if len(self.number) > MAX_WORDS:
                    raise ValueError(f"the items have more than {MAX_WORDS} different words; split the benchmark")
                whole = len(found) >= SHORT_WORDS
                self.items.append(Item(len(self.items), item_id, ids, answer_words(text))) if whole else self.short.append(Item(-1 - len(self.short), item_id, ids, 0))

    def __len__(self) -> int:
        return len(self.number)


def passages_of(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """The known words of a text's passages, with -1 after each passage that has any, and how many passages there are."""
    there = np.flatnonzero(ids >= 0)
    nth = there // PASSAGE
    before = np.concatenate([[0], np.cumsum(np.diff(nth) > 0)]) if len(nth) else nth
    made = np.full(len(there) + (int(before[-1]) + 1 if len(nth) else 0), -1, np.int32)
    made[np.arange(len(there)) + before] = ids[there]
    return made, -(-len(ids) // PASSAGE)


def encoded(docs: DataFrame, shared) -> DataFrame:
    """ids, passages: passages_of every row of docs (one column, text), by the words' numbers, kept in the checkpoint folder."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_blocks(batches, SLICE):
            made = [passages_of(ids) for ids in numbered(shared.value, rows.column(0).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in made])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([ids for ids, _ in made])))
            yield pa.RecordBatch.from_arrays([lists, pa.array([n for _, n in made], pa.int64())], ["ids", "passages"])

    return checkpointed(docs.mapInArrow(encode, "ids array<int>, passages long"))


def frequencies(corpus: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """How often each word of the vocabulary occurs in encoded texts, and how many passages there are. A word that comes
    twice in a passage counts twice."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros(n_words + 1, np.int64), 0
        for rows in batches:
            counts += np.bincount(rows.column(0).flatten().to_numpy() + 1, minlength=n_words + 1)
            passages += pc.sum(rows.column(1)).as_py() or 0
        there = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], there]).astype(np.int32)), pa.array(np.concatenate([[passages], counts[1:][there]]))], ["word", "n"])

    found = corpus.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = found["word"].to_numpy(), found["n"].to_numpy()
    counts = np.zeros(n_words, np.int64)
    counts[word[word >= 0]] = n[word >= 0]
    return counts, int(n[word < 0].sum())


def weights_of(vocabulary: Vocabulary, counts: np.ndarray, passages: int) -> np.ndarray:
    """The inverse frequency of each word, 0 for frequent ones. An item that would keep few words or little weight, such
    as one that a large part of the documents holds, keeps all of its words' weights."""
    inverse = np.maximum(np.log((1 + passages) / (1 + counts)) + 1.0, LEAST_WEIGHT)
    frequent = counts > MOST_FREQUENT * passages
    spared = [i.ids for i in vocabulary.items if (~frequent[i.ids]).sum() < 4 or (inverse[i.ids] ** 2)[~frequent[i.ids]].sum() < 0.3 * (inverse[i.ids] ** 2).sum()]
    if spared:
        frequent[np.concatenate(spared)] = False
    return np.where(frequent, 0.0, inverse)


# -- the decomposition -----------------------------------------------------------------------------------------------


def _weighted(batch: pa.RecordBatch, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch's passages that have a weight, where each passage begins, and the square of what its words'
    weights are multiplied by."""
    lists = batch.column(0)
    ids = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    value = np.append(weight, 0.0)[ids]  # the last one is that of -1
    some = np.flatnonzero(value)
    passage = (row + np.cumsum(ids < 0))[some]
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    if not len(starts):
        return ids[some], starts, np.empty(0)
    return ids[some], starts, batch.column(1).to_numpy()[row[some[starts]]] ** 2 / np.add.reduceat(value[some] ** 2, starts)


def _met_together(together: np.ndarray, size: int, ids: np.ndarray, counts: np.ndarray, squares: np.ndarray) -> None:
    """Adds the passages' squares at every pair of places in them, one half of a symmetric matrix of size x size words."""
    ids, owner = ids.astype(np.int64), np.repeat(np.arange(len(counts)), counts)
    at, value = np.arange(len(ids)), squares[owner]
    np.add.at(together, ids * (size + 1), value / 2)
    for step in range(1, int(counts.max())):
        at = at[: np.searchsorted(at, len(ids) - step)]
        at = at[owner[at] == owner[at + step]]
        np.add.at(together, ids[at] * size + ids[at + step], value[at])


def _product(rows: DataFrame, weights, block: np.ndarray, most_words: int = GRAM) -> np.ndarray:
    """A' (A block) for the matrix A of the passages in rows: arrays of word numbers, -1 between passages, and the length
    that each passage's weighted words have. A task multiplies passage by passage or, with ``most_words`` words or fewer, its
    sums for each pair of words."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, (weights[:, None] * block).astype(np.float32)))

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, thin = shared.value
        total, together = np.zeros(thin.shape, np.float64), None
        most = max(1, NUMBERS // thin.shape[1])
        for batch in batches:
            ids, starts, squares = _weighted(batch, weight)
            ends = np.append(starts[1:], len(ids))
            if len(weight) <= most_words and (ends - starts if len(starts) else starts).max(initial=0) <= PASSAGE:
                if len(starts):
                    together = np.zeros((len(weight), len(weight)), np.float32) if together is None else together
                    together.fill(0)
                    _met_together(together.reshape(-1), len(weight), ids, ends - starts, squares.astype(np.float32))
                    total += together @ thin
                    total += together.T @ thin
                continue
            scale = squares[:, None].astype(np.float32)
            begin = 0
            while begin < len(starts):
                end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + most, "right")))
                own, first = ids[starts[begin] : ends[end - 1]], starts[begin:end] - starts[begin]
                dense = np.add.reduceat(thin[own], first, axis=0) * scale[begin:end]
                order = np.argsort(own, kind="stable")
                owner = np.repeat(np.arange(end - begin), np.diff(first, append=len(own)))
                edges = np.flatnonzero(np.diff(own[order], prepend=-1))
                total[own[order[edges]]] += np.add.reduceat(dense[owner[order]], edges, axis=0)
                begin = end
        total *= weight[:, None]
        for k, at in enumerate(range(0, len(total), WORDS)):
            if (part := total[at : at + WORDS]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], ["words", "part"])

    def added(parts: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(p, np.float64) for p in sorted(parts.column("part").to_pylist()))  # the same in any order
        return pa.table({"words": parts.column("words")[:1], "part": pa.array([summed.tobytes()], pa.binary())})

    total = np.zeros(block.shape)
    for row in rows.mapInArrow(multiply, "words long, part binary").groupBy("words").applyInArrow(added, "words long, part binary").toLocalIterator():
        part = np.frombuffer(row["part"], np.float64).reshape(-1, block.shape[1])
        total[row["words"] * WORDS : row["words"] * WORDS + len(part)] = part
    return total


def rank_of(n_items: int) -> int:
    """Dimensions of the latent space: 4.5 times the root of the number of items, within RANKS."""
    return int(np.clip(4.5 * n_items**0.5, *RANKS))


def latent_basis(rows: DataFrame, weights: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors (words x rank) of the matrix of rows, by randomised subspace iteration."""
    width = min(rank + EXTRA, len(weights))
    block = np.random.default_rng(SEED).standard_normal((len(weights), width))
    for _ in range(ROUNDS):
        block, _ = np.linalg.qr(_product(rows, weights, block))
    values, vectors = np.linalg.eigh(block.T @ _product(rows, weights, block))
    return (block @ vectors[:, np.argsort(-values)])[:, :rank].astype(np.float32)


# -- the search ------------------------------------------------------------------------------------------------------


def _sequence_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words: equal runs have equal ones."""
    wide = ids.astype(np.int64)
    keys = np.zeros(max(len(ids) - size + 1, 0), np.int64)
    for k in range(size):
        keys = keys * np.int64(0x5851F42D4C957F2D) + wide[k : k + len(keys)]
    return keys


def _summed(values: np.ndarray, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of values[rows] over runs, none of them empty: where each starts in rows and how many it has. All runs' first
    rows are taken together, then all second ones: for many short runs far less work than reduceat."""
    made = values[rows[starts]]
    for k in range(1, int(counts.max(initial=1))):
        more = np.flatnonzero(counts > k)
        made[more] += values[rows[starts[more] + k]]
    return made


class Space:
    """What all blocks share: the words' numbers, weights and projections, and the least window size."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, basis: np.ndarray):
        self.known = known_words(vocabulary.number)
        self.weighty = np.append(weights > 0, False)  # the last one is that of the number -1
        self.projection = (weights[:, None] * basis).astype(np.float32)
        self.least = min((i.scale for i in vocabulary.items), default=8)


class Search:
    """What a task needs: the space, and a block of items by window size."""

    def __init__(self, space: Space, items: list[Item], short: list[Item]):
        self.known, self.weighty, self.projection, self.least = space.known, space.weighty, space.projection, space.least
        self.scales: dict[int, tuple[list[Item], np.ndarray, np.ndarray]] = {}
        for scale in sorted({i.scale for i in items}):
            own = [i for i in items if i.scale == scale]
            latent = np.stack([self.projection[i.ids].sum(0) for i in own])
            length = np.maximum(np.linalg.norm(latent, axis=1), 1e-6)
            self.scales[scale] = own, (latent / length[:, None]).T.copy(), LEAST_PART * length
        self.short: dict[int, tuple[np.ndarray, dict[int, list[Item]]]] = {}
        for size in {len(i.ids) for i in short}:
            by_key: dict[int, list[Item]] = {}
            for i in short:
                if len(i.ids) == size:
                    by_key.setdefault(int(_sequence_keys(i.ids, size)[0]), []).append(i)
            self.short[size] = np.array(sorted(by_key), np.int64), by_key
        self._masks: dict[int, tuple[dict[int, int], dict[int, int]]] = {}

    def candidates(self, segments: list[np.ndarray]) -> Iterator[tuple[int, Item, int, int, float]]:
        """segment, item, first word and end of the window, cosine, for every similar window of some texts."""
        lengths = np.array([len(s) for s in segments])
        size = self.least // 2
        blocks = -(-lengths // size)
        first_block = np.cumsum(blocks) - blocks
        ids = np.concatenate(segments)
        at, ends = np.flatnonzero(self.weighty[ids]), np.cumsum(lengths)
        owner = np.repeat(np.arange(len(segments)), np.diff(np.searchsorted(at, ends), prepend=0))
        block, ids = first_block[owner] + (at - (ends - lengths)[owner]) // size, ids[at]
        sums = np.zeros((int(blocks.sum()), self.projection.shape[1]), np.float32)
        if len(ids):
            edges = np.flatnonzero(np.diff(block, prepend=-1))
            sums[block[edges]] = _summed(self.projection, ids, edges, np.diff(edges, append=len(ids)))
        every = np.arange(len(sums))
        for scale, (items, latents, parts) in self.scales.items():
            step = scale // 2 // size
            halves = -(-blocks // step)
            owner = np.repeat(np.arange(len(segments)), halves)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(halves) - halves, halves)
            half = _summed(sums, every, first_block[owner] + nth * step, np.minimum(blocks[owner] - nth * step, step))
            latent = half.copy()
            latent[:-1] += half[1:]
            last = np.flatnonzero(nth + 1 == halves[owner])
            latent[last] = half[last]
            only = (nth == 0) | (nth + 1 < halves[owner])  # the last half is in the window before it
            norm = np.linalg.norm(latent, axis=1)
            some = np.flatnonzero(only & (norm >= parts.min()))
            for at in range(0, len(some), max(1, PRODUCT // len(items))):
                chosen = some[at : at + max(1, PRODUCT // len(items))]
                product = latent[chosen] @ latents
                for w, i in zip(*np.nonzero((product >= parts) & (product >= LEAST_COSINE * norm[chosen, None]))):
                    k = chosen[w]
                    begin = int(nth[k]) * scale // 2
                    yield int(owner[k]), items[i], begin, min(begin + scale, int(lengths[owner[k]])), float(product[w, i] / norm[k])

    def exact(self, ids: np.ndarray) -> Iterator[tuple[Item, int]]:
        """The short items among the words of a text, and where each begins first."""
        for size, (known, by_key) in self.short.items():
            keys = _sequence_keys(ids, size)
            seen: set[int] = set()
            for at in np.flatnonzero(np.isin(keys, known)).tolist():
                for item in by_key[int(keys[at])]:
                    if item.place not in seen and (ids[at : at + size] == item.ids).all():
                        seen.add(item.place)
                        yield item, at

    def confirm(self, item: Item, ids: np.ndarray, begin: int, end: int) -> tuple[float, float, str | None]:
        """The shares of the item and of its answer in common subsequences, and what the window is, if anything. Where it is
        nothing for want of the item's words, the shares are a bound and 0."""
        size = len(item.ids)
        if item.place not in self._masks:
            self._masks[item.place] = _masks(item.ids), _masks(item.ids[size - item.answer :])
        masks, answer_masks = self._masks[item.place]
        around = ids[max(0, begin - size // 2) : end + size // 2].tolist()
        share = sum(masks[x].bit_count() for x in masks.keys() & set(around)) / size  # the most it can be
        share = lcs(masks, size, around) / size if share >= PARAPHRASE else share
        if share < PARAPHRASE:
            return share, 0.0, None
        answer = lcs(answer_masks, item.answer, around) / item.answer if item.answer else 0.0
        return share, answer, "copy" if share >= COPY else "paraphrase" if share >= PARAPHRASE and answer >= ANSWER else None

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, str, int, int, float, float, float]]]:
        """item_id, kind, first word, words, cosine, share, answer of the best window for each item found, by text: the one with
        the largest share, then answer, then cosine, and the first of equal ones."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        overlap = 2 * max(self.scales, default=0)
        rows, bases, segments, size = [], [], [], 0

        def search() -> None:
            for k, item, begin, end, cosine in self.candidates(segments):
                share, answer, kind = self.confirm(item, segments[k], begin, end)
                found = (share, answer, cosine, -(bases[k] + begin), end - begin, kind)
                if kind and found[:4] > best[rows[k]].get(item.item_id, (-1.0,))[:4]:
                    best[rows[k]][item.item_id] = found

        for row, ids in enumerate(numbered(self.known, texts) if self.scales or self.short else []):
            for item, at in self.exact(ids):
                found = (1.0, 1.0, 1.0, -at, len(item.ids), "copy")
                best[row][item.item_id] = max(found, best[row].get(item.item_id, (-1.0,)), key=lambda f: f[:4])
            for base in range(0, len(ids) if self.scales else 0, LONG):  # a very long text piece by piece
                rows.append(row)
                bases.append(base)
                segments.append(ids[base : base + LONG + overlap])
                size += len(segments[-1])
                if size >= 2 * LONG:
                    search()
                    rows, bases, segments, size = [], [], [], 0
        if segments:
            search()
        return [[(i, kind, -begin, n, cosine, share, answer) for i, (share, answer, cosine, begin, n, kind) in sorted(found.items())] for found in best]

    def clean(self, texts: list[str | None], evidence: int) -> list[bool]:
        """Whether a text holds no item, or only ones of fewer than ``evidence`` words beside other words."""
        return [all(hit[3] < evidence for hit in hits) and not any(hit[3] == len(words(text)) for hit in hits) for text, hits in zip(texts, self.hits(texts))]


class Shared:
    """A block's search from two broadcasts, the space of all blocks and the block's items; a worker makes it once."""

    def __init__(self, space: Broadcast, block: Broadcast):
        self.space, self.block = space, block

    @property
    def value(self) -> Search:
        key = id(self.space.value), id(self.block.value)
        if _searches.get("key") != key:
            _searches.update(key=key, held=(self.space.value, self.block.value), search=Search(self.space.value, *self.block.value))
        return _searches["search"]


_searches: dict = {}


def prepare(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> list:
    """A Shared search for each block of items. Items with a null id, a null text or none of a word are not sought;
    items that repeat an id with another text are sought by all their texts' words under one id, and repeated rows are one
    item. Extra columns of either table are not read."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    vocabulary = Vocabulary(map(tuple, items.distinct().orderBy("item_id", "text").toLocalIterator()))
    if not len(vocabulary):
        return []
    corpus = encoded(texts, spark.sparkContext.broadcast(known_words(vocabulary.number)))
    counts, passages = frequencies(corpus, len(vocabulary))
    weights = weights_of(vocabulary, counts, passages)

    def searches(basis: np.ndarray) -> list[Shared]:
        space = spark.sparkContext.broadcast(Space(vocabulary, weights, basis))
        return [Shared(space, spark.sparkContext.broadcast(block)) for block in _blocks(vocabulary)]

    if not vocabulary.items:
        return searches(np.zeros((len(weights), 1), np.float32))
    share = (len(vocabulary.items) / max(1, passages)) ** 0.5
    own = spark.createDataFrame([(i.ids.tolist(), 1.0) for i in vocabulary.items], "ids array<int>, length double")
    few = 4 * spark.sparkContext.defaultParallelism  # each task passes on a block of its own
    matrix = corpus.coalesce(few).select("ids", F.lit(share).alias("length")).union(own.coalesce(1))
    return searches(latent_basis(matrix, weights, rank_of(len(vocabulary.items))))


def _blocks(vocabulary: Vocabulary) -> Iterator[tuple[list[Item], list[Item]]]:
    """Items and short items in blocks of about BLOCK_ITEMS; all texts of an id are in one."""
    ids = sorted({i.item_id for i in vocabulary.items + vocabulary.short})
    for at in range(0, len(ids), BLOCK_ITEMS):
        mine = set(ids[at : at + BLOCK_ITEMS])
        yield [i for i in vocabulary.items if i.item_id in mine], [i for i in vocabulary.short if i.item_id in mine]


COLUMNS = "doc_id long, item_id long, kind string, first_word long, n_words int, cosine double, share double, answer double"


def contaminated(docs: DataFrame, searches: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COLUMNS: a row for each row of docs and item found in its whole text, however long, with the best window: the
    largest share, then answer, then cosine, then the first. Rows may repeat and ids be null; null and empty texts have no
    hits, an empty table or benchmark gives no rows; other columns are not read."""

    def run(shared):
        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in text_blocks(batches, SLICE):
                found = [(i, *hit) for i, hits in zip(rows.column(0).to_pylist(), shared.value.hits(rows.column(1).to_pylist())) for hit in hits]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                    names = [c.split()[0] for c in COLUMNS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

        return search

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not searches:
        return docs.sparkSession.createDataFrame([], COLUMNS)
    return reduce(DataFrame.union, [chosen.mapInArrow(run(s), COLUMNS) for s in searches])


def keep_uncontaminated(docs: DataFrame, searches: list, text_col: str = "text", evidence: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is found, or only items of fewer than ``evidence`` words. Null and empty texts stay; rows that repeat stay
    or go alike; columns may have any names, those of COLUMNS too."""
    for shared in searches:
        docs = kept_rows(docs, text_col, lambda rows, s=shared: s.value.clean(rows.column(rows.schema.get_field_index(text_col)).to_pylist(), evidence))
    return docs
