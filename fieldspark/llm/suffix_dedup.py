"""Removal of long byte strings that an earlier document holds, by bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id. Such
strings are found without one index over all texts:

* Equal texts are one text with the smallest id among them. Different texts are dealt into blocks by a hash of their
  digest; they are shuffled once, compressed, and every step below reads that same shuffle.
* A window of ``length`` bytes belongs to the smallest hash of the 24-byte grams in it, its anchor. Equal windows have
  equal anchors, and neighbouring windows mostly share theirs: a run of such windows is one piece of text.
* Blocks send their anchors (five bytes each, repeats once) to buckets, which answer which of them occur in more than
  one text. Only pieces of those go on: each different piece of a block once, with its smallest id, to its anchor's
  bucket. Windows of an anchor with very many pieces are sent one by one under their own hash, so no anchor's
  surroundings meet in one task.
* A bucket sorts the positions of its pieces to a depth of ``length`` bytes, which gives their Burrows-Wheeler transform,
  and finds common prefixes by increasing value: rows next to each other have a common prefix of v + 1 bytes where the
  two rows before them in the transform, of one symbol, have a prefix of v bytes as the least between them. All boundaries
  of value v are known before those of v + 1 (breadth first), and expansion stops at ``length``: what no boundary divides by
  then are the intervals of equal windows. The smallest id of each goes back to the blocks, as ranges of pieces.

A bucket's work is done in chunks of about ``CHUNK_BYTES``, whatever the number of pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import checkpointed, quoted, text_blocks

LENGTH = 50
GRAM = 24
#: Bytes of different texts in a block; a task holds one block.
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 2 << 20
#: Occurrences of an anchor (127 a block at most counted) above which its windows are dealt one by one.
HOT = 4096
STEP = 1 << 18
NO_ID = np.iinfo(np.int64).max
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_ROWS = "kind int, block long, bucket long, data binary"


# -- anchors -----------------------------------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` >= 8 bytes that start at each place of data where so many are left."""
    count = len(data) - size + 1
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    hashes = np.zeros(count, np.uint64)
    for k, at in enumerate([*range(0, size - 8, 8), size - 8]):
        hashes += words[at : at + count]
        hashes *= _ODD[k % len(_ODD)]
        hashes ^= hashes >> np.uint64(29)
    return hashes


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end and anchor of every run of windows of one anchor; texts lie between the bounds."""
    valid = np.zeros(len(data) + 1, bool)
    for begin, end in zip(bounds[:-1], bounds[1:]):
        valid[begin : max(begin, end - length + 1)] = True
    places, anchors = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    before, was = np.uint64(0), False
    for at in range(0, max(0, len(data) - length + 1), STEP):
        part = data[at : at + STEP + length - 1]
        own = _least(_gram_hashes(part, GRAM), length - GRAM + 1)
        fits = valid[at : at + len(own)]
        change = np.empty(len(own), bool)
        change[1:] = (fits[1:] != fits[:-1]) | (fits[1:] & (own[1:] != own[:-1]))
        change[0] = bool(fits[0]) != was or (was and own[0] != before)
        before, was = own[-1], bool(fits[-1])
        found = np.flatnonzero(change)
        places.append(found + at)
        anchors.append(own[found])
    place, anchor = np.concatenate(places), np.concatenate(anchors)
    stop = np.append(place[1:], max(0, len(data) - length + 1))
    real = valid[place]
    return place[real], stop[real], anchor[real]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD[3]
    return (values ^ (values >> np.uint64(29))) * _ODD[1]


def _dealt(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 32 further bits, of each value."""
    mixed = _mixed(values)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), mixed.astype(np.uint32)


# -- blocks ------------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """The different texts of a block in the order of their digests, laid end to end."""

    number: int
    digests: list[bytes]
    firsts: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def read(cls, rows: pa.Table) -> Block:
        unpack, texts, firsts = zstandard.ZstdDecompressor().decompress, {}, {}
        for digest, packed, first, no_id in zip(*(rows.column(c).to_pylist() for c in ("digest", "packed", "first", "no_id"))):
            if packed is None:
                firsts[digest] = NO_ID if no_id else first
            elif digest not in texts:
                texts[digest] = packed
        digests = sorted(texts)
        whole = [unpack(texts.pop(d)) for d in digests]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in whole], dtype=np.int64)])
        data = np.frombuffer(b"".join(whole), np.uint8)
        number = rows.column("block")[0].as_py() if rows.num_rows else -1
        return cls(number, digests, np.array([firsts[d] for d in digests], np.int64), data, bounds)


@dataclass
class Anchored:
    """The runs of a block and their anchors by bucket, ascending within it: the order in which they are sent."""

    start: np.ndarray
    stop: np.ndarray
    owner: np.ndarray
    nth: np.ndarray  # of each run's anchor among those sent
    anchors: np.ndarray
    rest: np.ndarray
    edges: np.ndarray  # of the buckets

    @classmethod
    def of(cls, block: Block, length: int, buckets: int) -> Anchored:
        start, stop, anchor = runs(block.data, block.bounds, length)
        anchors, nth = np.unique(anchor, return_inverse=True)
        bucket, rest = _dealt(anchors, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.searchsorted(block.bounds, start, "right") - 1
        return cls(start, stop, owner, place[nth], anchors[order], rest[order], np.searchsorted(bucket[order], np.arange(buckets + 1)))


def _sent(block: int, kind: int, blobs: Iterable[tuple[int, bytes]]) -> pa.Table:
    blobs = list(blobs)
    n = len(blobs)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "block": pa.array([block] * n, pa.int64()), "bucket": pa.array([b for b, _ in blobs], pa.int64()), "data": pa.array([d for _, d in blobs], pa.binary())})


def _send_anchors(length: int, buckets: int):
    """The anchors of a block: 32 bits of each, and how often it occurs, with the high bit set if in several texts."""

    def run(rows: pa.Table) -> pa.Table:
        block = Block.read(rows)
        sent = Anchored.of(block, length, buckets)
        n = len(sent.anchors)
        often = np.minimum(np.bincount(sent.nth, minlength=n), 127).astype(np.uint8)
        low, high = np.full(n, len(block.digests)), np.full(n, -1)
        np.minimum.at(low, sent.nth, sent.owner)
        np.maximum.at(high, sent.nth, sent.owner)
        often |= (low != high).astype(np.uint8) << 7
        return _sent(block.number, 0, ((b, sent.rest[s:e].tobytes() + often[s:e].tobytes()) for b, (s, e) in enumerate(zip(sent.edges[:-1], sent.edges[1:])) if e > s))

    return run


def _judge_anchors(hot: int):
    """Answers to each block of a bucket, in the order sent: 1 for an anchor of several texts, 2 for one of very many
    occurrences, else 0. Anchors that differ but agree in 32 bits only make pieces that nothing else shares."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = rows.column("data").to_pylist()
        sizes = [len(b) // 5 for b in blobs]
        rest = np.concatenate([np.frombuffer(b, np.uint32, n) for b, n in zip(blobs, sizes)])
        often = np.concatenate([np.frombuffer(b, np.uint8, n, 4 * n) for b, n in zip(blobs, sizes)])
        _, nth, counts = np.unique(rest, return_inverse=True, return_counts=True)
        several = (counts > 1) | (np.bincount(nth, often >> 7, len(counts)) > 0)
        codes = (several + (several & (np.bincount(nth, often & 127, len(counts)) > hot))).astype(np.uint8)[nth]
        answers = np.split(codes, np.cumsum(sizes)[:-1])
        return pa.table({"kind": pa.array([0] * len(blobs), pa.int32()), "block": rows.column("block"), "bucket": rows.column("bucket"), "data": pa.array([a.tobytes() for a in answers], pa.binary())})

    return run


# -- pieces ------------------------------------------------------------------------------------------------------------


@dataclass
class Pieces:
    """The different pieces of a block that may be shared, by bucket, and where they occur."""

    texts: list[bytes]
    least: np.ndarray  # smallest id
    keys: np.ndarray
    edges: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    piece: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, block: Block, answers: pa.Table, length: int, buckets: int) -> Pieces:
        sent = Anchored.of(block, length, buckets)
        code = np.zeros(len(sent.anchors), np.uint8)
        for kind, bucket, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
            if kind == 0:
                code[sent.edges[bucket] : sent.edges[bucket + 1]] = np.frombuffer(data, np.uint8)
        mine = code[sent.nth]
        once, many = np.flatnonzero(mine == 1), np.flatnonzero(mine == 2)
        counts = sent.stop[many] - sent.start[many]
        single = np.repeat(sent.start[many], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.concatenate([sent.start[once], single])
        windows = np.concatenate([sent.stop[once] - sent.start[once], np.ones(len(single), np.int64)])
        owner = np.concatenate([sent.owner[once], np.repeat(sent.owner[many], counts)])
        key = sent.anchors[sent.nth[once]]
        if len(single):
            own = [_gram_hashes(block.data[s : s + length], length)[0] for s in single]
            key = np.concatenate([key, np.array(own, np.uint64)])
        whole, known, piece, firsts = block.data.tobytes(), {}, np.empty(len(start), np.int64), []
        for k, (s, n) in enumerate(zip(start.tolist(), windows.tolist())):
            text = whole[s : s + n + length - 1]
            nth = known.setdefault(text, len(known))
            if nth == len(firsts):
                firsts.append(k)
            piece[k] = nth
        least = np.full(len(known), NO_ID)
        np.minimum.at(least, piece, block.firsts[owner])
        keys = key[firsts] if firsts else np.empty(0, np.uint64)
        bucket, _ = _dealt(keys, buckets)
        order = np.lexsort([keys, bucket])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        texts = list(known)
        return cls([texts[i] for i in order], least[order], keys[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), start, windows, place[piece], owner)


def _send_pieces(length: int, buckets: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.read(rows)
        pieces, pack = Pieces.of(block, answers, length, buckets), zstandard.ZstdCompressor(1).compress

        def blobs() -> Iterator[tuple[int, bytes]]:
            for b, (s, e) in enumerate(zip(pieces.edges[:-1], pieces.edges[1:])):
                if e > s:
                    sizes = np.array([len(t) for t in pieces.texts[s:e]], np.uint32)
                    head = np.uint32(e - s).tobytes() + pieces.keys[s:e].tobytes() + pieces.least[s:e].tobytes() + sizes.tobytes()
                    yield b, pack(head + b"".join(pieces.texts[s:e]))

        return _sent(block.number, 1, blobs())

    return run


def shared_windows(texts: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes of the texts, in order, the smallest id of a text that holds it."""
    sizes = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0  # ends of texts, below all bytes
    n = len(symbols)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    window = np.arange(n) + length <= ends[owner]
    wrapped = lambda x, k: np.concatenate([x[k % n :], x[: k % n]])
    keys, depth = np.zeros(n, np.uint64), 7
    for k in range(depth):
        keys = keys << np.uint64(9) | wrapped(symbols, k)
    while True:  # rows in order, to a depth of at least ``length`` symbols
        rows = np.argsort(keys)
        ordered = keys[rows]
        rank = np.empty(n, np.uint64)
        rank[rows] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        if depth >= length:
            break
        keys = rank << np.uint64(32) | wrapped(rank, depth)
        depth *= 2
    rows = rows.astype(np.int32)
    transform = symbols[rows - 1]
    back = np.argsort(transform, kind="stable").astype(np.int32)  # row t continues row back[t] by one symbol in front
    front = transform[back]
    divided = np.ones(n, bool)  # does a boundary of known value lie before the row?
    divided[1:] = front[1:] != front[:-1]
    open_ = np.flatnonzero(~divided).astype(np.int32)
    above, below = back[open_ - 1], back[open_]
    for _ in range(length - 1):
        passed = np.cumsum(divided, dtype=np.int32)
        found = passed[above] != passed[below]
        if not found.any():
            break
        divided[open_[found]] = True
        open_, above, below = open_[~found], above[~found], below[~found]
    held = np.where(window[rows], ids[owner[rows]], NO_ID)
    least = np.minimum.reduceat(held, np.flatnonzero(divided))[np.cumsum(divided) - 1]
    smallest = np.empty(n, np.int64)
    smallest[rows] = least
    return smallest[window]


def _solve(length: int, chunk: int):
    """Answers to each block of a bucket: ranges of windows of its pieces that a text with a smaller id than all of the
    block's with that piece holds."""

    def run(rows: pa.Table) -> pa.Table:
        unpack, known = zstandard.ZstdDecompressor().decompress, {}
        source, piece, least, nth, keys = [], [], [], [], []
        for number, blob in enumerate(rows.column("data").to_pylist()):
            blob = unpack(blob)
            n = int(np.frombuffer(blob, np.uint32, 1)[0])
            key, own = np.frombuffer(blob, np.uint64, n, 4), np.frombuffer(blob, np.int64, n, 4 + 8 * n)
            at = 4 + 20 * n
            source.append(np.full(n, number))
            piece.append(np.arange(n))
            least.append(own)
            these = np.empty(n, np.int64)
            for k, (size, one) in enumerate(zip(np.frombuffer(blob, np.uint32, n, 4 + 16 * n).tolist(), key.tolist())):
                these[k] = known.setdefault(blob[at : at + size], len(known))
                if these[k] == len(keys):
                    keys.append(one)
                at += size
            nth.append(these)
        source, piece, least, nth = map(np.concatenate, (source, piece, least, nth))
        texts, keys = list(known), np.array(keys, np.uint64)
        known.clear()
        ids = np.full(len(texts), NO_ID)
        np.minimum.at(ids, nth, least)
        order = np.argsort(keys, kind="stable")
        ends = np.cumsum([len(texts[i]) for i in order])
        last = np.append(keys[order][1:] != keys[order][:-1], True)  # anchors are not divided
        uses = np.argsort(nth, kind="stable")
        first_use = np.searchsorted(nth[uses], np.arange(len(texts) + 1))
        found, begin, done = [], 0, 0
        for end in (np.flatnonzero(last) + 1).tolist():
            if ends[end - 1] - done < chunk and end < len(order):
                continue
            some = order[begin:end]
            begin, done = end, ends[end - 1]
            smallest = shared_windows([texts[i] for i in some], ids[some], length)
            windows = np.array([len(texts[i]) - length + 1 for i in some])
            offsets = np.cumsum(windows) - windows
            uses_of = first_use[some + 1] - first_use[some]
            use = uses[np.repeat(first_use[some] - (np.cumsum(uses_of) - uses_of), uses_of) + np.arange(uses_of.sum())]
            span = np.repeat(windows, uses_of)
            inside = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
            earlier = smallest[np.repeat(np.repeat(offsets, uses_of), span) + inside] < np.repeat(least[use], span)
            opens = earlier & np.concatenate([[True], ~earlier[:-1]]) | earlier & (inside == 0)
            place = np.flatnonzero(opens)
            closed = np.concatenate([~earlier[1:] | (inside[1:] == 0), [True]]) & earlier
            which = np.repeat(use, span)[place]
            found.append(np.stack([which, inside[place], np.flatnonzero(closed) - place + 1], axis=1))
        ranges = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        ranges = ranges[np.argsort(source[ranges[:, 0]], kind="stable")]
        edges = np.searchsorted(source[ranges[:, 0]], np.arange(rows.num_rows + 1))
        data = [np.stack([piece[r[:, 0]], r[:, 1], r[:, 2]], axis=1).astype(np.uint32).tobytes() for r in (ranges[s:e] for s, e in zip(edges[:-1], edges[1:]))]
        return pa.table({"kind": pa.array([1] * len(data), pa.int32()), "block": rows.column("block"), "bucket": rows.column("bucket"), "data": pa.array(data, pa.binary())})

    return run


_FOUND = "digest binary, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def _finish(length: int, buckets: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.read(rows)
        pieces = Pieces.of(block, answers, length, buckets)
        ranges = [np.empty((0, 3), np.int64)]
        for kind, bucket, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
            if kind == 1:
                some = np.frombuffer(data, np.uint32).reshape(-1, 3).astype(np.int64)
                some[:, 0] += pieces.edges[bucket]
                ranges.append(some)
        ranges = np.concatenate(ranges)
        ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
        begins = np.searchsorted(ranges[:, 0], np.arange(len(pieces.texts) + 1))
        later = block.firsts[pieces.owner] > pieces.least[pieces.piece]
        some = np.flatnonzero(~later)
        n = begins[pieces.piece[some] + 1] - begins[pieces.piece[some]]
        which = np.repeat(begins[pieces.piece[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = np.concatenate([pieces.start[later], np.repeat(pieces.start[some], n) + ranges[which, 1]])
        stop = start + np.concatenate([pieces.windows[later], ranges[which, 2]]) + length - 1
        steps = np.bincount(start, minlength=len(block.data) + 1) - np.bincount(stop, minlength=len(block.data) + 1)
        gone = np.cumsum(steps)[:-1] > 0
        made = []
        whole = block.data.tobytes()
        for k in np.unique(np.searchsorted(block.bounds, start, "right") - 1):
            s, e = int(block.bounds[k]), int(block.bounds[k + 1])
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[s:e], [False]]).astype(np.int8))).reshape(-1, 2)
            keep = np.concatenate([[0], edges.ravel(), [e - s]]).reshape(-1, 2).tolist()
            kept = b"".join(whole[s + a : s + b] for a, b in keep)
            made.append({"digest": block.digests[k], "n_removed": int((edges[:, 1] - edges[:, 0]).sum()), "spans": [{"start": a, "stop": b} for a, b in edges.tolist()], "kept": kept})
        schema = pa.schema([("digest", pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
        return pa.Table.from_pylist(made, schema)

    return run


# -- the operator ------------------------------------------------------------------------------------------------------


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the text's UTF-8 bytes, null as empty) and n_bytes of each row, kept in the checkpoint folder."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return checkpointed(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))


def first_ids(rows: DataFrame) -> DataFrame:
    """digest, first, no_id, n_bytes: the smallest id of each different text of ``text_rows``; no_id if it has null ids only."""
    return rows.groupBy("digest").agg(F.min("id").alias("first"), F.min("id").isNull().alias("no_id"), F.first("n_bytes").alias("n_bytes"))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text that the task meets first, compressed."""
    pack, seen = zstandard.ZstdCompressor(1).compress, set()
    for rows in text_blocks((b for b in batches), 8 << 20, "text"):
        digests, blocks, keep = rows.column(0).to_pylist(), rows.column(1), []
        for k, digest in enumerate(digests):
            if digest not in seen:
                seen.add(digest)
                keep.append(k)
        n = len(keep)
        chosen = pa.array(keep, pa.int64())
        texts = [pack(t.as_buffer()) for t in rows.column(2).take(chosen)]
        yield pa.RecordBatch.from_arrays([rows.column(0).take(chosen), blocks.take(chosen), pa.array(texts, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], ["digest", "block", "packed", "first", "no_id"])


def repeats(docs: DataFrame, rows: DataFrame, text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot: int = HOT, chunk: int = CHUNK_BYTES) -> DataFrame:
    """digest, n_removed, spans (maximal removed byte ranges, array<struct<start,stop>>) and kept (the bytes left) of each
    different text of which some bytes go, when it stands under the smallest id that has it. ``rows`` are the docs'
    ``text_rows``. Texts without a removed byte are left out, those shorter than ``length`` among them."""
    if length <= GRAM:
        raise ValueError(f"strings of more than {GRAM} bytes only, not {length}")
    firsts = first_ids(rows).where(F.col("n_bytes") >= length)
    session = docs.sparkSession
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    count = max(3 * session.sparkContext.defaultParallelism, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("digest"), F.lit(count))
    text = F.col(text_col).cast("string").cast("binary")
    long_ = docs.select(text.alias("text")).where(F.octet_length("text") >= length).withColumn("digest", F.unhex(F.sha2("text", 256)))
    schema = "digest binary, block long, packed binary, first long, no_id boolean"
    texts = long_.select("digest", block.alias("block"), "text").mapInArrow(_packed, schema)
    named = firsts.select("digest", block.alias("block"), F.lit(None).cast("binary").alias("packed"), "first", "no_id")
    blocks = texts.union(named).repartition(count, "block")  # read four times, shuffled once
    judged = blocks.groupBy("block").applyInArrow(_send_anchors(length, count), _ROWS).groupBy("bucket").applyInArrow(_judge_anchors(hot), _ROWS)
    sent = blocks.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(_send_pieces(length, count), _ROWS)
    solved = sent.groupBy("bucket").applyInArrow(_solve(length, chunk), _ROWS)
    answers = judged.union(solved)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(length, count), _FOUND).where("n_removed > 0")


def for_documents(rows: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, digest, n_bytes, n_removed, spans of every row of ``text_rows``, and all further columns of ``found``, which is
    what ``repeats`` gives or a selection of it; copied is true for rows that repeat a text of a smaller id, of which
    nothing is kept if they have ``length`` bytes."""
    named = first_ids(rows).drop("n_bytes").join(found, "digest", "left")
    copied = ((F.col("id") > F.col("first")) | (F.col("id").isNull() & ~F.col("no_id"))) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    met = rows.join(named, "digest").withColumn("copied", copied)
    met = met.withColumn("n_removed", F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))))
    return met.withColumn("spans", F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", none))).drop("first", "no_id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs, all columns, with what is left of each text in place of it, as binary, for a cut may fall within a character.

    Strings are judged on the input, not on what is left; texts are UTF-8 bytes and null ones empty. Strings of rows with
    one id do not count against each other, and a null id is larger than all others and as large as other nulls. Rows that
    repeat an id and a text are cut alike; texts shorter than ``length`` bytes stay; very long ones count whole. An empty
    table stays empty; other columns may have any names.
    """
    rows = text_rows(docs, id_col, text_col)
    found = for_documents(rows, repeats(docs, rows, text_col, length), length).select("id", "digest", "copied", "kept").distinct()
    text = F.coalesce(docs[quoted(text_col)].cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns if c != text_col]).alias("row"), text.alias("text"), docs[quoted(id_col)].cast("long").alias("key"))
    met = keyed.withColumn("sha", F.unhex(F.sha2("text", 256))).join(found, (F.col("sha") == F.col("digest")) & F.col("key").eqNullSafe(F.col("id")))
    kept = F.when(F.col("copied"), F.lit(b"")).otherwise(F.coalesce("kept", "text"))
    return met.select("row.*", kept.alias(text_col)).select(*map(quoted, docs.columns))
