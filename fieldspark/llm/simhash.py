"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits: bit b is set if more than half of its word shingles have bit b set in their XXH64.
Two fingerprints link if at most ``LINK_BITS`` = 4 bits differ. Finding all links:

* The 64 bits are three blocks of 23, 23 and 18 bits. Four differences leave at most one in the first block, at most one
  in the second, or none in the third: otherwise there were 2 + 2 + 1 = 5.
* Each 23-bit block has the 4096 words of the perfect binary Golay code as its anchors (covering radius 3). A
  fingerprint goes to every anchor within 3 + 1 bits of its block, 1 or 6 of them (5.3 on average): whoever differs in
  one bit at most meets it at the anchor nearest to either. The 18-bit block is its own anchor (radius 0, threshold 0).
* The bits outside the block still differ in at most 4 places, so of five parts of them one is equal; it is added to the
  anchor. An anchor's fingerprints are so spread over 2^8 or 2^9 sub-buckets of each part, and the largest bucket of N
  evenly spread distinct fingerprints has about N * 5.3 / 2^20.
* Within a bucket fingerprints are compared by exclusive or and bit count. Only the links of a spanning forest of a large
  bucket are passed on, never all its pairs.

Equal fingerprints are one class before anything else happens, so copies cost one shuffled row each.

Fingerprints of texts whose sets of shingles have a Jaccard similarity of 0.8 differ in some ten bits: too many for these
anchors. Where a similarity is asked for, a second view therefore proposes pairs of different texts, which are then
checked on their whole sets of shingles:

* Minima of the shingles' hashes under ``BANDS * BAND_ROWS`` multipliers, ``BAND_ROWS`` to a bucket. Texts of similarity
  0.8 share one of the buckets with probability 1 - (1 - 0.8^6)^16 = 0.992.
* Four bits of each minimum are the text's sketch. Within a bucket, pairs whose sketches rule the similarity out are
  dropped. Rows with any other pair meet again, bucket by bucket, with their sets: pairs that nothing connects yet are
  checked there, and the links of a spanning forest are passed on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import checkpointed, quoted, text_blocks
from fieldspark.llm.vocabulary import hash_filter, in_filter
from fieldspark.operators.graphs import components

LINK_BITS = 4
SEED = 42
#: (first bit, bits, tolerated differences, parts of the remaining bits) of each block.
VIEWS = ((0, 23, 1, (8, 8, 8, 8, 9)), (23, 23, 1, (8, 8, 8, 8, 9)), (46, 18, 0, (9, 9, 9, 9, 10)))
#: Fixed value: the generator polynomial of the binary Golay code of length 23, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY_POLYNOMIAL = 0b101011100011
SMALL_RUN = 32
#: Links that one task reduces to a spanning forest.
LINKS = 1 << 20
BANDS, BAND_ROWS, SKETCH_WORDS = 16, 6, 6  # 96 minima; 16 of 4 bits to a word of the sketch
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(bytes([k]), SEED) | 1 for k in range(BANDS * BAND_ROWS)], np.uint64)
NIBBLES = np.uint64(0x1111111111111111)
#: Standard deviations of a sketch's differences beyond which a pair is not as similar as asked.
MAYBE = 3.0
#: Rows of a bucket, and shingles of their sets, that are checked in one place.
UNIT_ROWS, UNIT_HASHES = 4096, 4 << 20


# -- fingerprints ----------------------------------------------------------------------------------------------------


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit into a byte
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return total


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; none for a null text or one without words."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    size = min(words, len(parts))
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    xxh64 = xxhash.xxh64_intdigest
    return np.fromiter((xxh64(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    return int(np.packbits(_bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit SimHash of a text; 0 for a null text or one without words."""
    return _majority(shingle_hashes(text, words))


def minima(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS bucket keys and SKETCH_WORDS words of 16 four-bit marks, of the least products of a set of hashes."""
    low = np.full(len(MULTIPLIERS), ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[at : at + 2048, None] * MULTIPLIERS).min(0))
    buckets = MULTIPLIERS[:BANDS].copy()
    for column in low.reshape(BANDS, BAND_ROWS).T:
        buckets = (buckets ^ column ^ (buckets >> np.uint64(29))) * MULTIPLIERS[BANDS]
    marks = (low * MULTIPLIERS[-1] >> np.uint64(60)).reshape(SKETCH_WORDS, 16)
    return buckets, np.bitwise_or.reduce(marks << np.arange(0, 64, 4, dtype=np.uint64), axis=1)


SKETCHED = ", ".join(["size long", *(f"s{k} long" for k in range(SKETCH_WORDS))])
MEMBER = f"bucket long, part long, digest long, fp long, {SKETCHED}"


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, sketched: bool = False) -> DataFrame:
    """id, digest (Spark's xxhash64 of the text, null for null), fp (the fingerprint's bits as a long) of each row; if
    sketched, also size (number of different shingles), s0 to s5 (the sketch) and buckets."""
    names = ["id", "digest", "fp", *((c.split()[0] for c in SKETCHED.split(", ")) if sketched else ()), *(["buckets"] if sketched else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_blocks(batches, 8 << 20):
            texts = rows.column(1).to_pylist()
            digests = np.array([xxhash.xxh64_intdigest(t or "", SEED) for t in texts], np.uint64).view(np.int64)
            digests = pa.array(digests, mask=np.array([t is None for t in texts], bool))
            prints, sizes = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
            buckets, sketches = np.zeros((len(texts), BANDS), np.uint64), np.zeros((len(texts), SKETCH_WORDS), np.uint64)
            for k, t in enumerate(texts):
                hashes = shingle_hashes(t, words)
                prints[k] = _majority(hashes)
                if sketched and len(hashes):
                    different = np.unique(hashes)
                    sizes[k] = len(different)
                    buckets[k], sketches[k] = minima(different)
            columns = [rows.column(0), digests, pa.array(prints.view(np.int64))]
            if sketched:
                offsets = np.arange(0, buckets.size + 1, BANDS, dtype=np.int32)
                keys = pa.ListArray.from_arrays(offsets, pa.array(buckets.ravel().view(np.int64)))
                columns += [pa.array(sizes), *(pa.array(c.copy().view(np.int64)) for c in sketches.T), keys]
            yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id long, digest long, fp long" + (f", {SKETCHED}, buckets array<long>" if sketched else ""))


# -- anchors ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def golay_anchors(extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words x of 23 bits: three byte-wise tables whose exclusive or is the syndrome of x, and by syndrome the
    exclusive ors that lead from x to every code word within 3 + extra bits, and how many there are."""
    remainders = []
    for bit in range(23):
        word = 1 << bit
        for top in range(22, 10, -1):
            if word >> top & 1:
                word ^= GOLAY_POLYNOMIAL << (top - 11)
        remainders.append(word)
    tables = np.zeros((3, 256), np.int64)
    for k in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * k + bit < 23:
                    tables[k, value] ^= remainders[8 * k + bit]
    remainder = lambda x: tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255]
    high = np.arange(4096, dtype=np.int64) << 11
    code = high ^ remainder(high)
    bits = [0, *(1 << i for i in range(23))]
    errors = np.unique([a ^ b ^ c for a in bits for b in bits for c in bits]).astype(np.int64)
    errors = errors[np.bitwise_count(errors) <= 3]
    steps = [[] for _ in range(2048)]
    for error in errors:
        ways = error ^ code
        steps[int(remainder(error))] = ways[np.bitwise_count(ways) <= 3 + extra]
    counts = np.array([len(s) for s in steps])
    table = np.zeros((2048, counts.max()), np.int64)
    for k, found in enumerate(steps):
        table[k, : len(found)] = found
    return tables, table, counts


def _bits(x: np.ndarray, first: int, count: int) -> np.ndarray:
    return (x >> np.uint64(first)) & np.uint64((1 << count) - 1)


def replicas(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and the index of the fingerprint that goes to each."""
    keys, owners = [], []
    everyone = np.arange(len(prints))
    for view, (first, size, tolerated, parts) in enumerate(VIEWS):
        block = _bits(prints, first, size).astype(np.int64)
        if size == 23:
            tables, table, counts = golay_anchors(tolerated)
            syndrome = tables[0][block & 255] ^ tables[1][block >> 8 & 255] ^ tables[2][block >> 16]
            owner = np.repeat(everyone, counts[syndrome])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts[syndrome]) - counts[syndrome], counts[syndrome])
            anchor = (block[owner] ^ table[syndrome[owner], nth]) >> 11
        else:
            owner, anchor = everyone, block
        rest = _bits(prints, 0, first) | (prints >> np.uint64(first + size) << np.uint64(first) if first + size < 64 else np.uint64(0))
        at = 0
        for part, width in enumerate(parts):
            value = _bits(rest, at, width).astype(np.int64)
            at += width
            keys.append(((view * 8 + part) << 48) | (anchor << 16) | value[owner])
            owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            prints = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, owners = replicas(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[owners])], ["bucket", "fp"])


# -- comparison within buckets ---------------------------------------------------------------------------------------


def _forest(prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the linked groups of one large bucket: each print reached is compared with those left."""
    left = np.unique(prints)
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = np.bitwise_count(left ^ one) <= most
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found)
                yield np.full(len(found), one), found


def bucket_links(keys: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of fingerprints among rows sorted by key: all pairs of runs of SMALL_RUN rows or fewer, the links of
    a spanning forest of longer ones."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    large = ends - starts > SMALL_RUN
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for s, e in zip(starts[large], ends[large]):
        for x, y in _forest(prints[s:e], most):
            a.append(x)
            b.append(y)
    small = np.repeat(~large, ends - starts)
    at = np.flatnonzero(small)
    for step in range(1, SMALL_RUN):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        linked = at[(np.bitwise_count(prints[at] ^ prints[at + step]) <= most) & (prints[at] != prints[at + step])]
        a.append(prints[linked])
        b.append(prints[linked + step])
    return np.concatenate(a), np.concatenate(b)


def _compare(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            pairs = np.stack(bucket_links(keys, prints, most), axis=1).view(np.int64)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
            prints = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            held_keys, held = keys[cut:], prints[cut:]
            if cut:
                yield emit(keys[:cut], prints[:cut])
        if len(held_keys):
            yield emit(held_keys, held)

    return run


def links(prints: DataFrame, most: int = LINK_BITS) -> DataFrame:
    """a, b: pairs of distinct fingerprints of ``prints`` (one long column, distinct) with at most ``most`` <= 4
    differing bits. Whoever is linked in any way is connected by the pairs given."""
    if not 0 <= most <= LINK_BITS:
        raise ValueError(f"anchors are chosen for at most {LINK_BITS} differing bits, not {most}")
    spread = prints.mapInArrow(_replicate, "bucket long, fp long")
    n = max(prints.sparkSession.sparkContext.defaultParallelism, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = spread.repartition(n, "bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(_compare(most), "a long, b long").distinct()


# -- similar texts beyond the fingerprints' reach ----------------------------------------------------------------------


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many marks sketches (last axis: their words) differ."""
    x = a ^ b
    x = x | x >> np.uint64(1)
    return np.bitwise_count((x | x >> np.uint64(2)) & NIBBLES).sum(-1, dtype=np.int64)


def _judged(prints: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, similarity: float, most: int):
    """A function of places: which pairs differ in ``most`` bits at most, and which others may be as similar as asked."""
    differing = (1 - similarity) * 15 / 16
    count = len(MULTIPLIERS)
    bound = count * differing + MAYBE * (count * differing * (1 - differing)) ** 0.5

    def judge(a, b) -> tuple[np.ndarray, np.ndarray]:
        linked = np.bitwise_count(prints[a] ^ prints[b]) <= most
        ratio = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
        return linked, ~linked & ratio & (_differences(sketches[a], sketches[b]) <= bound)

    return judge


def bucket_members(keys: np.ndarray, rows: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Whether each of some rows (digest, fingerprint, size, sketch, band, and 32 bits of the keys of all bands), sorted by
    key, may be as similar as asked to another row of its bucket with which it shares no earlier band, and is not linked to
    it anyway."""
    judge = _judged(rows[:, 1], rows[:, 2].astype(np.float64), rows[:, 3 : 3 + SKETCH_WORDS], similarity, most)
    band = rows[:, 3 + SKETCH_WORDS].astype(np.int64)
    bands = np.ascontiguousarray(rows[:, 4 + SKETCH_WORDS :]).view(np.uint32)
    member = np.zeros(len(keys), bool)
    at, step = np.arange(len(keys)), 0
    while True:
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return member
        a = at[judge(at, at + step)[1]]
        b = a + step
        mine = ~((bands[a] == bands[b]) & (np.arange(BANDS) < band[a, None])).any(1)  # the first band that both share
        member[a[mine]] = member[b[mine]] = True


def _members(similarity: float, most: int, unit_rows: int, unit_hashes: int):
    """bucket, part, digest, fp, size and sketch of the members of buckets, from rows sorted by bucket. A bucket of more than
    unit_rows rows is not held: all of its rows are members, in parts of about unit_hashes shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, filled = None, 0.0  # the bucket whose rows have begun to go on unjudged, and what they fill, in parts

        def emit(keys: np.ndarray, rows: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(keys), pa.array(parts), *(pa.array(c.copy().view(np.int64)) for c in rows[:, : 3 + SKETCH_WORDS].T)]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in MEMBER.split(", ")])

        def parts_of(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
            nonlocal last, filled
            share = np.maximum(rows[:, 2].astype(np.float64) / unit_hashes, 1 / unit_rows)
            total = np.cumsum(share) - share
            first = np.flatnonzero(np.diff(keys, prepend=keys[0] if keys[0] == last else ~keys[0]))
            base = np.repeat(np.concatenate([[-filled], total[first]]), np.diff(np.concatenate([[0], first, [len(keys)]])))
            last, filled = keys[-1], total[-1] + share[-1] - base[-1]
            return (total - base).astype(np.int64)

        held_keys, held = np.empty(0, np.int64), np.empty((0, 0), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.stack([batch.column(k).to_numpy() for k in range(1, batch.num_columns)], axis=1).view(np.uint64)
            keys, rows = np.concatenate([held_keys, batch.column(0).to_numpy()]), np.concatenate([held, more]) if len(held) else more
            going = int(np.searchsorted(keys, last, "right")) if last is not None and keys[0] == last else 0
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if going:
                yield emit(keys[:going], rows[:going], parts_of(keys[:going], rows[:going]))
            if cut > going:
                yield from judged(keys[going:cut], rows[going:cut], emit, parts_of)
            held_keys, held = keys[max(cut, going) :], rows[max(cut, going) :]
            if len(held) > unit_rows:
                yield emit(held_keys, held, parts_of(held_keys, held))
                held_keys, held = held_keys[:0], held[:0]
        if len(held):
            yield from judged(held_keys, held, emit, parts_of)

    def judged(keys: np.ndarray, rows: np.ndarray, emit, parts_of) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(keys)) + 1
        sizes = np.diff(np.concatenate([[0], edge, [len(keys)]]))
        member = np.repeat(sizes > unit_rows, sizes)
        some = np.flatnonzero(~member)
        member[some] = bucket_members(keys[some], rows[some], similarity, most)
        if member.any():
            yield emit(keys[member], rows[member], parts_of(keys[member], rows[member]))

    return run


def unit_links(prints: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, similarity: float, most: int) -> Iterator[tuple[int, int]]:
    """Pairs of places that span what similar rows connect, beyond what is linked anyway: rows of equal groups or
    fingerprints within ``most`` bits. Every pair of rows that nothing connects yet and whose sketches do not rule it out is
    checked on the whole sets of hashes, so only the pairs of a forest are passed on and no link is lost."""
    judge = _judged(prints, np.array([len(s) for s in sets], np.float64), sketches, similarity, most)
    groups = groups.copy()
    for one in range(len(sets) - 1):
        left = one + 1 + np.flatnonzero(groups[one + 1 :] != groups[one])
        if not len(left):
            continue
        linked, maybe = judge(one, left)
        near, maybe = left[linked], left[maybe]
        if len(maybe):
            sizes = np.array([len(sets[k]) for k in maybe])
            hashes = np.concatenate([sets[k] for k in maybe])
            place = np.minimum(np.searchsorted(sets[one], hashes), len(sets[one]) - 1)
            shared = np.add.reduceat((sets[one][place] == hashes).astype(np.int64), np.cumsum(sizes) - sizes)
            alike = maybe[shared / (len(sets[one]) + sizes - shared) >= similarity]
            alike = alike[np.unique(groups[alike], return_index=True)[1]]
            alike = alike[~np.isin(groups[alike], groups[near])]
            for k in alike.tolist():
                yield one, k
            near = np.concatenate([near, alike])
        if len(near):
            groups[np.isin(groups, groups[near])] = groups[one]


def _confirmed(similarity: float, most: int):
    """fp_a, fp_b: the links of each unit (bucket, part), from rows sorted by them: fp, root, sketch, hashes."""

    def links_of(rows: pa.Table) -> Iterator[tuple[int, int]]:
        prints = rows["fp"].to_numpy().view(np.uint64)
        if len(prints) < 2:
            return
        sketches = np.stack([rows[f"s{k}"].to_numpy() for k in range(SKETCH_WORDS)], axis=1).view(np.uint64)
        sets = [x.values.to_numpy().view(np.uint64) for x in rows["hashes"]]
        for a, b in unit_links(prints, sketches, sets, rows["root"].to_numpy(), similarity, most):
            yield int(prints[a].view(np.int64)), int(prints[b].view(np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            bucket, part = rows["bucket"].to_numpy(), rows["part"].to_numpy()
            edge = (np.flatnonzero((np.diff(bucket) != 0) | (np.diff(part) != 0)) + 1).tolist()
            found: list[tuple[int, int]] = []
            for s, e in zip([0, *edge], [*edge, len(bucket)]):
                if held and (held[-1]["bucket"][-1].as_py(), held[-1]["part"][-1].as_py()) != (bucket[s], part[s]):
                    found.extend(links_of(pa.concat_tables(held).combine_chunks()))
                    held = []
                held.append(rows.slice(s, e - s))
            yield _linked(found)
        if held:
            yield _linked(list(links_of(pa.concat_tables(held).combine_chunks())))

    return run


def _linked(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _maybe_paired(bits):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array(in_filter(bits.value, rows.column(0).to_numpy().view(np.uint64))))

    return run


def _shingle_sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_blocks(batches, 4 << 20):
            sets = [np.unique(shingle_hashes(t, words)) for t in rows.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["digest", "hashes"])

    return run


def _confirm(units: DataFrame, sets: DataFrame, similarity: float, most: int, partitions: int) -> DataFrame:
    """a, b: the links of units, rows of which are bucket, part, digest, fp, root and the sketch."""
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]
    whole = units.join(sets.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of")).select("bucket", "part", "fp", "root", *sketch, "hashes")
    sorted_ = whole.repartition(partitions, "bucket", "part").sortWithinPartitions("bucket", "part")
    return sorted_.mapInArrow(_confirmed(similarity, most), "a long, b long").distinct()


def similar_links(docs: DataFrame, rows: DataFrame, text_col: str, words: int, similarity: float, most: int, linked: DataFrame, unit_rows: int = UNIT_ROWS, unit_hashes: int = UNIT_HASHES) -> DataFrame:
    """a, b: links between fingerprints of different texts whose sets of shingles have a Jaccard similarity of
    ``similarity`` or more. With ``linked``, those of ``links``, they connect whatever pairs of a bucket connect that sketches
    do not rule out; they are as many as rows of buckets at most, never all pairs.

    Pairs are checked where the rows of a bucket meet, with their sets of hashes, so those of a large group need not be
    written. A bucket of more than ``unit_rows`` rows or ``unit_hashes`` hashes is dealt in parts. Its rows outside the group that is then
    the largest of the bucket meet every part in a second turn, so that each pair has been checked or is connected."""
    sketch = [c.split()[0] for c in SKETCHED.split(", ")]
    values = [F.first(c).alias(c) for c in ("fp", *sketch, "buckets")]  # the same in all rows of a digest
    texts = rows.where("size > 0").groupBy("digest").agg(*values)
    low = F.lit(0xFFFFFFFF)
    bands = [F.shiftleft(F.get("buckets", k + 1), 32).bitwiseOR(F.get("buckets", k).bitwiseAND(low)).alias(f"b{k}") for k in range(0, BANDS, 2)]
    spread = texts.select(F.posexplode("buckets").alias("band", "bucket"), "digest", "fp", *sketch, *bands)
    spread = spread.select("bucket", "digest", "fp", *sketch, F.col("band").cast("long").alias("band"), *[f"b{k}" for k in range(0, BANDS, 2)])
    session = docs.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = spread.repartition(n, "bucket").sortWithinPartitions("bucket", F.xxhash64("digest", "bucket"))  # parts of different buckets mix a group differently
    members = checkpointed(sorted_.mapInArrow(_members(similarity, most, unit_rows, unit_hashes), MEMBER).drop("size"))
    named = members.select("digest").distinct()
    bits = session.sparkContext.broadcast(hash_filter(named, F.col("digest")))
    text = F.col(text_col).cast("string")
    met = docs.select(F.xxhash64(text).alias("digest"), text.alias("text")).where("text is not null")
    met = met.mapInArrow(_maybe_paired(bits), "digest long, text string")
    met = met.join(named, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    sets = checkpointed(met.mapInArrow(_shingle_sets(words), "digest long, hashes array<long>"))
    found = checkpointed(_confirm(members.withColumn("root", F.col("fp")), sets, similarity, most, n))
    parts = members.groupBy("bucket").agg((F.max("part") + 1).alias("parts")).where("parts > 1")
    dealt = checkpointed(members.join(parts, "bucket"))
    if dealt.isEmpty():
        return found
    roots = rooted(found.union(linked))
    known = dealt.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    known = checkpointed(known)
    largest = known.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("m")).select("bucket", F.col("m.root").alias("main"))
    meeting = known.join(largest, "bucket")
    own, everywhere = meeting.where("root = main"), meeting.where("root <> main")
    units = own.union(everywhere.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(own.columns))
    return found.union(_confirm(units.join(everywhere.select("bucket").distinct(), "bucket"), sets, similarity, most, n))


def _starred(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root: the smallest node that the task's links lead to, of each node but those roots."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for rows in batches:
        for a, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    nodes = np.fromiter(root, np.int64, len(root))
    for at in range(0, len(nodes), 8192):
        some = nodes[at : at + 8192]
        roots = np.array([top(x) for x in some.tolist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[some != roots]) for x in (some, roots)], ["node", "root"])


def rooted(found: DataFrame, most: int = LINKS) -> DataFrame:
    """What ``components`` gives for links a, b. Parts of about ``most`` links each become stars of a root and its nodes first:
    where many texts of a group are alike, their links grow with its square, and stars do not. The stars of several
    parts still have to be connected; those of one part are the components, without rounds of joins."""
    found = checkpointed(found)
    parts = -(-found.count() // most) or 1
    stars = checkpointed(found.repartition(parts).mapInArrow(_starred, "node long, root long"))
    return stars if parts == 1 else components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))


# -- the operator ----------------------------------------------------------------------------------------------------


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = LINK_BITS, similarity: float | None = None) -> DataFrame:
    """id, digest, fp, first: every row's fingerprint and the first row (struct of no_id, id, digest) of its group.

    A group is what links of at most ``most`` differing bits connect, and, where a similarity is given, links between
    texts of at least that Jaccard similarity of their sets of shingles; its first row has the smallest id, null after
    all others, then the smallest digest. A null text counts as an empty one: both have fingerprint 0 and link with
    whatever is near 0. Rows without an id keep a null id. An empty table gives no rows; other columns are not read.
    """
    rows = checkpointed(with_fingerprints(docs, id_col, text_col, words, sketched=similarity is not None))
    own = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest"))
    prints = checkpointed(rows.groupBy("fp").agg(own.alias("own")))
    found = links(prints.select("fp"), most)
    if similarity is not None:
        found = checkpointed(found)
        found = found.union(similar_links(docs, rows, text_col, words, similarity, most, found))
    roots = rooted(found)
    grouped = prints.join(roots, prints.fp == roots.node, "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    firsts = grouped.groupBy("root").agg(F.min("own").alias("first"))
    named = grouped.join(firsts, "root").select(F.col("fp").alias("print"), "first")
    return rows.join(named, rows.fp == named["print"]).select("id", "digest", "fp", "first")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = LINK_BITS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest id that links reach) of each row."""
    grouped = simhash_groups(docs, id_col, text_col, words, most)
    return grouped.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, most: int = LINK_BITS, similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each group is kept: its first. Rows that repeat
    an id and its text are one document, of which one row stays. Null and empty texts and those without a word have one
    fingerprint, 0, and are one group; of equal ids the smallest digest is first. Very long texts count whole; columns may
    have any names; an empty table stays empty."""
    grouped = checkpointed(simhash_groups(docs, id_col, text_col, words, most, similarity))
    first = F.col("id").eqNullSafe(F.col("first.id")) & F.col("digest").eqNullSafe(F.col("first.digest"))

    def key(id_: Column, digest: Column) -> Column:
        return F.concat(F.coalesce(id_.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(digest.cast("string"), F.lit("-")))

    gone = grouped.where(~first).select(key(F.col("id"), F.col("digest")).alias("gone_key")).distinct()
    repeated = grouped.where(first).groupBy("id", "digest").count().where("count > 1").limit(1).count() > 0
    text = docs[quoted(text_col)].cast("string")
    mine = key(docs[quoted(id_col)].cast("long"), F.when(text.isNotNull(), F.xxhash64(text)))
    keyed = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), mine.alias("row_key"))
    kept = keyed.join(gone, keyed.row_key == gone.gone_key, "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["row_key"])
    return kept.select("row.*")
