"""How the term frequencies of a language's sources differ: joint walks through K-squared trees of the count matrix.

* Terms are counted by language and source within the tasks that read the texts, after a first pass has told which terms
  enough documents of the language hold. What passes between the two is a bit set of fixed size; a join by language and
  term then keeps exactly those terms.
* A language's matrix of groups and kept terms is mostly zero. Its terms are dealt into column blocks of some
  ``COLUMNS``, its groups into tiles of ``MEMBERS``, and each pair of tiles over each column block is a task's work. The matrix
  of a tile is a tree whose nodes are quartered, down to leaves of ``LEAF`` cells, and know whether they are all zero.
* Both trees of a pair of tiles are walked together, over the same terms: where both nodes are all zero, every pair of
  groups gets the value of two zero counts times the number of terms, and the walk ends there; leaves with counts
  are computed for all pairs of their groups at once. The partial sums of all column blocks are added.

Probabilities are whole numbers, computed in 38 decimal digits; differences stay within 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import checkpointed, text_blocks
from fieldspark.llm.vocabulary import SLICE_BYTES, byte_table, hash_filter, hashes, in_filter, slices, summed, tokenised

LEAST_DOCS = 10
RANKS = 10
UNIT = 1_000_000_000
COLUMNS = 8192
MEMBERS = 128
LEAF = (8, 32)
LEVELS = 4  # MEMBERS = LEAF[0] << LEVELS
#: Different terms, and counted pairs of a source and a term, that a task holds.
TERMS, FLUSH = 1 << 19, 1 << 22
#: Bytes that stand between terms.
TABLE = byte_table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


# -- counts ------------------------------------------------------------------------------------------------------------


def _documents_with_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[bytes, int]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            terms = sorted(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in terms], pa.int64())], ["lang", "term", "docs"])

    for (lang,), texts in slices(batches, 1):
        parted = [t for text in texts for t in (text.translate(TABLE), b"\xff")]
        terms, codes = _with_ends(parted)
        end = terms.index(b"\xff")
        doc = np.cumsum(codes == end)
        seen = np.unique(doc * len(terms) + codes) % len(terms)
        counts = held.setdefault(lang, {})
        size -= len(counts)
        for term, n in zip(terms, np.bincount(seen, minlength=len(terms)).tolist()):
            if n and term != b"\xff":
                counts[term] = counts.get(term, 0) + n
        size += len(counts)
        if size > TERMS:
            yield from sent()
            held.clear()
            size = 0
    yield from sent()


def _with_ends(parts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Terms and codes of texts that are followed by an end byte each."""
    return tokenised([b" ".join(parts)], bytes(range(256)))


@dataclass
class _Held:
    """Counts of one language within a task: numbers of its terms and sources, and (source, term, count) not yet added up."""

    terms: dict[bytes, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    parts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, lang: str, by_source: list[tuple[str, list[bytes]]], kept: np.ndarray) -> int:
        words, codes = _with_ends([t for _, texts in by_source for t in (b" ".join(texts).translate(TABLE), b"\xff")])
        end = words.index(b"\xff")
        fits = in_filter(kept, hashes(words, lang))
        fits[end] = False
        number = np.array([self.terms.setdefault(w, len(self.terms)) if fit else -1 for w, fit in zip(words, fits.tolist())])
        source = np.array([self.sources.setdefault(s, len(self.sources)) for s, _ in by_source])
        owner = np.cumsum(codes == end)  # an end follows its source's last term
        use = fits[codes]
        keys, counts = np.unique(source[owner[use]] << 40 | number[codes[use]], return_counts=True)
        self.parts.append((keys, counts))
        return len(keys)

    def sent(self, lang: str) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(self.parts)
        terms, sources = pa.array(list(self.terms), pa.binary()), pa.array(list(self.sources), pa.string())
        for at in range(0, len(keys), 1 << 16):
            own = keys[at : at + (1 << 16)]
            source, term = sources.take(pa.array(own >> 40)), terms.take(pa.array(own & (1 << 40) - 1)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), source, term, pa.array(counts[at : at + (1 << 16)])], ["lang", "source", "term", "n"])


def _count_terms(kept: Broadcast):
    """lang, source, term, n, added up over what a task reads; terms that the bit set rules out are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        size = 0
        for rows in text_blocks(batches, SLICE_BYTES, "text"):
            by_lang: dict[str, list] = {}
            for (lang, source), texts in slices([rows], 2):
                by_lang.setdefault(lang, []).append((source, texts))
            for lang, by_source in by_lang.items():
                size += held.setdefault(lang, _Held()).add(lang, by_source, kept.value)
            if size > FLUSH:
                for lang, own in held.items():
                    yield from own.sent(lang)
                held, size = {}, 0
        for lang, own in held.items():
            yield from own.sent(lang)

    return run


# -- trees -------------------------------------------------------------------------------------------------------------


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of whole numbers from 1 to some 10^9."""
    d = p - q
    return d * d // (p + q)


def zero_tree(counted: np.ndarray) -> list[np.ndarray]:
    """Whether the nodes of each level, leaves first, hold a count. ``counted`` is padded to MEMBERS rows and whole trees of columns."""
    rows, columns = counted.shape
    levels = [counted.reshape(rows // LEAF[0], LEAF[0], columns // LEAF[1], LEAF[1]).any((1, 3))]
    for _ in range(LEVELS):
        r, c = levels[-1].shape
        levels.append(levels[-1].reshape(r // 2, 2, c // 2, 2).any((1, 3)))
    return levels


def joint_sums(p: np.ndarray, q: np.ndarray, p0: np.ndarray, q0: np.ndarray, trees: tuple[list[np.ndarray], list[np.ndarray]], columns: int, same: bool) -> np.ndarray:
    """Sums of the divergence over the first ``columns`` terms for each pair of a row of p and a row of q (MEMBERS rows
    each); p0 and q0 are what a count of zero gives. If both are the same tile, blocks below the diagonal stay 0."""
    leaves = MEMBERS // LEAF[0]
    empty = np.zeros((leaves, leaves), np.int64)  # terms over which both rows of leaves are zero
    sums = np.zeros((leaves, leaves, LEAF[0], LEAF[0]), np.int64)
    tops = trees[0][LEVELS].shape[1]
    a = b = np.zeros(tops, np.int64)
    c = np.arange(tops)
    for level in range(LEVELS, -1, -1):
        width = LEAF[1] << level
        used = c * width < columns
        if same:
            used &= a <= b
        a, b, c = a[used], b[used], c[used]
        zero = ~(trees[0][level][a, c] | trees[1][level][b, c])
        real = np.minimum(width, columns - c[zero] * width)
        priced = np.zeros((leaves >> level, leaves >> level), np.int64)
        np.add.at(priced, (a[zero], b[zero]), real)
        empty += np.kron(priced, np.ones((1 << level, 1 << level), np.int64))
        a, b, c = a[~zero], b[~zero], c[~zero]
        if level:
            quarter = np.indices((2, 2, 2)).reshape(3, -1)
            a, b, c = ((2 * x[:, None] + k).ravel() for x, k in zip((a, b, c), quarter))
    left = p.reshape(leaves, LEAF[0], -1, LEAF[1]).transpose(0, 2, 1, 3)
    right = q.reshape(leaves, LEAF[0], -1, LEAF[1]).transpose(0, 2, 1, 3)
    for at in range(0, len(a), 256):
        some = slice(at, at + 256)
        values = divergence(left[a[some], c[some]][:, :, None], right[b[some], c[some]][:, None]).sum(-1)
        np.add.at(sums, (a[some], b[some]), values)
    zeros = divergence(p0[:, None], q0[None])
    return sums.transpose(0, 2, 1, 3).reshape(MEMBERS, MEMBERS) + np.kron(empty, np.ones((LEAF[0], LEAF[0]), np.int64)) * zeros


def _tile_matrix(rows: pa.Table, columns: dict[str, int], width: int) -> tuple[list[str], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sources by place, what each cell and each zero gives, and the tree of one tile's rows."""
    whole = LEAF[1] << LEVELS
    padded = -(-max(width, 1) // whole) * whole
    zero = np.ones(MEMBERS, np.int64)
    sources, cells = [], []
    for member, source, term, p in zip(*(rows.column(k).to_pylist() for k in ("member", "source", "term", "p"))):
        if term is None:
            sources.append((member, source))
            zero[member] = p
        else:
            cells.append((member, columns[term], p))
    matrix = np.ones((MEMBERS, padded), np.int64)
    matrix[:, :width] = zero[:, None]
    counted = np.zeros((MEMBERS, padded), bool)
    if cells:
        m, t, p = np.array(cells, np.int64).T
        matrix[m, t], counted[m, t] = p, True
    return [s for _, s in sorted(sources)], matrix, zero, zero_tree(counted)


def _tile_sums(rows: pa.Table) -> pa.Table:
    """lang, a, b, value: the partial sums of a pair of tiles over one column block, for each pair of sources once."""
    lang, down, across = (rows.column(k)[0].as_py() for k in ("lang", "down", "across"))
    width = max(rows.column("width").to_pylist())  # rows of groups have it
    terms = [t for t in rows.column("term").to_pylist() if t is not None]
    often: dict[str, int] = {}
    for t in terms:
        often[t] = often.get(t, 0) + 1
    columns = {t: k for k, t in enumerate(sorted(often, key=lambda t: (-often[t], t)))}  # frequent terms first: zeros lie together
    tile = rows.column("tile").to_numpy()
    sides = [_tile_matrix(rows.filter(pa.array(tile == t)), columns, width) for t in ((down,) if down == across else (down, across))]
    (a, p, p0, tree), (b, q, q0, other) = sides[0], sides[-1]
    sums = joint_sums(p, q, p0, q0, (tree, other), width, down == across)
    i, j = np.triu_indices(len(a), 1) if down == across else (x.ravel() for x in np.indices((len(a), len(b))))
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array([a[k] for k in i], pa.string()), "b": pa.array([b[k] for k in j], pa.string()), "value": pa.array(sums[i, j], pa.int64())})


# -- the operator ------------------------------------------------------------------------------------------------------


def _probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 terms)), for terms > 0; UNIT otherwise, where nothing is compared."""
    exact = f"cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * {terms} as decimal(20,0))"
    return F.expr(f"case when {terms} = 0 then {UNIT}L else 1 + cast({exact} as long) end")


def group_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The matrix and its groups: lang, source, term, n (1 or more), lang_n (the language's count of the term); and lang, source,
    total (of n), lang_total, terms (kept by the language) of every pair of language and source that occurs."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))
    held = texts.select("lang", "text").mapInArrow(_documents_with_terms, "lang string, term string, docs long")
    kept = checkpointed(held.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"))
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(kept, F.xxhash64("lang", "term")))
    # Tasks send their terms added up, so they go to their term's partition without another partial sum.
    counted = texts.mapInArrow(_count_terms(bits), "lang string, source string, term string, n long").repartition("lang", "term")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi")
    cells = checkpointed(summed.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))).select("lang", "source", "term", "n", "lang_n"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    whole = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(whole, "lang", "left").join(terms, "lang", "left")
    return cells, checkpointed(groups.na.fill(0, ["total", "lang_total", "terms"]))


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: the divergence of each two sources of a language, both ways."""
    placed = groups.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    placed = placed.withColumn("tiles", F.ceil(F.count("*").over(Window.partitionBy("lang")) / MEMBERS).cast("int")).withColumn("blocks", F.ceil((F.col("terms") + 1) / COLUMNS).cast("int"))
    tile, member = F.floor(F.col("nth") / MEMBERS).cast("int").alias("tile"), (F.col("nth") % MEMBERS).cast("int").alias("member")
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with")
    block = lambda b: F.pmod(F.xxhash64("term"), b).cast("int")
    met = cells.join(placed.select("lang", "source", "total", "terms", "blocks", "tiles", tile, member), ["lang", "source"])
    values = met.select("lang", "source", "term", block(F.col("blocks")).alias("block"), _probability("n", "total", "terms").alias("p"), "tile", "member", others)
    sizes = cells.select("lang", "term").distinct().join(groups.groupBy("lang").agg(F.ceil((F.max("terms") + 1) / COLUMNS).cast("int").alias("blocks")), "lang")
    sizes = sizes.groupBy("lang", block(F.col("blocks")).alias("block")).agg(F.count("*").cast("int").alias("width"))
    zeros = placed.select("lang", "source", F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), _probability("0", "total", "terms").alias("p"), tile, member, "tiles")
    zeros = zeros.select("lang", "source", "term", "block", "p", "tile", "member", others).join(sizes, ["lang", "block"], "left").na.fill(0, ["width"])
    rows = zeros.unionByName(values.withColumn("width", F.lit(0)))
    keyed = rows.withColumn("down", F.least("tile", "with")).withColumn("across", F.greatest("tile", "with")).drop("with")
    sums = keyed.groupBy("lang", "block", "down", "across").applyInArrow(_tile_sums, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s"), "value").select("lang", "s.a", "s.b", "value")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank. Part "pair": every other source of the language and the sum over all kept
    terms of floor((p - q)^2 / (p + q)), all ranks. Part "term": the terms that the source has more often than its
    language as a whole, by the same measure, ``ranks`` at most.

    Values descend, equal ones are ordered by the item's bytes. A null text, language or source is empty; a group without
    terms has counts of zero; a language without kept terms has pairs of value 0; a source that is alone has none. Texts
    count whole, repeated rows as often as they occur; an empty table gives no rows; columns of other names are not read.
    """
    cells, groups = group_counts(docs, text_col, lang_col, source_col, least_docs)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = pair_values(cells, groups).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", ranked)
    own = cells.join(groups, ["lang", "source"]).withColumn("p", _probability("n", "total", "terms")).withColumn("q", _probability("lang_n", "lang_total", "terms"))
    terms = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return pairs.union(terms.withColumn("rank", ranked).where(F.col("rank") <= ranks))
