"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and the first 3 to 8 letters of longer ones, each counted once, as 64-bit hashes. For grades
0 < 1 < ... < K the model is P(grade > k) = 1 / (1 + exp(threshold_k - w . x)): one vector of weights for all ordered
thresholds. A text's expected severity is the sum of these probabilities, its grade the most probable one, and it is
toxic if P(grade > 0) > 1/2.

The model is fitted on all labelled rows. The features that occur more in higher grades, beyond chance by a G-test, are
its vocabulary, the ``FEATURES`` that tell most if there are more; Spark sums their counts, in grade 0 only of features
whose counts in higher grades leave it open whether they are chosen. The rows, as places in the
vocabulary, stay distributed: each step of L-BFGS sums likelihood and slope over all of them, and the driver holds a few
vectors. Labels that only say toxic or not are graded by how much there is: among toxic rows, the numbers of different
features of the vocabulary are cut at quantiles into ``TIERS`` grades. Scoring is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import checkpointed, kept_rows, text_blocks
from fieldspark.llm.letters import SPACE, letters
from fieldspark.llm.vocabulary import hash_filter, in_filter

FEATURES, TIERS = 4_096, 3
#: Rows of the least frequent feature that may be chosen, and its least G statistic: of a million features that tell
#: nothing about two grades, a few hundredths of one exceed 30.
LEAST_ROWS, LEAST_G = 3, 30.0
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Steps of a fit, and the largest slope at which it has arrived.
ROUNDS, LEAST_SLOPE = 60, 1e-6
SLICE = 2 << 20
#: Odd multipliers that spread hashes over 64 bits.
MULTIPLIER, FINISHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _finished(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(kind)) * FINISHER
    return h ^ (h >> np.uint64(29))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The features of texts that are scored together, repeats included: row and hash of each. A word of any length is
    hashed as a whole: a polynomial in MULTIPLIER, letter by letter."""
    codes = [letters(t or "") for t in texts]
    flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    space = flat == SPACE
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row = np.searchsorted(np.cumsum([len(c) for c in codes]), starts, "right")
    size = ends - starts
    rows, hashes, h = [], [], np.zeros(len(starts), np.uint64)
    powers = np.multiply.accumulate(np.full(max(int(size.max()), max(PREFIXES)), MULTIPLIER))
    for k in range(max(PREFIXES)):
        letter = flat[np.minimum(starts + k, len(flat) - 1)].astype(np.uint64)
        h = np.where(k < size, h + letter * powers[k], h)
        if k + 1 in PREFIXES:
            longer = size > k + 1
            rows.append(row[longer])
            hashes.append(_finished(h[longer], k + 1))
    place = np.arange(len(flat) - starts[0]) - np.repeat(starts - starts[0], np.diff(starts, append=len(flat)))
    terms = np.where(space[starts[0] :], np.uint64(0), flat[starts[0] :].astype(np.uint64) * powers[np.minimum(place, len(powers) - 1)])
    rows.append(row)
    hashes.append(_finished(np.add.reduceat(terms, starts - starts[0]) + size.astype(np.uint64) * FINISHER, 0))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass(frozen=True)
class OrdinalModel:
    """vocabulary: sorted hashes; weights: one each; thresholds: in ascending order, one less than there are grades."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def _known(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row and place in the vocabulary of each known feature, once a row."""
        rows, hashes = features(texts)
        if not len(self.vocabulary) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        likely = np.zeros(1 << 16, bool)
        likely[self.vocabulary & np.uint64(0xFFFF)] = True
        some = likely[hashes & np.uint64(0xFFFF)]
        rows, hashes = rows[some], hashes[some]
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == hashes
        both = np.unique(rows[same] * np.int64(len(self.vocabulary)) + place[same])
        return both // len(self.vocabulary), both % len(self.vocabulary)

    def exceedance(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) of each text and threshold; 0 for texts without a word."""
        rows, places = self._known(texts)
        score = np.bincount(rows, self.weights[places], len(texts))
        worded = np.array([any(c.isalpha() for c in t or "") for t in texts], bool)
        return worded[:, None] / (1.0 + np.exp(np.clip(self.thresholds - score[:, None], -500, 500)))


def _thresholds(free: np.ndarray) -> np.ndarray:
    """The first threshold and logarithms of gaps as thresholds: they stay ordered."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def _sums(rows: np.ndarray, places: np.ndarray, grades: np.ndarray, counts: np.ndarray, x: np.ndarray, n_features: int) -> np.ndarray:
    """The negative log-likelihood of rows that count ``counts`` times, and its slope by weights and free thresholds."""
    weights, free, n = x[:n_features], x[n_features:], len(grades)
    top, thresholds = len(free), _thresholds(free)
    low, high = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)
    score = np.bincount(rows, weights[places], n)
    above = 1 / (1 + np.exp(np.clip(thresholds - score[:, None], -500, 500)))
    upper = np.where(grades > 0, above[np.arange(n), low], 1.0)  # P(grade >= own)
    lower = np.where(grades < top, above[np.arange(n), high], 0.0)  # P(grade > own)
    likely = np.maximum(upper - lower, 1e-12)
    d_upper = np.where(grades > 0, upper * (1 - upper), 0.0) / likely * counts
    d_lower = np.where(grades < top, lower * (1 - lower), 0.0) / likely * counts
    d_threshold = np.bincount(low, d_upper * (grades > 0), top) - np.bincount(high, d_lower * (grades < top), top)
    d_weights = np.bincount(places, (d_lower - d_upper)[rows], n_features)
    return np.concatenate([[-(np.log(likely) * counts).sum()], d_weights, [d_threshold.sum()], np.cumsum(d_threshold[::-1])[::-1][1:] * np.exp(free[1:])])


def _minimised(evaluate, x: np.ndarray) -> np.ndarray:
    """Where a function of value and slope is least, by L-BFGS with halved steps: at most ``ROUNDS`` steps."""
    value, slope = evaluate(x)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if np.abs(slope).max() <= LEAST_SLOPE:
            break
        way, parts = -slope, []
        for s, y in reversed(history):
            parts.append((s @ way) / (s @ y))
            way = way - parts[-1] * y
        way = way * (history[-1][0] @ history[-1][1] / (history[-1][1] @ history[-1][1]) if history else 1 / np.linalg.norm(slope))
        for (s, y), part in zip(history, reversed(parts)):
            way = way + s * (part - (y @ way) / (s @ y))
        step = 1.0
        while (found := evaluate(x + step * way))[0] > value + 1e-4 * step * (way @ slope):
            step /= 2
            if step < 1e-6:
                return x
        pair = step * way, found[1] - slope
        if pair[0] @ pair[1] > 0:
            history = [*history[-9:], pair]
        x, (value, slope) = x + step * way, found
    return x


def _fitted(sums, totals: np.ndarray, n_features: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean negative log-likelihood and a ridge penalty. ``sums`` gives _sums over all
    rows, of which totals has the number by grade. A grade that no row has gets a gap all the same. All rows of one
    grade, or none, leave the weights 0."""
    top, n = len(totals) - 1, totals.sum()
    if top == 0:
        return np.zeros(n_features), np.array([50.0])
    share = np.clip([totals[k + 1 :].sum() / n for k in range(top)], 1e-6, 1 - 1e-6)
    start = np.log(1 / share - 1)
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        total, own = sums(x) / n, np.concatenate([x[:n_features], np.zeros(top)])
        return total[0] + ridge / 2 * (own @ own), total[1:] + ridge * own

    x = _minimised(evaluate, np.concatenate([np.zeros(n_features), free]))
    return x[:n_features], _thresholds(x[n_features:])


def fit(rows: np.ndarray, places: np.ndarray, grades: np.ndarray, n_features: int, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """_fitted for rows in arrays."""
    return _fitted(lambda x: _sums(rows, places, grades, np.ones(len(grades)), x, n_features), np.bincount(grades, minlength=1), n_features, ridge)


def fit_rows(seen: DataFrame, n_features: int, totals: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """_fitted for a table of grade, n (how often) and places: each step sums over all of its rows, a vector from a task."""
    session = seen.sparkSession
    seen = seen.coalesce(session.sparkContext.defaultParallelism)

    def sums(x: np.ndarray) -> np.ndarray:
        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(x) + 1)
            for batch in batches:
                lists = batch.column(2)
                lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
                places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                total += _sums(np.repeat(np.arange(len(lengths)), lengths), places, batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), x, n_features)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return sum((np.frombuffer(r["sums"]) for r in seen.mapInArrow(add, "sums binary").collect()), np.zeros(len(x) + 1))

    return _fitted(sums, totals, n_features, ridge)


def _told(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The G statistic of the presence of each feature (counts by feature and grade)."""
    n = totals.sum()
    told = np.zeros(len(counts))
    for cell, share in ((counts, counts.sum(1) / n), (totals - counts, 1 - counts.sum(1) / n)):
        expected = np.maximum(share[:, None] * totals, 1e-300)
        told += 2 * np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-300) / expected), 0.0).sum(1)
    return told


def _g(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """_told; 0 for features that do not occur in higher grades than others."""
    grades = np.arange(len(totals))
    return np.where(counts @ grades / counts.sum(1) > totals @ grades / totals.sum(), _told(counts, totals), 0.0)


def _most_g(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The most that _g can be for features with these counts in the grades above 0, whatever their count in grade 0: _told is
    convex in that count, so it is largest where the count is 0 or where features stop to be of higher grades than others."""
    grades = np.arange(len(totals))
    last = np.minimum(counts @ grades / (totals @ grades / totals.sum()) - counts[:, 1:].sum(1), totals[0])
    ends = [np.concatenate([c[:, None], counts[:, 1:]], 1) for c in (np.zeros(len(counts)), np.maximum(last, 0.0))]
    return np.maximum(*(_told(e, totals) for e in ends))


def _cuts(values: np.ndarray, counts: np.ndarray, tiers: int) -> np.ndarray:
    """Quantiles, as numpy.quantile has them, of values (in order) of which each is there so often, each cut once."""
    if not len(values):
        return np.empty(0)
    ends, place = np.cumsum(counts), np.arange(1, tiers) / tiers * (counts.sum() - 1)
    below, above = (values[np.searchsorted(ends, f(place), "right")] for f in (np.floor, np.ceil))
    return np.unique(below + (above - below) * (place - np.floor(place)))


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_features: int = FEATURES, tiers: int = TIERS) -> OrdinalModel:
    """Fits on all rows of ``graded`` (id_col and grade, from 0 to at most 255) and their texts. If
    there are only grades 0 and 1, grade 1 is told apart by evidence into ``tiers`` grades. Null ids, grades and texts are
    left out; of an id with several grades or texts each counts, and each repeated row; a graded id without a document
    does not count. Texts count whole, however long. Without any row the model calls nothing toxic. Other columns are not read."""
    chosen = graded.where(F.col(id_col).isNotNull() & F.col("grade").between(0, 255)).select(F.col(id_col).cast("long").alias("id"), F.col("grade").cast("int").alias("grade"))
    chosen = chosen.groupBy("id", "grade").agg(F.count("*").alias("n"))
    session = docs.sparkSession
    bits = session.sparkContext.broadcast(hash_filter(chosen, F.xxhash64("id")))  # so that few other texts move

    def maybe_graded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array(in_filter(bits.value, rows.column(2).to_numpy().view(np.uint64))))

    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("id", "text", F.xxhash64("id").alias("mark")).mapInArrow(maybe_graded, "id long, text string, mark long")
    # the labels grow with the documents: they are never broadcast
    sample = checkpointed(texts.join(chosen.hint("shuffle_hash"), "id").select("grade", "text", "n"))

    def count(known: Broadcast | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in text_blocks(batches, SLICE):
                row, hashed = features(rows.column(1).to_pylist())
                if known is not None:
                    some = in_filter(known.value, hashed)
                    row, hashed = row[some], hashed[some]
                grade = rows.column(0).to_numpy()[row]
                order = np.lexsort((row, grade, hashed))
                row, grade, hashed = row[order], grade[order], hashed[order]
                pair = np.append(True, (hashed[1:] != hashed[:-1]) | (grade[1:] != grade[:-1]))[: len(row)]
                once = pair | np.append(True, row[1:] != row[:-1])[: len(row)]
                n = np.bincount(np.cumsum(pair)[once] - 1, rows.column(2).to_numpy()[row[once]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashed[pair].view(np.int64)), pa.array(grade[pair]), pa.array(n)], ["feature", "grade", "n"])

        return run

    totals = sample.groupBy("grade").agg(F.sum("n").alias("count")).toPandas()
    if totals.empty:
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.array([50.0]))
    top = int(totals["grade"].max())
    by_grade = np.zeros(top + 1)
    by_grade[totals["grade"]] = totals["count"]
    sums = [F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"g{g}") for g in range(top + 1)]
    columns = ", ".join(["feature long", *(f"g{g} long" for g in range(top + 1))])

    def strong(statistic):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                counts = np.stack([rows.column(g + 1).to_numpy() for g in range(top + 1)], 1).astype(float)
                told = statistic(counts, by_grade)
                made = pa.RecordBatch.from_arrays([*rows.columns, pa.array(told)], [*rows.schema.names, "told"])
                yield made.filter(pa.array(told >= LEAST_G - 1e-6 if statistic is _most_g else told >= LEAST_G))

        return run

    # most features have too few rows in higher grades to be chosen, however few they have in grade 0: only the others are counted there
    higher = sample.where("grade > 0").mapInArrow(count(None), "feature long, grade int, n long").groupBy("feature").agg(*sums)
    higher = checkpointed(higher.mapInArrow(strong(_most_g), columns + ", told double").drop("told"))
    likely = session.sparkContext.broadcast(hash_filter(higher, F.col("feature")))
    lowest = sample.where("grade = 0").mapInArrow(count(likely), "feature long, grade int, n long").groupBy("feature").agg(*sums)
    counted = higher.union(lowest).groupBy("feature").agg(*(F.sum(f"g{g}").alias(f"g{g}") for g in range(top + 1)))
    rated = counted.where(sum((F.col(f"g{g}") for g in range(top + 1)), F.lit(0)) >= LEAST_ROWS)
    best = rated.mapInArrow(strong(_g), columns + ", told double").select("feature", "told").orderBy(F.desc("told"), "feature").limit(n_features)
    vocabulary = np.sort(best.select("feature").toPandas()["feature"].to_numpy(np.int64).view(np.uint64))
    finder = sample.sparkSession.sparkContext.broadcast(OrdinalModel(vocabulary, np.zeros(len(vocabulary)), np.zeros(1)))

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_blocks(batches, SLICE):
            row, place = finder.value._known(rows.column(1).to_pylist())
            offsets = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32)))], ["grade", "n", "places"])

    seen = checkpointed(sample.mapInArrow(present, "grade int, n long, places array<int>").groupBy("grade", "places").agg(F.sum("n").alias("n")).select("grade", "n", "places"))
    if top == 1:
        found = seen.where("grade > 0").groupBy(F.size("places").alias("features")).agg(F.sum("n").alias("n")).orderBy("features").toPandas()
        cuts = _cuts(found["features"].to_numpy(float), found["n"].to_numpy(), tiers)
        tier = sum((F.when(F.size("places") > float(c), 1).otherwise(0) for c in cuts), F.lit(1))
        seen = seen.withColumn("grade", F.when(F.col("grade") > 0, tier).otherwise(0))
        by_tier = np.bincount(1 + np.searchsorted(cuts, found["features"]), found["n"], 1)
        by_grade = np.concatenate([by_grade[:1], by_tier[1:]])
    weights, thresholds = fit_rows(seen, len(vocabulary), by_grade)
    return OrdinalModel(vocabulary, weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, grade, expected_severity, p_toxic, toxic of every row's whole text. Null texts and those without a letter
    have grade, severity and probability 0; of equally probable grades the lowest is given. Texts of any length are scored
    whole. Rows may repeat, ids may be null, an empty table gives no rows; only the two columns are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_blocks(batches, SLICE):
            above = shared.value.exceedance(rows.column(1).to_pylist())
            edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
            columns = [(-np.diff(edges)).argmax(1).astype(np.int32), above.sum(1), above[:, 0], above[:, 0] > 0.5]
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, columns)], ["doc_id", "grade", "expected_severity", "p_toxic", "toxic"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, grade int, expected_severity double, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic: P(grade > 0) is 1/2 at most. Null and empty texts and those
    without a letter stay; rows that repeat stay or go alike; the model's names do not clash with columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, lambda rows: shared.value.exceedance(rows.column(rows.schema.get_field_index(text_col)).to_pylist())[:, 0] <= 0.5)
