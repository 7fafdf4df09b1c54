"""Choosing centers and tuning parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.errors import InputError, MemoryLimitError
from fieldspark.functions.kernels import Anisotropy, Kernel
from fieldspark.functions.mixing import INCREMENT, plain, splitmix64, times, unsigned_order
from fieldspark.operators import ranking
from fieldspark.operators.fields import MAX_CENTERS, FittedField, axes, fit, kernel_pairs, solve_dense, system_of
from fieldspark.sessions import checkpointed


def select_all(candidates: DataFrame) -> DataFrame:
    """nth, idx: every candidate, in the order of idx."""
    return ranking.numbered(candidates.select(F.col("idx").cast("long").alias("idx")), ["idx"], "nth").select(F.col("nth").cast("int").alias("nth"), "idx")


def selected_basis(candidates: DataFrame, chosen: DataFrame, kernel: Kernel, dimension: int) -> DataFrame:
    """field_id, selected: a review of the chosen centers (nth, idx): their kernel matrix must have full rank and a Cholesky
    factor, or it is an error. One bounded task a field."""
    own = candidates.join(chosen.select("idx", "nth"), "idx")
    centers = own.select("field_id", F.col("nth").cast("int").alias("idx"), *axes(dimension), F.lit(0.0).alias("y"))
    return fit(centers, kernel, dimension).groupBy("field_id").agg(F.count("*").alias("selected"))


def select_user(candidates: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """nth, idx: the candidates named, in that order; repeated or missing ones are errors."""
    if len(set(chosen)) != len(chosen):
        raise InputError("an index is named twice")
    wanted = candidates.sparkSession.createDataFrame(list(enumerate(chosen)), "nth int, idx long")
    found = wanted.join(candidates.select("idx"), "idx")
    if found.count() != len(chosen):
        raise InputError("an index is not among the candidates")
    return found.select("nth", F.col("idx").cast("long").alias("idx"))


def select_farthest(candidates: DataFrame, dimension: int, count: int, seed: int = 0) -> DataFrame:
    """nth, idx, distance: farthest points one after another, starting with row seed mod n in the order of idx. A round
    moves each candidate's distance to the nearest chosen one and takes the largest, ties by the seeded order; the
    candidates stay distributed, a round brings one row to the driver."""
    x = axes(dimension)
    tie = unsigned_order(splitmix64(F.col("idx").bitwiseXOR(F.lit(seed))))
    state = checkpointed(candidates.select(F.col("idx").cast("long").alias("idx"), *x).withColumn("tie", tie).withColumn("near", F.lit(float("inf"))))
    n = state.count()
    if not 0 < count <= n:
        raise InputError("more centers than candidates", count=count, candidates=n)
    first = ranking.numbered(state, ["idx"], "__nth").where(F.col("__nth") == seed % n).first()
    made, last, distance = [], first, 0.0
    for nth in range(count):
        made.append((nth, last["idx"], distance))
        square = sum(((F.col(c) - float(last[c])) ** 2 for c in x), F.lit(0.0))
        state = state.where(F.col("idx") != last["idx"]).withColumn("near", F.least("near", F.sqrt(square)))
        if nth % 8 == 7:
            state = checkpointed(state)  # else the plan grows with every round
        if nth + 1 < count:
            last = state.orderBy(F.desc("near"), "tie").first()
            distance = last["near"]
    return candidates.sparkSession.createDataFrame(made, "nth int, idx long, distance double")


def select_greedy(candidates: DataFrame, kernel: Kernel, dimension: int, count: int, by: str = "residual", seed: int = 0) -> DataFrame:
    """field_id, nth, idx, score of greedy selection within each field of candidates (field_id, idx, x0 ..., y): the
    largest residual of the interpolant so far, or the largest power function. One bounded task a field."""
    if by not in ("residual", "power") or kernel.cpd_order:
        raise InputError("greedy selection takes a positive definite kernel and residual or power", by=by)
    pairs = kernel_pairs(candidates, kernel, dimension)
    targets = candidates.select(F.col("field_id").alias("own_id"), F.col("idx").alias("own_idx"), F.col("y").alias("own_y"))

    def choose(key: tuple, entries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        if n > MAX_CENTERS:
            raise MemoryLimitError("too many candidates", candidates=n)
        rows = rows.sort_values("own_idx")
        gram = np.zeros((n, n))
        gram[entries["i"], entries["j"]] = gram[entries["j"], entries["i"]] = entries["v"]
        ties = np.array([plain((seed ^ i) & (1 << 64) - 1) for i in range(n)], np.uint64)
        return pd.DataFrame([(key[0], nth, i, s) for nth, (i, s) in enumerate(greedy(gram, rows["own_y"].to_numpy(), count, by, ties))], columns=["field_id", "nth", "idx", "score"])

    return pairs.groupBy("field_id").cogroup(targets.groupBy("own_id")).applyInPandas(choose, "field_id long, nth int, idx long, score double")


def greedy(gram: np.ndarray, y: np.ndarray, count: int, by: str, ties: np.ndarray) -> list[tuple[int, float]]:
    """Newton basis by pivoted Cholesky: a pivot must exceed n eps times its diagonal."""
    n, eps = len(gram), np.finfo(float).eps
    diagonal, residual, basis = np.diag(gram).copy(), y.astype(float).copy(), np.zeros((n, 0))
    left, made = np.ones(n, bool), []
    while len(made) < count and left.any():
        diagonal = np.where((diagonal < 0) & (diagonal >= -eps * np.diag(gram)), 0.0, diagonal)
        allowed = left & (diagonal > n * eps * np.abs(np.diag(gram)))
        if not allowed.any():
            break
        score = np.abs(residual) if by == "residual" else diagonal
        best = min(np.flatnonzero(allowed), key=lambda i: (-score[i], ties[i]))
        column = (gram[:, best] - basis @ basis[best]) / np.sqrt(diagonal[best])
        made.append((int(best), float(score[best])))
        residual = residual - column * (residual[best] / column[best])
        diagonal = diagonal - column**2
        basis = np.column_stack([basis, column])
        left[best] = False
    return made


# -- tuning


#: Points of the fullest cell with which the search for neighbours begins.
CELL_POINTS = 32


def _cell_width(points: DataFrame, x: Sequence[str], extent: float) -> float:
    """A width at which no cell holds many of the points, which are different: the largest extent / 2^k for which that is so,
    by halving the range of k. So far outliers do not put all others into a few cells."""
    low, high = 0, 60
    while low < high:
        k = (low + high) // 2
        width = F.lit(extent / 2**k)
        fullest = points.groupBy(*[F.floor(F.col(c) / width).alias(c) for c in x]).count().agg(F.max("count")).first()[0]
        low, high = (low, k) if fullest <= CELL_POINTS else (k + 1, high)
    return extent / 2**low


def nearest_distances(points: DataFrame, dimension: int) -> DataFrame:
    """idx, nearest: the distance to the nearest other point. Points at one place are found first: their distance is 0, and
    they stand for one. Candidates come from a grid of cells, at first so small that none holds many points: a point is
    settled when one is found within its cells' reach, the others go on to cells twice as wide."""
    x = axes(dimension)
    points = points.select(F.col("idx").cast("long").alias("idx"), *x)
    bounds = points.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in x]).first()
    n, extent = bounds["n"], max([bounds[c] or 0.0 for c in x])
    if n < 2:
        return points.select("idx", F.lit(None).cast("double").alias("nearest"))
    if extent == 0:
        return points.select("idx", F.lit(0.0).alias("nearest"))
    from fieldspark.operators.neighbors import within

    places = checkpointed(points.groupBy(*x).agg(F.min("idx").alias("idx"), F.count("*").alias("n")))
    open_, made = places.where("n = 1").select("idx", *x), []
    width = _cell_width(places, x, extent)
    while True:
        found = within(open_, places, width, dimension).where("i <> j").groupBy("i").agg(F.min("r").alias("nearest"))
        found = checkpointed(found.select(F.col("i").alias("idx"), "nearest"))
        made.append(found)
        open_ = checkpointed(open_.join(found, "idx", "left_anti"))
        if open_.isEmpty():
            break
        width *= 2
    whole = made[0]
    for more in made[1:]:
        whole = whole.union(more)
    many = places.where("n > 1").select(*x, F.lit(0.0).alias("nearest"))
    return whole.union(points.join(many, x).select("idx", "nearest"))


#: The least that each parameter of a candidate may be.
LEAST = {"length": float(np.finfo(float).tiny), "support_radius": float(np.finfo(float).tiny), "regularization": 0.0, "axis_ratio": 1.0, "influence_radius": float(np.finfo(float).tiny)}


def candidate_violations(candidates: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """cand, problem of tuning candidates (cand and parameters of LEAST, null where inactive): a parameter that is not finite,
    below its least or out of its bounds, one that is active without bounds or the other way round, and candidates that
    repeat an earlier one's parameters (0 and -0 are one)."""
    names = [c for c in LEAST if c in candidates.columns]
    problem = F.lit(None).cast("string")
    for c in reversed(names):
        v = F.col(c)
        if c in bounds:
            low, high = bounds[c]
            if not LEAST[c] <= low <= high < float("inf"):
                raise InputError("the bounds are not in order or too low", parameter=c)
            problem = F.when(v.isNull(), f"{c} is missing").when(F.isnan(v) | (v < low) | (v > high), f"{c} is out of bounds").otherwise(problem)
        else:
            problem = F.when(v.isNotNull(), f"{c} has no bounds").otherwise(problem)
    key = [(F.col(c) + F.lit(0.0)).alias(f"__{c}") for c in names]
    first = F.min("cand").over(Window.partitionBy(*[f"__{c}" for c in names]))
    rated = candidates.select("cand", problem.alias("problem"), *key).withColumn("__first", first)
    return rated.select("cand", F.coalesce("problem", F.when(F.col("__first") < F.col("cand"), "repeats a candidate")).alias("problem")).where("problem is not null")


def fixed_choice(candidates: DataFrame, chosen: int) -> DataFrame:
    """cand, status: the candidate given is selected, the others are not evaluated. One that is not there is an error."""
    if candidates.where(F.col("cand") == chosen).first() is None:
        raise InputError("no such candidate", candidate=chosen)
    return candidates.select("cand", F.when(F.col("cand") == chosen, "Selected").otherwise("NotEvaluated").alias("status"))


def power_scores(evidence: DataFrame) -> DataFrame:
    """cand, score from evidence (cand, max_sq_power, samples): the largest squared power of a candidate's parts. A part
    without samples or with a negative power is an error."""
    bad = evidence.where("not samples > 0 or not max_sq_power >= 0 or max_sq_power = double('infinity')").first()
    if bad is not None:
        raise InputError("evidence needs samples and a finite power of 0 or more", candidate=bad["cand"])
    return evidence.groupBy("cand").agg(F.max("max_sq_power").alias("score"))


def _few(candidates: DataFrame, parameters: Sequence[str]) -> list[dict]:
    few = candidates.select("cand", *parameters).limit(MAX_CENTERS + 1).collect()
    if len(few) > MAX_CENTERS:
        raise MemoryLimitError("too many candidates", limit=MAX_CENTERS)
    return [c.asDict() for c in few]


_EVIDENCE = "cand int, fold int, weighted_squared_error double, weight double"


def evaluated(candidates: DataFrame, folded: DataFrame, error: Callable[[pd.DataFrame, dict], tuple[float, float]], parameters: Sequence[str]) -> DataFrame:
    """cand, fold, weighted_squared_error, weight: ``error`` of the rows of each fold under each candidate's parameters. It must
    be a sum over rows and a sum of weights, for it is computed for the rows of a batch at a time and added up: neither
    rows nor folds are gathered or repeated. candidates is a small table; folds are what the caller made them."""
    few = _few(candidates, parameters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [(c["cand"], fold, *map(float, error(own, {p: c[p] for p in parameters}))) for fold, own in rows.groupby("fold") for c in few]
            yield pd.DataFrame(made, columns=["cand", "fold", "weighted_squared_error", "weight"])

    parts = folded.mapInPandas(run, _EVIDENCE)
    return parts.groupBy("cand", "fold").agg(F.sum("weighted_squared_error").alias("weighted_squared_error"), F.sum("weight").alias("weight"))


def cross_validated(candidates: DataFrame, folded: DataFrame, dimension: int, kernel: Callable[[dict], Kernel], parameters: Sequence[str], anisotropy: Callable[[dict], Anisotropy | None] | None = None) -> DataFrame:
    """cand, fold, weighted_squared_error, weight of points (idx, x0 ..., y, fold and optionally weight): for each candidate
    and fold a field is fitted to the points of all other folds, with the kernel (and anisotropy) that the candidate's
    parameters give, and its squared errors at the fold's own points are added up. Each is a task of at most MAX_CENTERS
    points, which is checked; a fit that fails is an error."""
    few, x = _few(candidates, parameters), axes(dimension)
    n = folded.count()
    if n > MAX_CENTERS:
        raise MemoryLimitError("too many points for dense fits", points=n, limit=MAX_CENTERS)
    numbers = sorted(r["fold"] for r in folded.select("fold").distinct().collect())  # no more than points
    weight = F.col("weight") if "weight" in folded.columns else F.lit(1.0)
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("__nth"), F.lit(f).alias("__fold")) for k in range(len(few)) for f in numbers])).alias("t")
    spread = folded.select("idx", *x, "y", "fold", weight.cast("double").alias("weight"), every).select("*", "t.*").drop("t")

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        c = few[key[0]]
        own = own.sort_values("idx")
        held = (own["fold"] == key[1]).to_numpy()
        parts, shape = {p: c[p] for p in parameters}, anisotropy
        k, a = kernel(parts), shape(parts) if shape else None
        found, _ = solve_dense(*system_of(own[~held], k, dimension, a), own.loc[~held, "y"].to_numpy(float))
        m = int((~held).sum())
        field = FittedField(k, own.loc[~held, x].to_numpy(float), found[:m], found[m:], a)
        miss = field.numbers(own.loc[held, x].to_numpy(float))[:, 0] - own.loc[held, "y"].to_numpy(float)
        w = own.loc[held, "weight"].to_numpy(float)
        return pd.DataFrame({"cand": [c["cand"]], "fold": [key[1]], "weighted_squared_error": [float(w @ miss**2)], "weight": [float(w.sum())]})

    return spread.groupBy("__nth", "__fold").applyInPandas(run, _EVIDENCE)


def distance_scores(median: float, candidates: DataFrame, names: Sequence[str]) -> DataFrame:
    """cand, score: the mean square of the logarithm of each active parameter over the median; null ones are inactive."""
    square = lambda c: F.pow(F.ln(F.col(c)) - F.ln(F.lit(median)), 2)
    total = sum((F.coalesce(square(c), F.lit(0.0)) for c in names), F.lit(0.0))
    active = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return candidates.select("cand", F.try_divide(total, active).alias("score"))


def folds(points: DataFrame, k: int, seed: int) -> DataFrame:
    """idx, fold: points in the seeded order, dealt in turn. The order is that of splitmix64(seed ^ idx * increment)."""
    key = unsigned_order(splitmix64(times(F.col("idx"), INCREMENT).bitwiseXOR(F.lit(seed))))
    placed = ranking.numbered(points.select("idx", key.alias("__key")), ["__key", "idx"], "__place")
    return placed.select("idx", F.pmod("__place", F.lit(k)).alias("fold"))


def cv_scores(evidence: DataFrame) -> DataFrame:
    """cand, score from (cand, fold, weighted_squared_error, weight)."""
    return evidence.groupBy("cand").agg(F.try_divide(F.sum("weighted_squared_error"), F.sum("weight")).alias("score"))


def gcv_scores(evidence: DataFrame) -> DataFrame:
    """cand, score from (cand, rss, n, dof)."""
    return evidence.select("cand", F.try_divide(F.col("n") * F.col("rss"), F.pow(F.col("n") - F.col("dof"), 2)).alias("score"))


def select_minimum(scores: DataFrame, seed: int = 0) -> DataFrame:
    """The row with the smallest score, ties by the seeded order, and ties: how many have it."""
    key = unsigned_order(splitmix64(times(F.col("cand").cast("long"), INCREMENT).bitwiseXOR(F.lit(seed))))
    best = scores.where("score is not null").agg(F.min("score").alias("least"))
    tied = scores.join(F.broadcast(best), scores.score == best.least)
    return tied.agg(F.min_by("cand", F.struct(key, "cand")).alias("cand"), F.min("score").alias("score"), F.count("*").alias("ties"))
