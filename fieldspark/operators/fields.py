"""Fitting and evaluating fields: f(x) = sum of w_j k(x, x_j) + polynomial.

The centers of a field go to one bounded task that makes the kernel matrix and factorises it, so many fields are fitted
side by side and no matrix is shuffled; a field with more than ``MAX_CENTERS`` centers is refused before anything is
computed. Evaluation is a map over the points: nothing is shuffled, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldspark.errors import CapabilityError, InputError, MemoryLimitError
from fieldspark.functions import polynomials
from fieldspark.functions.kernels import Anisotropy, Kernel, jet
from fieldspark.operators import densefactor
from fieldspark.operators.densefactor import SolveOptions

MAX_CENTERS = 4_000
#: Centers times results (a value, its derivatives) up to which a field is evaluated by expressions that Spark runs itself.
EXPRESSION_CENTERS = 32
#: Tasks that the fields to be fitted are dealt over, at least.
TASKS = 200
#: Kernel evaluations at once in an Arrow task.
BLOCK = 1 << 18


def axes(dimension: int, prefix: str = "x") -> list[str]:
    return [f"{prefix}{k}" for k in range(dimension)]


# -- assembly


def require_centers(centers: DataFrame) -> None:
    """An error if a field has more than MAX_CENTERS centers."""
    largest = centers.groupBy("field_id").count().agg(F.max("count")).first()[0] or 0
    if largest > MAX_CENTERS:
        raise MemoryLimitError("too many centers for a dense matrix", centers=largest, limit=MAX_CENTERS)


def kernel_pairs(centers: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """field_id, i, j, v: the upper triangle of each field's kernel matrix from centers (field_id, idx, x0 ...)."""
    require_centers(centers)
    x = axes(dimension)
    left = centers.select("field_id", F.col("idx").alias("i"), *[F.col(c).alias(f"a_{c}") for c in x])
    right = centers.select("field_id", F.col("idx").alias("j"), *[F.col(c).alias(f"b_{c}") for c in x])
    pairs = left.join(right, "field_id").where("i <= j")
    d = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in x]
    return pairs.select("field_id", "i", "j", jet(kernel, d, 0, anisotropy)["value"].alias("v"))


def augmented(centers: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """field_id, i, j, v: the whole symmetric system, with the polynomial rows and columns after the centers'."""
    upper = kernel_pairs(centers, kernel, dimension, anisotropy)
    both = upper.union(upper.where("i < j").select("field_id", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    terms = polynomials.values([F.col(c) for c in axes(dimension)], kernel.cpd_order) if kernel.cpd_order else []
    if not terms:
        return both
    sizes = centers.groupBy("field_id").agg((F.max("idx") + 1).alias("n"))
    rows = centers.join(sizes, "field_id").select("field_id", "idx", F.posexplode(F.array(*terms)).alias("k", "v"), "n")
    block = rows.select("field_id", F.col("idx").alias("i"), (F.col("n") + F.col("k")).alias("j"), "v")
    return both.union(block).union(block.select("field_id", F.col("j").alias("i"), F.col("i").alias("j"), "v"))


# -- solving


def rank_review(matrix: np.ndarray) -> int:
    """The rank after equilibration; a singular value near the threshold is an error rather than a guess."""
    return densefactor.require_rank(matrix, agree=False).svd_rank


null_space = densefactor.null_space


def solve_dense(k: np.ndarray, p: np.ndarray, y: np.ndarray, options: SolveOptions = SolveOptions()) -> tuple[np.ndarray, float]:
    """Weights and polynomial coefficients, and the backward error. Nothing is regularised unless the options say so: a
    kernel matrix that is not positive definite where it should be, or a residual beyond 128 n eps, is an error."""
    made = densefactor.solve(k, p, y, options)
    return made.found, made.backward_error


def dealt(centers: DataFrame) -> DataFrame:
    """The centers dealt by their field: few rows are much work, and Spark would put many fields in one task by their bytes."""
    return centers.repartition(max(TASKS, centers.sparkSession.sparkContext.defaultParallelism), "field_id")


COEFFICIENTS = "field_id long, role string, idx int, value double, backward_error double"


def system_of(own: pd.DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None) -> tuple[np.ndarray, np.ndarray]:
    """The kernel matrix and the polynomial's columns of one field's centers, in their order."""
    x = own[axes(dimension)].to_numpy(float)
    n, basis = len(x), polynomials.exponents(dimension, kernel.cpd_order)
    k = np.empty((n, n))
    step = max(1, BLOCK // max(1, n))
    for at in range(0, n, step):
        k[at : at + step] = jet(kernel, [x[at : at + step, i, None] - x[None, :, i] for i in range(dimension)], 0, anisotropy)["value"]
    return k, np.stack([np.broadcast_to(polynomials.derivative(list(x.T), e), n) for e in basis], 1) if basis else np.empty((n, 0))


def fit(centers: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None, options: SolveOptions = SolveOptions()) -> DataFrame:
    """COEFFICIENTS of every field of centers (field_id, idx from 0 without gaps, x0 ..., y)."""
    require_centers(centers)

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        k, p = system_of(own, kernel, dimension, anisotropy)
        found, backward = solve_dense(k, p, own["y"].to_numpy(float), options)
        n = len(own)
        roles = np.where(np.arange(len(found)) < n, "center", "poly")
        return pd.DataFrame({"field_id": key[0], "role": roles, "idx": np.where(roles == "center", np.arange(len(found)), np.arange(len(found)) - n), "value": found, "backward_error": backward})

    return dealt(centers.select("field_id", "idx", *axes(dimension), "y")).groupBy("field_id").applyInPandas(solve, COEFFICIENTS)


def fit_review(centers: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None, options: SolveOptions = SolveOptions()) -> DataFrame:
    """What a fit of each field would meet: field_id, condition of the system that is solved, its inertia (positive,
    negative, zero; null for Cholesky factors), steps of refinement, backward_error."""
    require_centers(centers)

    def review(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        made = densefactor.solve(*system_of(own, kernel, dimension, anisotropy), own["y"].to_numpy(float), options)
        signs = made.inertia or (None, None, None)
        return pd.DataFrame({"field_id": [key[0]], "condition": [made.condition], **{n: pd.array([v], "Int64") for n, v in zip(("positive", "negative", "zero"), signs)}, "refinements": [made.refinements], "backward_error": [made.backward_error]})

    return dealt(centers.select("field_id", "idx", *axes(dimension), "y")).groupBy("field_id").applyInPandas(review, "field_id long, condition double, positive long, negative long, zero long, refinements long, backward_error double")


def polynomial_ranks(centers: DataFrame, order: int, dimension: int) -> DataFrame:
    """field_id, decision (full, deficient or ambiguous), svd_rank and qr_rank of each field's polynomial of degree below the
    order at its centers."""

    def review(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x = [own[c].to_numpy(float) for c in axes(dimension)]
        p = np.stack([np.broadcast_to(polynomials.derivative(x, e), len(own)) for e in polynomials.exponents(dimension, order)], 1)
        made = densefactor.decide_rank(p)
        return pd.DataFrame({"field_id": [key[0]], "decision": [made.decision], "svd_rank": [made.svd_rank], "qr_rank": [made.qr_rank]})

    return centers.select("field_id", *axes(dimension)).groupBy("field_id").applyInPandas(review, "field_id long, decision string, svd_rank long, qr_rank long")


def projected_energies(centers: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """field_id, nth, energy: eigenvalues, ascending, of each field's kernel matrix within the null space of its polynomial."""
    require_centers(centers)

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        k, p = system_of(own.sort_values("idx"), kernel, dimension, anisotropy)
        values = densefactor.polynomial_energies(k, p)
        return pd.DataFrame({"field_id": key[0], "nth": np.arange(len(values)), "energy": values})

    return dealt(centers.select("field_id", "idx", *axes(dimension))).groupBy("field_id").applyInPandas(run, "field_id long, nth long, energy double")


# -- fitted fields


@dataclass(frozen=True)
class FittedField:
    """Centers (rows), weights and polynomial coefficients of one field."""

    kernel: Kernel
    centers: np.ndarray
    weights: np.ndarray
    polynomial: np.ndarray
    anisotropy: Anisotropy | None = None

    @property
    def dimension(self) -> int:
        return self.centers.shape[1]

    @property
    def center_derivatives(self) -> int:
        """The derivatives that the centers themselves take of the kernel."""
        return 0

    def by_expressions(self, order: int) -> bool:
        """Whether Spark evaluates the field as an expression: few centers times results, or planning takes longer than work."""
        return len(self.centers) * len(self.names(order)) <= EXPRESSION_CENTERS

    def _apart(self, x: np.ndarray) -> None:
        if len(self.centers) and (np.abs(x[:, None, :] - self.centers[None]).max(axis=2) == 0).any():
            raise CapabilityError("the kernel has no such derivative at its centers, and a point is one", family=self.kernel.family)

    def _contributions(self, x: list[Any], center: Sequence[Any], weight: Any, order: int) -> list[Any]:
        n = range(self.dimension)
        made = jet(self.kernel, [a - b for a, b in zip(x, center)], order, self.anisotropy)
        parts = [made["value"]] + (made["g"] if order >= 1 else []) + ([made["h"][i][j] for i in n for j in n] if order >= 2 else [])
        return [p * weight for p in parts]

    def _polynomial(self, x: list[Any], order: int) -> list[Any]:
        n, basis = range(self.dimension), polynomials.exponents(self.dimension, self.kernel.cpd_order)
        orders = [()] + ([(i,) for i in n] if order >= 1 else []) + ([(i, j) for i in n for j in n] if order >= 2 else [])
        zero = x[0] * 0.0
        return [sum((polynomials.derivative(x, e, *o) * float(c) for e, c in zip(basis, self.polynomial)), zero) for o in orders]

    def names(self, order: int, prefix: str = "f") -> list[str]:
        n = range(self.dimension)
        return [prefix] + ([f"{prefix}_{i}" for i in n] if order >= 1 else []) + ([f"{prefix}_{i}{j}" for i in n for j in n] if order >= 2 else [])

    def expressions(self, x: list[Column], order: int = 0) -> list[Column]:
        """Value, gradient and Hessian as columns: a fold over the centers, in their order."""
        total = self._polynomial(x, order)
        if len(self.centers):
            each = F.array(*[F.struct(*[F.lit(float(c)).alias(f"c{k}") for k, c in enumerate(row)], F.lit(float(w)).alias("w")) for row, w in zip(self.centers, self.weights)])
            names = self.names(order)
            start = F.struct(*[F.lit(0.0).alias(n) for n in names])

            def add(state: Column, center: Column) -> Column:
                parts = self._contributions(x, [center[f"c{k}"] for k in range(self.dimension)], center["w"], order)
                return F.struct(*[(state[n] + p).alias(n) for n, p in zip(names, parts)])

            summed = F.aggregate(each, start, add)
            total = [summed[n] + t for n, t in zip(names, total)]
        return total

    def numbers(self, x: np.ndarray, order: int = 0) -> np.ndarray:
        """The same for an array of points, a row each; points are taken in blocks."""
        made = np.empty((len(x), len(self.names(order))))
        step = max(1, BLOCK // max(1, len(self.centers)))
        for at in range(0, len(x), step):
            block = x[at : at + step]
            parts = self._contributions([block[:, k, None] for k in range(self.dimension)], self.centers.T, self.weights, order)
            rest = self._polynomial([block[:, k] for k in range(self.dimension)], order)
            for k, (p, q) in enumerate(zip(parts, rest)):
                made[at : at + step, k] = np.broadcast_to(p, (len(block), len(self.centers))).sum(1) + q
        return made

    def function(self, along: int = 0) -> Callable[[list[np.ndarray]], np.ndarray]:
        """The value, or with ``along`` the derivative by that coordinate (from 1), for arrays of coordinates."""
        return lambda x: self.numbers(np.stack(x, 1), 1 if along else 0)[:, along]

    def evaluate(self, points: DataFrame, columns: Sequence[str] | None = None, order: int = 0, prefix: str = "f") -> DataFrame:
        """points with f, f_0 ... and f_00 ... as the order asks. Null coordinates give null results. Where the kernel has
        such derivatives off its centers only, a point at one is an error."""
        demand = order + self.center_derivatives
        self.kernel.require(demand, away=True)
        apart = self.kernel.capability(demand) == "away"
        columns = list(columns or axes(self.dimension))
        names = self.names(order, prefix)
        if set(names) & set(points.columns):
            raise InputError("the result's names are taken", names=sorted(set(names) & set(points.columns)))
        if self.by_expressions(order) and not apart:
            made = self.expressions([F.col(c).cast("double") for c in columns], order)
            return points.select("*", *[m.alias(n) for m, n in zip(made, names)])
        shared = points.sparkSession.sparkContext.broadcast(self)  # at most MAX_CENTERS centers

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [batch.schema.get_field_index(c) for c in columns]
                x = np.stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in at], 1)
                some = np.logical_or.reduce([batch.column(k).is_null().to_numpy(zero_copy_only=False) for k in at])
                if apart:
                    shared.value._apart(x[~some])
                found = shared.value.numbers(x, order)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[:, k].copy(), mask=some) for k in range(len(names))]], [*batch.schema.names, *names])

        return points.mapInArrow(run, StructType([*points.schema.fields, *[StructField(n, DoubleType()) for n in names]]))


def collect_field(centers: DataFrame, coefficients: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> FittedField:
    """One field as an object: MAX_CENTERS rows at most come to the driver."""
    rows = centers.orderBy("idx").limit(MAX_CENTERS + 1).toPandas()
    if len(rows) > MAX_CENTERS:
        raise MemoryLimitError("too many centers", limit=MAX_CENTERS)
    found = coefficients.toPandas().sort_values("idx")
    of = lambda role: found.loc[found["role"] == role, "value"].to_numpy()
    return FittedField(kernel, rows[axes(dimension)].to_numpy(float), of("center"), of("poly"), anisotropy)


def fit_field(centers: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> FittedField:
    return collect_field(centers, fit(centers, kernel, dimension, anisotropy), kernel, dimension, anisotropy)
