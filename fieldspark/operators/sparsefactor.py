"""Sparse positive definite systems by Cholesky factors, a factor for each connected component.

Components of the matrix's graph are independent systems: they are found by a distributed union (``graphs.components``), and each
is factorised in a task of its own, all side by side. Within a component unknowns are eliminated in an order of least
degree; the elimination tree passes each unknown's dense update to its parent, so that work and memory follow the
factor's entries and not the square of the component. A component whose factor would have more than ``MAX_FACTOR`` entries
is refused before anything is computed; conjugate gradients (``neighbors.conjugate_gradients``) take such systems.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.errors import ConditioningError, InputError, MemoryLimitError
from fieldspark.functions import exact
from fieldspark.functions.kernels import Anisotropy, Kernel
from fieldspark.operators import graphs, neighbors

MAX_FACTOR = 20_000_000
MAX_COMPONENT = 100_000
EPS = float(np.finfo(float).eps)


@dataclass
class Symbolic:
    """The order of elimination, and for each unknown (in that order) the later ones that its column of the factor has."""

    order: np.ndarray
    columns: list[np.ndarray]
    parent: np.ndarray

    @property
    def entries(self) -> int:
        return len(self.order) + sum(map(len, self.columns))


def least_degree(n: int, rows: np.ndarray, columns: np.ndarray, most: int = MAX_FACTOR) -> Symbolic:
    """Eliminates the unknown with the fewest neighbours, ties by number, and joins its neighbours to each other. The graph of
    what is left is kept as cliques: an eliminated unknown's neighbours are one clique, which absorbs those it was in."""
    near: list[set[int]] = [set() for _ in range(n)]
    for i, j in zip(rows.tolist(), columns.tolist()):
        if i != j:
            near[i].add(j)
    cliques: dict[int, set[int]] = {}
    within: list[set[int]] = [set() for _ in range(n)]
    degree = [len(s) for s in near]
    queue = [(d, k) for k, d in enumerate(degree)]
    heapify(queue)
    done, order, found, total = [False] * n, [], [], n
    while queue:
        d, k = heappop(queue)
        if done[k] or d != degree[k]:
            continue
        own = near[k].union(*(cliques[c] for c in within[k]))
        own.discard(k)
        done[k] = True
        order.append(k)
        found.append(own)
        total += len(own)
        if total > most:
            raise MemoryLimitError("the factor of a component has too many entries", limit=most, unknowns=n)
        absorbed = within[k]
        for c in absorbed:
            del cliques[c]
        cliques[k] = set(own)
        for j in own:
            within[j] -= absorbed
            within[j].add(k)
            near[j] -= own
            near[j].discard(k)
            for c in within[j]:
                cliques[c].discard(k)
            degree[j] = len(near[j].union(*(cliques[c] for c in within[j])) - {j})
            heappush(queue, (degree[j], j))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    below = [np.sort(place[list(s)]) if s else np.empty(0, np.int64) for s in found]
    parent = np.array([b[0] if len(b) else -1 for b in below], np.int64)
    return Symbolic(np.array(order, np.int64), below, parent)


@dataclass
class Factor:
    """Pivots' roots and columns of L, with L L' = P A P'."""

    symbolic: Symbolic
    diagonal: np.ndarray
    values: list[np.ndarray]

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b[self.symbolic.order].astype(float)
        for k, (below, values) in enumerate(zip(self.symbolic.columns, self.values)):
            x[k] /= self.diagonal[k]
            x[below] -= values * x[k]
        for k in range(len(x) - 1, -1, -1):
            x[k] = (x[k] - self.values[k] @ x[self.symbolic.columns[k]]) / self.diagonal[k]
        made = np.empty(len(x))
        made[self.symbolic.order] = x
        return made


def factorize(n: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, most: int = MAX_FACTOR) -> Factor:
    """The Cholesky factor of a symmetric matrix given by all its entries. A pivot that is not positive is an error."""
    symbolic = least_degree(n, rows, columns, most)
    place = np.empty(n, np.int64)
    place[symbolic.order] = np.arange(n)
    i, j = place[rows], place[columns]
    lower = i >= j
    i, j, v = i[lower], j[lower], values[lower]
    by = np.lexsort([i, j])
    i, j, v = i[by], j[by], v[by]
    begins = np.searchsorted(j, np.arange(n + 1))
    updates: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    diagonal, made = np.empty(n), []
    for k in range(n):
        index = np.concatenate([[k], symbolic.columns[k]])
        front = np.zeros((len(index), len(index)))
        own = slice(begins[k], begins[k + 1])
        front[np.searchsorted(index, i[own]), 0] += v[own]
        for theirs, update in updates[k]:
            at = np.searchsorted(index, theirs)
            front[np.ix_(at, at)] += update
        updates[k] = []
        if not front[0, 0] > 0:
            raise ConditioningError("the matrix is not positive definite", pivot=float(front[0, 0]))
        diagonal[k] = np.sqrt(front[0, 0])
        column = front[1:, 0] / diagonal[k]
        made.append(column)
        if len(column):
            updates[symbolic.parent[k]].append((index[1:], front[1:, 1:] - np.outer(column, column)))
    return Factor(symbolic, diagonal, made)


SOLUTION = "component long, idx long, w double, entries long, backward_error double"


def _solved(key: tuple, entries: pd.DataFrame) -> pd.DataFrame:
    """One component: rows (i, j, v), and (i, null, y) for the right-hand side."""
    side = entries["j"].isna()
    names = np.sort(entries.loc[side, "i"].to_numpy(np.int64))
    n = len(names)
    if n > MAX_COMPONENT:
        raise MemoryLimitError("a component has too many unknowns for one factor", unknowns=n, limit=MAX_COMPONENT)
    if len(np.unique(names)) < n:
        raise InputError("an unknown has two right-hand sides")
    b = np.empty(n)
    b[np.searchsorted(names, entries.loc[side, "i"])] = entries.loc[side, "v"]
    rows, columns = (np.searchsorted(names, entries.loc[~side, c].to_numpy(np.int64)) for c in ("i", "j"))
    values = entries.loc[~side, "v"].to_numpy(float)
    factor = factorize(n, rows, columns, values)
    x = factor.solve(b)
    left = exact.residuals(rows, columns, values, x, b)
    error = exact.backward_error(left, np.bincount(rows, np.abs(values), n), x, b)
    if not error <= 128 * n * EPS:
        raise ConditioningError("the residual is too large", backward_error=error)
    return pd.DataFrame({"component": key[0], "idx": names, "w": x, "entries": factor.symbolic.entries, "backward_error": error})


def solve_factored(matrix: DataFrame, rhs: DataFrame) -> DataFrame:
    """SOLUTION of a sparse symmetric positive definite system (i, j, v, both triangles) for rhs (idx, y): component is the
    smallest unknown of the connected part, entries those of its factor.

    There is no fallback, regularisation or refinement: a pivot that is not positive, or a residual (of exact sums) beyond
    128 n eps, is an error. An unknown without an entry of the matrix is an error too; an empty system has no rows."""
    roots = graphs.components(matrix.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b")))
    named = rhs.select(F.col("idx").cast("long").alias("i"), F.col("y").cast("double").alias("v")).join(roots, F.col("i") == F.col("node"), "left").select("i", "v", F.coalesce("root", "i").alias("component"))
    sides = named.select("component", "i", F.lit(None).cast("long").alias("j"), "v")
    entries = matrix.join(named.select("i", "component"), "i").select("component", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")
    return sides.union(entries).groupBy("component").applyInPandas(_solved, SOLUTION)


def fit_factored(points: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """SOLUTION: weights of a field with a compactly supported kernel through points (idx, x0 ..., y)."""
    return solve_factored(neighbors.sparse_matrix(points, kernel, dimension, anisotropy), points.select("idx", "y"))
