"""Pairs of points within a radius, sparse kernel matrices, and their solution by conjugate gradients.

A distance join is an equi-join on the cells of a grid as wide as the radius: one side goes to its own cell, the other to
the 3^D cells around it, and the exact distance is tested afterwards. Pairs grow with the density of points, not with the
square of their number.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.errors import ConditioningError, InputError
from fieldspark.functions.kernels import Anisotropy, Kernel, distance
from fieldspark.operators.fields import axes
from fieldspark.sessions import checkpointed


def candidate_radius(radius: float, anisotropy: Anisotropy | None) -> float:
    """A radius in plain distance that holds everything within the anisotropic one."""
    if anisotropy is None:
        return radius
    inverse = np.abs(np.linalg.inv(np.asarray(anisotropy.matrix)))
    return float(np.nextafter(radius * np.nextafter(len(inverse) * inverse.max(), np.inf), np.inf))


def within(left: DataFrame, right: DataFrame, radius: float, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """i, j, r for rows (idx, x0 ...) of left and right with a distance below the radius. Null coordinates match nothing."""
    if not radius > 0:
        raise InputError("the radius must be positive", radius=radius)
    x, width = axes(dimension), candidate_radius(radius, anisotropy)
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    a = left.select(F.col("idx").alias("i"), *[F.col(c).alias(f"a_{c}") for c in x], *[cell(c).alias(f"cell_{c}") for c in x])
    around = F.explode(F.array(*[F.struct(*[(cell(c) + F.lit(o)).alias(f"cell_{c}") for c, o in zip(x, offsets)]) for offsets in product((-1, 0, 1), repeat=dimension)]))
    b = right.select(F.col("idx").alias("j"), *[F.col(c).alias(f"b_{c}") for c in x], around.alias("cell")).select("j", *[f"b_{c}" for c in x], "cell.*")
    d = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in x]
    r = distance(anisotropy.separation(d) if anisotropy else d)
    # Pairs, not bytes, are the work: dealt by cell, rows stay apart where Spark would put small tables in few tasks.
    cells = [f"cell_{c}" for c in x]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(tasks, *cells).join(b.repartition(tasks, *cells), cells).select("i", "j", r.alias("r")).where(F.col("r") < radius)


def sparse_matrix(points: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """i, j, v: the nonzero entries of the kernel matrix of a compactly supported kernel."""
    if kernel.support == float("inf"):
        raise InputError("the kernel has no bounded support", family=kernel.family)
    pairs = within(points, points, kernel.support, dimension, anisotropy)
    return pairs.select("i", "j", kernel.radial(F.col("r"))["phi"].alias("v")).where("v <> 0")


def matrix_stats(points: DataFrame, matrix: DataFrame) -> DataFrame:
    """n, nonzeros, off-diagonal pairs, density, longest row and isolated centers of a sparse matrix."""
    rows = matrix.groupBy("i").agg(F.count("*").alias("m"))
    found = rows.agg(F.sum("m").alias("nonzeros"), F.max("m").alias("longest_row"), F.count_if(F.col("m") == 1).alias("isolated"))
    n = points.agg(F.count("*").alias("n"))
    return n.join(found, how="cross").select("n", "nonzeros", F.expr("(nonzeros - n) div 2").alias("pairs"), F.expr("nonzeros / (n * n)").alias("density"), "longest_row", "isolated")


def conjugate_gradients(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-12, most: int = 200) -> DataFrame:
    """idx, w: the solution of a sparse positive definite system (i, j, v) for rhs (idx, y).

    Vectors are tables as long as the system, products a join and a sum, so its size is bounded by no single task; each
    round is kept in the checkpoint folder. The residual is measured against the matrix at the end."""
    matrix = matrix.persist()
    try:
        state = checkpointed(rhs.select("idx", F.lit(0.0).alias("w"), F.col("y").cast("double").alias("r"), F.col("y").cast("double").alias("p")))
        size = rhs.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 0.0
        rr = size**2
        for _ in range(most):
            if rr**0.5 <= tolerance * size:
                break
            product_ = matrix.join(state, matrix.j == state.idx).groupBy("i").agg(F.sum(F.col("v") * F.col("p")).alias("q"))
            joined = checkpointed(state.join(product_, state.idx == product_.i).select("idx", "w", "r", "p", "q"))
            pq = joined.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
            if not pq > 0:
                raise ConditioningError("the matrix is not positive definite")
            step = rr / pq
            moved = joined.select("idx", (F.col("w") + step * F.col("p")).alias("w"), (F.col("r") - step * F.col("q")).alias("r"), "p")
            after = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
            state = checkpointed(moved.select("idx", "w", "r", (F.col("r") + (after / rr) * F.col("p")).alias("p")))
            rr = after
        product_ = matrix.join(state, matrix.j == state.idx).groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("q"))
        worst = product_.join(rhs, product_.i == rhs.idx).agg(F.max(F.abs(F.col("q") - F.col("y")))).first()[0] or 0.0
        if worst > 1e3 * tolerance * max(size, 1e-300):
            raise ConditioningError("the residual is too large", residual=worst)
        return state.select("idx", "w")
    finally:
        matrix.unpersist()


def fit_sparse(points: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """idx, w: weights of a field with a compactly supported kernel through points (idx, x0 ..., y)."""
    return conjugate_gradients(sparse_matrix(points, kernel, dimension, anisotropy), points.select("idx", "y"))


def evaluate_sparse(queries: DataFrame, points: DataFrame, weights: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """idx, f, visited: the value at each query (idx, x0 ...) from the centers in its support, and how many there are."""
    weighted = points.join(weights, "idx").select("idx", *axes(dimension), "w")
    near = within(queries, weighted, kernel.support, dimension, anisotropy).join(weights.withColumnRenamed("idx", "j"), "j")
    summed = near.groupBy("i").agg(F.sum(F.col("w") * kernel.radial(F.col("r"))["phi"]).alias("f"), F.count("*").alias("visited"))
    return queries.select("idx").join(summed, queries.idx == summed.i, "left").select("idx", F.coalesce("f", F.lit(0.0)).alias("f"), F.coalesce("visited", F.lit(0)).alias("visited"))


