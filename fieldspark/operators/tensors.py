"""Orientation tensors: weighted means of n n', their axes, and how much each sample matters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldspark.errors import InputError


def _pairs(dimension: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dimension) for j in range(i, dimension)]


def tensor(samples: DataFrame, directions: Sequence[str], weight: str, by: Sequence[str] = ()) -> DataFrame:
    """c_ij of the normalised tensor (trace 1) of unit directions, for each group; total is the sum of weights. Sums are
    partial before they are shuffled, so a group may have any number of samples. Weights that sum to 0 give nulls."""
    moments = [F.sum(F.col(weight) * F.col(directions[i]) * F.col(directions[j])).alias(f"s_{i}{j}") for i, j in _pairs(len(directions))]
    sums = samples.groupBy(*by).agg(F.sum(weight).alias("total"), *moments)
    return sums.select(*by, "total", *[F.try_divide(f"s_{i}{j}", "total").alias(f"c_{i}{j}") for i, j in _pairs(len(directions))])


def axes_2d(c00: Column, c01: Column, c11: Column) -> dict[str, Column]:
    """Eigenvalues, the first axis (its larger component positive) and the gap of a symmetric 2 x 2 tensor."""
    half = (c00 - c11) / 2.0
    root = F.sqrt(half * half + c01 * c01)
    mean = (c00 + c11) / 2.0
    # the larger of two equivalent forms of the eigenvector
    x = F.when(half >= 0, half + root).otherwise(c01)
    y = F.when(half >= 0, c01).otherwise(root - half)
    length = F.sqrt(x * x + y * y)
    sign = F.when(F.abs(x) >= F.abs(y), F.when(x < 0, -1.0).otherwise(1.0)).otherwise(F.when(y < 0, -1.0).otherwise(1.0))
    flat = length == 0
    return {"l0": mean + root, "l1": mean - root, "gap": root * 2.0, "u0": F.when(flat, 1.0).otherwise(sign * F.try_divide(x, length)), "u1": F.when(flat, 0.0).otherwise(sign * F.try_divide(y, length))}


def axes_3d(tensors: DataFrame) -> DataFrame:
    """tensors (c_00 ... c_22) with eigenvalues l0 >= l1 >= l2, axes a_kj and gaps g0, g1; a few numbers a row, in batches."""
    added = [f"l{k}" for k in range(3)] + [f"a_{k}{j}" for k in range(3) for j in range(3)] + ["g0", "g1"]

    def run(batches):
        for rows in batches:
            c = np.empty((len(rows), 3, 3))
            for i, j in _pairs(3):
                c[:, i, j] = c[:, j, i] = rows[f"c_{i}{j}"]
            values, vectors = np.linalg.eigh(np.nan_to_num(c))
            values, vectors = values[:, ::-1], vectors[:, :, ::-1].transpose(0, 2, 1)
            top = np.abs(np.round(vectors, 12)).argmax(2)
            vectors = vectors * np.sign(np.take_along_axis(vectors, top[:, :, None], 2))
            made = np.concatenate([values, vectors.reshape(-1, 9), values[:, :2] - values[:, 1:]], 1)
            yield pd.concat([rows.reset_index(drop=True), pd.DataFrame(made, columns=added)], axis=1)

    return tensors.mapInPandas(run, StructType([*tensors.schema.fields, *[StructField(name, DoubleType()) for name in added]]))


def influence(samples: DataFrame, directions: Sequence[str], weight: str, key: str) -> DataFrame:
    """key, influence: the distance (Frobenius, over the root of 2) between the tensor and the one without the sample.
    The tensor without a sample follows from the sums, so this is one aggregate and one map."""
    n = len(directions)
    sums = samples.agg(F.sum(weight).alias("total"), *[F.sum(F.col(weight) * F.col(directions[i]) * F.col(directions[j])).alias(f"s_{i}{j}") for i, j in _pairs(n)])
    joined = samples.join(F.broadcast(sums), how="cross")  # one row
    rest = F.col("total") - F.col(weight)
    squares = F.lit(0.0)
    for i, j in _pairs(n):
        own = F.col(weight) * F.col(directions[i]) * F.col(directions[j])
        change = F.col(f"s_{i}{j}") / F.col("total") - F.try_divide(F.col(f"s_{i}{j}") - own, rest)
        squares = squares + change * change * (1.0 if i == j else 2.0)
    found = F.when(F.col(weight) == 0, 0.0).when(rest <= 0, 1.0).otherwise(F.sqrt(squares / 2.0))
    return joined.select(key, found.alias("influence"))


def ratio_cv(samples: DataFrame, directions: Sequence[str], weight: str, ratios: Sequence[float]) -> DataFrame:
    """ratio, loss: for each axis ratio of a 2-D anisotropy, the weighted mean over samples of minus the logarithm of the
    share that the leave-one-out axes give the sample's direction; the smallest loss fits best."""
    sums = samples.agg(F.sum(weight).alias("total"), *[F.sum(F.col(weight) * F.col(directions[i]) * F.col(directions[j])).alias(f"s_{i}{j}") for i, j in _pairs(2)])
    joined = samples.join(F.broadcast(sums), how="cross").where(F.col("total") > F.col(weight))
    left = [(F.col(f"s_{i}{j}") - F.col(weight) * F.col(directions[i]) * F.col(directions[j])) / (F.col("total") - F.col(weight)) for i, j in _pairs(2)]
    axes = axes_2d(*left)
    along = F.pow(F.col(directions[0]) * axes["u0"] + F.col(directions[1]) * axes["u1"], 2)
    each = joined.select(F.col(weight).alias("w"), along.alias("along"))
    scored = each.select("w", F.explode(F.array(*[F.struct(F.lit(float(r)).alias("ratio"), ((F.col("along") * (r * r) + 1 - F.col("along")) / (r * r + 1)).alias("share")) for r in ratios])).alias("s"))
    return scored.groupBy("s.ratio").agg((F.sum(-F.col("w") * F.ln("s.share")) / F.sum("w")).alias("loss"))


def axis_review(eigen: DataFrame, values: Sequence[str], isotropic: float) -> DataFrame:
    """eigen with gap_k, the share of the sum by which each eigenvalue (in descending order) exceeds the next, and isotropic:
    whether the largest exceeds the smallest by that share at most."""
    if not 0 <= isotropic <= 1:
        raise InputError("the threshold is a share", threshold=isotropic)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    gaps = {f"gap_{k}": F.try_divide(F.col(a) - F.col(b), total) for k, (a, b) in enumerate(zip(values, values[1:]))}
    return eigen.withColumns(gaps).withColumn("isotropic", F.try_divide(F.col(values[0]) - F.col(values[-1]), total) <= isotropic)


def fixed_ratios(eigen: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """eigen with ratio_k, lengths along the axes over the shortest: finite, in descending order, the last one 1."""
    if not ratios or ratios[-1] != 1 or any(not a >= b or not a < float("inf") for a, b in zip(ratios, ratios[1:])):
        raise InputError("ratios must be finite, descending and end at 1", ratios=list(ratios))
    return eigen.withColumns({f"ratio_{k}": F.lit(float(r)) for k, r in enumerate(ratios)})
