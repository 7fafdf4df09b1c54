"""Linear functionals of a field: sums of values and directional derivatives, and fields fitted to them.

A functional is given by its terms, rows (expr_id, coef, kind, x0 ..., u0 ...): kind is ``value``, the field's value at x,
or ``dderiv``, its derivative along u there; terms of a fit have a field_id too. Applied to polynomials, kernels or sampled
fields, functionals are projections of their terms and sums by expr_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.errors import CapabilityError, InputError
from fieldspark.functions import polynomials
from fieldspark.functions.kernels import Anisotropy, Kernel, jet
from fieldspark.operators.fields import BLOCK, COEFFICIENTS, FittedField, axes, require_centers, solve_dense

VALUE, DERIVATIVE = "value", "dderiv"


def _along(parts: Sequence[Column], dimension: int, prefix: str = "u") -> Column:
    return sum((F.col(f"{prefix}{k}") * parts[k] for k in range(1, dimension)), F.col(f"{prefix}0") * parts[0])


def require_terms(terms: DataFrame, dimension: int) -> DataFrame:
    """The terms, if each is a value or a derivative along a direction with finite numbers; else an error naming one."""
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(c)
    good = finite("coef")
    for c in axes(dimension):
        good = good & finite(c)
    direction = F.lit(False)
    for c in axes(dimension, "u"):
        direction = direction | (finite(c) & (F.col(c) != 0))
    problem = F.when(~F.coalesce(F.col("kind").isin(VALUE, DERIVATIVE), F.lit(False)), "no such kind").when(~good, "a number is not finite").when((F.col("kind") == DERIVATIVE) & ~direction, "no direction")
    first = terms.select("expr_id", problem.alias("problem")).where("problem is not null").first()
    if first is not None:
        raise InputError(first["problem"], expression=first["expr_id"])
    return terms


def derivative_order(terms: DataFrame, by: Sequence[str] = ("expr_id",)) -> DataFrame:
    """The highest derivative in each functional: 0 or 1."""
    return terms.groupBy(*by).agg(F.max((F.col("kind") == DERIVATIVE).cast("int")).alias("derivatives"))


def apply_to_samples(terms: DataFrame, value: Column, gradient: Sequence[Column]) -> DataFrame:
    """expr_id, terms, value: the functionals of a field whose value and gradient at each term's place are columns of it."""
    action = F.when(F.col("kind") == VALUE, value).otherwise(_along(gradient, len(gradient)))
    return terms.groupBy("expr_id").agg(F.count("*").alias("terms"), F.sum(F.col("coef") * action).alias("value"))


def apply_to_polynomials(terms: DataFrame, dimension: int, order: int, by: Sequence[str] = ("expr_id",)) -> DataFrame:
    """expr_id, k, v: the functionals of each polynomial below the order, a row of the action matrix each."""
    x = [F.col(c) for c in axes(dimension)]
    values, slopes = polynomials.values(x, order), polynomials.gradients(x, order)
    actions = [F.when(F.col("kind") == VALUE, v).otherwise(_along(g, dimension)) * F.col("coef") for v, g in zip(values, slopes)]
    summed = terms.groupBy(*by).agg(F.array(*[F.sum(a) for a in actions]).alias("row"))
    return summed.select(*by, F.posexplode("row").alias("k", "v"))


def require_pairs(left: DataFrame, right: DataFrame, kernel: Kernel, dimension: int) -> None:
    """An error if two terms at one place together need a derivative that the kernel does not have at its centers, or any
    two need one that it does not have at all. Terms meet by an equi-join on their places."""
    most = [df.agg(F.max((F.col("kind") == DERIVATIVE).cast("int"))).first()[0] or 0 for df in (left, right)]
    if sum(most) <= kernel.center_order:
        return
    need = lambda df, name: df.select("field_id", *axes(dimension), (F.col("kind") == DERIVATIVE).cast("int").alias(name)).distinct()
    met = need(left, "a").join(need(right, "b"), ["field_id", *axes(dimension)]).where(F.col("a") + F.col("b") > kernel.center_order).first()
    if met is not None:
        raise CapabilityError("the kernel has no such derivative at its centers", family=kernel.family, place=[met[c] for c in axes(dimension)])


def apply_to_kernel(left: DataFrame, right: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """field_id, i, j, v: functional i of ``left`` by the kernel's first argument and functional j of ``right`` by its second,
    for all of a field: a derivative by the second argument has the opposite sign of one by the first."""
    require_pairs(left, right, kernel, dimension)
    side = lambda df, s, name: df.select("field_id", F.col("expr_id").alias(name), *[F.col(c).alias(f"{s}_{c}") for c in ("coef", "kind", *axes(dimension), *axes(dimension, "u"))])
    pairs = side(left, "a", "i").join(side(right, "b", "j"), "field_id")
    made = jet(kernel, [F.col(f"a_{c}") - F.col(f"b_{c}") for c in axes(dimension)], 2, anisotropy)
    first, second = _along(made["g"], dimension, "a_u"), -_along(made["g"], dimension, "b_u")
    both = -sum((F.col(f"a_u{i}") * F.col(f"b_u{j}") * made["h"][i][j] for i in range(dimension) for j in range(dimension)), F.lit(0.0))
    a, b = F.col("a_kind") == VALUE, F.col("b_kind") == VALUE
    action = F.when(a & b, made["value"]).when(b, first).when(a, second).otherwise(both)
    return pairs.groupBy("field_id", "i", "j").agg(F.sum(F.col("a_coef") * F.col("b_coef") * action).alias("v"))


# -- fits


def _actions(kernel: Kernel, anisotropy: Anisotropy | None, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """The kernel under each term of a (a row each) and of b (a column each)."""
    n = range(a["x"].shape[1])
    either = bool(a["d"].any()) + bool(b["d"].any())
    made = jet(kernel, [a["x"][:, k, None] - b["x"][None, :, k] for k in n], either, anisotropy)
    total = np.broadcast_to(made["value"], (len(a["x"]), len(b["x"])))
    if either:
        first, second = sum(a["u"][:, k, None] * made["g"][k] for k in n), -sum(b["u"][None, :, k] * made["g"][k] for k in n)
        both = -sum(a["u"][:, i, None] * b["u"][None, :, j] * made["h"][i][j] for i in n for j in n) if either == 2 else 0.0
        da, db = a["d"][:, None], b["d"][None, :]
        total = np.where(da & db, both, np.where(da, first, np.where(db, second, total)))
    return total * a["coef"][:, None] * b["coef"][None, :]


def _arrays(terms: pd.DataFrame, dimension: int) -> dict[str, np.ndarray]:
    of = lambda prefix: terms[axes(dimension, prefix)].to_numpy(float)
    derivative = (terms["kind"] == DERIVATIVE).to_numpy()
    return {"x": of("x"), "u": np.where(derivative[:, None], np.nan_to_num(of("u")), 0.0), "d": derivative, "coef": terms["coef"].to_numpy(float)}


def fit_functionals(centers: DataFrame, terms: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> DataFrame:
    """COEFFICIENTS of every field whose functionals, ``terms`` (field_id, expr_id, coef, kind, x0 ..., u0 ...), take the
    targets of ``centers`` (field_id, expr_id from 0 without gaps, y): each is an observation and a center. A field is one
    task of at most MAX_CENTERS functionals, which is checked."""
    require_centers(centers)
    require_terms(terms, dimension)
    require_pairs(terms, terms, kernel, dimension)
    lost = centers.join(terms, ["field_id", "expr_id"], "left_anti").first() or terms.join(centers, ["field_id", "expr_id"], "left_anti").first()
    if lost is not None:
        raise InputError("an observation without terms, or terms without one", expression=lost["expr_id"])
    targets = centers.select(F.col("field_id").alias("own_id"), F.col("expr_id").alias("own_expr"), F.col("y").alias("own_y"))

    def solve(key: tuple, own: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        n, arrays = len(y), _arrays(own, dimension)
        owner = own["expr_id"].to_numpy()
        gather = np.zeros((n, len(own)))
        gather[owner, np.arange(len(own))] = 1.0
        k = gather @ _actions(kernel, anisotropy, arrays, arrays) @ gather.T
        basis = polynomials.exponents(dimension, kernel.cpd_order)
        x = [arrays["x"][:, i] for i in range(dimension)]
        p = np.zeros((n, len(basis)))
        for m, e in enumerate(basis):
            value = np.broadcast_to(polynomials.derivative(x, e), len(own))
            slope = sum(arrays["u"][:, i] * polynomials.derivative(x, e, i) for i in range(dimension))
            p[:, m] = gather @ (np.where(arrays["d"], slope, value) * arrays["coef"])
        right = np.zeros(n)
        right[y["own_expr"]] = y["own_y"]
        found, backward = solve_dense((k + k.T) / 2, p, right)
        roles = np.where(np.arange(len(found)) < n, "center", "poly")
        return pd.DataFrame({"field_id": key[0], "role": roles, "idx": np.where(roles == "center", np.arange(len(found)), np.arange(len(found)) - n), "value": found, "backward_error": backward})

    return terms.groupBy("field_id").cogroup(targets.groupBy("own_id")).applyInPandas(solve, COEFFICIENTS)


@dataclass(frozen=True)
class FunctionalField(FittedField):
    """A field whose centers are functionals: centers and weights are those of the terms; directions are 0 for values."""

    directions: np.ndarray | None = None
    derivative: np.ndarray | None = None

    @property
    def center_derivatives(self) -> int:
        return int(self.derivative.any())

    def by_expressions(self, order: int) -> bool:
        return False

    def numbers(self, x: np.ndarray, order: int = 0) -> np.ndarray:
        n = range(self.dimension)
        values = FittedField(self.kernel, self.centers[~self.derivative], self.weights[~self.derivative], self.polynomial, self.anisotropy)
        made = values.numbers(x, order)
        centers, weights, u = (a[self.derivative] for a in (self.centers, self.weights, self.directions))
        step = max(1, BLOCK // max(1, len(centers)))
        for at in range(0, len(x) if len(centers) else 0, step):
            block = x[at : at + step]
            j = jet(self.kernel, [block[:, k, None] - centers[None, :, k] for k in n], order + 1, self.anisotropy)
            parts = [sum(j["g"][k] * u[:, k] for k in n)]
            if order >= 1:
                parts += [sum(j["h"][i][k] * u[:, k] for k in n) for i in n]
            if order >= 2:
                parts += [sum(j["t"][i][l][k] * u[:, k] for k in n) for i in n for l in n]  # noqa: E741
            for k, part in enumerate(parts):
                made[at : at + step, k] -= (part * weights).sum(1)
        return made


def fit_functional_field(centers: DataFrame, terms: DataFrame, kernel: Kernel, dimension: int, anisotropy: Anisotropy | None = None) -> FunctionalField:
    """One field as an object: its terms and coefficients come to the driver, MAX_CENTERS functionals at most."""
    found = fit_functionals(centers, terms, kernel, dimension, anisotropy).toPandas().sort_values("idx")
    own = terms.orderBy("expr_id").toPandas()
    arrays = _arrays(own, dimension)
    of = lambda role: found.loc[found["role"] == role, "value"].to_numpy()
    return FunctionalField(kernel, arrays["x"], of("center")[own["expr_id"].to_numpy()] * arrays["coef"], of("poly"), anisotropy, arrays["u"], arrays["d"])
