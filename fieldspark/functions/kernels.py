"""Radial kernels and their derivatives, written once for Spark columns and numpy arrays.

A kernel gives phi, its first three derivatives d1, d2, d3 by the radius, and a = phi'/r and b = (phi'' - a)/r in their
direct forms, which stay finite where the quotients do not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import inf
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from fieldspark.errors import CapabilityError, InputError
from fieldspark.functions import exact


class _Spark:
    exp, sqrt = staticmethod(F.exp), staticmethod(F.sqrt)

    @staticmethod
    def where(condition: Column, yes: Any, no: Any) -> Column:
        return F.when(condition, yes).otherwise(no)

    @staticmethod
    def ln(x: Column) -> Column:
        return F.ln(F.when(x > 0, x).otherwise(1.0))


class _Numpy:
    exp, sqrt, where = staticmethod(np.exp), staticmethod(np.sqrt), staticmethod(np.where)

    @staticmethod
    def ln(x: np.ndarray) -> np.ndarray:
        return np.log(np.where(x > 0, x, 1.0))


def _power(x: Any, n: int) -> Any:
    """x^n by products; 1 for n <= 0, which callers multiply by 0 or guard."""
    made = x * 0.0 + 1.0
    for _ in range(max(n, 0)):
        made = made * x
    return made


FAMILIES = ("gaussian", "imq", "mq", "matern12", "matern32", "matern52", "phs", "wendland_c2", "wendland_c4", "wendland_c6")


@dataclass(frozen=True)
class Kernel:
    """family and its parameter: a length, a support radius for Wendland kernels, a positive integer power for phs."""

    family: str
    parameter: float = 1.0

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise InputError("no such kernel", family=self.family)
        if not 0 < self.parameter < inf or self.family == "phs" and self.parameter != int(self.parameter):
            raise InputError("the parameter must be positive and finite, a power an integer", parameter=self.parameter)

    @staticmethod
    def surface_spline(dimension: int, order: int) -> Kernel:
        """The polyharmonic spline that minimises derivatives of the order in the dimension."""
        if 2 * order <= dimension:
            raise InputError("twice the order must exceed the dimension", order=order)
        return Kernel("phs", 2 * order - dimension)

    @property
    def support(self) -> float:
        """The radius from which the kernel is 0."""
        return self.parameter if self.family.startswith("wendland") else inf

    @property
    def cpd_order(self) -> int:
        """0 for positive definite kernels, else the order of conditional definiteness: polynomials below it are added."""
        return int(self.parameter) // 2 + 1 if self.family == "phs" else int(self.family == "mq")

    @property
    def center_order(self) -> int:
        """The highest derivative that exists at distance 0."""
        if self.family == "phs":
            return min(int(self.parameter) - 1, 3)
        return {"matern12": 0, "matern32": 2, "wendland_c2": 2}.get(self.family, 3)

    def capability(self, order: int) -> str:
        """everywhere, away (from the centers only) or unsupported: where the derivatives of an order exist."""
        return "unsupported" if order > 3 else "everywhere" if order <= self.center_order else "away"

    def require(self, order: int, away: bool = False) -> None:
        """An error if the derivatives do not exist, or with ``away`` not even off the centers."""
        if self.capability(order) == "unsupported":
            raise CapabilityError("derivatives end at the third", order=order)
        if self.capability(order) == "away" and not away:
            raise CapabilityError("the kernel has no such derivative at its centers", family=self.family, order=order)

    def radial(self, r: Any) -> dict[str, Any]:
        """phi, d1, d2, d3, a, b as columns or arrays of the radius r >= 0."""
        m = _Spark if isinstance(r, Column) else _Numpy
        if self.family == "phs":
            return self._phs(r, m)
        if self.family.startswith("wendland"):
            return self._wendland(r, m)
        if self.family.startswith("matern"):
            return self._matern(r, m)
        al = 1.0 / self.parameter
        q = r * al
        if self.family == "gaussian":
            phi = m.exp(q * q * -0.5)
            return {"phi": phi, "d1": q * phi * -al, "d2": (q * q - 1.0) * phi * al**2, "d3": q * (3.0 - q * q) * phi * al**3, "a": phi * -(al**2), "b": q * phi * al**3}
        h2 = q * q + 1.0
        h = m.sqrt(h2)
        if self.family == "imq":
            h3, h5 = h * h2, h * h2 * h2
            return {"phi": 1.0 / h, "d1": q / h3 * -al, "d2": (q * q * 2.0 - 1.0) / h5 * al**2, "d3": q * (3.0 - q * q * 2.0) / (h5 * h2) * (3 * al**3), "a": 1.0 / h3 * -(al**2), "b": q / h5 * (3 * al**3)}
        h3 = h * h2
        return {"phi": -h, "d1": q / h * -al, "d2": 1.0 / h3 * -(al**2), "d3": q / (h3 * h2) * (3 * al**3), "a": 1.0 / h * -(al**2), "b": q / h3 * al**3}

    def _matern(self, r: Any, m: Any) -> dict[str, Any]:
        nu2 = {"matern12": 1, "matern32": 3, "matern52": 5}[self.family]
        be = nu2**0.5 / self.parameter
        t = r * be
        e = m.exp(t * -1.0)
        if nu2 == 1:
            safe = m.where(t > 0, t, 1.0)  # a and b have no value at 0
            return {"phi": e, "d1": e * -be, "d2": e * be**2, "d3": e * -(be**3), "a": e / safe * -(be**2), "b": e * (t + 1.0) / (safe * safe) * be**3}
        if nu2 == 3:
            return {"phi": (t + 1.0) * e, "d1": t * e * -(be), "d2": (t - 1.0) * e * be**2, "d3": (2.0 - t) * e * be**3, "a": e * -(be**2), "b": e * be**3}
        return {
            "phi": (t + 1.0 + t * t / 3.0) * e, "d1": t * (t + 1.0) * e * (-be / 3), "d2": (t * t - t - 1.0) * e * (be**2 / 3),
            "d3": t * (3.0 - t) * e * (be**3 / 3), "a": (t + 1.0) * e * (-(be**2) / 3), "b": t * e * (be**3 / 3),
        }

    def _phs(self, r: Any, m: Any) -> dict[str, Any]:
        p = int(self.parameter)
        s = -1.0 if (p // 2 + 1) % 2 else 1.0
        at0 = lambda value, power: value if power >= 0 else m.where(r > 0, value, 0.0)
        over = lambda n: _power(r, n) if n >= 0 else 1.0 / _power(m.where(r > 0, r, 1.0), -n)
        if p % 2:
            parts = {"phi": (1, p), "d1": (p, p - 1), "d2": (p * (p - 1), p - 2), "d3": (p * (p - 1) * (p - 2), p - 3), "a": (p, p - 2), "b": (p * (p - 2), p - 3)}
            return {k: at0(over(n) * (s * c), n) for k, (c, n) in parts.items()}
        ln = m.ln(r)
        parts = {
            "phi": (p, 1, 0), "d1": (p - 1, p, 1), "d2": (p - 2, p * (p - 1), 2 * p - 1),
            "d3": (p - 3, p * (p - 1) * (p - 2), 3 * p * p - 6 * p + 2), "a": (p - 2, p, 1), "b": (p - 3, p * (p - 2), 2 * (p - 1)),
        }
        return {k: at0(over(n) * (ln * float(c) + float(d)) * s, n) for k, (n, c, d) in parts.items()}

    def _wendland(self, r: Any, m: Any) -> dict[str, Any]:
        al = 1.0 / self.parameter
        q = r * al
        t = m.where(q < 1.0, 1.0 - q, 0.0)
        p = lambda n: _power(t, n)
        if self.family == "wendland_c2":
            return {"phi": p(4) * (q * 4.0 + 1.0), "d1": q * p(3) * (-20 * al), "d2": (q * 4.0 - 1.0) * p(2) * (20 * al**2), "d3": (1.0 - q * 2.0) * t * (120 * al**3), "a": p(3) * (-20 * al**2), "b": p(2) * (60 * al**3)}
        if self.family == "wendland_c4":
            c = -56 / 3
            return {
                "phi": p(6) * (q * 6.0 + 1.0 + q * q * (35 / 3)), "d1": q * (q * 5.0 + 1.0) * p(5) * (c * al), "d2": (q * 4.0 + 1.0 - q * q * 35.0) * p(4) * (c * al**2),
                "d3": q * (3.0 - q * 7.0) * p(3) * (560 * al**3), "a": (q * 5.0 + 1.0) * p(5) * (c * al**2), "b": q * p(4) * (560 * al**3),
            }
        return {
            "phi": p(8) * (q * 8.0 + 1.0 + q * q * 25.0 + q * q * q * 32.0), "d1": q * (q * 7.0 + 1.0 + q * q * 16.0) * p(7) * (-22 * al),
            "d2": (q * 6.0 + 1.0 - q * q * 15.0 - q * q * q * 160.0) * p(6) * (-22 * al**2), "d3": q * (q * 5.0 + 1.0 - q * q * 20.0) * p(5) * (1584 * al**3),
            "a": (q * 7.0 + 1.0 + q * q * 16.0) * p(7) * (-22 * al**2), "b": q * (q * 6.0 + 1.0) * p(6) * (528 * al**3),
        }


@dataclass(frozen=True)
class Anisotropy:
    """Distances are those of A (x - y): rows of A as a tuple of tuples."""

    matrix: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        a = np.asarray(self.matrix, float)
        if a.ndim != 2 or a.shape[0] != a.shape[1] or not np.isfinite(a).all() or np.linalg.matrix_rank(a) < len(a):
            raise InputError("the transform must be an invertible matrix")

    @staticmethod
    def _of(a: np.ndarray) -> Anisotropy:
        return Anisotropy(tuple(map(tuple, np.asarray(a, float).tolist())))

    @staticmethod
    def isotropic(dimension: int, length: float) -> Anisotropy:
        return Anisotropy._of(np.eye(dimension) / length)

    @staticmethod
    def spheroidal(axis: tuple[float, ...], along: float, across: float) -> Anisotropy:
        u = np.asarray(axis, float) / np.linalg.norm(axis)
        return Anisotropy._of(np.eye(len(u)) / across + np.outer(u, u) * (1 / along - 1 / across))

    @staticmethod
    def ellipsoidal(axes: tuple[tuple[float, ...], ...], lengths: tuple[float, ...], tolerance: float = 1e-9) -> Anisotropy:
        u = np.asarray(axes, float)
        if np.abs(u @ u.T - np.eye(len(u))).max() > tolerance:
            raise InputError("the axes must be orthonormal", tolerance=tolerance)
        return Anisotropy._of(u / np.asarray(lengths, float)[:, None])

    @staticmethod
    def from_metric(metric: tuple[tuple[float, ...], ...]) -> Anisotropy:
        b = np.asarray(metric, float)
        if (b != b.T).any() or not exact.definite(b[None])[0]:
            raise InputError("the metric must be symmetric and positive definite")
        try:
            return Anisotropy._of(np.linalg.cholesky(b).T)
        except np.linalg.LinAlgError as error:
            raise InputError("the metric is definite, but by less than doubles hold") from error

    @property
    def condition(self) -> float:
        s = exact.singular_values(np.asarray(self.matrix, float)[None])[0]
        return float(s[0] / s[-1])

    def separation(self, d: list[Any]) -> list[Any]:
        return [sum((x * float(m) for m, x in zip(row[1:], d[1:])), d[0] * float(row[0])) for row in self.matrix]

    def gradient(self, g: list[Any]) -> list[Any]:
        return [sum((g[i] * float(self.matrix[i][j]) for i in range(1, len(g))), g[0] * float(self.matrix[0][j])) for j in range(len(g))]

    def hessian(self, h: list[list[Any]]) -> list[list[Any]]:
        half = [self.gradient([row[j] for row in h]) for j in range(len(h))]
        return [self.gradient([half[j][i] for j in range(len(h))]) for i in range(len(h))]

    def third(self, t: list[list[list[Any]]]) -> list[list[list[Any]]]:
        """The third derivatives by x of a function of z = A x: every index goes through the transpose of A."""
        n = range(len(t))
        half = [self.hessian(t[i]) for i in n]
        whole = [[self.gradient([half[i][j][k] for i in n]) for k in n] for j in n]
        return [[[whole[j][k][i] for k in n] for j in n] for i in n]


def metric_review(rows: DataFrame, entries: list[str], dimension: int) -> DataFrame:
    """rows with definite and condition: whether the symmetric metric whose upper triangle the columns hold, row by row, is
    positive definite, decided exactly where doubles cannot; and the quotient of its extreme singular values (null if one
    is 0). A null entry gives nulls."""
    places = [(i, j) for i in range(dimension) for j in range(i, dimension)]
    if len(entries) != len(places):
        raise InputError("as many columns as the upper triangle has are needed", columns=len(entries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((batch.num_rows, dimension, dimension))
            none = np.zeros(batch.num_rows, bool)
            for name, (i, j) in zip(entries, places):
                column = batch.column(batch.schema.get_field_index(name))
                none |= column.is_null().to_numpy(zero_copy_only=False)
                made[:, i, j] = made[:, j, i] = column.cast(pa.float64()).fill_null(1.0).to_numpy(zero_copy_only=False)
            values = exact.singular_values(np.nan_to_num(made))
            condition = np.divide(values[:, 0], values[:, -1], out=np.zeros(len(values)), where=values[:, -1] > 0)
            found = [pa.array(exact.definite(made), mask=none), pa.array(condition, mask=none | (values[:, -1] == 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "definite", "condition"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("definite", BooleanType()), StructField("condition", DoubleType())]))


def distance(d: list[Any]) -> Any:
    m = _Spark if isinstance(d[0], Column) else _Numpy
    return m.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))


def jet(kernel: Kernel, d: list[Any], order: int, anisotropy: Anisotropy | None = None) -> dict[str, Any]:
    """value, gradient (g), Hessian (h) and third derivatives (t), as far as the order asks, of the kernel by its first
    argument, at the separation d = x - y. At d = 0 the gradient is 0, the Hessian phi''(0) times the identity and the third
    derivatives 0. A derivative by the second argument has the opposite sign."""
    z = anisotropy.separation(d) if anisotropy else d
    m = _Spark if isinstance(z[0], Column) else _Numpy
    r = distance(z)
    parts = kernel.radial(r)
    made: dict[str, Any] = {"value": parts["phi"]}
    n = range(len(z))
    if order >= 1:
        g = [parts["a"] * x for x in z]
        made["g"] = anisotropy.gradient(g) if anisotropy else g
    if order >= 2:
        safe = m.where(r > 0, r, 1.0)
        u = [x / safe for x in z]
        h = [[u[i] * u[j] * (parts["d2"] - parts["a"]) + (parts["a"] if i == j else 0.0) for j in n] for i in n]
        made["h"] = anisotropy.hessian(h) if anisotropy else h
    if order >= 3:
        across = lambda i, j, l: sum((u[k] for k, same in ((l, i == j), (j, i == l), (i, j == l)) if same), u[i] * u[j] * u[l] * -3.0)  # noqa: E731, E741
        t = [[[u[i] * u[j] * u[l] * parts["d3"] + across(i, j, l) * parts["b"] for l in n] for j in n] for i in n]  # noqa: E741
        made["t"] = anisotropy.third(t) if anisotropy else t
    return made
