"""Convex problems of many independent small fields: box-constrained least squares, robust location, projections.

A problem with hard equalities, bounds and cones and soft squared, absolute or Huber terms is lowered to a quadratic
programme over cones and solved in one bounded task a problem (``conic``). Its solution and multipliers are then checked
against the rows as given, and the losses recomputed from them. Problems that separate by coordinate have closed forms
as expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.errors import ConditioningError, InfeasibleError, InputError, MemoryLimitError
from fieldspark.operators import conic

MAX_VARIABLES = 1_000


def box_projection(target: Column, lower: Column, upper: Column) -> Column:
    """The point of an interval nearest to the target: the minimiser of (x - target)^2 within it."""
    return F.least(F.greatest(target, lower), upper)


def huber(t: Column, delta: float) -> Column:
    """t^2/2 up to delta, delta |t| - delta^2/2 beyond."""
    return F.when(F.abs(t) <= delta, t * t / 2.0).otherwise(F.abs(t) * delta - delta * delta / 2.0)


def cone_projection(head: Column, norm: Column) -> dict[str, Column]:
    """The projection of (head, v) with |v| = norm on the cone |v| <= head: its head and the factor of v."""
    middle = (head + norm) / 2.0
    return {"head": F.when(norm <= head, head).when(norm <= -head, 0.0).otherwise(middle), "factor": F.when(norm <= head, 1.0).when(norm <= -head, 0.0).otherwise(F.try_divide(middle, norm))}


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, median: the smallest minimiser of the weighted sum of |x - value|."""
    from pyspark.sql import Window

    summed = rows.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    below = F.sum("w").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("w").over(Window.partitionBy(*by))
    return summed.select(*by, value, below.alias("below"), total.alias("total")).where("below * 2 >= total").groupBy(*by).agg(F.min(value).alias("median"))


# -- cones


@dataclass(frozen=True)
class Cone:
    """|f x + k| <= c x + d."""

    f: np.ndarray
    k: np.ndarray
    c: np.ndarray
    d: float


CLASSES = ("eq", "bound", "cone", "soft")


def _lowered(entries: pd.DataFrame) -> tuple:
    """Names of the variables, the programme's matrices, its cones and the soft rows, from the rows of one problem."""
    unknown = set(entries["cls"]) - set(CLASSES)
    if unknown:
        raise InputError("no such class of rows", classes=sorted(map(str, unknown)))
    names = np.sort(entries["var"].unique())
    if len(names) > MAX_VARIABLES:
        raise MemoryLimitError("too many variables", variables=len(names))
    place = {v: k for k, v in enumerate(names)}
    whole = [(first, np.bincount([place[v] for v in part["var"]], part["coef"], len(names))) for _, part in entries.groupby("row") for first in [part.iloc[0]]]
    soft = [(f, r) for f, r in whole if f["cls"] == "soft"]
    if {f["loss"] for f, _ in soft} - {"l1", "l2", "huber"}:
        raise InputError("no such loss")
    plain = lambda f: f["loss"] == "l2" and pd.notna(f["target"])
    extra = sum(0 if plain(f) else 2 if f["loss"] == "huber" else 1 for f, _ in soft)
    size = len(names) + extra
    p, q = np.zeros((size, size)), np.zeros(size)
    a, b, g, h, blocks = [], [], [], [], {}
    wide = lambda r: np.concatenate([r, np.zeros(extra)])
    at = len(names)
    for f, r in whole:
        if f["cls"] == "eq":
            a.append(wide(r))
            b.append(f["target"])
        elif f["cls"] == "bound" and f["lower"] == f["upper"]:
            a.append(wide(r))
            b.append(f["lower"])
        elif f["cls"] == "bound":
            for side, sign in ((f["upper"], 1.0), (f["lower"], -1.0)):
                if pd.notna(side):
                    g.append(sign * wide(r))
                    h.append(sign * side)
        elif f["cls"] == "cone":
            blocks.setdefault(f["cone"], []).append((wide(r), 0.0 if pd.isna(f["target"]) else f["target"]))
    for f, r in soft:
        r = wide(r) / f["scale"]
        if plain(f):
            p += 2 * np.outer(r, r)
            q -= 2 * f["target"] / f["scale"] * r
            continue
        u = np.zeros(size)  # the violation is at most v (+ w)
        u[at] = 1.0
        if f["loss"] == "l1":
            q[at] += 1.0
        elif f["loss"] == "l2":
            p[at, at] += 2.0
        else:
            p[at, at] += 1.0
            u[at + 1] = 1.0
            q[at + 1] += f["delta"]
        used = 2 if f["loss"] == "huber" else 1
        for k in range(at, at + used):
            g.append(-np.eye(size)[k])
            h.append(0.0)
        low, high = (f["target"], f["target"]) if pd.notna(f["target"]) else (f["lower"], f["upper"])
        for side, sign in ((high, 1.0), (low, -1.0)):
            if pd.notna(side):
                g.append(sign * r - u)
                h.append(sign * side / f["scale"])
        at += used
    cones = []
    for rows in blocks.values():
        (c, d), tail = rows[0], rows[1:]
        cones.append(Cone(np.array([t[0] for t in tail]).reshape(-1, size), np.array([t[1] for t in tail], float), c, d))
    return names, (p, q, np.array(a).reshape(-1, size), np.array(b, float), np.array(g).reshape(-1, size), np.array(h, float)), cones, soft


def objective(soft: list, x: np.ndarray) -> float:
    """The sum of the losses of the soft rows as given: rho(violation / scale), where a target is missed by the distance and
    an interval by the way to its nearer end."""
    total = 0.0
    for f, r in soft:
        e = float(r @ x)
        if pd.notna(f["target"]):
            miss = abs(e - f["target"])
        else:
            miss = max(0.0, *[v for v in (f["lower"] - e, e - f["upper"]) if pd.notna(v)])
        t = miss / f["scale"]
        total += t * t if f["loss"] == "l2" else t if f["loss"] == "l1" else t * t / 2 if t <= f["delta"] else f["delta"] * t - f["delta"] ** 2 / 2
    return total


def optimality(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, cones: conic.Cones, found: conic.Solution) -> float:
    """The worst departure of a solution and its multipliers from optimality, each over the terms that it is made of:
    rows, cones and dual cones, stationarity, and the sum of products of slacks and multipliers over the objective."""
    x, z = found.x, found.z
    s = b - a @ x
    bend = np.abs(p).max(initial=0)
    far = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0) / bend if bend else 0.0)  # how large x is, or would be unbound
    size = np.abs(a) @ np.abs(x) + np.abs(b) + conic.SMALL * np.abs(a).max(axis=1, initial=0) * far
    worst = float((np.abs(s[: cones.zeros]) / np.maximum(size[: cones.zeros], 1e-300)).max(initial=0))
    line = cones.line
    worst = max(worst, float((-s[line] / np.maximum(size[line], 1e-300)).max(initial=0)), float((-z[line]).max(initial=0) / max(1e-300, np.abs(z).max(initial=0))))
    for k in cones.blocks:
        for u, scale in ((s[k], size[k].max()), (z[k], np.abs(z).max(initial=0))):
            worst = max(worst, float(np.linalg.norm(u[1:]) - u[0]) / max(1e-300, float(scale)))
    slope = p @ x + q + a.T @ z
    terms = np.abs(p) @ np.abs(x) + np.abs(q) + np.abs(a.T) @ np.abs(z)
    terms = np.maximum(terms, conic.SMALL * terms.max(initial=0))
    worst = max(worst, float((np.abs(slope) / np.maximum(terms, 1e-300)).max(initial=0)))
    cost = max(1e-300, np.abs(p).max(initial=0), np.abs(q).max(initial=0))
    value = max(abs(float(x @ p @ x)) / 2, abs(float(q @ x)), cost * conic.least_value(x))
    return max(worst, abs(float(s[cones.zeros :] @ z[cones.zeros :])) / value)


REVIEW = 1e-6


def _solved(entries: pd.DataFrame, options: conic.Options) -> tuple[np.ndarray, np.ndarray, float]:
    names, (p, q, a, b, g, h), cones, soft = _lowered(entries)
    rows = np.vstack([a, g, *(-np.vstack([c.c, c.f]) for c in cones)])
    sides = np.concatenate([b, h, *(np.append(c.d, c.k) for c in cones)])
    shape = conic.Cones(len(b), len(h), [1 + len(c.k) for c in cones])
    found = conic.solve(p, q, rows, sides, shape, options)
    worst = optimality(p, q, rows, sides, shape, found)
    if not worst <= REVIEW:
        raise ConditioningError("the optimality conditions are not met", worst=worst)
    return names, found.x[: len(names)], objective(soft, found.x[: len(names)])


def solve_problems(rows: DataFrame, options: conic.Options = conic.Options()) -> DataFrame:
    """problem_id, var, value from rows (problem_id, row, cls, var, coef, target, lower, upper, scale, loss, delta) of
    affine expressions: cls eq (= target), bound (in lower to upper), soft (loss of the violation / scale of a target, or of
    lower and upper where that is null: l2, its square; l1; huber) or cone. The rows of a cone have its name in ``cone``:
    the first, expression + target, is at least the norm of the others. Another class is an error, and so is a problem
    whose constraints exclude one another or whose optimum is not reached: no part of a result is given."""
    rows = rows if "cone" in rows.columns else rows.withColumn("cone", F.lit(None).cast("long"))

    def solve(key: tuple, entries: pd.DataFrame) -> pd.DataFrame:
        names, x, _ = _solved(entries, options)
        return pd.DataFrame({"problem_id": key[0], "var": names, "value": x})

    return rows.groupBy("problem_id").applyInPandas(solve, "problem_id long, var long, value double")


def problem_status(rows: DataFrame, options: conic.Options = conic.Options()) -> DataFrame:
    """problem_id, status (solved, infeasible or unsolved) and objective, the losses of the soft rows as given, of the
    problems that solve_problems takes; null where there is no solution."""
    rows = rows if "cone" in rows.columns else rows.withColumn("cone", F.lit(None).cast("long"))

    def review(key: tuple, entries: pd.DataFrame) -> pd.DataFrame:
        try:
            status, least = "solved", _solved(entries, options)[2]
        except (InfeasibleError, ConditioningError) as error:
            status, least = "infeasible" if isinstance(error, InfeasibleError) else "unsolved", None
        return pd.DataFrame({"problem_id": [key[0]], "status": [status], "objective": pd.Series([least], dtype=float)})

    return rows.groupBy("problem_id").applyInPandas(review, "problem_id long, status string, objective double")
