"""Local trends: kernels whose anisotropy varies in space, sum over r of b_r(x) b_r(y) k_r(x, y)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import pi
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.errors import CapabilityError, InputError
from fieldspark.functions.kernels import Anisotropy, Kernel, jet
from fieldspark.operators import ranking
from fieldspark.sessions import checkpointed


def _smooth(t: Column) -> Column:
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return t * t * t * (t * (t * 6.0 - 15.0) + 10.0)


def _smooth_jet(t: Column, rate: float) -> tuple[Column, Column, Column]:
    """The step and its first two derivatives by a variable that t changes with at a rate."""
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return t * t * t * (t * (t * 6.0 - 15.0) + 10.0), t * t * (t - 1.0) * (t - 1.0) * (30.0 * rate), t * (t - 1.0) * (t * 2.0 - 1.0) * (60.0 * rate**2)


@dataclass(frozen=True)
class Weight:
    """A constant, a Gaussian bump, or a bump within a box whose rim it leaves smoothly: 0 on the rim and outside."""

    amplitude: float
    center: tuple[float, ...] = ()
    radius: float = 0.0
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()
    transition: float = 0.0

    def __post_init__(self):
        if not self.amplitude > 0 or self.center and not self.radius > 0 or self.low and not self.transition > 0:
            raise InputError("amplitude, radius and transition must be positive")

    def gate(self, x: Sequence[Column]) -> Column:
        gate = F.lit(1.0)
        for c, a, b in zip(x, self.low, self.high):
            gate = gate * _smooth((c - a) / self.transition) * _smooth((F.lit(b) - c) / self.transition)
        return gate

    def jet(self, x: Sequence[Column]) -> tuple[Column, list[Column], list[list[Column]]]:
        """Value, gradient and Hessian: products of a factor for each axis, whose derivatives are known."""
        factors = []
        for k, c in enumerate(x):
            f = (F.lit(1.0), F.lit(0.0), F.lit(0.0))
            if self.center:
                d, r2 = c - self.center[k], self.radius**2
                e = F.exp(d * d / (-2.0 * r2))
                f = (e, e * d / -r2, e * (d * d / r2 - 1.0) / r2)
            if self.low:
                w = self.transition
                for g in (_smooth_jet((c - self.low[k]) / w, 1 / w), _smooth_jet((F.lit(self.high[k]) - c) / w, -1 / w)):
                    f = (f[0] * g[0], f[1] * g[0] + f[0] * g[1], f[2] * g[0] + f[1] * g[1] * 2.0 + f[0] * g[2])
            factors.append(f)
        n = range(len(x))
        product = lambda orders: reduce(lambda a, b: a * b, [factors[k][orders.count(k)] for k in n], F.lit(self.amplitude))
        return product([]), [product([i]) for i in n], [[product([i, j]) for j in n] for i in n]

    def at(self, x: Sequence[Column]) -> Column:
        value = F.lit(self.amplitude)
        if self.center:
            square = sum(((c - m) * (c - m) for c, m in zip(x, self.center)), F.lit(0.0))
            value = value * F.exp(square / (-2.0 * self.radius**2))
        return value * self.gate(x) if self.low else value


@dataclass(frozen=True)
class Mixture:
    """A constant background and local components: (weight, kernel, anisotropy). Positive definite kernels only."""

    components: tuple[tuple[Weight, Kernel, Anisotropy], ...]

    def __post_init__(self):
        if not self.components or self.components[0][0].center or self.components[0][0].low:
            raise InputError("the first component must be a constant background")
        for _, kernel, _ in self.components:
            if kernel.cpd_order:
                raise CapabilityError("a mixture takes positive definite kernels only", family=kernel.family)

    def value(self, x: Sequence[Column], y: Sequence[Column]) -> Column:
        d = [a - b for a, b in zip(x, y)]
        return sum((w.at(x) * w.at(y) * jet(k, d, 0, a)["value"] for w, k, a in self.components), F.lit(0.0))

    def gradient(self, x: Sequence[Column], y: Sequence[Column]) -> list[Column]:
        """By x."""
        return self.derivatives(x, y, 1)[0]

    def derivatives(self, x: Sequence[Column], y: Sequence[Column], order: int = 2) -> tuple[list[Column], list[list[Column]] | None]:
        """Gradient and Hessian by x, with all terms of the product rule; third derivatives are not given."""
        self.require(order)
        d, n = [a - b for a, b in zip(x, y)], range(len(x))
        g, h = [F.lit(0.0) for _ in n], [[F.lit(0.0) for _ in n] for _ in n]
        for w, k, a in self.components:
            value, slope, bend = w.jet(x)
            made, other = jet(k, d, order, a), w.at(y)
            for i in n:
                g[i] = g[i] + other * (slope[i] * made["value"] + value * made["g"][i])
                for j in n if order > 1 else ():
                    h[i][j] = h[i][j] + other * (bend[i][j] * made["value"] + slope[i] * made["g"][j] + slope[j] * made["g"][i] + value * made["h"][i][j])
        return g, h if order > 1 else None

    def capability(self, order: int) -> str:
        """The least of the components': everywhere, away or unsupported; a mixture has no third derivatives."""
        found = {k.capability(order) for _, k, _ in self.components}
        return "unsupported" if order > 2 else next(c for c in ("unsupported", "away", "everywhere") if c in found)

    def require(self, order: int) -> None:
        if self.capability(order) != "everywhere":
            raise CapabilityError("the mixture has no such derivative everywhere", order=order)

    def coverage(self, x: Sequence[Column]) -> dict[str, Column]:
        squares = [w.at(x) * w.at(x) for w, _, _ in self.components]
        active = sum(((s > 0).cast("int") for s in squares), F.lit(0))
        return {"coverage": sum(squares[1:], squares[0]), "background": squares[0], "active": active}


def direction_jumps(controls: DataFrame, directions: Sequence[str], by: Sequence[str], order: Sequence[str], limit: float) -> DataFrame:
    """controls with jump, the angle between a control's axis and that of the one before it (null for the first), and
    exceeds, whether it is over the limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    dot = sum((F.col(c) * F.lag(c).over(w) for c in directions[1:]), F.col(directions[0]) * F.lag(directions[0]).over(w))
    jump = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    return controls.select("*", jump.alias("jump")).withColumn("exceeds", F.coalesce(F.col("jump") > limit, F.lit(False)))


def resolved_directions(points: DataFrame, field: Any, columns: Sequence[str], least: float, low: float) -> DataFrame:
    """points with the unit gradient u_k of a field and its norm; null directions below ``least``, low_confidence below
    ``low``."""
    made = field.evaluate(points, columns, order=1, prefix="__g")
    g = [F.col(f"__g_{k}") for k in range(field.dimension)]
    norm = F.sqrt(sum((c * c for c in g[1:]), g[0] * g[0]))
    return made.select(*points.columns, norm.alias("norm"), *[F.when(norm >= least, F.try_divide(c, norm)).alias(f"u_{k}") for k, c in enumerate(g)], (norm < low).alias("low_confidence"))


@dataclass(frozen=True)
class TrendPolicy:
    """What controls may be: the largest condition of an anisotropy, the least norm of a reference gradient, the norm below
    which its direction has low confidence, and the largest jump of a direction from one control to the next."""

    condition: float = 1e6
    least: float = 1e-9
    low: float = 1e-3
    jump: float = pi / 2

    def __post_init__(self):
        if not (self.condition >= 1 and 0 < self.least <= self.low and 0 <= self.jump <= pi / 2):
            raise InputError("condition >= 1, 0 < least <= low and a jump of 0 to pi/2 are needed")


def compiled_controls(controls: DataFrame, background: tuple[float, ...], policy: TrendPolicy) -> DataFrame:
    """component, ord, center, matrix, radius, strength, jump, problem of ordered controls (ord, x0 ..., u0 ..., along, across,
    radius, strength): component 0 is the background, isotropic with its length (strength, length); others follow in the
    order of ord, numbered without a window over all of them. matrix has the rows of the transform of distances, longer along
    the direction u. problem says what the policy refuses, else null."""
    dim = sum(c in controls.columns for c in ("x0", "x1", "x2"))
    u = [F.col(f"u{k}") for k in range(dim)]
    norm = F.sqrt(sum((c * c for c in u[1:]), u[0] * u[0]))
    unit = [F.try_divide(c, norm) for c in u]
    placed = checkpointed(ranking.numbered(controls, ["ord"], "component").withColumn("component", F.col("component") + 1).withColumns({f"__u{k}": c for k, c in enumerate(unit)}))
    before = placed.select((F.col("component") + 1).alias("component"), *[F.col(f"__u{k}").alias(f"__v{k}") for k in range(dim)])
    met = placed.join(before, "component", "left")
    dot = sum((F.col(f"__u{k}") * F.col(f"__v{k}") for k in range(1, dim)), F.col("__u0") * F.col("__v0"))
    jump = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    entry = lambda i, j: F.col(f"__u{i}") * F.col(f"__u{j}") * (1 / F.col("along") - 1 / F.col("across")) + (1 / F.col("across") if i == j else 0.0)
    matrix = F.array(*[F.array(*[entry(i, j) for j in range(dim)]) for i in range(dim)])
    condition = F.greatest("along", "across") / F.least("along", "across")
    positive = (F.col("along") > 0) & (F.col("across") > 0) & (F.col("radius") > 0) & (F.col("strength") > 0)
    problem = F.when(~F.coalesce(positive, F.lit(False)), "a length, radius or strength is not positive").when(~F.coalesce(norm >= policy.least, F.lit(False)), "no direction").when(condition > policy.condition, "condition").when(F.coalesce(jump > policy.jump, F.lit(False)), "jump")
    made = met.select("component", F.col("ord").cast("long").alias("ord"), F.array(*[F.col(f"x{k}") for k in range(dim)]).alias("center"), matrix.alias("matrix"), "radius", "strength", jump.alias("jump"), problem.alias("problem"))
    strength, length = background
    none = F.lit(None).cast("double")
    first = controls.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("component"), F.lit(None).cast("long").alias("ord"), F.array(*[none] * dim).alias("center"), F.array(*[F.array(*[F.lit(1 / length if i == j else 0.0) for j in range(dim)]) for i in range(dim)]).alias("matrix"),
        none.alias("radius"), F.lit(float(strength)).alias("strength"), none.alias("jump"), F.lit(None).cast("string").alias("problem"),
    )
    return first.union(made)


def diagnostics(compiled: DataFrame, samples: DataFrame, mixture: Mixture, low: float) -> dict[str, DataFrame]:
    """What is exported of trends: controls and background (the compiled rows), samples with their coverage, the samples of low
    confidence, whose coverage is below ``low``, and a summary row of counts and extremes."""
    x = [F.col(c) for c in ("x0", "x1", "x2") if c in samples.columns]
    found = mixture.coverage(x)
    covered = samples.select("*", found["coverage"].alias("coverage"), found["background"].alias("background"), found["active"].alias("active"))
    weak = covered.where(F.col("coverage") < low)
    summary = covered.agg(F.count("*").alias("samples"), F.count_if(F.col("coverage") < low).alias("low_confidence"), F.min("coverage").alias("least"), F.max("coverage").alias("most"))
    counts = compiled.agg(F.count_if(F.col("component") > 0).alias("controls"), F.count("problem").alias("problems"))
    return {"controls": compiled.where("component > 0"), "background": compiled.where("component = 0"), "samples": covered, "low_confidence": weak, "summary": summary.crossJoin(counts)}
