"""Points, directions, affine normalisation and orientations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.errors import InputError


def require_finite(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """df, after one aggregate that found no null, NaN or infinite value; else an error with the smallest key."""
    bad = [F.min_by(F.lit(c), F.when(~F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) | F.isnan(c), F.col(key))).alias(f"c{i}") for i, c in enumerate(columns)]
    at = [F.min(F.when(~F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) | F.isnan(c), F.col(key))).alias(f"k{i}") for i, c in enumerate(columns)]
    found = df.agg(*bad, *at).first()
    for i, c in enumerate(columns):
        if found[f"k{i}"] is not None:
            raise InputError("not a finite number", column=c, row=found[f"k{i}"])
    return df


def unit(components: Sequence[Column]) -> list[Column]:
    """The direction of length one, scaled by its largest component first; nulls for the zero vector."""
    largest = F.greatest(*[F.abs(c) for c in components]) if len(components) > 1 else F.abs(components[0])
    scaled = [F.try_divide(c, largest) for c in components]
    length = F.sqrt(sum((s * s for s in scaled[1:]), scaled[0] * scaled[0]))
    return [s / length for s in scaled]


class Affine:
    """x = origin + scale x~ with an invertible matrix of at most three dimensions."""

    def __init__(self, origin: Sequence[float], scale: Sequence[Sequence[float]]):
        self.origin, self.scale = np.asarray(origin, float), np.asarray(scale, float)
        if self.scale.shape != (len(origin),) * 2 or not np.isfinite(self.scale).all() or np.linalg.matrix_rank(self.scale) < len(origin):
            raise InputError("the scale must be an invertible matrix", shape=self.scale.shape)
        self.inverse = np.linalg.inv(self.scale)

    def _times(self, matrix: np.ndarray, x: Sequence[Column]) -> list[Column]:
        return [sum((F.lit(float(m)) * c for m, c in zip(row[1:], x[1:])), F.lit(float(row[0])) * x[0]) for row in matrix]

    def normalize(self, x: Sequence[Column]) -> list[Column]:
        return self._times(self.inverse, [c - F.lit(float(o)) for c, o in zip(x, self.origin)])

    def denormalize(self, x: Sequence[Column]) -> list[Column]:
        return [c + F.lit(float(o)) for c, o in zip(self._times(self.scale, x), self.origin)]

    def gradient(self, g: Sequence[Column]) -> list[Column]:
        """A gradient in normalised coordinates, in the original ones."""
        return self._times(self.inverse.T, g)

    def hessian(self, h: Sequence[Sequence[Column]]) -> list[list[Column]]:
        half = [self._times(self.inverse.T, [row[j] for row in h]) for j in range(len(h))]  # columns of S^-T H
        whole = [self._times(self.inverse.T, [half[j][i] for j in range(len(h))]) for i in range(len(h))]
        return whole


def _exact_sin(degrees: Column) -> Column:
    turn = F.pmod(degrees, F.lit(360.0))
    return F.when(turn.isin(0.0, 180.0), 0.0).when(turn == 90.0, 1.0).when(turn == 270.0, -1.0).otherwise(F.sin(F.radians(degrees)))


def _exact_cos(degrees: Column) -> Column:
    turn = F.pmod(degrees, F.lit(360.0))
    return F.when(turn.isin(90.0, 270.0), 0.0).when(turn == 0.0, 1.0).when(turn == 180.0, -1.0).otherwise(F.cos(F.radians(degrees)))


#: The angles in degrees that each kind of reading can have, and whether the upper end belongs to it.
ANGLES = {"full": (0.0, 360.0, False), "dip": (0.0, 90.0, True), "signed": (-90.0, 90.0, True)}


def angle_violations(rows: DataFrame, angles: dict[str, str], key: str) -> DataFrame:
    """key, field, value of every angle (column: its kind in ANGLES) that is null, not finite or out of its range."""
    made = []
    for column, kind in angles.items():
        low, high, closed = ANGLES[kind]
        v = F.col(column)
        good = (v >= low) & ((v <= high) if closed else (v < high)) & ~F.isnan(v)
        made.append(F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit(column).alias("field"), v.cast("double").alias("value"))))
    return rows.select(F.col(key), F.explode(F.array_compact(F.array(*made))).alias("bad")).select(key, "bad.*")


def plus_zero(angle: Column) -> Column:
    """The angle, with 0 in place of -0."""
    return angle + F.lit(0.0)


def axial(polarity: Column) -> Column:
    """Whether a direction stands for its opposite too: its polarity is unknown."""
    return polarity == "unknown"


@dataclass(frozen=True)
class Frame:
    """What coordinates mean: a length unit, an angle unit, a reference system (EPSG number or WKT) and, for each axis of
    the data, the axis of the system that it is."""

    length_unit: str
    angle_unit: str = "degrees"
    epsg: int | None = None
    wkt: str | None = None
    axis_order: tuple[int, ...] = (0, 1)

    def __post_init__(self):
        if not self.length_unit.strip():
            raise InputError("a length unit needs a name")
        if self.angle_unit not in ("degrees", "radians"):
            raise InputError("angles are in degrees or radians", unit=self.angle_unit)
        if self.epsg is not None and self.epsg <= 0 or self.wkt is not None and not self.wkt.strip() or self.epsg is None and self.wkt is None:
            raise InputError("a reference system needs a positive EPSG number or a WKT")
        if sorted(self.axis_order) != list(range(len(self.axis_order))):
            raise InputError("the axis order must be a permutation", order=self.axis_order)

    def ordered(self, columns: Sequence[str]) -> list[Column]:
        """The coordinates in the system's own order."""
        if len(columns) != len(self.axis_order):
            raise InputError("as many columns as axes are needed", columns=len(columns))
        return [F.col(columns[self.axis_order.index(k)]) for k in range(len(columns))]

    def degrees(self, angle: Column) -> Column:
        return angle if self.angle_unit == "degrees" else F.degrees(angle)

    def require_same(self, other: Frame) -> None:
        """An error naming the first field in which two frames differ."""
        for field in ("length_unit", "angle_unit", "epsg", "wkt", "axis_order"):
            if getattr(self, field) != getattr(other, field):
                raise InputError("the frames differ", field=field, one=getattr(self, field), other=getattr(other, field))


def signed_dip(dip: Column) -> list[Column]:
    """The plane's normal in two dimensions, dip from -90 to 90 degrees."""
    return [_exact_sin(dip), _exact_cos(dip)]


def dip_direction(direction: Column, dip: Column) -> list[Column]:
    """The plane's upward normal for an azimuth of [0, 360) and a dip of [0, 90] degrees."""
    return [_exact_sin(dip) * _exact_sin(direction), _exact_sin(dip) * _exact_cos(direction), _exact_cos(dip)]


def strike_dip(strike: Column, dip: Column) -> list[Column]:
    """By the right-hand rule: the plane dips to the right of its strike."""
    return dip_direction(F.pmod(strike + 90.0, F.lit(360.0)), dip)


def plunge(angle: Column) -> list[Column]:
    return [_exact_cos(angle), -_exact_sin(angle)]


def azimuth_plunge(azimuth: Column, angle: Column) -> list[Column]:
    """A line's direction, positive plunge downwards."""
    return [_exact_cos(angle) * _exact_sin(azimuth), _exact_cos(angle) * _exact_cos(azimuth), -_exact_sin(angle)]


def with_polarity(normal: Sequence[Column], polarity: Column) -> list[Column]:
    """positive keeps a direction, negative turns it round, unknown leaves it axial."""
    return [F.when(polarity == "negative", -c).otherwise(c) for c in normal]


def complement_array(normal: Sequence[Column]) -> Column:
    """An orthonormal basis of the plane across a unit normal (2 or 3 dimensions), its vectors end to end in one array:
    the axis with the least part of the normal, first of equal ones, made perpendicular; then the cross product. The first
    nonzero component of each is positive."""
    dim = len(normal)

    def bound(value: Column, f: Callable[[Column], Column]) -> Column:
        """f of an array that is written, and computed, once however often f uses it."""
        return F.get(F.transform(F.array(value), f), 0)

    def each(f: Callable[[list[Column]], list[Column]]) -> Callable[[Column], Column]:
        return lambda v: F.array(*f([F.get(v, k) for k in range(dim)]))

    def signed(v: list[Column]) -> list[Column]:
        first = F.lit(1.0)
        for c in reversed(v):
            first = F.when(c > 0, 1.0).when(c < 0, -1.0).otherwise(first)
        return [c * first for c in v]

    def across(n: list[Column]) -> list[Column]:
        size = [F.abs(c) for c in n]
        least = F.least(*size)
        axis = F.when(size[0] == least, 0).when(size[1] == least, 1).otherwise(2)
        along = n[-1]
        for k in range(dim - 2, -1, -1):
            along = F.when(axis == k, n[k]).otherwise(along)
        return [F.when(axis == k, 1.0).otherwise(0.0) - along * c for k, c in enumerate(n)]

    def both(n: Column) -> Column:
        first = bound(bound(bound(n, each(across)), each(unit)), each(signed))
        if dim == 2:
            return first
        a = [F.get(n, k) for k in range(3)]
        cross = lambda v: [a[1] * v[2] - a[2] * v[1], a[2] * v[0] - a[0] * v[2], a[0] * v[1] - a[1] * v[0]]
        return bound(first, lambda v: F.concat(v, bound(each(cross)(v), each(signed))))

    return bound(F.array(*normal), both)


def with_complement(df: DataFrame, normal: Sequence[str], prefix: str = "__t") -> DataFrame:
    """df with the vectors of complement_array as columns prefix_0_0 ..., a step of plain columns after another."""
    dim, n = len(normal), [F.col(c) for c in normal]
    own = lambda name: f"{prefix}_{name}"
    size = [F.abs(c) for c in n]
    axis = F.when(size[0] == F.least(*size), 0)
    for k in range(1, dim):
        axis = axis.when(size[k] == F.least(*size), k)
    df = df.withColumn(own("axis"), axis)
    along = F.when(F.col(own("axis")) == 0, n[0])
    for k in range(1, dim):
        along = along.when(F.col(own("axis")) == k, n[k])
    df = df.withColumn(own("along"), along)
    df = df.withColumns({own(f"raw{k}"): F.when(F.col(own("axis")) == k, 1.0).otherwise(0.0) - F.col(own("along")) * n[k] for k in range(dim)})

    def signed(df: DataFrame, which: int, v: list[Column]) -> DataFrame:
        first = F.lit(1.0)
        for c in reversed(v):
            first = F.when(c > 0, 1.0).when(c < 0, -1.0).otherwise(first)
        return df.withColumn(own("sign"), first).withColumns({own(f"{which}_{k}"): c * F.col(own("sign")) for k, c in enumerate(v)})

    df = df.withColumns({own(f"one{k}"): c for k, c in enumerate(unit([F.col(own(f"raw{k}")) for k in range(dim)]))})
    df = signed(df, 0, [F.col(own(f"one{k}")) for k in range(dim)])
    if dim == 3:
        v = [F.col(own(f"0_{k}")) for k in range(3)]
        cross = [n[1] * v[2] - n[2] * v[1], n[2] * v[0] - n[0] * v[2], n[0] * v[1] - n[1] * v[0]]
        df = df.withColumns({own(f"two{k}"): c for k, c in enumerate(cross)})
        df = signed(df, 1, [F.col(own(f"two{k}")) for k in range(3)])
    return df


def complement(normal: Sequence[Column]) -> list[list[Column]]:
    """complement_array as columns; each evaluates it anew."""
    basis, dim = complement_array(normal), len(normal)
    return [[F.get(basis, at + k) for k in range(dim)] for at in range(0, dim * (dim - 1), dim)]
