"""Points and constraint tables from files, with explicit schemas, and fitted fields to and from Parquet."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fieldspark.errors import InputError, MemoryLimitError, VersionError
from fieldspark.functions.geometry import require_finite
from fieldspark.functions.kernels import Anisotropy, Kernel
from fieldspark.operators.fields import MAX_CENTERS, FittedField, axes
from fieldspark.operators.functionals import FunctionalField

VERSION = 2
#: A field's terms (several for each functional) and its polynomial.
MAX_ROWS = 8 * MAX_CENTERS


def point_schema(dimension: int, value: bool = True) -> str:
    return "idx long, " + ", ".join(f"{c} double" for c in axes(dimension)) + (", y double" if value else "")


def read_points(spark: SparkSession, path: str, dimension: int, value: bool = True, format: str = "parquet", **options: str) -> DataFrame:
    """idx, x0 ..., y from Parquet, CSV (with a header) or JSON lines. Nothing is inferred; a coordinate or value that is
    null, NaN or infinite is an error that names the row."""
    if dimension not in (1, 2, 3):
        raise InputError("points have one to three dimensions", dimension=dimension)
    if format not in ("parquet", "csv", "json"):
        raise InputError("no such format", format=format)
    reader = spark.read.format(format).schema(point_schema(dimension, value)).options(**options)
    if format == "csv":
        reader = reader.option("header", "true").option("mode", "FAILFAST")
    return require_finite(reader.load(path), [*axes(dimension), *(["y"] if value else [])], "idx")


def write_points(points: DataFrame, path: str, format: str = "parquet") -> None:
    writer = points.write.format(format)
    (writer.option("header", "true") if format == "csv" else writer).save(path)


def write_field(spark: SparkSession, field: FittedField, path: str) -> None:
    """A row for the definition, one for each center and one for each polynomial coefficient, in their order. The centers of
    a field of functionals are its terms, with a direction where they are derivatives."""
    functional = isinstance(field, FunctionalField)
    definition = json.dumps({"version": VERSION, "family": field.kernel.family, "parameter": field.kernel.parameter, "anisotropy": field.anisotropy and field.anisotropy.matrix, "functionals": functional, "dimension": field.dimension})
    rows = [("definition", 0, None, None, definition, None)]
    ways = [[float(u) for u in way] if slope else None for way, slope in zip(field.directions, field.derivative)] if functional else [None] * len(field.centers)
    rows += [("center", i, [float(c) for c in x], float(w), None, way) for i, (x, w, way) in enumerate(zip(field.centers, field.weights, ways))]
    rows += [("polynomial", i, None, float(c), None, None) for i, c in enumerate(field.polynomial)]
    spark.createDataFrame(rows, "role string, idx int, x array<double>, value double, definition string, direction array<double>").coalesce(1).write.parquet(path)


def read_field(spark: SparkSession, path: str) -> FittedField:
    """The field as it was written: a plain one, or one of functionals. One of another version is an error, and so is one with
    more rows than a field can have."""
    rows = spark.read.parquet(path).orderBy("role", "idx").limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise MemoryLimitError("the field has too many rows", limit=MAX_ROWS)
    definition = json.loads(next(r.definition for r in rows if r.role == "definition"))
    if definition["version"] != VERSION:
        raise VersionError("the field was written by another version", version=definition["version"])
    centers, polynomial = ([r for r in rows if r.role == role] for role in ("center", "polynomial"))
    a, dimension = definition["anisotropy"], definition["dimension"]
    parts = (
        Kernel(definition["family"], definition["parameter"]), np.array([r.x for r in centers], float).reshape(-1, dimension),
        np.array([r.value for r in centers]), np.array([r.value for r in polynomial]), a and Anisotropy(tuple(map(tuple, a))),
    )
    if not definition["functionals"]:
        return FittedField(*parts)
    derivative = np.array([r.direction is not None for r in centers], bool)
    directions = np.array([r.direction or [0.0] * dimension for r in centers], float).reshape(-1, dimension)
    return FunctionalField(*parts, directions=directions, derivative=derivative)
