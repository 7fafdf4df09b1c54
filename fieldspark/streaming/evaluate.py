"""Fields over streams: evaluation is a map, and orientation tensors are windowed sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.fields import FittedField


def evaluate_stream(points: DataFrame, field: FittedField, columns: Sequence[str] | None = None, order: int = 0) -> DataFrame:
    """The stream with the field's value, and derivatives, at each point; no state is kept."""
    return field.evaluate(points, columns, order)


def windowed_tensor(samples: DataFrame, directions: Sequence[str], weight: str, time: str, window: str, lateness: str) -> DataFrame:
    """begin, total, c_ij: the orientation tensor of each window of event time; rows later than ``lateness`` are left out."""
    n = len(directions)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    moments = [F.sum(F.col(weight) * F.col(directions[i]) * F.col(directions[j])).alias(f"s_{i}{j}") for i, j in pairs]
    sums = samples.withWatermark(time, lateness).groupBy(F.window(time, window)).agg(F.sum(weight).alias("total"), *moments)
    return sums.select(F.col("window.start").alias("begin"), "total", *[F.try_divide(f"s_{i}{j}", "total").alias(f"c_{i}{j}") for i, j in pairs])
