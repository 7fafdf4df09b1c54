"""Numbers in a global order, and quantiles, without a window over all rows.

Rows are dealt by ranges of the order's keys, the ranges are counted, and rows are numbered within their range only; a
running sum of the counts, one number a range, gives each its first number.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.sessions import checkpointed


def numbered(rows: DataFrame, keys: Sequence[str], name: str = "nth", within: str | None = None) -> DataFrame:
    """rows with their number from 0 in the order of the keys, nulls first; equal rows are numbered arbitrarily. ``within`` is
    a column of few values, each of which is numbered on its own. The rows are kept in the checkpoint folder once."""
    order = [*([within] if within else []), *keys]
    parted = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counted = parted.groupBy("__part", *([within] if within else [])).count().collect()  # ranges and classes: a few
    starts, before = [], {}
    for row in sorted(counted, key=lambda r: r["__part"]):
        of = row[within] if within else None
        starts.append((row["__part"], of, before.get(of, 0)))
        before[of] = before.get(of, 0) + row["count"]
    kind = dict(rows.dtypes)[within] if within else "string"
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, f"__part int, __of {kind}, __start long"))
    own = F.row_number().over(Window.partitionBy("__part", *([within] if within else [])).orderBy(*keys))
    met = parted.withColumn("__own", own).withColumnRenamed("__part", "__mine")
    same = (F.col("__mine") == F.col("__part")) & (F.col(within).eqNullSafe(F.col("__of")) if within else F.lit(True))
    return met.join(start, same).select(*rows.columns, (F.col("__start") + F.col("__own") - 1).cast("long").alias(name))


def quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Quantiles of the column's values that are not null, by linear interpolation between ranks (type 7): only the values at
    those ranks come to the driver. None without values. Equal values are counted before they are dealt by ranges, so a
    value that most rows have is one row there."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parted = checkpointed(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    starts, total = [], 0
    for part, n in sorted(map(tuple, parted.groupBy("part").agg(F.sum("n")).collect())):
        starts.append((part, total))
        total += n
    if not total:
        return [None for _ in shares]
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))  # a row for each range
    until = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = parted.join(start, "part").select("v", "n", until.alias("until"))
    places = [(total - 1) * p for p in shares]
    wanted = sorted({k for p in places for k in (floor(p), min(floor(p) + 1, total - 1))})
    holds = F.exists(F.array(*[F.lit(k).cast("long") for k in wanted]), lambda k: (k < F.col("until")) & (k >= F.col("until") - F.col("n")))
    found = sorted((r["until"], r["v"]) for r in ranked.where(holds).collect())
    at = {k: next(v for until, v in found if k < until) for k in wanted}
    made = []
    for p in places:
        low, high = at[floor(p)], at[min(floor(p) + 1, total - 1)]
        made.append(low + (high - low) * (p - floor(p)))
    return made
