"""Point sets of the relational tables: coordinates, values and directions, as the queries use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, x0, y: mean price (in units of 997, so that rounded results have no ties) of parts by size, 50 sizes at most."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("x0")).agg((F.avg("p_retailprice") / 997).alias("y"))
    return sizes.select(F.lit(0).cast("long").alias("field_id"), (F.row_number().over(Window.orderBy("x0")) - 1).alias("idx"), "x0", "y")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, x0, x1: nation and account balance (thousands) of suppliers."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").cast("double").alias("x0"), (F.col("s_acctbal") / 1000).alias("x1"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").cast("double").alias("x0"), (F.col("c_acctbal") / 1000).alias("x1"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x0, x1, x2, y: quantity, percent of discount and of tax of line items, with the mean price (thousands)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x0"), (F.round(F.col("l_discount") * 100) + 0.0).alias("x1"), (F.round(F.col("l_tax") * 100) + 0.0).alias("x2"), "l_extendedprice")
    return rows.groupBy("x0", "x1", "x2").agg((F.avg("l_extendedprice") / 1000).alias("y"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """triples with idx, a number that says where on the 50 x 11 x 9 grid a point is."""
    return triples(spark, sf_dir).select((F.col("x0") * 10_000 + F.col("x1") * 100 + F.col("x2")).cast("long").alias("idx"), "x0", "x1", "x2", "y")


def directions(spark: SparkSession, sf_dir: str, dimension: int) -> DataFrame:
    """l_orderkey, l_linenumber, returnflag, u0 ..., w: unit vectors of discount and tax (and quantity), weighted."""
    from fieldspark.functions.geometry import unit

    columns = ["l_discount", "l_tax"] if dimension == 2 else ["l_quantity", "l_discount", "l_tax"]
    factor = {"l_quantity": 1.0, "l_discount": 100.0, "l_tax": 100.0}
    made = unit([F.col(c) * factor[c] for c in columns])
    rows = table(spark, sf_dir, "lineitem").where(" or ".join(f"{c} <> 0" for c in columns))
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", *[m.alias(f"u{k}") for k, m in enumerate(made)], F.col("l_quantity").alias("w"))
