"""Files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark import errors
from fieldspark.functions.kernels import Anisotropy, Kernel
from fieldspark.operators import tensors
from fieldspark.operators.fields import FittedField
from fieldspark.sources import points as S
from fieldspark.streaming import evaluate

FIELD = FittedField(Kernel("gaussian", 0.7), np.array([[0.0, 1.0], [2.0, 0.5]]), np.array([1.5, -2.0]), np.zeros(0), Anisotropy.isotropic(2, 1.5))


@pytest.mark.parametrize("format", ["parquet", "csv", "json"])
def test_points_round_trip(spark, tmp_path, format):
    rows = [(1, 0.1, 2.0, 3.0), (2, -1e-300, 4.5, 0.0)]
    S.write_points(spark.createDataFrame(rows, S.point_schema(2)), str(tmp_path / "p"), format)
    assert sorted(map(tuple, S.read_points(spark, str(tmp_path / "p"), 2, format=format).collect())) == rows


def test_values_that_are_no_numbers(spark, tmp_path):
    for k, bad in enumerate((float("nan"), float("inf"), None)):
        spark.createDataFrame([(1, 0.0, 1.0), (2, bad, 1.0)], S.point_schema(1)).write.parquet(str(tmp_path / str(k)))
        with pytest.raises(errors.InputError, match="row=2"):
            S.read_points(spark, str(tmp_path / str(k)), 1)


def test_field_round_trip(spark, tmp_path):
    S.write_field(spark, FIELD, str(tmp_path / "f"))
    back = S.read_field(spark, str(tmp_path / "f"))
    at = np.array([[0.3, 0.4], [1.0, 1.0]])
    assert (back.numbers(at, 2) == FIELD.numbers(at, 2)).all()


def test_streams_match_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i % 50:02d}:00", (i % 7) / 7.0, (i % 5) / 5.0, 1.0 + i % 3) for i in range(200)], "id long, ts string, x0 double, x1 double, w double")
    rows = rows.withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def through(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.table(name)

    by_stream = through(evaluate.evaluate_stream(stream, FIELD), "append", "points_out")
    assert by_stream.exceptAll(FIELD.evaluate(rows)).count() == 0 and by_stream.count() == 200
    made = through(evaluate.windowed_tensor(stream, ["x0", "x1"], "w", "ts", "10 minutes", "1 hour"), "complete", "tensor_out")
    whole = tensors.tensor(rows.withColumn("begin", F.window("ts", "10 minutes").start), ["x0", "x1"], "w", ["begin"])
    same = lambda df: sorted((str(r.begin), round(r.total, 9), round(r.c_01, 9)) for r in df.collect())
    assert same(made) == same(whole)
