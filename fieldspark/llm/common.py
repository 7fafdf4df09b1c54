"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from fieldspark.sessions import checkpointed, shared_dir

__all__ = ["checkpointed", "kept_rows", "quoted", "shared_dir", "table", "text_blocks"]


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_blocks(batches: Iterable[pa.RecordBatch], max_bytes: int, column: str = "") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices whose column (the first of texts, if none is named) holds about max_bytes at most (one row at
    least), so that what a task makes from a slice stays bounded."""
    for batch in batches:
        texts = (i for i, f in enumerate(batch.schema) if pa.types.is_string(f.type) or pa.types.is_binary(f.type))
        which = batch.schema.get_field_index(column) if column else next(texts)
        lengths = pa.compute.binary_length(batch.column(which)).fill_null(0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(lengths):
            if i > begin and size + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.RecordBatch], list[bool]], max_bytes: int = 2 << 20) -> DataFrame:
    """The rows of docs, all columns as they are, for which ``keep`` says so of a slice of rows. Nothing is shuffled."""

    names = docs.columns
    plain = [f"c{k}" for k in range(len(docs.columns))]  # mapInArrow would read dots in names as paths
    schema = StructType([StructField(name, field.dataType, field.nullable) for name, field in zip(plain, docs.schema)])
    text_col = plain[names.index(text_col)]
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_blocks(batches, max_bytes, text_col):
            yield rows.filter(pa.array(keep(rows.rename_columns(names)), pa.bool_()))

    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*names)
