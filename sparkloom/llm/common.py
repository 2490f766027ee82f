"""Shared pieces: Arrow helpers, text expressions, whole rows beside columns that an operator adds."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread

#: Java and RE2 class of the ASCII white space that ends a word, and its complement.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: Rows of a slice: with texts of 100 kB, 6 MB.
BATCH_ROWS = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches (of 64 MB at most, Spark's own bound) in slices of so many rows, which bound what a Python worker
    makes of them at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def rows_apart(docs: DataFrame, **more: Column) -> DataFrame:
    """(row, ...): each whole row in one struct, where no column of its own can clash with the columns beside it;
    text is a string in it. `unpacked` gives the rows back."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def with_field(rows: pa.StructArray, name: str, values: pa.Array) -> pa.StructArray:
    """The rows with one field replaced."""
    names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
    return pa.StructArray.from_arrays([values if n == name else x for n, x in zip(names, rows.flatten())], names)
