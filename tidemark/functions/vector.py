"""Vectors as arrays of numbers, inside the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, unequal lengths or a zero vector."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def fit_dimension(v: Column, dim: int) -> Column:
    """The leading ``dim`` numbers; null if there are fewer."""
    return F.when(F.size(v) >= dim, F.slice(v, 1, dim))


def dummy_embedding(text: Column, dim: int = 384) -> Column:
    """(code point mod 97) / 96 of the leading characters, filled up with zeros."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.when(i <= F.length(text), (F.ascii(F.substring(text, i, F.lit(1))) % 97) / 96.0).otherwise(0.0))


def mean_pool(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, mean: the mean of each key's vectors, number by number; vectors of one key that differ in length are an error."""
    parts = vectors.select(key, F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    ragged = F.when(F.min("n") != F.max("n"), F.raise_error(F.lit("vectors of one key differ in length")))
    return parts.groupBy(key).agg(ragged.cast("boolean").alias("ok"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean")).where("ok IS NULL").select(key, "mean")


def max_sim(query: list[list[float]], vectors: Column) -> Column:
    """Sum over the query's vectors of the largest dot product with any of the document's."""
    total = F.lit(0.0)
    for q in query:
        total = total + F.coalesce(F.array_max(F.transform(vectors, lambda v: dot(v, literal(q)))), F.lit(0.0))
    return total


def pack(vectors: DataFrame, vector: str, packed: str) -> DataFrame:
    """Adds little-endian 32-bit floats as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if v is None else np.asarray(v, "<f4").tobytes() for v in batch.column(vector).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, packed])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField(packed, T.BinaryType())]))


def unpack(vectors: DataFrame, packed: str, vector: str) -> DataFrame:
    """Adds the numbers of packed 32-bit floats; bytes that are no whole numbers give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in batch.column(packed).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float32()))], [*batch.schema.names, vector])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))]))
