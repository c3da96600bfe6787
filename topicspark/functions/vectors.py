"""Vectors as arrays: means by group in the JVM, products of whole Arrow batches with a small matrix in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of topic vectors that are sent to every task; more is an error.
SENT_BYTES = 256 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where one of them has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def means(rows: DataFrame, by: str, vector: str, weight: str | None = None, name: str = "embedding") -> DataFrame:
    """``by, size, embedding``: the mean vector of each group, summed up map-side; with ``weight``, the weighted mean."""
    dense = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    mean = Summarizer.mean(dense, F.col(weight)) if weight else Summarizer.mean(dense)
    size = F.sum(weight) if weight else F.count("*")
    return rows.where(F.col(by).isNotNull() & F.col(vector).isNotNull()).groupBy(by).agg(size.alias("size"), vector_to_array(mean).alias(name))


def matrix(rows: DataFrame, key: str, vector: str) -> tuple[list, np.ndarray]:
    """Keys and unit vectors of a small table (topics), ordered by key. Refuses more than SENT_BYTES."""
    n = rows.count()
    first = rows.select(F.size(vector).alias("d")).first()
    if n and n * first["d"] * 8 > SENT_BYTES:
        raise ValueError(f"{n} vectors of {first['d']} numbers are more than {SENT_BYTES} bytes; reduce the topics or their dimensions")
    got = rows.select(key, vector).orderBy(key).collect()
    x = np.array([r[1] for r in got], dtype=np.float64).reshape(len(got), -1)
    return [r[0] for r in got], unit(x)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((0, 1))
    return np.divide(x, size, out=np.zeros_like(x, dtype=np.float64), where=size > 0)


def rows_of(column: pa.Array) -> np.ndarray:
    """An array column without nulls as a matrix."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def similarities(rows: DataFrame, key: str, vector: str, to: np.ndarray, name: str = "similarities") -> DataFrame:
    """``key, similarities``: the cosine of each row's vector with each row of ``to`` (of length 1), one product a batch. Rows
    with a null vector are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(to.T))
    own = rows.where(F.col(vector).isNotNull()).select(key, vector)

    def compute(batches):
        for batch in batches:
            if batch.num_rows:
                s = unit(rows_of(batch.column(1))) @ sent.value
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, name])

    return own.mapInArrow(compute, T.StructType([own.schema[key], T.StructField(name, T.ArrayType(T.DoubleType()))]))


def nearest(rows: DataFrame, key: str, vector: str, labels: list, to: np.ndarray, label: str = "topic", kind: str = "int", tie: float = 1e-12) -> DataFrame:
    """``key, topic, similarity``: the most similar row of ``to`` (of length 1); the first of equals. Rows with a null vector
    are left out. Only the best leaves the product of a batch."""
    own = rows.where(F.col(vector).isNotNull()).select(key, vector)
    schema = T.StructType([own.schema[key], *T.StructType.fromDDL(f"{label} {kind}, similarity double").fields])
    sent = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(to.T), pa.array(labels, pa.string() if kind == "string" else pa.int64())))
    if not len(labels):
        return own.select(key, F.lit(None).cast(kind).alias(label), F.lit(None).cast("double").alias("similarity")).limit(0)

    def compute(batches):
        to, names = sent.value
        out = pa.string() if kind == "string" else {"int": pa.int32(), "bigint": pa.int64()}[kind]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s = unit(rows_of(part.column(1))) @ to
                best = s.max(axis=1)
                first = (s >= best[:, None] - tie).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), names.take(pa.array(first)).cast(out), pa.array(best)], names=[key, label, "similarity"])

    return own.mapInArrow(compute, schema)
