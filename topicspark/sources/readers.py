"""Documents, vectors and images from files, and the engine's tables back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.sources.shared import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts take time to work through: over all cores even if its files are one split."""
    return spread(table(spark, folder, name))


def documents(spark: SparkSession, path: str, kind: str = "parquet", text: str = "text", key: str | None = "doc_id", **options) -> DataFrame:
    """``doc_id, text`` and the other columns of a file or folder: parquet, json, csv, orc or text (a line a document). Without
    a key column the id is a hash of the text's place in its file, the same at each reading of ``text`` files."""
    if kind == "text":
        rows = spark.read.text(path, **options).withColumnRenamed("value", "text")
        meta = rows.select("*", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_n"))
        return meta.select(F.xxhash64("file_path", "file_block_start", "_n").alias("doc_id"), "text")
    rows = spark.read.format(kind).options(**options).load(path)
    if text not in rows.columns:
        raise ValueError(f"no column {text}; there are {rows.columns}")
    rows = rows.withColumnRenamed(text, "text")
    return rows.withColumnRenamed(key, "doc_id") if key else rows.withColumn("doc_id", F.xxhash64("text"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, content`` of image files, for embedders that take bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def check_documents(docs: DataFrame, text: str = "text") -> None:
    if not isinstance(docs, DataFrame):
        raise TypeError("documents are a DataFrame")
    if dict(docs.dtypes).get(text) != "string":
        raise TypeError(f"documents need a string column {text}")


def check_embeddings(docs: DataFrame, vectors: DataFrame, key: str = "doc_id") -> None:
    """Every document needs one vector."""
    missing = docs.select(key).join(vectors.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise ValueError("there are documents without a vector")
