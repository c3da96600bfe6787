"""Vectors of documents: what can be computed here, and callables for everything else."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, PCA, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.functions import text as tx
from topicspark.functions import vectors as vx
from topicspark.functions.batches import pieces, words_of
from topicspark.sources.shared import new_folder


class Embedder(Protocol):
    """Gives ``doc_id, embedding`` of ``doc_id, text``."""

    def embed(self, docs: DataFrame) -> DataFrame: ...


class CallableEmbedder:
    """Any function of a list of texts that gives a matrix: a sentence encoder, a hosted service, a pipeline. It is called on
    the executors for ``batch`` texts at a time; empty texts are given as ``empty``."""

    def __init__(self, encode: Callable[[Sequence[str]], np.ndarray], batch: int = 256, empty: str = " "):
        self.encode, self.batch, self.empty = encode, batch, empty

    def embed(self, docs: DataFrame) -> DataFrame:
        encode, batch, empty = self.encode, self.batch, self.empty
        key = dict(docs.dtypes)["doc_id"]

        def run(frames):
            for frame in frames:
                texts = [t or empty for t in frame["text"]]
                parts = [np.asarray(encode(texts[i : i + batch]), dtype=np.float32) for i in range(0, len(texts), batch)]
                yield pd.DataFrame({"doc_id": frame["doc_id"], "embedding": [row.tolist() for p in parts for row in p]})

        return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {key}, embedding array<float>")


class WordVectorEmbedder:
    """The mean of the vectors (``word, embedding``) of a text's known words; texts without one have zeros. A join by word."""

    def __init__(self, word_vectors: DataFrame, dim: int, english: bool = True):
        self.words, self.dim, self.english = word_vectors, dim, english

    def embed(self, docs: DataFrame) -> DataFrame:
        toks = docs.select("doc_id", F.explode(tx.words(F.col("text"), self.english)).alias("word")).join(self.words, "word")
        found = vx.means(toks, "doc_id", "embedding").select("doc_id", "embedding")
        zeros = F.array_repeat(F.lit(0.0), self.dim)
        return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("embedding", zeros).alias("embedding"))

    @classmethod
    def train(cls, docs: DataFrame, dim: int = 64, seed: int = 42, english: bool = True) -> WordVectorEmbedder:
        words = docs.select(tx.words(F.col("text"), english).alias("w")).where(F.size("w") > 0)
        model = Word2Vec(vectorSize=dim, minCount=5, seed=seed, inputCol="w", outputCol="v").fit(words)
        return cls(model.getVectors().select("word", vector_to_array("vector").alias("embedding")), dim, english)


class TermEmbedder:
    """The light fallback: hashed terms, inverse document frequencies, principal components. The texts are read once; what
    follows is learnt from their written counts, those that Spark's HashingTF gives."""

    def __init__(self, dim: int = 64, features: int = 1024, english: bool = True):
        self.dim, self.features, self.english = dim, features, english

    def embed(self, docs: DataFrame) -> DataFrame:
        counted = self._hashed(docs)
        scaled = IDF(inputCol="tf", outputCol="x").fit(counted).transform(counted)
        return PCA(k=self.dim, inputCol="x", outputCol="v").fit(scaled).transform(scaled).select("doc_id", vector_to_array("v").alias("embedding"))


    def _hashed(self, docs: DataFrame) -> DataFrame:
        """``doc_id, tf``, written."""
        n, rows = self.features, docs.select("doc_id", (F.col("text") if self.english else tx.words(F.col("text"), False)).alias("w"))
        vector = T.StructType.fromDDL("type tinyint, size int, indices array<int>, values array<double>")

        def count(batches):
            for batch in batches:
                for piece in pieces(batch, 1):
                    sizes, words = words_of(piece.column(1))
                    place = (murmur3(words.dictionary).astype(np.int32).astype(np.int64) % n)[np.asarray(words.indices)]
                    pair, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + place, return_counts=True)
                    edges = pa.array(np.searchsorted(pair, np.arange(len(sizes) + 1) * n), pa.int32())
                    lists = [pa.ListArray.from_arrays(edges, x) for x in (pa.array(pair % n, pa.int32()), pa.array(times, pa.float64()))]
                    tf = pa.StructArray.from_arrays([pa.array(np.zeros(len(sizes)), pa.int8()), pa.array(np.full(len(sizes), n), pa.int32()), *lists], names=vector.names)
                    yield pa.RecordBatch.from_arrays([piece.column(0), tf], names=["doc_id", "tf"])

        at = new_folder(docs.sparkSession, "hashed")
        rows.mapInArrow(count, T.StructType([rows.schema["doc_id"], T.StructField("tf", vector)])).write.parquet(at)
        return docs.sparkSession.read.schema(T.StructType([rows.schema["doc_id"], T.StructField("tf", VectorUDT())])).parquet(at)


def murmur3(words: pa.StringArray, seed: int = 42) -> np.ndarray:
    """The 32 bits of Murmur3 of each word's bytes, words of one length at once."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else np.zeros(0, np.uint8)
    size, out = np.diff(offsets), np.zeros(len(words), np.uint32)

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        raw = np.zeros((len(own), -(-length // 4) * 4), np.uint8)
        raw[:, :length] = data[offsets[own][:, None] + np.arange(length)]
        blocks = raw.view("<u4").astype(np.uint32)
        h = np.full(len(own), seed, np.uint32)
        for i in range(length // 4):
            h = h ^ mixed(blocks[:, i])
            h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        if length % 4:
            h = h ^ mixed(blocks[:, -1])
        h = h ^ np.uint32(length)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
        out[own] = h ^ h >> np.uint32(16)
    return out


class MeanEmbedder:
    """The mean of what two embedders give for one document, such as its text and its image's caption."""

    def __init__(self, one: Embedder, two: Embedder):
        self.one, self.two = one, two

    def embed(self, docs: DataFrame) -> DataFrame:
        a, b = self.one.embed(docs), self.two.embed(docs).withColumnRenamed("embedding", "other")
        return a.join(b, "doc_id").select("doc_id", F.zip_with("embedding", "other", lambda x, y: (x + y) / 2).alias("embedding"))


class WordDocEmbedder:
    """One embedder for documents and another one for words, such as a topic's best terms."""

    def __init__(self, docs: Embedder | Callable, words: Embedder | Callable):
        self.docs, self.words = select_embedder(docs), select_embedder(words)

    def embed(self, docs: DataFrame) -> DataFrame:
        return self.docs.embed(docs)

    def embed_words(self, words: DataFrame) -> DataFrame:
        """``word, embedding`` of ``word``."""
        return word_vectors(self.words, words)


def word_vectors(embedder: Embedder, words: DataFrame) -> DataFrame:
    """``word, embedding`` of the distinct words of ``words``, by the embedder's own way with words if it has one."""
    if hasattr(embedder, "embed_words"):
        return embedder.embed_words(words)
    own = words.where("word IS NOT NULL").select("word").distinct()
    return embedder.embed(own.select(F.col("word").alias("doc_id"), F.col("word").alias("text"))).withColumnRenamed("doc_id", "word")


def select_embedder(what: Embedder | Callable | None) -> Embedder:
    """An embedder as it is, a function wrapped, nothing: the fallback."""
    if what is None:
        return TermEmbedder()
    if hasattr(what, "embed"):
        return what
    if callable(what):
        return CallableEmbedder(what)
    raise TypeError("an embedder has a method embed, or is a function of a list of texts")
