"""Topics of documents by similarity of vectors: nearest topic, search, guided and zero-shot assignment, merged vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.functions import vectors as vx


def nearest_topic(docs: DataFrame, topic_vectors: DataFrame, key: str = "doc_id", vector: str = "embedding", keep_outlier: bool = True) -> DataFrame:
    """``doc_id, topic, similarity``. The vector of topic -1 competes unless ``keep_outlier`` is off."""
    own = topic_vectors if keep_outlier else topic_vectors.where("topic <> -1")
    names, x = vx.matrix(own, "topic", "embedding")
    return vx.nearest(docs, key, vector, names, x)


def nearest_center(docs: DataFrame, centers: DataFrame, topic_vectors: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``doc_id, topic, similarity``: the topic of the nearest of ``centers`` (``topic, embedding``), as k-means assigns rows,
    and the similarity with that topic's vector. Rows with a null vector are left out; NaN is 0 for the distance."""
    got = sorted((r["topic"], r["embedding"]) for r in centers.collect())
    names, x = vx.matrix(topic_vectors, "topic", "embedding")
    own = docs.where(F.col(vector).isNotNull()).select(key, vector)
    sent = docs.sparkSession.sparkContext.broadcast((np.array([t for t, _ in got]), np.array([c for _, c in got]), np.stack([x[names.index(t)] for t, _ in got])))

    def compute(batches):
        topic, center, unit = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = vx.rows_of(part.column(1))
                w = np.where(np.isnan(v), 0.0, v)
                best = ((center**2).sum(axis=1) - 2 * w @ center.T).argmin(axis=1)
                similarity = (vx.unit(v) * unit[best]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(topic[best].astype(np.int32)), pa.array(similarity)], names=[key, "topic", "similarity"])

    return own.mapInArrow(compute, T.StructType([own.schema[key], *T.StructType.fromDDL("topic int, similarity double").fields]))


def find_topics(topic_vectors: DataFrame, query: list[float], n: int = 5) -> DataFrame:
    """``topic, similarity`` of the ``n`` topics most similar to a vector, ties by number."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return topic_vectors.select("topic", F.round(vx.cosine(F.col("embedding"), asked), 9).alias("similarity")).orderBy(F.desc("similarity"), "topic").limit(n)


def topic_similarity(topic_vectors: DataFrame, include_outlier: bool = False) -> DataFrame:
    """``topic_a, topic_b, similarity`` of all pairs of topics, the square of their number."""
    own = topic_vectors if include_outlier else topic_vectors.where("topic <> -1")
    a = own.select(F.col("topic").alias("topic_a"), F.col("embedding").alias("_a"))
    b = own.select(F.col("topic").alias("topic_b"), F.col("embedding").alias("_b"))
    return a.crossJoin(b).select("topic_a", "topic_b", vx.cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def merged_vectors(topic_vectors: DataFrame, mapping: DataFrame) -> DataFrame:
    """``topic, size, embedding`` after merging: means weighted by size."""
    rows = topic_vectors.join(mapping.select(F.col("from_topic").alias("topic"), "to_topic"), "topic").select(F.col("to_topic").alias("topic"), "size", "embedding")
    return vx.means(rows, "topic", "embedding", "size")


def word_weighted_vectors(weighted: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """``topic, size, embedding``: the mean of the word vectors weighted by c-TF-IDF; topics whose weights are all zero weigh
    their words alike."""
    total = F.sum("weight").over(W.partitionBy("topic"))
    rows = weighted.join(word_vectors, "word").withColumn("w", F.when(total > 0, F.col("weight")).otherwise(1.0))
    return vx.means(rows, "topic", "embedding", "w")


def zero_shot(docs: DataFrame, label_vectors: np.ndarray, threshold: float = 0.7, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``doc_id, topic, similarity``: the most similar label's number where the similarity reaches the threshold, else null;
    those documents are left for clustering."""
    best = vx.nearest(docs, key, vector, list(range(len(label_vectors))), vx.unit(np.asarray(label_vectors, dtype=float)))
    return best.withColumn("topic", F.when(F.col("similarity") >= threshold, F.col("topic")))


def combine_zero_shot(assigned: DataFrame, clustered: DataFrame, n_labels: int) -> DataFrame:
    """``doc_id, topic``: labels keep 0..n-1, clusters go up by n, -1 stays."""
    up = F.when(F.col("topic") == -1, -1).otherwise(F.col("topic") + n_labels).cast("int").alias("topic")
    return assigned.where("topic IS NOT NULL").select("doc_id", "topic").unionByName(clustered.select("doc_id", up))


def guided(docs: DataFrame, seed_vectors: np.ndarray, key: str = "doc_id", vector: str = "embedding", share: float = 0.25) -> DataFrame:
    """``doc_id, topic, embedding``: documents nearer to a seed topic than to the mean of all documents get its number and
    move towards it by ``share``; the others are -1 and stay where they are."""
    mean = vx.means(docs.select(F.lit(0).alias("g"), vector), "g", vector).first()
    seeds = np.asarray(seed_vectors, dtype=float)
    if mean is None:
        return docs.select(key, F.lit(-1).alias("topic"), F.col(vector).alias("embedding"))
    to = vx.unit(np.vstack([seeds, np.array(mean["embedding"])[None]]))
    best = vx.nearest(docs, key, vector, [*range(len(seeds)), -1], to)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in seeds])
    moved = F.zip_with(vector, F.element_at(table, F.col("topic") + 1), lambda x, y: x.cast("double") * (1 - share) + y * share)
    joined = docs.select(key, vector).join(best.select(key, "topic"), key)
    return joined.select(key, "topic", F.when(F.col("topic") >= 0, moved).otherwise(F.transform(vector, lambda x: x.cast("double"))).alias("embedding"))
