"""New topics for the documents of topic -1, by four strategies; the other documents keep theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.operators import assign
from topicspark.operators.distribution import approximate_distribution


def _replace(docs: DataFrame, best: DataFrame) -> DataFrame:
    """``doc_id, topic, new_topic``; ``best`` has ``doc_id, topic`` of those that get a new one."""
    joined = docs.select("doc_id", "topic").join(best.select("doc_id", F.col("topic").alias("_new")), "doc_id", "left")
    return joined.select("doc_id", "topic", F.when(F.col("topic") == -1, F.coalesce("_new", F.lit(-1))).otherwise(F.col("topic")).cast("int").alias("new_topic"))


def _best(scores: DataFrame, score: str, threshold: float) -> DataFrame:
    """The topic of the highest score, the lowest number of equals, if the score is above 0 and reaches the threshold."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("_s"), "topic"))
    rows = scores.withColumn("_s", F.round(score, 9)).where((F.col("_s") > 0) & (F.col("_s") >= threshold) & (F.col("topic") != -1))
    return rows.withColumn("_r", rank).where("_r = 1").select("doc_id", "topic")


def by_probabilities(docs: DataFrame, probabilities: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``probabilities``: ``doc_id, topic, probability``."""
    own = probabilities.join(docs.where("topic = -1").select("doc_id"), "doc_id", "left_semi")
    return _replace(docs, _best(own, "probability", threshold))


def by_distributions(docs: DataFrame, weighted: DataFrame, idf: DataFrame, threshold: float = 0.0, english: bool = True, **options) -> DataFrame:
    """By the weights of windows of tokens, over the outliers' texts only."""
    found = approximate_distribution(docs.where("topic = -1"), weighted, idf, english=english, **options)
    return _replace(docs, _best(found, "weight", threshold))


def by_ctfidf(docs: DataFrame, weighted: DataFrame, idf: DataFrame, threshold: float = 0.0, english: bool = True) -> DataFrame:
    """By the cosine of a document's c-TF-IDF vector with each topic's, over the outliers' texts only."""
    found = approximate_distribution(docs.where("topic = -1"), weighted, idf, None, min_similarity=0.0, english=english)
    return _replace(docs, _best(found, "weight", threshold))


def by_embeddings(docs: DataFrame, topic_vectors: DataFrame, vectors: DataFrame, threshold: float = 0.0) -> DataFrame:
    """By the cosine of the documents' vectors (``doc_id, embedding``) with the topics'."""
    own = vectors.join(docs.where("topic = -1").select("doc_id"), "doc_id", "left_semi")
    best = assign.nearest_topic(own, topic_vectors, keep_outlier=False)
    return _replace(docs, best.where((F.round("similarity", 9) > 0) & (F.round("similarity", 9) >= threshold)))
