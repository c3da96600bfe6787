"""The rows behind each chart; drawing is left to whoever has a library for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.operators import assign, cluster


def _largest(sizes: DataFrame, n: int) -> DataFrame:
    return sizes.where("topic <> -1").orderBy(F.desc("count"), "topic").limit(n).select("topic")


def barchart(ranked: DataFrame, sizes: DataFrame, n_topics: int = 8, n_words: int = 5) -> DataFrame:
    """``topic, rank, word, score`` of the largest topics."""
    return ranked.join(_largest(sizes, n_topics), "topic", "left_semi").where(F.col("rank") <= n_words).select("topic", "rank", "word", "score")


def term_rank(ranked: DataFrame, log_scale: bool = False) -> DataFrame:
    """``topic, rank, score``: how fast the scores of a topic fall."""
    score = F.log10("score") if log_scale else F.col("score")
    return ranked.where((F.col("topic") != -1) & (F.col("score") > 0)).select("topic", "rank", score.alias("score"))


def heatmap(topic_vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``topic_a, topic_b, label_a, label_b, similarity``; labels over 30 characters are cut."""
    short = labels.select("topic", F.when(F.length("label") > 30, F.concat(F.substring("label", 1, 27), F.lit("..."))).otherwise(F.col("label")).alias("label"))
    rows = assign.topic_similarity(topic_vectors)
    rows = rows.join(short.select(F.col("topic").alias("topic_a"), F.col("label").alias("label_a")), "topic_a")
    return rows.join(short.select(F.col("topic").alias("topic_b"), F.col("label").alias("label_b")), "topic_b").select("topic_a", "topic_b", "label_a", "label_b", "similarity")


def distribution(weights: DataFrame, labels: DataFrame, least: float = 0.015) -> DataFrame:
    """``doc_id, topic, label, weight`` of at least ``least``."""
    return weights.where(F.col("weight") >= least).join(labels, "topic").select("doc_id", "topic", "label", "weight")


def token_distribution(tokens: DataFrame) -> DataFrame:
    """``doc_id, pos, token, weights``: a map of topics for each token, topics without weight left out."""
    return tokens.groupBy("doc_id", "pos", "token").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("topic", "weight")))).alias("weights"))


def topics_map(topic_vectors: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """``topic, x, y, count, label``: topics in the plane of their two main components."""
    flat = cluster.reduce_dimensions(topic_vectors.where("topic <> -1"), 2, key="topic", name="p")
    return flat.join(sizes, "topic").join(labels, "topic").select("topic", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "count", "label")


def documents_map(docs: DataFrame, vectors: DataFrame, labels: DataFrame, share: float = 1.0, least: int = 100) -> DataFrame:
    """``doc_id, topic, label, x, y``: documents in the plane, ``share`` of each topic's with ``least`` or more (a sampling
    parameter of the chart, by hash of the id). Outliers are "Unlabelled"."""
    n = F.count("*").over(W.partitionBy("topic"))
    kept = docs.select("doc_id", "topic", n.alias("_n")).where((F.col("_n") < least) | (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000))
    flat = cluster.reduce_dimensions(vectors.join(kept.select("doc_id"), "doc_id", "left_semi"), 2, name="p")
    rows = kept.join(flat, "doc_id").join(labels, "topic", "left")
    label = F.when(F.col("topic") == -1, "Unlabelled").otherwise(F.col("label"))
    return rows.select("doc_id", "topic", label.alias("label"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
