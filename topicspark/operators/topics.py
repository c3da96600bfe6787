"""Sizes, labels, information about topics and documents, representative documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.functions import text as tx
from topicspark.operators import ctfidf
from topicspark.sources.shared import written

OUTLIER = -1


def sizes(docs: DataFrame, topic: str = "topic") -> DataFrame:
    """``topic, count``."""
    return docs.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("count"))


def labels(words: DataFrame, n: int = 4, prefix: bool = True, separator: str = "_", word_length: int | None = None) -> DataFrame:
    """``topic, label``: the topic's number and its first ``n`` words, each cut to ``word_length`` characters."""
    own = F.slice("words", 1, n)
    if word_length:
        own = F.transform(own, lambda w: F.substring(w, 1, word_length))
    parts = F.concat(F.array(F.col("topic").cast("string")), own) if prefix else own
    return words.select("topic", F.array_join(parts, separator).alias("label"))


def custom_labels(default: DataFrame, given: Mapping[int, str]) -> DataFrame:
    """``topic, label``: the given labels, and the default ones of topics that have none."""
    if not given:
        return default
    names = default.sparkSession.createDataFrame(list(given.items()), "topic int, _given string")
    return default.join(F.broadcast(names), "topic", "left").select("topic", F.coalesce("_given", "label").alias("label"))


def topic_info(size: DataFrame, words: DataFrame, label: DataFrame, representative: DataFrame | None = None) -> DataFrame:
    """``topic, count, name, words`` and, if given, ``representative_docs`` (ids); one row a topic, by topic."""
    info = size.join(words, "topic", "left").join(label.withColumnRenamed("label", "name"), "topic", "left")
    info = info.select("topic", "count", "name", "words")
    if representative is not None:
        own = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
        info = info.join(representative.groupBy("topic").agg(own.alias("representative_docs")), "topic", "left")
    return info.orderBy("topic")


def document_info(docs: DataFrame, info: DataFrame, representative: DataFrame, topic: str = "topic") -> DataFrame:
    """The documents with ``name``, ``top_n_words`` and ``representative_document``, and what else they came with, such as a
    ``probability``. Flags go by doc_id, so copies of a
    representative text aren't flagged. Both sides have a row or a few rows for each topic."""
    flags = representative.select("doc_id", F.lit(True).alias("representative_document"))
    about = info.select(F.col("topic").alias(topic), "name", F.array_join("words", " - ").alias("top_n_words"))
    joined = docs.join(about, topic, "left").join(flags, "doc_id", "left")
    return joined.withColumn("representative_document", F.coalesce("representative_document", F.lit(False)))


def sample_per_topic(docs: DataFrame, topic: str, n: int, key: str = "doc_id") -> DataFrame:
    """Up to ``n`` documents of each topic, a draw by the MD5 of their ids. Each partition's rows are cut to n a topic before
    the shuffle. Only ids are ranked; the texts of the drawn ones, which are written, are fetched."""
    rank = F.row_number().over(W.partitionBy(topic).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))
    drawn = docs.select(topic, key).withColumn("_rank", rank).where(F.col("_rank") <= n).select(topic, key)
    return docs.join(written(drawn, "drawn"), [topic, key], "left_semi")


def document_similarity(docs: DataFrame, weighted: DataFrame, idf: DataFrame, topic: str = "topic", english: bool = True) -> DataFrame:
    """``doc_id, topic, similarity``: the cosine of each document's c-TF-IDF vector with that of its own topic. Joined on
    (topic, word), so each count meets one weight."""
    toks = tx.tokens(docs, topic, english=english).groupBy("topic", "doc_id", "word").agg(F.count("*").alias("n"))
    own = toks.join(idf.select("word", "idf"), "word").withColumn("x", F.col("n") * F.col("idf"))
    length = weighted.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    both = own.join(weighted.select("topic", "word", "weight"), ["topic", "word"], "left").join(length, "topic")
    found = both.groupBy("doc_id", "topic", "length").agg(F.sum(F.col("x") * F.col("weight")).alias("d"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return found.select("doc_id", "topic", F.when(F.col("l") * F.col("length") > 0, F.col("d") / (F.col("l") * F.col("length"))).otherwise(0.0).alias("similarity"))


def representative_docs(docs: DataFrame, weighted: DataFrame, idf: DataFrame, n: int = 3, samples: int = 500, topic: str = "topic", english: bool = True) -> DataFrame:
    """``topic, rank, doc_id, similarity``: the ``n`` documents of each topic most similar to it, of up to ``samples``
    documents a topic (a parameter of the operator, as in topic_info)."""
    few = sample_per_topic(docs.select("doc_id", "text", topic).where(F.col(topic).isNotNull()), topic, samples)
    scored = document_similarity(few, weighted, idf, topic, english)
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc(F.round("similarity", 9)), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select("topic", "rank", "doc_id", "similarity")


def describe(docs: DataFrame, topic: str = "topic", top_n: int = 10, english: bool = True, **count_options) -> dict[str, DataFrame]:
    """The tables that describe the topics of a table of documents: counts, idf, weights, words, labels, sizes."""
    counts = ctfidf.term_counts(docs, topic, english=english, **count_options)
    weighted = ctfidf.weights(counts)
    words = ctfidf.word_lists(ctfidf.top_words(weighted, top_n))
    return {"counts": counts, "idf": ctfidf.idf(counts), "weights": weighted, "words": words, "labels": labels(words), "sizes": sizes(docs, topic)}
