"""Text to terms: cleaning, words, n-grams. All of it stays in JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.sources.shared import written

#: A word has two characters or more; in English mode only ASCII letters and digits are left by then.
WORD, ENGLISH_WORD = r"(?U)\b\w\w+\b", "[a-z0-9]{2,}"


def clean(text: Column, english: bool = True) -> Column:
    """Line feeds and tabs become spaces; in English mode all but ASCII letters, digits and spaces goes. Null counts as empty."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\n\t", "  ")
    return F.regexp_replace(flat, "[^A-Za-z0-9 ]+", "") if english else flat


def words(text: Column, english: bool = True) -> Column:
    """Words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(clean(text, english)), F.lit(ENGLISH_WORD if english else WORD), F.lit(0))


def tokens(docs: DataFrame, topic: str = "topic", text: str = "text", key: str = "doc_id", english: bool = True) -> DataFrame:
    """``topic, doc_id, pos, word``; only these columns of the documents are read."""
    return docs.select(F.col(topic).alias("topic"), F.col(key).alias("doc_id"), F.posexplode(words(F.col(text), english)).alias("pos", "word"))


def drop_stop_words(toks: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Without the stop words, a fixed list that belongs to the configuration."""
    return toks.where(~F.col("word").isin(*stop_words)) if stop_words else toks


def document_words(docs: DataFrame, topic: str = "topic", text: str = "text", key: str = "doc_id", english: bool = True, stop_words: Sequence[str] = ()) -> DataFrame:
    """``topic, doc_id, w``: the words of each document that has any, in order, without the stop words."""
    w = words(F.col(text), english)
    if stop_words:
        gone = F.array(*map(F.lit, stop_words))
        w = F.filter(w, lambda x: ~F.array_contains(gone, x))
    return docs.select(F.col(topic).alias("topic"), F.col(key).alias("doc_id"), w.alias("w")).where(F.size("w") > 0)


def ngrams(by_doc: DataFrame, low: int = 1, high: int = 1) -> DataFrame:
    """``topic, word`` with n-grams of low..high words from ``topic, doc_id, w``. The texts of a topic count as one, in the
    order of doc_id, so an n-gram may span documents; each document has a word at least.

    N-grams within a document come from its array of words.
    """

    def runs(w: str, n: Column, k: int) -> Column:
        """The n-grams of k words that begin at the first ``n`` words."""
        if k == 1:
            return F.slice(w, 1, n)
        last = F.least(n, F.size(w) - (k - 1))
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", *(F.element_at(w, i + j) for j in range(k))))

    inside = by_doc.select("topic", F.explode(F.concat(*(runs("w", F.size("w"), k) for k in range(low, high + 1)))).alias("word"))
    if high == 1:
        return inside
    span = high - 1
    ends = by_doc.select("topic", "doc_id", F.slice("w", 1, span).alias("h"), F.slice("w", -F.least(F.size("w"), F.lit(span)), F.lit(span)).alias("e"))
    return inside.unionByName(borders(ends, low, high))


def borders(ends: DataFrame, low: int, high: int) -> DataFrame:
    """``topic, word``: the n-grams of up to ``high`` words that span documents, from ``topic, doc_id, h, e``, the first and
    last high - 1 words of each document. Only these travel."""
    span = high - 1
    # parts of neighbouring documents, so that no task has a whole topic
    ends = written(ends.repartitionByRange("topic", "doc_id").withColumn("part", F.spark_partition_id()), "ends")
    inner = W.partitionBy("topic", "part").orderBy("doc_id")
    first = ends.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= span).groupBy("topic", "part")
    first = first.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("r", "h"))), lambda x: x["h"])).alias("own"))
    # the first words of the parts that follow: a topic has no more parts than there are partitions
    follow = W.partitionBy("topic").orderBy("part").rowsBetween(1, span)
    beyond = first.select("topic", "part", F.slice(F.flatten(F.collect_list("own").over(follow)), 1, span).alias("beyond"))
    inside_part = F.flatten(F.collect_list("h").over(inner.rowsBetween(1, span)))
    ends = ends.withColumn("near", inside_part).join(beyond, ["topic", "part"])
    ends = ends.select("topic", F.size("e").alias("n"), F.concat("e", F.slice(F.concat("near", "beyond"), 1, span)).alias("x"))

    def across(k: int) -> Column:
        """Those that begin in the document and end after it."""
        first, last = F.greatest(F.col("n") - (k - 2), F.lit(1)), F.least(F.col("n"), F.size("x") - (k - 1))
        at = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", *(F.element_at("x", i + j) for j in range(k))))

    return ends.select("topic", F.explode(F.concat(*(across(k) for k in range(max(low, 2), high + 1)))).alias("word"))


def truncate_words(text: Column, n: int, unit: str = "whitespace") -> Column:
    """The first ``n`` characters (unit "char") or words of a text."""
    if unit == "char":
        return F.substring(text, 1, n)
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")
