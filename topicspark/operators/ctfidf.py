"""Class-based TF-IDF in long form: (topic, word, n) and what follows from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.functions import text as tx
from topicspark.functions.batches import document_ends, partial_counts
from topicspark.sources.shared import written

EMPTY_WORD = "emptydoc"


def term_counts(
    docs: DataFrame, topic: str = "topic", text: str = "text", key: str = "doc_id", english: bool = True,
    ngram_range: tuple[int, int] = (1, 1), stop_words: Sequence[str] = (), min_df: int = 1, max_features: int | None = None, once: bool = True,
) -> DataFrame:
    """``topic, word, n``. ``min_df`` is the number of topics a word must be in; ``max_features`` keeps the most frequent
    words over all topics, ties by name. A topic without any word has the one word ``emptydoc``.

    The texts are read once: their counts are written, and what topics have none is asked of these. Without ``once``, for
    the batches of a stream, nothing is written and the texts are read twice.
    """
    low, high = ngram_range
    counts = partial_counts(docs.where(F.col(topic).isNotNull()), {"topic": F.col(topic)}, text, english, stop_words, low, high)
    if high > 1:
        across = tx.borders(document_ends(docs, high - 1, topic, text, key, english, stop_words), low, high).where("topic IS NOT NULL")
        counts = counts.unionByName(across.select("topic", "word", F.lit(1).cast("bigint").alias("n")))
    counts = _with_empty(counts.groupBy("topic", "word").agg(F.sum("n").alias("n")), docs, topic, once)
    if min_df > 1:
        enough = counts.groupBy("word").agg(F.count("*").alias("_t")).where(F.col("_t") >= min_df)
        counts = counts.join(enough, "word", "left_semi").select("topic", "word", "n")
    if max_features is not None:
        # max_features words at most, a parameter
        best = counts.groupBy("word").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "word").limit(max_features).select("word")
        counts = counts.join(best, "word", "left_semi").select("topic", "word", "n")
    return counts


def _with_empty(counts: DataFrame, docs: DataFrame, topic: str, once: bool) -> DataFrame:
    """The counts, written if ``once``, and ``emptydoc`` for the topics that have none."""
    if once:
        counts = written(counts, "counts")
    every = docs.select(F.col(topic).alias("topic")).where(F.col(topic).isNotNull()).distinct()
    empty = every.join(counts.select("topic").distinct(), "topic", "left_anti").select("topic", F.lit(EMPTY_WORD).alias("word"), F.lit(1).cast("bigint").alias("n"))
    if not once or not empty.isEmpty():
        counts = counts.unionByName(empty)
    return counts


def summed(sliced: DataFrame, docs: DataFrame, topic: str = "topic") -> DataFrame:
    """``topic, word, n`` from ``slice, topic, word, n`` of the same documents, whose texts aren't read again."""
    counts = sliced.where("topic IS NOT NULL").groupBy("topic", "word").agg(F.sum("n").alias("n"))
    return _with_empty(counts, docs, topic, True)


def idf(
    counts: DataFrame, bm25: bool = False, seeds: Mapping[str, float] | None = None,
) -> DataFrame:
    """``word, df, idf``: ln(1 + A / df), or the BM25 form, with A the mean number of words of a topic, cut to an integer."""
    mean = counts.groupBy("topic").agg(F.sum("n").alias("s")).agg(F.floor(F.avg("s")).alias("a"))
    df = counts.groupBy("word").agg(F.sum("n").alias("df"))
    return df.crossJoin(F.broadcast(mean)).select("word", "df", _idf(F.col("a"), F.col("df"), bm25, seeds).alias("idf"))


def _idf(a: Column, df: Column, bm25: bool, seeds: Mapping[str, float] | None) -> Column:
    value = F.log1p((a - df + 0.5) / (df + 0.5)) if bm25 else F.log1p(a / df)
    if seeds:
        # a short list that belongs to the configuration
        factor = F.create_map(*[F.lit(x) for pair in seeds.items() for x in pair])
        value = value * F.coalesce(F.element_at(factor, F.col("word")), F.lit(1.0))
    return value


def seed_factors(seed_words: Sequence[str] = (), seed_multiplier: float = 2.0, seed_topic_list: Sequence[Sequence[str]] = ()) -> dict[str, float]:
    """Factors of the seeded words; those of seed topics have 1.2, also where they are in both lists."""
    return dict.fromkeys(seed_words, float(seed_multiplier)) | {w: 1.2 for ws in seed_topic_list for w in ws}


def weights(counts: DataFrame, bm25: bool = False, reduce_frequent_words: bool = False, seeds: Mapping[str, float] | None = None) -> DataFrame:
    """``topic, word, n, df, weight``: the share of the word in its topic (or the root of it) times its idf.

    The counts of a word are summed before the shuffle and joined back to it, so that a word of very many topics is never
    one task's alone; the totals, a row for each topic, are joined too. These are written, so that Spark knows their size
    and doesn't shuffle the counts by topic for a few of them.
    """
    totals = written(counts.groupBy("topic").agg(F.sum("n").alias("s")), "totals")
    totals = totals.crossJoin(F.broadcast(totals.agg(F.floor(F.avg("s")).alias("a"))))
    rows = counts.join(counts.groupBy("word").agg(F.sum("n").alias("df")), "word").join(totals, "topic")
    tf = F.col("n") / F.col("s")
    tf = F.sqrt(tf) if reduce_frequent_words else tf
    return rows.select("topic", "word", "n", "df", (tf * _idf(F.col("a"), F.col("df"), bm25, seeds)).alias("weight"))


def under_idf(counts: DataFrame, known: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """``*by, word, n, weight`` of other counts under an existing idf table; words without idf are left out, though they
    count in the share. ``counts`` are read twice, so they should be written."""
    counts = counts.join(written(counts.groupBy(*by).agg(F.sum("n").alias("s")), "totals"), list(by))
    return counts.join(known.select("word", "idf"), "word").select(*by, "word", "n", (F.col("n") / F.col("s") * F.col("idf")).alias("weight"))


def top_words(weighted: DataFrame, n: int = 10, by: Sequence[str] = ("topic",), score: str = "weight") -> DataFrame:
    """``*by, rank, word, score``: the ``n`` best words, ties by name. Spark cuts each partition's groups to n rows before
    the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), "word"))
    return weighted.withColumn("rank", rank).where(F.col("rank") <= n).select(*by, "rank", "word", F.col(score).alias("score"))


def word_lists(ranked: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """``*by, words``: arrays in the order of the ranks."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return ranked.groupBy(*by).agg(F.transform(ordered, lambda x: x["word"]).alias("words"))
