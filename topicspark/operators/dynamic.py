"""Topics over time and per class: words of each slice under the idf of all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.functions.batches import partial_counts
from topicspark.operators import ctfidf
from topicspark.sources.shared import written


def parse_times(docs: DataFrame, column: str, datetime_format: str | None = None) -> Column:
    """Strings become timestamps; numbers and timestamps stay."""
    if dict(docs.dtypes)[column] != "string":
        return F.col(column)
    return F.to_timestamp(F.col(column), datetime_format) if datetime_format else F.to_timestamp(F.col(column))


def equal_bins(docs: DataFrame, column: str, n: int, name: str = "bin") -> DataFrame:
    """The documents with the left edge of their bin: ``n`` bins of equal width, closed on the right, the lowest value in the
    first. The first edge lies a thousandth of the range lower."""
    span = docs.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x, lo, hi = F.col(column).cast("double"), F.col("lo"), F.col("hi")
    k = F.greatest(F.ceil((x - lo) / ((hi - lo) / n)) - 1, F.lit(0))
    edge = F.when(hi == lo, lo).when(k == 0, lo - (hi - lo) * 0.001).otherwise(lo + k * (hi - lo) / n)
    return docs.crossJoin(F.broadcast(span)).withColumn(name, F.round(edge, 9)).drop("lo", "hi")


def slice_counts(docs: DataFrame, slice_by: str, topic: str = "topic", english: bool = True) -> DataFrame:
    """``slice, topic, word, n``, written, also of documents without slice or topic."""
    counts = partial_counts(docs, {"slice": F.col(slice_by), "topic": F.col(topic)}, english=english)
    return written(counts.groupBy("slice", "topic", "word").agg(F.sum("n").alias("n")), "slices")


def _slice_weights(sliced: DataFrame, idf: DataFrame) -> DataFrame:
    """``slice, topic, word, n, weight``, written."""
    return written(ctfidf.under_idf(sliced.where("slice IS NOT NULL AND topic IS NOT NULL"), idf, ("slice", "topic")), "slice-weights")


def _normal(rows: DataFrame, *by: str) -> DataFrame:
    """Scaled to sum 1 by the groups' totals. These are written and joined, so that no task has a group as a whole."""
    total = written(rows.groupBy(*by).agg(F.sum(F.abs("weight")).alias("_total")), "totals")
    return rows.join(total, list(by)).withColumn("weight", F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(0.0)).drop("_total")


def _finish(rows: DataFrame, docs: DataFrame, slice_by: str, topic: str, n_words: int, name: str) -> DataFrame:
    """Best words of each slice and topic joined by commas, and the number of documents."""
    rows = rows.withColumn("score", F.round("weight", 12))
    words = ctfidf.word_lists(ctfidf.top_words(rows, n_words, ("slice", "topic"), "score"), ("slice", "topic"))
    freq = docs.where(F.col(slice_by).isNotNull() & F.col(topic).isNotNull()).groupBy(F.col(slice_by).alias("slice"), F.col(topic).alias("topic")).agg(F.count("*").alias("frequency"))
    return freq.join(words, ["slice", "topic"], "left").select("topic", F.coalesce(F.array_join("words", ", "), F.lit("")).alias("words"), "frequency", F.col("slice").alias(name))


def _with_global(rows: DataFrame, weighted: DataFrame, n_words: int) -> DataFrame:
    """The mean of each slice's row and the topic's own, both of sum 1; a word may be in one of them only.

    A word that a slice lacks has half its weight in the topic there. Of these all that can be among a slice's ``n_words``
    best are given: the topic's best, which come before all others of it whether the slice lacks them or adds to them, and
    the words of a weight below 0 here or there, which are in most of the texts and may be pulled down.
    """
    every = written(_normal(weighted.select("topic", "word", "weight"), "topic"), "shares")
    rows = rows.select("slice", "topic", "word", "weight")
    own = rows.join(every.withColumnRenamed("weight", "g"), ["topic", "word"], "left")
    own = own.select("slice", "topic", "word", ((F.col("weight") + F.coalesce("g", F.lit(0.0))) / 2).alias("weight"))
    half = every.withColumn("weight", F.col("weight") / 2)
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc(F.round("weight", 12)), "word"))
    low = written(rows.unionByName(every, allowMissingColumns=True).where("weight < 0").select("topic", "word").distinct(), "low")
    best = half.join(low, ["topic", "word"], "left_anti").withColumn("_r", rank).where(F.col("_r") <= n_words).drop("_r")
    best = written(best.unionByName(half.join(low, ["topic", "word"], "left_semi")), "best")
    has = rows.join(best, ["topic", "word"], "left_semi").select("slice", "topic", "word")
    lacked = rows.select("slice", "topic").distinct().join(best, "topic").join(has, ["slice", "topic", "word"], "left_anti")
    return own.unionByName(lacked.select("slice", "topic", "word", "weight"))


def topics_over_time(
    docs: DataFrame, weighted: DataFrame, idf: DataFrame, time: str, topic: str = "topic", evolution_tuning: bool = False, global_tuning: bool = True,
    n_words: int = 5, english: bool = True, sliced: DataFrame | None = None,
) -> DataFrame:
    """``topic, words, frequency, timestamp`` for each time and topic that occur together. ``sliced``: slice_counts() of them,
    if there are some already.

    Rows are scaled to sum 1. With ``evolution_tuning`` a row is averaged with the topic's tuned row at the time before
    (if it has one there), then with ``global_tuning`` with the topic's row over all times. Times are few (tens), so the
    evolution runs inside one row a topic and word.
    """
    sliced = slice_counts(docs, time, topic, english) if sliced is None else sliced
    rows = _normal(_slice_weights(sliced, idf), "slice", "topic")
    if evolution_tuning:
        rows = _evolve(rows, weighted, global_tuning, n_words)
    elif global_tuning:
        rows = _with_global(rows, weighted, n_words)
    return _finish(rows, docs, time, topic, n_words, "timestamp")


def _evolve(rows: DataFrame, weighted: DataFrame, global_tuning: bool, n_words: int) -> DataFrame:
    """The recursion along the times of each (topic, word), step by step over the rows of an Arrow batch: a topic present at
    the time before lends its tuned value, else the value stands alone. Of a batch the rows are given that can be among the
    ``n_words`` best of their topic and time, all that tie included."""
    # a row a time, a row a topic
    step, place = (written(rows.select(c).distinct().withColumn(n, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(c)) - 1), n) for c, n in (("slice", "t"), ("topic", "place")))
    pairs = rows.select("slice", "topic").distinct().join(step, "slice").join(place, "topic").select("place", "t").collect()
    present = np.zeros([1 + max((r[c] for r in pairs), default=-1) for c in ("place", "t")], dtype=bool)
    present[[r["place"] for r in pairs], [r["t"] for r in pairs]] = True
    values = rows.join(step, "slice").groupBy("topic", "word").agg(F.collect_list("t").alias("t"), F.collect_list("weight").alias("own"))
    if global_tuning:
        every = _normal(weighted.select("topic", "word", "weight"), "topic").withColumnRenamed("weight", "g")
        values = values.join(every, ["topic", "word"], "full")
    else:
        values = values.withColumn("g", F.lit(0.0))
    values = values.join(place, "topic").select("place", "word", "t", "own", F.coalesce("g", F.lit(0.0)).alias("g"))

    def fold(batches):
        for batch in batches:
            places, at = np.asarray(batch.column("place")), np.asarray(batch.column("t").flatten())
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(batch.column("t")), 0)))
            own = np.zeros((batch.num_rows, present.shape[1]))
            own[row, at] = np.asarray(batch.column("own").flatten())
            g, before = np.asarray(batch.column("g")), np.zeros(batch.num_rows)
            has = present[places]
            for t in range(present.shape[1]):
                w = np.where(has[:, t - 1], (own[:, t] + before) / 2, own[:, t]) if t else own[:, t]
                before = np.where(has[:, t], (w + g) / 2 if global_tuning else w, 0.0)
                kept = before > 0
                for p in np.unique(places):
                    mine = np.flatnonzero((places == p) & kept)
                    if len(mine) > n_words:
                        # rounding to 12 digits may make neighbours equal
                        least = np.partition(before[mine], -n_words)[-n_words] - 1e-11
                        kept[mine[before[mine] < least]] = False
                some = np.flatnonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t), pa.int32()), batch.column("place").take(pa.array(some)), batch.column("word").take(pa.array(some)), pa.array(before[some])], names=["t", "place", "word", "weight"])

    done = values.mapInArrow(fold, "t int, place int, word string, weight double")
    return done.join(step, "t").join(place, "place").select("slice", "topic", "word", "weight")


def topics_per_class(docs: DataFrame, weighted: DataFrame, idf: DataFrame, by: str, topic: str = "topic", global_tuning: bool = True, n_words: int = 5, english: bool = True, sliced: DataFrame | None = None) -> DataFrame:
    """``topic, words, frequency, class`` for each class and topic that occur together; scaled rows are averaged with the
    topic's own if ``global_tuning``."""
    rows = _slice_weights(slice_counts(docs, by, topic, english) if sliced is None else sliced, idf)
    if global_tuning:
        rows = _with_global(_normal(rows, "slice", "topic"), weighted, n_words)
    return _finish(rows, docs, by, topic, n_words, "class")


def chart(frequencies: DataFrame, by: str, normalize: bool = False, n_topics: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Rows for a chart of frequencies: of the ``n_topics`` largest topics without -1, frequencies of length 1 a topic if
    ``normalize``."""
    rows = frequencies.where("topic <> -1")
    if n_topics is not None and sizes is not None:
        best = sizes.where("topic <> -1").orderBy(F.desc("count"), "topic").limit(n_topics).select("topic")
        rows = rows.join(best, "topic", "left_semi")
    if normalize:
        length = F.sqrt(F.sum(F.col("frequency") * F.col("frequency")).over(W.partitionBy("topic")))
        rows = rows.withColumn("frequency", F.col("frequency") / length)
    return rows.select("topic", "words", "frequency", by)
