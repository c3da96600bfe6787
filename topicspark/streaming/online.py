"""Incremental topics: counts that fade, centroids that move, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicspark.functions import vectors as vx
from topicspark.operators import ctfidf
from topicspark.sources.shared import new_folder


def merge_counts(state: DataFrame | None, batch: DataFrame, decay: float = 0.0, delete_min_df: float | None = None) -> DataFrame:
    """``topic, word, n``: the state's counts times (1 - decay) plus the batch's. Words whose counts over all topics fall
    under ``delete_min_df`` go; they may come back."""
    old = None if state is None else state.select("topic", "word", (F.col("n") * (1 - decay)).alias("n"))
    new = batch.select("topic", "word", F.col("n").cast("double").alias("n"))
    every = new if old is None else old.unionByName(new)
    out = every.groupBy("topic", "word").agg(F.sum("n").alias("n"))
    if delete_min_df is not None:
        kept = out.groupBy("word").agg(F.sum("n").alias("_s")).where(F.col("_s") >= delete_min_df).select("word")
        out = out.join(kept, "word", "left_semi").select("topic", "word", "n")
    return out


def closed_form(batches: DataFrame, last: int, decay: float) -> DataFrame:
    """``topic, word, n`` after all batches (``batch, topic, word, n``) at once: the sum of n x (1 - decay) ^ age."""
    age = F.lit(last) - F.col("batch")
    return batches.groupBy("topic", "word").agg(F.sum(F.col("n") * F.pow(F.lit(1 - decay), age)).alias("n"))


class Versions:
    """A state table in the shared folder: each version is a folder of Parquet named by its batch, so a batch that is run
    again after a failure finds the version before it and replaces its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done if p.getName().startswith("v"))

    def read(self, before: int | None = None) -> DataFrame | None:
        have = [n for n in self.numbers() if before is None or n < before]
        return self.spark.read.parquet(f"{self.path}/v{have[-1]}") if have else None

    def write(self, df: DataFrame, number: int, keep: int = 2) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        _, fs = self._fs()
        for n in [n for n in self.numbers() if n <= number][:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n}"), True)


def update_centroids(centroids: np.ndarray, sizes: np.ndarray, sums: np.ndarray, counts: np.ndarray, decay: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mini-batch step: each centroid becomes the mean of all it has seen, older batches weighing (1 - decay) as much."""
    old = sizes * (1 - decay)
    total = old + counts
    moved = np.divide(centroids * old[:, None] + sums, total[:, None], out=centroids.astype(float).copy(), where=total[:, None] > 0)
    return moved, total


def new_topic_numbers(known: list[int], labels: list[int]) -> dict[int, int]:
    """Labels not seen before get the numbers after the highest known one, in order."""
    free = max([*known, -1]) + 1
    return {label: free + i for i, label in enumerate(sorted(set(labels) - set(known)))}


class OnlineTopics:
    """Topics over micro-batches of ``doc_id, text, embedding``: nearest centroid, moved centroids, faded counts. Its state
    is two small tables of versions (centroids: a row a topic; counts: a row for each topic and word) and the assignments."""

    def __init__(self, spark: SparkSession, path: str, n_topics: int, decay: float = 0.0, delete_min_df: float | None = None, english: bool = True):
        self.spark, self.path, self.k, self.decay, self.delete, self.english = spark, path.rstrip("/"), n_topics, decay, delete_min_df, english
        self.counts, self.centroids = Versions(spark, f"{self.path}/counts"), Versions(spark, f"{self.path}/centroids")

    def step(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; running it again with its number gives the same state."""
        batch = batch.where(F.col("embedding").isNotNull())
        state = self.centroids.read(number)
        if state is None:
            # the first k documents by id are where the centroids start
            start = batch.orderBy("doc_id").limit(self.k).select("embedding").collect()
            if not start:
                return
            at, sizes = np.array([r[0] for r in start], dtype=float), np.zeros(len(start))
        else:
            rows = state.orderBy("topic").collect()
            at, sizes = np.array([r["embedding"] for r in rows]), np.array([r["size"] for r in rows])
        assigned = vx.nearest(batch, "doc_id", "embedding", list(range(len(at))), vx.unit(at)).select("doc_id", "topic")
        target = f"{self.path}/assignments/b{number}"
        assigned.write.mode("overwrite").parquet(target)
        docs = batch.join(self.spark.read.parquet(target), "doc_id")
        sums, n = np.zeros_like(at), np.zeros(len(at))
        for r in vx.means(docs, "topic", "embedding").collect():
            sums[r["topic"]], n[r["topic"]] = np.array(r["embedding"]) * r["size"], r["size"]
        moved, total = update_centroids(at, sizes, sums, n, self.decay)
        rows = [(i, float(s), v.tolist()) for i, (v, s) in enumerate(zip(moved, total))]
        counts = ctfidf.term_counts(docs, english=self.english, once=False)
        self.counts.write(merge_counts(self.counts.read(number), counts, self.decay, self.delete), number)
        self.centroids.write(self.spark.createDataFrame(rows, "topic int, size double, embedding array<double>").coalesce(1), number)

    def weights(self, **options) -> DataFrame:
        return ctfidf.weights(self.counts.read(), **options)

    def assignments(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/assignments/*")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Runs step() for each micro-batch of a stream."""
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def frequency_windows(events: DataFrame, by: str, time: str, width: str = "1 day", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """``start, end, by, n`` of fixed or sliding windows of event time, of a stream or a table. Events later than ``late`` are
    dropped from a stream. Times without a zone count as UTC by the session's setting."""
    rows = _timed(events, time, late)
    window = F.window("_t", width, slide) if slide else F.window("_t", width)
    return rows.groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def session_windows(events: DataFrame, by: str, time: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """``start, end, by, n`` of sessions: events of one key that follow each other within ``gap``."""
    rows = _timed(events, time, late)
    return rows.groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    return rows.withWatermark("_t", late) if events.isStreaming and late else rows


def to_memory(df: DataFrame, name: str, mode: str = "complete", before: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes all there is of a stream to a table in memory, for tests and small results."""
    return (before(df) if before else df).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def settled(stream: DataFrame, what: str) -> DataFrame:
    """All there is of a stream of totals run through: each micro-batch's totals are written to the shared folder, and the
    last ones read."""
    spark = stream.sparkSession
    at = new_folder(spark, what)
    numbers: list[int] = []

    def write(totals: DataFrame, number: int) -> None:
        totals.write.mode("overwrite").parquet(f"{at}/b{number}")
        numbers.append(number)

    run = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/b{max(numbers)}") if numbers else spark.createDataFrame([], stream.schema)


def bucket(time: Column, width_seconds: int) -> Column:
    """The beginning of the window of a time, as seconds."""
    return (F.floor(F.unix_timestamp(time) / width_seconds) * width_seconds).cast("bigint")
