"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import fm, labelled
from topicspark.llm import textvec as tv
from topicspark.llm.common import fresh, table

#: Bytes of the beginnings of words that are terms too; probability from which a document goes.
PREFIX_BYTES, CUT = (4, 5, 6), 0.8
#: Terms count if they are this many times (as a logarithm) as frequent with one label as with the other.
WEAKEST = 1.5


def text_terms(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = PREFIX_BYTES) -> fm.Sparse:
    """The distinct words of each text and the beginnings of its longer words, hashed."""
    w = tv.words(data, offsets)
    shift = np.uint64(64 - fm.D_BITS)
    rows, terms = [w.row], [w.hashes() >> shift]
    for k in prefixes:
        long = np.flatnonzero(w.end - w.start > k)
        rows.append(w.row[long])
        terms.append(tv.mix(w.hashes(k)[long] + np.uint64(k)) >> shift)
    row, index = tv.unique_pairs(np.concatenate(rows), np.concatenate(terms))
    return fm.Sparse(index, np.searchsorted(row, np.arange(w.n_rows + 1)))


def features(batch: pa.RecordBatch) -> fm.Sparse:
    return labelled.stack([text_terms(data, offsets) for _, _, data, offsets in tv.chunks(batch.column("text"))])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = labelled.TRAIN_ROWS) -> fm.Machine:
    x, y, _ = labelled.gather(docs.select("doc_id", "text"), labels, "toxic", features, train_rows)
    return fm.train(x, y, weakest=WEAKEST)


def flag_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, train_rows: int = labelled.TRAIN_ROWS) -> DataFrame:
    """``doc_id, toxicity, toxic`` of every document; toxic where the probability is at least ``cut``.

    The machine is fitted to at most ``train_rows`` labelled documents, those of the smallest hash, ties by id; ids are
    integers, and of several labels of a document the worse counts. A null or empty text has the probability of the bias
    alone; a text of any length is read whole. Repeated rows are judged alike; a probability just at ``cut`` is toxic.
    Without labels nothing is toxic. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    scored = labelled.apply(docs, fit(docs, labels, train_rows), features, "toxicity")
    return scored.select("doc_id", F.round("toxicity", 6).alias("toxicity"), (F.col("toxicity") >= cut).alias("toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, with the columns they came with, whatever their names. Null and empty texts have the
    probability of the bias and stay; long texts, repeated rows, ties and an empty table are treated as by flag_toxic."""
    name = fresh("toxicity", docs.columns)
    scored = labelled.apply(docs, fit(docs, table(spark, sf_dir, "labels")), features, name)
    return scored.where(F.col(name) < CUT).select(*(F.col(f"`{c}`") for c in docs.columns))
