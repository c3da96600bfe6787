"""Quality classifier: a factorization machine over hashed words, statistics of form, and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import docstats, fm, labelled
from topicspark.llm import textvec as tv
from topicspark.llm.common import table
from topicspark.llm.toxicity import text_terms

#: Probability of good quality below which a document goes; bytes of the beginnings of words that are features too.
CUT, PREFIX_BYTES = 0.5, (6,)
#: Features count if they are this many times (as a logarithm) as frequent with one label as with the other.
WEAKEST = 1.0
#: Width of the steps into which each statistic of docstats.NAMES is cut.
STEPS = np.array([0.05, 0.04, 0.05, 0.03, 0.06, 0.02, 0.1])
#: Each statistic and each metadata column stands as so many features, so that a long text's words don't drown it.
WEIGHT = 4


def _terms(data: np.ndarray, offsets: np.ndarray) -> fm.Sparse:
    shift = np.uint64(64 - fm.D_BITS)
    level = np.floor(docstats.statistics(data, offsets) / STEPS).astype(np.int64)
    level = np.concatenate((level, np.floor(np.log2(np.diff(offsets) + 1))[:, None].astype(np.int64)), axis=1)
    n, k = level.shape
    salt = np.arange(k * WEIGHT, dtype=np.uint64) * np.uint64(1 << 20)
    form = tv.mix(np.repeat(level, WEIGHT, axis=1).astype(np.uint64) + salt + np.uint64(1 << 40)) >> shift
    words = text_terms(data, offsets, PREFIX_BYTES)
    row = np.concatenate((words.row(), np.repeat(np.arange(n), k * WEIGHT)))
    row, index = tv.unique_pairs(row, np.concatenate((words.index.astype(np.uint64), form.ravel())))
    return fm.Sparse(index, np.searchsorted(row, np.arange(n + 1)))


def _metadata(batch: pa.RecordBatch, column: str, salt: int) -> np.ndarray:
    """WEIGHT features of each row for the value of a column; null is a value too."""
    values = batch.column(column).cast(pa.string()).dictionary_encode()
    names = pa.array([*(x or "" for x in values.dictionary.to_pylist()), "\0null"])
    data = np.frombuffer("".join(names.to_pylist()).encode(), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x.encode()) for x in names.to_pylist()])))
    power, _ = tv._powers(len(data) + 1)
    h = np.array([(((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a]).sum()) for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.uint64)
    code = np.asarray(values.indices.fill_null(len(names) - 1)).astype(np.int64)
    each = tv.mix(h[code][:, None] + np.uint64(salt << 32) + np.arange(WEIGHT, dtype=np.uint64))
    return each >> np.uint64(64 - fm.D_BITS)


def features(batch: pa.RecordBatch) -> fm.Sparse:
    x = labelled.stack([_terms(data, offsets) for _, _, data, offsets in tv.chunks(batch.column("text"))])
    if not len(x):
        return x
    meta = np.concatenate((_metadata(batch, "lang", 11), _metadata(batch, "source", 13)), axis=1)
    row = np.concatenate((x.row(), np.repeat(np.arange(len(x)), meta.shape[1])))
    row, index = tv.unique_pairs(row, np.concatenate((x.index.astype(np.uint64), meta.ravel())))
    return fm.Sparse(index, np.searchsorted(row, np.arange(len(x) + 1)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = labelled.TRAIN_ROWS) -> fm.Machine:
    x, y, _ = labelled.gather(docs, labels, "quality", features, train_rows, worst=0)
    return fm.train(x, y, weakest=WEAKEST)


def classify_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, train_rows: int = labelled.TRAIN_ROWS) -> DataFrame:
    """``doc_id, quality, keep`` of every document; kept where the probability of good quality is at least ``cut``.

    The machine is fitted to at most ``train_rows`` labelled documents, those of the smallest hash, ties by id; ids are
    integers, and of several labels of a document the worse counts. A null or empty text is judged by its form and
    metadata, a text of any length whole; a null language or source is a value of its own. Repeated rows are judged alike.
    A probability just at ``cut`` is kept. Without labels every document has the probability one half, and stays. An empty
    table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    scored = labelled.apply(docs, fit(docs, labels, train_rows), features, "quality")
    return scored.select("doc_id", F.round("quality", 6).alias("quality"), (F.col("quality") >= cut).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
