"""What the two classifiers share: labelled rows to learn from, and scores for every row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm import fm
from topicspark.llm.common import fresh, wider

Features = Callable[[pa.RecordBatch], fm.Sparse]
#: Labelled rows that a model is fitted to, at most: those with the smallest hash of doc_id.
TRAIN_ROWS = 24_000


def gather(docs: DataFrame, labels: DataFrame, label: str, features: Features, train_rows: int = TRAIN_ROWS, worst: int = 1) -> tuple[fm.Sparse, np.ndarray, np.ndarray]:
    """Features, labels and doc_ids (integers) of up to ``train_rows`` labelled documents. Rows with a null id, and labels
    other than 0 and 1, are left out; of several labels of a document the one that is ``worst`` counts."""
    best = F.max(label) if worst else F.min(label)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(best.alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # the broadcast side has train_rows rows at most
    rows = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_labelled")), F.col("doc_id") == F.col("_labelled"))

    def compute(batches):
        for batch in batches:
            x = features(batch)
            parts = [x.index[a:b].astype(np.int32).tobytes() for a, b in zip(x.first[:-1], x.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "label", "x"]
            )

    got = rows.mapInArrow(compute, "doc_id bigint, label int, x binary").toArrow()
    parts = [_indices(c) for c in got.column("x").chunks]
    whole = stack(parts)
    ids, y = got.column("doc_id").to_numpy().copy(), got.column("label").to_numpy().astype(float)
    del parts, got
    ids, first = np.unique(ids, return_index=True)
    return whole.take(first), y[first], ids


def _indices(column: pa.Array) -> fm.Sparse:
    """Rows from binary values of 32-bit indices."""
    _, off, raw = column.buffers()
    first = np.frombuffer(off, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    data = np.frombuffer(raw, dtype=np.int32) if raw is not None else np.zeros(0, np.int32)
    return fm.Sparse(data[first[0] : first[-1]] if len(first) else data, first - first[0])


def apply(docs: DataFrame, machine: fm.Machine, features: Features, name: str) -> DataFrame:
    """``docs`` with a column ``name``: the machine's probability."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def compute(batches):
        for batch in batches:
            p = fm.sigmoid(sent.value.score(features(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    return docs.mapInArrow(compute, wider(docs, f"`{name}` double"))


def stack(parts: list[fm.Sparse]) -> fm.Sparse:
    if not parts:
        return fm.Sparse(np.zeros(0, np.int64), np.zeros(1, np.int64))
    base = np.concatenate(([0], np.cumsum([len(p.index) for p in parts])))
    return fm.Sparse(np.concatenate([p.index for p in parts]), np.concatenate([[0], *(p.first[1:] + b for p, b in zip(parts, base))]))


__all__ = ["Features", "apply", "fresh", "gather", "stack"]
