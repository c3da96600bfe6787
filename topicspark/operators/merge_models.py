"""One model of several: topics that are unlike all known ones are added under new numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from topicspark.functions import vectors as vx


def match(known: np.ndarray, known_topics: Sequence[int], new: np.ndarray, new_topics: Sequence[int], min_similarity: float = 0.7) -> dict[int, int]:
    """Where each topic of a second model goes: to the most similar known topic (the lowest number of equals), or, below
    ``min_similarity``, to the next free number, in order. -1 stays. Topics are few."""
    out: dict[int, int] = {}
    free = max([*known_topics, -1]) + 1
    own = [i for i, t in enumerate(known_topics) if t != -1]
    near = vx.unit(new) @ vx.unit(known[own]).T if len(own) else np.zeros((len(new), 0))
    for i, t in sorted(enumerate(new_topics), key=lambda x: x[1]):
        if t == -1:
            out[t] = -1
            continue
        best = float(near[i].max()) if near.shape[1] else -1.0
        if round(best, 9) < min_similarity:
            out[t], free = free, free + 1
        else:
            out[t] = known_topics[own[int(np.flatnonzero(near[i] >= best - 1e-12)[0])]]
    return out


def merge(vectors: Sequence[DataFrame], min_similarity: float = 0.7) -> tuple[list[dict[int, int]], DataFrame]:
    """The mapping of each model's topics (``topic, size, embedding``), the first one's unchanged, and the vectors of all:
    known topics keep theirs, new ones bring theirs; sizes add up."""
    spark = vectors[0].sparkSession
    state: dict[int, list] = {}
    mappings = []
    for table in vectors:
        rows = [(r["topic"], float(r["size"]), list(map(float, r["embedding"]))) for r in table.orderBy("topic").collect()]
        topics = [r[0] for r in rows]
        if not mappings:
            mapping = {t: t for t in topics}
        else:
            have = sorted(state)
            known = np.array([state[t][1] for t in have]) if have else np.zeros((0, len(rows[0][2]) if rows else 1))
            mapping = match(known, have, np.array([r[2] for r in rows]), topics, min_similarity) if rows else {}
        for t, n, v in rows:
            state.setdefault(mapping[t], [0.0, v])[0] += n
        mappings.append(mapping)
    merged = spark.createDataFrame([(t, n, v) for t, (n, v) in sorted(state.items())], "topic int, size double, embedding array<double>")
    return mappings, merged
