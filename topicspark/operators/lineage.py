"""How topics change: an append-only table of steps, (step, from_topic, to_topic), and what composes it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EDGES = "step int, from_topic int, to_topic int"


def edges(topics: Iterable[int], mapping: Mapping[int, int]) -> list[tuple[int, int]]:
    """(from, to) of every topic; those without an entry stay."""
    return [(t, mapping.get(t, t)) for t in sorted(topics)]


def merge_mapping(groups: Sequence[int] | Sequence[Sequence[int]]) -> dict[int, int]:
    """Each group's topics go to its first one."""
    nested = [groups] if groups and isinstance(groups[0], int) else groups
    return {t: g[0] for g in nested for t in g}


def delete_mapping(topics: Iterable[int]) -> dict[int, int]:
    return dict.fromkeys(topics, -1)


def rank_mapping(sizes: Mapping[int, int]) -> dict[int, int]:
    """New numbers from 0 by falling size, the lower old number first of equals; -1 stays."""
    order = sorted((t for t in sizes if t != -1), key=lambda t: (-sizes[t], t))
    return {t: i for i, t in enumerate(order)} | ({-1: -1} if -1 in sizes else {})


def ranked(sizes: DataFrame) -> DataFrame:
    """``topic, new_topic``: the same in the engine; there are few topics."""
    order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("topic") == -1, F.desc("count"), "topic")) - 1
    return sizes.select("topic", F.when(F.col("topic") == -1, -1).otherwise(order).cast("int").alias("new_topic"))


def compose(steps: Sequence[Mapping[int, int]], topics: Iterable[int]) -> dict[int, int]:
    """Where each topic is after all steps; a number that a step doesn't know becomes -1."""
    now = {t: t for t in topics}
    for step in steps:
        now = {t: step.get(at, -1) for t, at in now.items()}
    return now


def composed(lineage: DataFrame, n_steps: int) -> DataFrame:
    """``from_topic, to_topic`` after all steps of a lineage table: a join for each step, of a row a topic."""
    now = lineage.where("step = 0").select("from_topic", "to_topic")
    for k in range(1, n_steps):
        step = lineage.where(F.col("step") == k).select(F.col("from_topic").alias("at"), F.col("to_topic").alias("next"))
        now = now.join(step, now["to_topic"] == step["at"], "left").select("from_topic", F.coalesce("next", F.lit(-1)).alias("to_topic"))
    return now


def apply(docs: DataFrame, mapping: Mapping[int, int], topic: str = "topic") -> DataFrame:
    """The documents under new numbers; a number without an entry stays. The mapping has an entry a topic, and is joined."""
    if not mapping:
        return docs
    names = docs.sparkSession.createDataFrame([(int(a), int(b)) for a, b in mapping.items()], "_from int, _to int")
    moved = docs.join(F.broadcast(names), docs[topic] == F.col("_from"), "left")
    return moved.select(*(F.coalesce("_to", docs[c]).cast("int").alias(c) if c == topic else docs[c] for c in docs.columns))


def map_probabilities(probabilities: DataFrame, mapping: DataFrame) -> DataFrame:
    """``doc_id, topic, probability`` under new numbers: those that become one topic add up, those of -1 go."""
    moved = probabilities.join(mapping.select(F.col("from_topic").alias("topic"), "to_topic"), "topic").where("to_topic <> -1")
    return moved.groupBy("doc_id", F.col("to_topic").alias("topic")).agg(F.sum("probability").alias("probability"))
