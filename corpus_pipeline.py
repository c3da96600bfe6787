"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from topicspark.llm import jaccard_join, packing, pii, quality_rules, toxicity
from topicspark.llm.common import small_batches, table, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sparing(stage: Stage) -> Stage:
    """The stage with small batches: one worker after the other has all models in it, and executors hold several workers."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality rules", _sparing(quality_rules.stage)),
    ("toxicity", _sparing(toxicity.stage)),
    ("near duplicates", _sparing(jaccard_join.stage)),
    ("personal data", _sparing(pii.stage)),
    ("packing", _sparing(packing.stage)),
]

#: SQL can't express the estimates, the classifier and the tagger; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written as Parquet and read again; the training sequences of what is left.

    Null and empty texts pass the filters and are in no sequence, as they have no tokens; texts of any length are worked on
    whole. Of several rows with one id one stays, rows without an id all do. An empty table gives no rows. Other columns
    pass through the stages.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
