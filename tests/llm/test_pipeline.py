import random

import pytest

import corpus_pipeline
from topicspark.llm import jaccard_join, packing, queries
from topicspark.llm.common import BATCH_ROWS

from .conftest import HARD


def test_names():
    import __spark_entry__

    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= __spark_entry__.queries().keys()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "personal data", "packing"]


def test_stage_by_stage_equals_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == columns
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)

    def parts(df):
        return sorted((i, a, n) for r in df.collect() for i, a, n in zip(r["doc_ids"], r["first_tokens"], r["lengths"]))

    got = parts(last)
    assert got == parts(corpus_pipeline.run(spark, data))
    assert {i for i, _, _ in got} == {r["doc_id"] for r in docs.collect() if r["text"]} <= ids


def test_hard_rows(docs, spark, data):
    rows = docs(HARD, ["1 AS node", "2 AS toxicity", "3 AS outlier", "4 AS spans", "5 AS uid", "6 AS bin_id"])
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, data)
    assert rows.count() > 0
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0


def test_near_duplicates_of_a_family_without_its_pairs(docs, spark, monkeypatch):
    """Of 250 different near copies the smallest id stays, and no task or table holds their 31,125 pairs."""
    rng = random.Random(7)
    base, rows = [f"b{i}" for i in range(200)], []
    for k in range(250):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"o{k}_{i}" for i in range(50))) for k in range(20)]
    given, real = [], jaccard_join.link_classes
    monkeypatch.setattr(jaccard_join, "link_classes", lambda members, pairs, *more: given.append(pairs.count()) or real(members, pairs, *more))
    kept = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(1000, 1020)]
    assert given[0] < 1_000


def test_stages_take_little_memory_of_workers(docs, spark, monkeypatch):
    """Whatever batches the session sends to Python, those of the stages are small; a smaller bound of the session stays."""
    name, stages = "spark.sql.execution.arrow.maxRecordsPerBatch", dict(corpus_pipeline.STAGES)
    rows, before = docs([(k, f"text {k} of some words") for k in range(30)]), spark.conf.get(name)
    try:
        for given, want in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("7", 7)):
            for stage in (stages["packing"], stages["near duplicates"]):
                spark.conf.set(name, given)
                stage(spark, rows, "")
                assert int(spark.conf.get(name)) == want
        # no table goes through Python workers other than those of the batches
        monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("a list became an RDD"))
        got = stages["packing"](spark, rows, "").collect()
        assert sum(len(r["doc_ids"]) for r in got) == 30
    finally:
        spark.conf.set(name, before)


def test_small_chunks_give_the_same_sequences(docs):
    rows = docs([(k, f"piece{k} " * (k + 1) + "\u00e9\u00e9") for k in range(40)])
    for got, want in zip(*(sorted(map(tuple, packing.sequences(rows, capacity=64, chunk=c).collect()), key=lambda r: r[0]) for c in (64, packing.CHUNK_BYTES)), strict=True):
        assert got == want
