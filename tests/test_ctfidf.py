import math
import os
import random
from collections import Counter

import pytest

from topicspark.functions import text as tx
from topicspark.operators import ctfidf, topics

DOCS = "doc_id bigint, text string, topic int"
ROWS = [(1, "apple banana apple", 0), (2, "banana cherry", 0), (3, "cherry date date", 1), (4, None, 1), (5, "don't\nstop\tnow é x", -1), (6, "", 2)]


def weights_by_hand(rows):
    counts = {}
    for _, text, t in rows:
        words = [w for w in "".join(c if c.isascii() and (c.isalnum() or c == " ") else "" for c in (text or "").replace("\n", " ").replace("\t", " ")).lower().split() if len(w) > 1]
        counts.setdefault(t, Counter()).update(words)
    for c in counts.values():
        if not c:
            c["emptydoc"] = 1
    a = int(sum(sum(c.values()) for c in counts.values()) / len(counts))
    df = sum(counts.values(), Counter())
    return {(t, w): n / sum(c.values()) * math.log(1 + a / df[w]) for t, c in counts.items() for w, n in c.items()}


def test_weights_by_hand(spark):
    got = ctfidf.weights(ctfidf.term_counts(spark.createDataFrame(ROWS, DOCS)))
    got = {(r["topic"], r["word"]): r["weight"] for r in got.collect()}
    want = weights_by_hand(ROWS)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert (2, "emptydoc") in got and (-1, "dont") in got


def test_ngrams_span_documents(spark):
    rows = [(1, "aa bb", 0), (2, "", 0), (3, "cc", 0), (4, "dd ee", 0), (5, "ff gg", 1)]
    toks = tx.document_words(spark.createDataFrame(rows, DOCS))
    got = sorted((r["topic"], r["word"]) for r in tx.ngrams(toks, 2, 3).collect())
    words = "aa bb cc dd ee".split()
    want = sorted([(0, " ".join(words[i : i + k])) for k in (2, 3) for i in range(6 - k)] + [(1, "ff gg")])
    assert got == want


@pytest.mark.parametrize("parts", ["1", "5"])
def test_ngrams_across_parts(spark, parts):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randrange(0, 4))), rng.randrange(2)) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((r["topic"], r["word"]) for r in tx.ngrams(tx.document_words(spark.createDataFrame(rows, DOCS)), 1, 3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for t in (0, 1):
        words = " ".join(text for _, text, topic in rows if topic == t).split()
        want += [(t, " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert got == sorted(want)


def test_ties_go_by_name(spark):
    df = spark.createDataFrame([(0, w, 1.0) for w in "delta alpha charlie bravo".split()], "topic int, word string, weight double")
    assert [r["word"] for r in ctfidf.top_words(df, 3).orderBy("rank").collect()] == ["alpha", "bravo", "charlie"]


def test_seed_factors():
    assert ctfidf.seed_factors(["a", "b"], 3.0, [["b", "c"]]) == {"a": 3.0, "b": 1.2, "c": 1.2}


def test_unicode_words(spark):
    df = spark.createDataFrame([("Éa été x_1 _ Über",)], "t string").select(tx.words(df_col("t"), False).alias("w"))
    assert df.first()["w"] == ["éa", "été", "x_1", "über"]


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_labels_and_info(spark):
    words = spark.createDataFrame([(0, ["aaa", "bbb", "ccc", "ddd", "eee"])], "topic int, words array<string>")
    assert topics.labels(words).first()["label"] == "0_aaa_bbb_ccc_ddd"
    assert topics.labels(words, 2, False, " ", 2).first()["label"] == "aa bb"
    assert topics.custom_labels(topics.labels(words), {0: "Name"}).first()["label"] == "Name"


def test_written_tables_are_released(spark):
    from topicspark.sources import shared

    kept = list(shared._tables)
    shared._tables.clear()
    df = shared.written(spark.range(5).toDF("doc_id"), "test")
    at = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert df.count() == 5 and os.path.isdir(at)
    shared.release()
    assert not os.path.exists(at)
    shared._tables.extend(kept)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 3)])
def test_texts_are_read_once_for_counts(spark, ngrams):
    """No part of the result is counted from the texts again, whether a topic has no words or all have some."""
    for rows in (ROWS, ROWS[:3]):
        counts = ctfidf.term_counts(spark.createDataFrame(rows, DOCS), ngram_range=ngrams)
        assert "Generate" not in _plan(counts) and "MapInArrow" not in _plan(counts)
        assert sum(r["n"] for r in counts.where("topic = 1 AND word IN ('date', 'date date')").collect()) == {1: 2, 2: 1}[ngrams[0]] + (ngrams == (1, 2))


def test_ngrams_and_stop_words_like_counting_by_hand(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["aa", "Bb!", "the", "c", "dé"]) for _ in range(rng.randrange(0, 6))) or None, i % 3) for i in range(50)]
    got = {(r["topic"], r["word"]): r["n"] for r in ctfidf.term_counts(spark.createDataFrame(rows, DOCS), ngram_range=(1, 3), stop_words=["the"]).collect()}
    want = Counter()
    for t in range(3):
        words = [w for _, text, topic in rows if topic == t for w in (text or "").lower().replace("!", "").replace("é", "").split() if len(w) > 1 and w != "the"]
        want.update((t, " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert got == dict(want)
