import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.operators import assign, charts, distribution, embed, hierarchy, tuners

NAMES = ("cat", "dog", "car")


def encode(texts):
    """How many of its words are each of the names."""
    return np.array([[sum(w == n for w in t.split()) for n in NAMES] for t in texts], dtype=float)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "cat cat dog", 0), (2, "dog dog dog dog car", 1), (3, "car cat", 2), (4, "nothing known", -1), (5, None, -1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, topic int")


def vectors_of(df, key="doc_id"):
    return {r[key]: list(map(float, r["embedding"])) for r in df.collect()}


def test_means_of_word_vectors(spark, docs):
    words = spark.createDataFrame([(n, np.eye(3)[i].tolist()) for i, n in enumerate(NAMES)], "word string, embedding array<double>")
    got = vectors_of(embed.WordVectorEmbedder(words, 3).embed(docs))
    assert got[1] == pytest.approx([2 / 3, 1 / 3, 0]) and got[2] == pytest.approx([0, 0.8, 0.2]) and got[4] == got[5] == [0, 0, 0]


def test_mean_of_two_and_words_apart(docs):
    one, two = embed.CallableEmbedder(encode), embed.CallableEmbedder(lambda ts: np.ones((len(ts), 3)))
    assert vectors_of(embed.MeanEmbedder(one, two).embed(docs))[1] == [1.5, 1.0, 0.5]
    both = embed.WordDocEmbedder(encode, lambda ts: np.full((len(ts), 2), 7.0))
    assert vectors_of(both.embed(docs))[3] == [1, 0, 1]
    words = docs.select(F.explode(F.split("text", " ")).alias("word"))
    assert vectors_of(both.embed_words(words), "word") == {w: [7.0, 7.0] for w in ("cat", "dog", "car", "nothing", "known")}
    assert vectors_of(embed.word_vectors(one, words), "word")["dog"] == [0, 1, 0]


def test_term_embedder_keeps_the_distances_of_few_terms(spark):
    texts = ["aa bb", "aa bb", "cc dd", "aa cc", "ee ff gg"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = vectors_of(embed.TermEmbedder(4, 64).embed(df))
    assert got[0] == pytest.approx(got[1])
    # four components hold five points, two of them equal: distances are those of the weighted terms
    terms = sorted({w for t in texts for w in t.split()})
    df_ = {w: sum(w in t.split() for t in texts) for w in terms}
    x = np.array([[t.split().count(w) * np.log(6 / (df_[w] + 1)) for w in terms] for t in texts])
    y = np.array([got[i] for i in range(5)])
    d = lambda m: np.linalg.norm(m[:, None] - m[None], axis=2)
    assert np.allclose(d(x), d(y), atol=1e-6)


def test_distribution_by_vectors_of_windows(spark, docs):
    topics = spark.createDataFrame([(i, np.eye(3)[i].tolist()) for i in range(3)] + [(-1, [1.0, 1.0, 1.0])], "topic int, embedding array<double>")
    got = {(r["doc_id"], r["topic"]): r["weight"] for r in distribution.embedded_distribution(docs, topics, embed.CallableEmbedder(encode), window=2, min_similarity=0.2).collect()}
    want = {}
    for r in docs.collect():
        w = (r["text"] or "").split()
        s = np.zeros(3)
        for i in range(max(len(w) - 1, 1)):
            v = encode([" ".join(w[i : i + 2])])[0]
            c = v / np.linalg.norm(v) if v.any() else v
            s += np.where(c >= 0.2, c, 0)
        want |= {(r["doc_id"], t): s[t] / s.sum() for t in range(3) if s[t] > 0}
    assert got == pytest.approx(want)


def test_words_ranked_by_representative_documents(spark, docs):
    vectors = embed.CallableEmbedder(encode).embed(docs)
    ranked = spark.createDataFrame([(0, r, w, 1.0) for r, w in enumerate(["dog", "car", "cat"], 1)], tuners.RANKED)
    words = embed.word_vectors(embed.CallableEmbedder(encode), ranked)
    found = spark.createDataFrame([(0, 1, 1)], "topic int, rank int, doc_id bigint")
    got = tuners.keyword_similarity(ranked, words, vectors, found, 2).orderBy("rank").collect()
    assert [r["word"] for r in got] == ["cat", "dog"] and got[0]["score"] == pytest.approx(2 / 5**0.5)
    weighted = spark.createDataFrame([(0, "cat", 3.0), (0, "dog", 1.0), (1, "dog", 0.0), (1, "car", 0.0)], "topic int, word string, weight double")
    mean = vectors_of(assign.word_weighted_vectors(weighted, words), "topic")
    assert mean == {0: pytest.approx([0.75, 0.25, 0]), 1: pytest.approx([0, 0.5, 0.5])}


def test_maps_and_trees(spark, docs):
    vectors = embed.CallableEmbedder(encode).embed(docs)
    labels = spark.createDataFrame([(0, "cats"), (1, "dogs"), (2, "cars")], "topic int, label string")
    got = {r["doc_id"]: r["label"] for r in charts.documents_map(docs, vectors, labels).collect()}
    assert got == {1: "cats", 2: "dogs", 3: "cars", 4: "Unlabelled", 5: "Unlabelled"}
    rows = [(4, "", [0, 1, 2], 3, "", 2, "", 2.0), (3, "", [0, 1], 0, "", 1, "", 1.0)]
    tree = spark.createDataFrame(rows, hierarchy.HIERARCHY)
    lines = {(r["parent_id"], r["side"]): tuple(r)[2:] for r in hierarchy.dendrogram(tree).collect()}
    assert lines == {(3, "left"): (0, 0, 0.5, 1), (3, "right"): (1, 0, 0.5, 1), (4, "left"): (0.5, 1, 1.25, 2), (4, "right"): (2, 0, 1.25, 2)}
    at = {(r["level"], r["doc_id"]): r["ancestor"] for r in hierarchy.document_levels(tree, docs, 2).collect()}
    assert at == {(0, 1): 3, (0, 2): 3, (0, 3): 2, (0, 4): -1, (0, 5): -1, (1, 1): 4, (1, 2): 4, (1, 3): 4, (1, 4): -1, (1, 5): -1}
    empty = spark.createDataFrame([], hierarchy.HIERARCHY)
    assert hierarchy.dendrogram(empty).count() == 0


def test_hashed_terms_are_those_of_spark_and_read_the_texts_once(spark):
    from pyspark.ml.feature import HashingTF

    rows = [(i, " ".join("abcdefghijk0123456789"[k % 7 : k % 7 + k % 13] + str(k) for k in range(i, 3 * i))) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = embed.TermEmbedder(4, 64)._hashed(df)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    from topicspark.functions import text as tx

    want = HashingTF(numFeatures=64, inputCol="w", outputCol="tf").transform(df.select("doc_id", tx.words(F.col("text")).alias("w")))
    assert {r["doc_id"]: r["tf"] for r in got.collect()} == {r["doc_id"]: r["tf"] for r in want.select("doc_id", "tf").collect()}
