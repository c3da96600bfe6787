import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.plans.model import TopicModel
from topicspark.sources import readers
from topicspark.streaming import online


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    words = [[f"{a}{i}x" for i in range(30)] for a in ("cat", "dog", "car", "sun")]
    rows, vectors = [], []
    for i in range(120):
        t = 0 if i < 50 else i % 4
        rows.append((i, " ".join(rng.choice(words[t], 12)), t, i % 10))
        v = rng.normal(size=8) * 0.1
        v[t] += 1
        vectors.append((i, v.tolist()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, given int, slot int")
    return docs, spark.createDataFrame(vectors, "doc_id bigint, embedding array<double>")


@pytest.fixture(scope="module")
def model(corpus, tmp_path_factory):
    docs, vectors = corpus
    return TopicModel(n_clusters=4, n_components=None, folder=f"file://{tmp_path_factory.mktemp('model')}").fit(docs, vectors)


def sizes(m):
    return {r["topic"]: r["count"] for r in m.get_topic_freq().collect()}


def test_fit_and_read(model, corpus):
    docs, vectors = corpus
    assert sum(sizes(model).values()) == 120 and sorted(sizes(model)) == [0, 1, 2, 3]
    info = model.get_topic_info().collect()
    assert [r["topic"] for r in info] == [0, 1, 2, 3] and all(len(r["representative_docs"]) == min(3, r["count"]) for r in info)
    assert info[0]["count"] == max(r["count"] for r in info)
    own = model.assignments.where("topic = 0").join(docs, "doc_id").select("text").collect()
    assert set(info[0]["words"]) <= {w for r in own for w in r["text"].split()}
    about = model.get_document_info(docs)
    assert about.count() == 120 and about.where("representative_document").count() == sum(min(3, r["count"]) for r in info)
    assert model.transform(docs, vectors).join(model.assignments.withColumnRenamed("topic", "t"), "doc_id").where("topic <> t").count() == 0
    assert model.find_topics([1.0] + [0.0] * 7, 2).count() == 2
    assert model.get_topic(0).count() == 10
    assert "n_clusters=4" in str(model)


def test_documents_of_the_fit_keep_their_topic(spark, tmp_path):
    """Clusters that lie in one direction, which the cosine can't tell apart, and again after loading; not after a change."""
    rng = np.random.default_rng(1)
    rows = [(i, f"word{i % 3} more", [float(x) for x in np.array([(1.0, 0.2), (6.0, 1.2), (0.0, 9.0)][i % 3]) + rng.normal(size=2) * 0.1]) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, embedding array<double>")
    m = TopicModel(n_clusters=3, n_components=None).fit(docs, vectors)
    want = {r["doc_id"]: r["topic"] for r in m.assignments.collect()}
    m.save(f"file://{tmp_path}/saved")
    for one in (m, TopicModel.load(spark, f"file://{tmp_path}/saved")):
        got = one.transform(docs, vectors).collect()
        assert {r["doc_id"]: r["topic"] for r in got} == want and all(r["similarity"] > 0.9 for r in got)
    m.merge_topics(docs, [0, 1])
    assert {r["topic"] for r in m.transform(docs, vectors).collect()} == {0, 1}


def test_questions(model, corpus):
    docs, _ = corpus
    over = model.topics_over_time(docs, "slot")
    assert over.agg(F.sum("frequency")).first()[0] == 120
    assert model.topics_over_time(docs, "slot", bins=3).select("timestamp").distinct().count() == 3
    assert model.topics_per_class(docs, "given").agg(F.sum("frequency")).first()[0] == 120
    tree = model.hierarchical_topics()
    assert tree.count() == 3 and sorted(max((r["topics"] for r in tree.collect()), key=len)) == [0, 1, 2, 3]
    from topicspark.operators import hierarchy

    assert len(hierarchy.tree(tree).split("\n")) <= 8 and hierarchy.levels(tree, 4).select("level").distinct().count() == 4
    dist = model.approximate_distribution(docs)
    assert dist.groupBy("doc_id").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        model.reduce_outliers(docs)
    for kind in ("barchart", "term_rank", "heatmap", "topics"):
        assert model.chart(kind).count() > 0


def test_changes(corpus, tmp_path):
    docs, vectors = corpus
    m = TopicModel(n_clusters=4, n_components=None, folder=f"file://{tmp_path}/m").fit(docs, vectors)
    m.merge_topics(docs, [0, 1])
    assert sorted(sizes(m)) == [0, 1, 2] and sum(sizes(m).values()) == 120
    m.delete_topics(docs, [2])
    assert sorted(sizes(m)) == [-1, 0, 1] and m.has_outliers()
    for strategy in ("distributions", "c-tf-idf", "embeddings"):
        moved = m.reduce_outliers(docs, strategy, embeddings=vectors)
        assert moved.where("topic <> -1 AND topic <> new_topic").count() == 0 and moved.count() == 120
    m.reduce_topics(docs, 2)
    assert sorted(sizes(m)) == [-1, 0]
    assert m.lineage().select("step").distinct().count() == 4
    m.set_topic_labels({0: "All"})
    assert m.labels().where("topic = 0").first()["label"] == "All"
    with pytest.raises(ValueError):
        m.set_topic_labels(["only one"])


def test_save_and_load(spark, model, corpus, tmp_path):
    docs, vectors = corpus
    model.save(f"file://{tmp_path}/saved")
    again = TopicModel.load(spark, f"file://{tmp_path}/saved")
    assert again.settings == model.settings and sizes(again) == sizes(model)
    assert sorted(map(tuple, again.transform(docs, vectors).collect())) == sorted(map(tuple, model.transform(docs, vectors).collect()))


def test_merged_models(model):
    both = TopicModel.merge_models([model, model])
    assert sorted(sizes(both)) == [0, 1, 2, 3] and sum(sizes(both).values()) == 240


def test_given_and_zero_shot(spark, corpus):
    docs, vectors = corpus
    m = TopicModel(method="given").fit(docs, y=docs.select("doc_id", F.col("given").alias("topic")))
    assert sizes(m) == {0: 68, 1: 18, 2: 17, 3: 17} or sum(sizes(m).values()) == 120

    def encode(texts):
        return np.array([[1.0 if t.startswith(k) else 0.0 for k in ("cat", "dog", "car", "sun")] + [0.0] * 4 for t in texts])

    z = TopicModel(embedder=encode, zero_shot_topics=("cat", "dog"), zero_shot_min_similarity=0.8, n_clusters=2, n_components=None).fit(docs, vectors)
    assert sorted(sizes(z)) == [0, 1, 2, 3]


def test_update_topics(spark, corpus):
    docs, vectors = corpus
    m = TopicModel(n_clusters=4, n_components=None).fit(docs, vectors)
    m.delete_topics(docs, [3])
    moved = m.reduce_outliers(docs, "embeddings", embeddings=vectors)
    want = {r["doc_id"]: r["new_topic"] for r in moved.collect()}
    assert sum(r["topic"] == -1 < r["new_topic"] for r in moved.collect()) > 0
    m.update_topics(docs, moved)
    assert {r["doc_id"]: r["topic"] for r in m.assignments.collect()} == want
    # the vectors are those of the new topics
    assert {r["topic"]: r["size"] for r in m.tables["topic_vectors"].collect()} == {t: list(want.values()).count(t) for t in set(want.values())}
    assert {r["topic"] for r in m.transform(docs, vectors).select("topic").distinct().collect()} <= set(want.values())
    m.update_topics(docs, top_n_words=3)
    assert all(len(r["words"]) == 3 for r in m.get_topic_info().collect())
    given = TopicModel(method="given").fit(docs, y=docs.select("doc_id", F.col("given").alias("topic")))
    given.tables["topic_vectors"] = m.tables["topic_vectors"]
    given.update_topics(docs, docs.select("doc_id", F.lit(0).alias("topic")))
    assert "topic_vectors" not in given.tables


def test_parts_and_probabilities(spark, corpus):
    docs, vectors = corpus
    seen = []

    def reducer(rows):
        seen.append("reducer")
        return rows.select("doc_id", F.slice("embedding", 1, 4).alias("embedding"))

    def clusterer(rows):
        first = F.array_position(F.transform("embedding", lambda x: x == F.array_max("embedding")), True) - 1
        return rows.select("doc_id", first.alias("topic"), F.lit(0.5).alias("probability"))

    def vectorizer(rows):
        return rows.groupBy("topic", F.substring("text", 1, 3).alias("word")).agg(F.count("*").alias("n"))

    m = TopicModel(reducer=reducer, clusterer=clusterer, vectorizer=vectorizer, weighting=lambda c: c.select("topic", "word", "n", F.col("n").cast("double").alias("weight"))).fit(docs, vectors)
    assert seen == ["reducer"] and sorted(sizes(m)) == [0, 1, 2, 3]
    assert {w for r in m.get_topic_info().collect() for w in r["words"]} == {"cat", "dog", "car", "sun"}
    about = m.get_document_info(docs)
    assert about.where("probability = 0.5").count() == 120
    d = TopicModel(method="density", min_topic_size=8, n_components=None).fit(docs, vectors)
    assert d.get_document_info(docs).where("topic >= 0 AND probability > 0").count() > 60


def test_guided_fit(spark, corpus):
    docs, vectors = corpus
    names = ("cat", "dog", "car", "sun")

    def encode(texts):
        return np.array([[1.0 if t.startswith(k) else 0.0 for k in names] + [0.0] * 4 for t in texts])

    got = []
    TopicModel(embedder=encode, seed_topics=(("cat", "cats"),), n_components=None, reducer=lambda r: got.append(r) or r, n_clusters=4).fit(docs, vectors)
    moved = {r["doc_id"]: np.array(r["embedding"]) for r in got[0].collect()}
    before = {r["doc_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    first = {r["doc_id"]: r["text"].startswith("cat") for r in docs.collect()}
    seed = np.eye(8)[0]
    assert all(np.allclose(moved[i], before[i] * 0.75 + seed * 0.25 if first[i] else before[i], atol=1e-6) for i in moved)


def test_other_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one text"), (2, "another")], "doc_id bigint, text string")
    for kind in ("json", "csv", "orc"):
        rows.write.format(kind).option("header", "true").save(f"{tmp_path}/{kind}")
        options = {"header": "true"} if kind == "csv" else {}
        got = readers.documents(spark, f"{tmp_path}/{kind}", kind, **options)
        assert sorted((int(r["doc_id"]), r["text"]) for r in got.collect()) == [(1, "one text"), (2, "another")]
    rows.select("text").coalesce(1).write.text(f"{tmp_path}/lines")
    got = readers.documents(spark, f"{tmp_path}/lines", "text")
    assert sorted(r["text"] for r in got.collect()) == ["another", "one text"] and got.select("doc_id").distinct().count() == 2
    with pytest.raises(ValueError):
        readers.documents(spark, f"{tmp_path}/json", "json", text="body")


def test_card(model):
    from topicspark.sources import store

    text = store.model_card("News", model.get_params(), [r.asDict() for r in model.get_topic_info().collect()])
    assert text.startswith("# News") and "4 topics" in text and "* n_clusters: 4" in text


def test_guards(spark):
    with pytest.raises(TypeError):
        readers.check_documents(["text"])
    with pytest.raises(ValueError):
        TopicModel().get_topic_info()
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        readers.check_embeddings(docs, docs.where("doc_id = 2"))


def test_online_steps_and_stream(spark, corpus, tmp_path):
    docs, vectors = corpus
    rows = docs.join(vectors, "doc_id").select("doc_id", "text", "embedding")
    for k in range(3):
        rows.where(F.col("doc_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    state = online.OnlineTopics(spark, f"file://{tmp_path}/state", 4, 0.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    state.start(stream, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert state.assignments().select("doc_id").distinct().count() == 120
    before = sorted(map(tuple, state.counts.read().collect()))
    last = state.counts.numbers()[-1]
    # a batch that is run again changes nothing
    batch = rows.join(spark.read.parquet(f"{tmp_path}/state/assignments/b{last}").select("doc_id"), "doc_id")
    state.step(spark.createDataFrame(batch.collect(), rows.schema), last)
    assert sorted((a, b, round(c, 9)) for a, b, c in map(tuple, state.counts.read().collect())) == sorted((a, b, round(c, 9)) for a, b, c in before)


def test_late_events_are_dropped(spark, tmp_path):
    early = [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:10:00"), ("b", "2024-01-03 00:00:00")]
    # what is late shows from the batch after the next
    between, late = [("b", "2024-01-03 00:10:00")], [("a", "2024-01-01 11:00:00"), ("b", "2024-01-03 00:30:00")]
    for k, rows in enumerate((early, between, late)):
        spark.createDataFrame(rows, "k string, ts string").selectExpr("k", "cast(ts as timestamp_ntz) as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e{k}")
    stream = spark.readStream.schema("k string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e*")
    q = online.to_memory(online.frequency_windows(stream, "k", "ts", "1 day"), "late", "append")
    q.awaitTermination(120)
    assert {(str(r["start"])[:10], r["k"], r["n"]) for r in spark.table("late").collect()} == {("2024-01-01", "a", 2)}
