import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.operators import cluster, distribution, hierarchy, lineage, merge_models, outliers, tuners
from topicspark.plans import queries as plans
from topicspark.streaming import online


def blobs(k, n=60, d=4, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d)) * 20
    label = np.repeat(np.arange(k), n)
    return centers[label] + rng.normal(size=(len(label), d)), label


@pytest.mark.parametrize("k", [2, 4])
def test_density_clusters_recover_blobs(k):
    x, label = blobs(k)
    got, strength = cluster.hdbscan(x, 10)
    kept = got >= 0
    assert len(set(got[kept].tolist())) == k and kept.mean() > 0.8
    assert all(len(set(label[got == c].tolist())) == 1 for c in range(k))
    assert ((strength >= 0) & (strength <= 1)).all()


def blob_table(spark, per=150, centers=3, d=5, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centers, d)) * 12
    x = np.concatenate([at[i] + rng.normal(size=(per, d)) for i in range(centers)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (9999, None)], "doc_id bigint, embedding array<double>"), np.repeat(np.arange(centers), per), at


@pytest.mark.parametrize("most", [20_000, 100])
def test_density_of_rows_and_of_bubbles(spark, monkeypatch, most):
    df, truth, at = blob_table(spark)
    monkeypatch.setattr(cluster, "MOST_ROWS", most)
    model = cluster.density_model(df, 20, bubbles=40)
    assert model.agg(F.sum("weight")).first()[0] == len(truth)
    got = {r["doc_id"]: (r["topic"], r["probability"]) for r in cluster.approximate_predict(df, model, known=True).collect()}
    assert got.keys() == set(range(len(truth)))
    names = {k: {got[i][0] for i in np.flatnonzero(truth == k) if got[i][0] >= 0} for k in range(3)}
    assert all(len(v) == 1 for v in names.values()) and len(set.union(*names.values())) == 3
    assert sum(t >= 0 for t, _ in got.values()) > 0.85 * len(truth)
    new = spark.createDataFrame([(0, at[0].tolist()), (1, (at[2] + 0.1).tolist()), (2, [500.0] * 5)], "doc_id bigint, embedding array<double>")
    near = {r["doc_id"]: (r["topic"], r["probability"]) for r in cluster.approximate_predict(new, model).collect()}
    assert {near[0][0]} == names[0] and {near[1][0]} == names[2] and near[2] == (-1, 0.0) and near[0][1] > 0
    shares = cluster.membership_vectors(new, model).collect()
    assert len(shares) == 9 and sum(r["probability"] for r in shares) == pytest.approx(3)
    best = {i: max((r["probability"], r["topic"]) for r in shares if r["doc_id"] == i)[1] for i in (0, 1)}
    assert {best[0]} == names[0] and {best[1]} == names[2]


def test_principal_components_like_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, embedding array<double>")
    got = np.array([r["reduced"] for r in cluster.reduce_dimensions(df, 3).orderBy("doc_id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    # the projection is of the vectors as they are; signs are free
    for own, axis in zip(got.T, axes):
        assert np.allclose(np.abs(own - own.mean()), np.abs((x - x.mean(axis=0)) @ axis), atol=1e-6)


def test_kmeans_rests_at_its_means(spark):
    df, truth, _ = blob_table(spark, 80)
    got = {r["doc_id"]: r["topic"] for r in cluster.cluster(df, 3).collect()}
    x = {r["doc_id"]: np.array(r["embedding"]) for r in df.collect() if r["embedding"]}
    mean = {t: np.mean([x[i] for i in got if got[i] == t], axis=0) for t in set(got.values())}
    assert all(min(mean, key=lambda t: np.linalg.norm(x[i] - mean[t])) == got[i] for i in got)
    assert len({(int(truth[i]), got[i]) for i in got}) == 3


def test_classifier_learns_what_is_labelled(spark):
    df, truth, _ = blob_table(spark, 80)
    labelled = spark.createDataFrame([(i, int(truth[i]) if i % 4 == 0 else -1) for i in range(len(truth))], "doc_id bigint, topic int")
    got = {r["doc_id"]: (r["topic"], r["probability"]) for r in cluster.classify(df, labelled).collect()}
    assert all(got[i][0] == truth[i] and got[i][1] > 0.5 for i in got) and len(got) == len(truth)


def brute_average_linkage(d, n_clusters):
    groups = [{i} for i in range(len(d))]
    while len(groups) > n_clusters:
        pairs = [(np.mean([d[i, j] for i in a for j in b]), min(a), min(b), ka, kb) for ka, a in enumerate(groups) for kb, b in enumerate(groups) if ka < kb]
        low = min(p[0] for p in pairs)
        _, _, _, ka, kb = min((p for p in pairs if p[0] <= low + 1e-12), key=lambda p: p[1:3])
        groups[ka] |= groups.pop(kb)
    return {i: min(g) for g in groups for i in g}


def similarities_by_sql(data, words=False):
    """Cosines of the sources' c-TF-IDF vectors, and their weights, from DuckDB."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    rows = con.sql(plans.SQL["ctfidf_similarity"]).fetchall()
    number = {t: int(t[len("src") :] if t.startswith("src") else "".join(c for c in t if c.isdigit())) for t in {r[0] for r in rows}}
    out = np.zeros((len(number), len(number)))
    order = {t: k for k, t in enumerate(sorted(number, key=number.get))}
    for a, b, s in rows:
        out[order[a], order[b]] = s
    return sorted(number.values()), out


def test_reduced_topics_like_brute_force(spark, data):
    topics, s = similarities_by_sql(data)
    want = {topics[i]: topics[j] for i, j in brute_average_linkage(1 - s, 8).items()}
    assert {r["from_topic"]: r["to_topic"] for r in plans.QUERIES["reduce_topics"](spark, data).collect()} == want


def test_hierarchy_like_ward_of_all_pairs(spark, data):
    topics, s = similarities_by_sql(data)
    rows = sorted(plans.QUERIES["hierarchical_topics"](spark, data).collect(), key=lambda r: r["distance"])
    d = np.clip(1 - s, 0, None)
    np.fill_diagonal(d, np.inf)
    i, j = np.unravel_index(d.argmin(), d.shape)
    assert rows[0]["topics"] == sorted([topics[i], topics[j]]) and rows[0]["distance"] == pytest.approx(d.min(), abs=1e-7)
    # Ward's distance of two groups from the distances of their members
    d2 = np.where(np.isfinite(d), d, 0) ** 2
    at = {t: k for k, t in enumerate(topics)}
    by = {r["parent_id"]: [at[t] for t in r["topics"]] for r in rows} | {t: [at[t]] for t in topics}
    for r in rows:
        a, b = by[r["child_left_id"]], by[r["child_right_id"]]
        within = lambda g: d2[np.ix_(g, g)].sum() / (2 * len(g) ** 2)
        between = d2[np.ix_(a, b)].mean()
        ward = 2 * len(a) * len(b) / (len(a) + len(b)) * (between - within(a) - within(b))
        assert r["distance"] == pytest.approx(np.sqrt(max(ward, 0)), abs=1e-5)


def test_chosen_words_like_brute_force(spark, data):
    """Each step of mmr_words takes the word that a plain loop takes."""
    words = [[1.0, 0.0, 0.2], [0.9, 0.1, 0.2], [0.0, 1.0, 0.1], [0.5, 0.5, 0.5], [0.1, 0.9, 0.3]]
    ranked = spark.createDataFrame([(0, i + 1, f"w{i}", 1.0 - i / 10) for i in range(5)], tuners.RANKED)
    vectors = spark.createDataFrame([(f"w{i}", w) for i, w in enumerate(words)], "word string, embedding array<double>")
    got = [r["word"] for r in tuners.maximal_marginal_relevance(ranked, vectors, diversity=0.3, n=3).orderBy("rank").collect()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    doc = np.mean([np.array(w) / np.linalg.norm(w) for w in words], axis=0).tolist()
    chosen = [max(range(5), key=lambda i: cos(words[i], doc))]
    while len(chosen) < 3:
        chosen.append(max((i for i in range(5) if i not in chosen), key=lambda i: 0.7 * cos(words[i], doc) - 0.3 * max(cos(words[i], words[j]) for j in chosen)))
    assert got == [f"w{i}" for i in sorted(chosen)]


def test_density_of_few_rows():
    assert cluster.hdbscan(np.zeros((3, 2)), 5)[0].tolist() == [-1, -1, -1]


@pytest.mark.parametrize("method", ["average", "complete", "single"])
def test_linkage_by_definition(method):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    groups = {i: [i] for i in range(9)}
    rule = {"average": np.mean, "complete": np.max, "single": np.min}[method]
    for k, (a, b, height, size) in enumerate(hierarchy.linkage(d, method)):
        names = sorted(groups)
        best = min((rule(d[np.ix_(groups[p], groups[q])]), p, q) for i, p in enumerate(names) for q in names[i + 1 :])
        assert height == pytest.approx(best[0]) and (a, b) == best[1:]
        groups[9 + k] = groups.pop(int(a)) + groups.pop(int(b))
        assert size == len(groups[9 + k])


def test_ward_by_variance():
    x, _ = blobs(3, 4, 2)
    links = hierarchy.linkage(np.linalg.norm(x[:, None] - x[None], axis=2), "ward")
    assert len(set(hierarchy.cut(links, 12, 3).reshape(3, 4)[:, 0].tolist())) == 3
    assert (np.diff(links[:, 2]) >= -1e-9).all()


def test_distances_are_validated():
    assert hierarchy.valid_distances([1.0, 2.0, 3.0]).tolist() == [[0, 1, 2], [1, 0, 3], [2, 3, 0]]
    for bad in ([1.0, 2.0], [[0, -1], [-1, 0]], [[1, 2, 3]]):
        with pytest.raises(ValueError):
            hierarchy.valid_distances(np.array(bad))
    assert (np.diff(hierarchy.unique_heights([0, 0, 0.5, 0.5, 1, 1])) > 0).all()


def test_lineage():
    assert lineage.merge_mapping([1, 2]) == {1: 1, 2: 1} and lineage.merge_mapping([[1, 2], [4, 3]]) == {1: 1, 2: 1, 4: 4, 3: 4}
    assert lineage.rank_mapping({-1: 50, 0: 5, 1: 9, 2: 9}) == {1: 0, 2: 1, 0: 2, -1: -1}
    assert lineage.compose([{0: 1, 1: 1, -1: -1}, {1: 0}], [-1, 0, 1]) == {-1: -1, 0: 0, 1: 0}


def test_models_are_matched():
    known = np.array([[1.0, 0], [0, 1]])
    assert merge_models.match(known, [0, 1], np.array([[0.9, 0.1], [-1, 0.1], [0.1, 0.1]]), [0, 1, -1]) == {0: 0, 1: 2, -1: -1}


def brute_windows(words, gains, idf, window, stride, padding, least):
    starts = range(1 - window, len(words), stride) if padding else range(0, max(len(words) - window, 0) + 1, stride)
    out = []
    for s in starts:
        own = range(max(s, 0), min(s + window, len(words)))
        vector = {}
        for i in own:
            vector[words[i]] = vector.get(words[i], 0) + idf[i]
        length = sum(v * v for k, v in vector.items() if k >= 0) ** 0.5
        sim = sum(gains[i] for i in own) / length if length else gains[0] * 0
        out.append(np.where(sim < least, 0, sim))
    return np.array(out)


@pytest.mark.parametrize("padding", [False, True])
@pytest.mark.parametrize("window, stride", [(4, 1), (3, 2), (1, 1), (50, 1)])
def test_windows_like_brute_force(padding, window, stride):
    rng = np.random.default_rng(window)
    words = rng.integers(-1, 5, 30)
    idf = np.where(words >= 0, 1 + words * 0.3, 0)
    gains = np.where(words[:, None] >= 0, np.abs(np.sin(np.arange(5)[:, None] * [1, 2, 3]))[words], 0) * idf[:, None] / 3
    _, _, got = distribution.shares(words, gains, idf, window, stride, padding, 0.1)
    assert np.allclose(got, brute_windows(words, gains, idf, window, stride, padding, 0.1))


def test_both_ways_of_distribution_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"aa bb w{i % 3} cc w{i % 5} dd aa", i % 3 - 1) for i in range(12)], "doc_id bigint, text string, topic int")
    from topicspark.operators import ctfidf

    counts = ctfidf.term_counts(docs)
    args = docs, ctfidf.weights(counts), ctfidf.idf(counts)
    for by_token in (False, True):
        one = sorted((*r[:-1], round(r[-1], 9)) for r in distribution.approximate_distribution(*args, by_token=by_token).collect())
        monkeypatch.setattr(distribution, "SENT_NUMBERS", 0)
        two = sorted((*r[:-1], round(r[-1], 9)) for r in distribution.approximate_distribution(*args, by_token=by_token).collect())
        monkeypatch.undo()
        assert one == two and one
    moved = outliers.by_distributions(*args).collect()
    assert len(moved) == 12 and all(r["new_topic"] == r["topic"] for r in moved if r["topic"] != -1)


def test_mmr_prefers_what_is_new():
    words = np.array([[1.0, 0.0], [0.99, 0.1], [0.6, 0.8]])
    assert tuners.mmr(np.array([1.0, 0.0]), words, 0.0, 2) == [0, 1]
    assert tuners.mmr(np.array([1.0, 0.0]), words, 0.9, 2) == [0, 2]


def test_tuners(spark):
    ranked = spark.createDataFrame([(t, r, w, 1.0 / r) for t in (0, 1) for r, w in enumerate(["red", "cat", "runs"], 1)], tuners.RANKED)
    docs = spark.createDataFrame([(0, 1, "red cat"), (1, 1, "cat runs")], "topic int, rank int, text string")
    labels = tuners.generated_labels(ranked, docs, lambda p: p.split("of ")[1].split(",")[0].upper(), pad=2).collect()
    assert sorted((r["topic"], r["rank"], r["word"]) for r in labels) == [(0, 1, "RED"), (0, 2, ""), (1, 1, "RED"), (1, 2, "")]
    zero = tuners.zero_shot_labels(ranked, lambda w, c: (c[0], 0.9), ["animals"]).collect()
    assert {(r["topic"], r["word"]) for r in zero} == {(0, "animals"), (1, "animals")}
    tags = {"red": "ADJ", "cat": "NOUN", "runs": "VERB"}
    pos = tuners.part_of_speech(ranked, docs, lambda t: [(w, tags[w]) for w in t.split()]).collect()
    assert {(r["topic"], r["word"]) for r in pos} == {(0, "red"), (0, "cat"), (1, "cat")}
    out = tuners.run(ranked, {"Short": lambda d: d.where("rank = 1")}, 2).collect()
    assert sorted((r["aspect"], r["rank"]) for r in out) == [("Main", 1), ("Main", 1), ("Main", 2), ("Main", 2), ("Short", 1), ("Short", 1)]


def test_retries():
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return p

    assert tuners.with_retries(flaky, sleep=lambda s: None)("x") == "x" and len(calls) == 3


def test_decay_step_by_step_equals_closed_form(spark):
    rows = [(b, t, w, n) for b in range(3) for t, w, n in [(0, "aa", b + 1), (b % 2, "bb", 2)]]
    df = spark.createDataFrame(rows, "batch int, topic int, word string, n bigint")
    state = None
    for b in range(3):
        state = online.merge_counts(state, df.where(f"batch = {b}"), 0.25)
    one = {(r["topic"], r["word"]): round(r["n"], 9) for r in state.collect()}
    assert one == {(r["topic"], r["word"]): round(r["n"], 9) for r in online.closed_form(df, 2, 0.25).collect()}
    assert online.new_topic_numbers([0, 1], [1, 7, 5]) == {5: 2, 7: 3}


def test_distribution_in_blocks_joins_distinct_words(spark, monkeypatch):
    """Beyond SENT_NUMBERS neither tokens nor documents are rows of a shuffle, and blocks, slices and columns leave no trace."""
    from topicspark.operators import ctfidf

    rows = [(i, None if i == 7 else " ".join(f"w{i * k % 11} the" for k in range(i % 9)), f"t{i % 4}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, topic string")
    counts = ctfidf.term_counts(docs)
    args = docs, ctfidf.weights(counts), ctfidf.idf(counts)
    for options in ({}, {"by_token": True}, {"window": 3, "stride": 2, "padding": True}, {"window": 40, "min_similarity": 0.0, "by_token": True}):
        one = sorted((*r[:-1], round(r[-1], 9)) for r in distribution.approximate_distribution(*args, **options).collect())
        for name, value in (("SENT_NUMBERS", 0), ("BLOCK_BYTES", 64), ("SLICE", 10), ("HELD_NUMBERS", 20)):
            monkeypatch.setattr(distribution, name, value)
        found = distribution.approximate_distribution(*args, **options)
        two = sorted((*r[:-1], round(r[-1], 9)) for r in found.collect())
        monkeypatch.undo()
        assert one == two and one
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "FlatMapGroupsInArrow" not in plan


def test_outliers_by_ctfidf_join_no_tokens(spark):
    from topicspark.operators import ctfidf

    docs = spark.createDataFrame([(0, "aa bb aa", 0), (1, "cc dd", 1), (2, "aa zz aa", -1), (3, "dd cc aa dd", -1), (4, "yy", -1)], "doc_id bigint, text string, topic int")
    counts = ctfidf.term_counts(docs)
    found = outliers.by_ctfidf(docs, ctfidf.weights(counts), ctfidf.idf(counts))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["new_topic"] for r in found.collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: -1}


def test_slices_with_global_weights_give_the_best_words_of_all(spark):
    """The words that a slice lacks are not all joined to it, also where weights are below 0."""
    from topicspark.operators import dynamic

    rng = np.random.default_rng(3)
    sign = {f"w{i}": -1 if i % 6 == 0 else 1 for i in range(30)}
    every = {(t, w): s * float(rng.random()) for t in (0, 1) for w, s in sign.items()}
    rows = {(b, t, w): sign[w] * float(rng.random()) for b in range(4) for t, w in every if rng.random() < 0.2}
    weighted = spark.createDataFrame([(t, w, x) for (t, w), x in every.items()], "topic int, word string, weight double")
    own = dynamic._normal(spark.createDataFrame([(*k, x) for k, x in rows.items()], "slice int, topic int, word string, weight double"), "slice", "topic")
    found = dynamic._with_global(own, weighted, 5).collect()
    assert len(found) < 4 * len(every)
    size = {t: sum(abs(x) for (k, _), x in every.items() if k == t) for t in (0, 1)}
    for b in range(4):
        for t in (0, 1):
            total = sum(abs(x) for k, x in rows.items() if k[:2] == (b, t))
            want = {w: (rows.get((b, t, w), 0) / total + every[t, w] / size[t]) / 2 for w in sign}
            got = {r["word"]: r["weight"] for r in found if (r["slice"], r["topic"]) == (b, t)}
            assert all(got[w] == pytest.approx(want[w]) for w in got)
            assert sorted(got, key=lambda w: -got[w])[:5] == sorted(want, key=lambda w: -want[w])[:5]
