import numpy as np
import pytest

from topicspark.llm import fm, labelled, quality_classifier, toxicity

from .conftest import HARD

LABELS = "doc_id bigint, quality int, toxic int"


def brute_score(m, x):
    out = []
    for a, b in zip(x.first[:-1], x.first[1:]):
        f = [i for i in x.index[a:b] if m.used[i]]
        s = 1 / np.sqrt(max(len(f), 1))
        z = m.bias + sum(m.linear[i] for i in f) * s
        z += sum(float(m.factors[i] @ m.factors[k]) for n, i in enumerate(f) for k in f[n + 1 :]) * s * s
        out.append(z)
    return np.array(out)


def sparse(rows):
    return fm.Sparse(np.concatenate([np.array(r, dtype=np.int64) for r in rows]), np.concatenate(([0], np.cumsum([len(r) for r in rows]))))


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    m = fm.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), rng.random(50) < 0.8)
    x = sparse([rng.choice(50, rng.integers(0, 12), replace=False) for _ in range(30)])
    assert np.allclose(m.score(x), brute_score(m, x))


def test_learns_pairs_that_additive_weights_miss():
    # insult 1 with group 2, or insult 3 with group 4, is toxic; 1 with 4 and 3 with 2 are not, nor rows with neither
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(3000):
        noise = rng.choice(np.arange(10, 60), 5, replace=False).tolist()
        a, b = rng.integers(0, 2, 2)
        rows.append(noise + ([1 + 2 * a, 2 + 2 * b] if i % 2 else []))
        y.append(int(i % 2 and a == b))
    x, y = sparse(rows), np.array(y, dtype=float)
    m = fm.train(x, y, epochs=30, size=64, weakest=1.0)
    additive = fm.Machine(m.bias, m.linear, np.zeros_like(m.factors), m.used)
    # additive weights order three of the four combinations right at best: 0.75
    own = np.arange(1, 3000, 2)
    assert fm.auc(m.score(x.take(own)), y[own]) > 0.95 > 0.76 > fm.auc(additive.score(x.take(own)), y[own])


def test_keeps_a_term_that_tells_only_beside_another():
    # insult 1 is toxic with group 2 only; group 2 is as frequent without insults
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.15, rng.random() < 0.5
        rows.append([1] * insult + [2] * group + rng.choice(np.arange(10, 60), 4, replace=False).tolist())
        y.append(int(insult and group))
    x, y = sparse(rows), np.array(y, dtype=float)
    assert abs(fm.gains(x, y, 64, 4)[2]) < 1.5
    gain = fm.select(x, y, 64, 4, 1.5)
    assert set(np.flatnonzero(gain).tolist()) == {1, 2}


def corpus(n=600, seed=2):
    rng = np.random.default_rng(seed)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(20, 200)))
        toxic, poor = i % 7 == 0, i % 5 == 0
        if toxic:
            w.insert(int(rng.integers(len(w))), f"scumb{rng.integers(1000)}")
        if poor:
            w += ["$$$", "###", "%%%"] * 20
        rows.append((i, " ".join(w), "en", f"src{i % 3}"))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_of_two_labels_the_worse_counts(docs, spark):
    known = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 0, 1), (3, 7, None)], LABELS)
    rows = docs([(1, "some words"), (2, "other words"), (3, "more words")])
    _, toxic, ids = labelled.gather(rows, known, "toxic", toxicity.features)
    assert dict(zip(ids.tolist(), toxic.tolist())) == {1: 1.0, 2: 0.0}
    _, good, ids = labelled.gather(rows, known, "quality", quality_classifier.features, worst=0)
    assert dict(zip(ids.tolist(), good.tolist())) == {1: 0.0, 2: 1.0}


def test_stage_keeps_columns_of_clashing_names(docs, spark, tmp_path):
    rows, labels = corpus(60)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    df = docs(rows, ["1 AS toxicity", "2 AS label", "3 AS _labelled"])
    assert toxicity.stage(spark, df, str(tmp_path)).columns == df.columns


@pytest.mark.parametrize("held", [0, 1])
def test_held_out(docs, spark, held):
    rows, labels = corpus()
    known = spark.createDataFrame([x for x in labels if x[0] % 2 != held], LABELS)
    truth = {x[0]: x for x in labels if x[0] % 2 == held}
    flagged = {r["doc_id"] for r in toxicity.flag_toxic(docs(rows), known).where("toxic").collect()} & truth.keys()
    toxic = {i for i, x in truth.items() if x[2]}
    assert len(flagged & toxic) >= 0.9 * len(toxic) and len(flagged - toxic) <= 0.02 * len(truth)
    gone = {r["doc_id"] for r in quality_classifier.classify_quality(docs(rows), known).where("NOT keep").collect()} & truth.keys()
    poor = {i for i, x in truth.items() if not x[1]}
    assert len(gone & poor) >= 0.9 * len(poor) and len(gone - poor) <= 0.03 * len(truth)


def test_hard_rows_and_missing_labels(docs, spark):
    clash = ["1 AS toxicity", "2 AS quality", "3 AS label"]
    some = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (2, None, None), (4, 1, 0)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for labels in (some, none):
        for f in (toxicity.flag_toxic, quality_classifier.classify_quality):
            assert f(docs(HARD, clash), labels).count() == len(HARD)
            assert f(docs([]), labels).count() == 0
    assert toxicity.flag_toxic(docs(HARD), none).where("toxic").count() == 0
    assert quality_classifier.classify_quality(docs(HARD), none).where("NOT keep").count() == 0


def test_bound_of_the_sample(docs, spark):
    rows, labels = corpus(100)
    from topicspark.llm import labelled

    x, y, ids = labelled.gather(docs(rows), spark.createDataFrame(labels, LABELS), "toxic", toxicity.features, 30)
    assert len(x) == len(y) == len(ids) == 30
