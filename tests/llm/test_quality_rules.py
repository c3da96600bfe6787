import math

import numpy as np
import pytest

from topicspark.llm import docstats
from topicspark.llm import quality_rules as q

from .conftest import HARD


def test_chi_squared():
    # known quantiles
    assert q.chi2_quantile(0.05, 7) == pytest.approx(14.0671, abs=1e-3)
    assert q.chi2_quantile(0.001, 3) == pytest.approx(16.2662, abs=1e-3)
    assert q.chi2_cdf(2, 2) == pytest.approx(1 - math.exp(-1))


def test_estimate_resists_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, q.P)) * 0.3
    x[:400] = 8 + rng.normal(size=(400, q.P)) * 0.1
    center, cov = q.mcd(x)
    assert np.abs(center).max() < 0.08
    assert np.allclose(np.diag(cov), 0.09 + q.FLOOR**2, rtol=0.35)
    assert q.distances(x[:400], center, cov).min() > q.distances(x[400:], center, cov).max()


def test_estimate_is_the_best_subset_of_a_small_sample():
    import itertools

    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 2))
    x[:2] += 6
    h = max(math.ceil(0.7 * 10), (10 + 2 + 1) // 2)
    floor = np.diag(q.FLOOR[:2] ** 2)
    best = min(np.linalg.slogdet(q._moments(x[list(s)])[1] + floor)[1] for s in itertools.combinations(range(10), h))
    center, _ = q.mcd(x)
    d = np.argsort(((x - center) ** 2).sum(axis=1))
    assert np.linalg.slogdet(q._moments(x[d[:h]])[1] + floor)[1] <= best + 0.5


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8])
def test_few_or_equal_rows(n):
    center, cov = q.mcd(np.ones((n, q.P)))
    assert np.linalg.slogdet(cov)[0] == 1 and center.shape == (q.P,)


def corpus():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(60, 200))).capitalize() + ".", "en", f"src{i % 2}") for i in range(300)]
    junk = [(1000, "$ %& @@ ## " * 80, "en", "src0"), (1001, "SPAM " * 300, "en", "src1"), (1002, "line of junk\n" * 120, "en", "src0")]
    return rows, junk


def test_junk_goes_and_clean_documents_stay(docs, spark, monkeypatch):
    rows, junk = corpus()
    got = {r["doc_id"]: r["keep"] for r in q.reject_outliers(docs(rows + junk)).collect()}
    assert not any(got[i] for i, *_ in junk)
    assert sum(got[i] for i, *_ in rows) >= 0.99 * len(rows)
    kept = q.stage(spark, docs(rows + junk), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}
    monkeypatch.setattr(q, "SENT", 0)
    assert {r["doc_id"] for r in q.stage(spark, docs(rows + junk), "").collect()} == {i for i, k in got.items() if k}


def test_like_brute_force_over_whole_groups(docs):
    rows, junk = corpus()
    import pyarrow as pa

    from topicspark.llm import textvec as tv

    x = np.concatenate([docstats.statistics(d, o) for _, _, d, o in tv.chunks(pa.array([r[1] for r in rows + junk]))])
    groups = np.array([r[3] for r in rows + junk])
    est = {g: (*q.mcd(x[groups == g]), (groups == g).sum()) for g in set(groups)}
    n = sum(e[2] for e in est.values())
    pool = [sum(e[k] * e[2] for e in est.values()) / n for k in (0, 1)]
    want = np.zeros(len(x))
    for g, (center, cov, m) in est.items():
        w = m / (m + q.PRIOR_ROWS)
        own = groups == g
        want[own] = q.distances(x[own], w * center + (1 - w) * pool[0], w * cov + (1 - w) * pool[1])
    got = {r["doc_id"]: r["outlier_distance"] for r in q.reject_outliers(docs(rows + junk)).collect()}
    # steps on the grid may stop at another row than steps on the exact order
    assert np.allclose([got[r[0]] for r in rows + junk], want, rtol=0.05)


def made(n, seed=5, copies=0.4, bad=0.2):
    """Statistics of n rows of one group, some of them copies of one row, some outliers."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, q.P)) * rng.uniform(0.05, 0.4, q.P)
    x[: int(copies * n)] = x[0]
    x[n - int(bad * n) :] = 3 + rng.normal(size=(int(bad * n), q.P)) * 0.2
    return x


def stats_of(spark, groups):
    import pandas as pd

    rows = pd.DataFrame({"lang": "en", "source": [g for g, x in groups for _ in x], "_x": [r.tolist() for _, x in groups for r in x]})
    rows["_id"] = np.arange(len(rows))
    return spark.createDataFrame(rows, "lang string, source string, _x array<double>, _id bigint").repartition(6)


@pytest.mark.parametrize("copies", [0.0, 0.4])
def test_large_group_like_the_estimate_over_all_its_rows(spark, copies):
    x, few = made(60_000, copies=copies), made(500, 6, copies)
    got = {r["source"]: (np.array(r["center"]), np.reshape(r["cov"], (q.P, q.P)), r["n"]) for r in q.estimates(stats_of(spark, [("big", x), ("small", few)])).collect()}
    cut = q.chi2_quantile(q.TAIL, q.P)
    for name, own in (("big", x), ("small", few)):
        center, cov = q.mcd(own)
        assert got[name][2] == len(own)
        assert np.allclose(got[name][0], center, atol=0.01)
        assert np.allclose(got[name][1], cov, atol=0.03 * np.abs(cov).max())
        want, had = (q.distances(own, *e) > cut for e in ((center, cov), got[name][:2]))
        assert want.sum() >= 0.2 * len(own) and (want != had).mean() < 0.001


def test_no_size_of_group_or_start_changes_the_method(spark, monkeypatch):
    x = made(3_000)
    whole = q.estimates(stats_of(spark, [("a", x)])).first()
    sampled = q.estimates(stats_of(spark, [("a", x)]), start_rows=300).first()
    assert np.allclose(whole["center"], sampled["center"], atol=0.02)
    monkeypatch.setattr(q, "SENT_GROUPS", 0)
    joined = q.estimates(stats_of(spark, [("a", x)])).first()
    assert np.allclose(whole["center"], joined["center"]) and np.allclose(whole["cov"], joined["cov"])


def test_many_groups_are_joined_alike(docs, monkeypatch):
    rows, junk = corpus()
    before = sorted(map(tuple, q.reject_outliers(docs(rows + junk)).collect()))
    monkeypatch.setattr(q, "SENT_GROUPS", 0)
    assert sorted(map(tuple, q.reject_outliers(docs(rows + junk)).collect())) == before


def test_hard_rows(docs, spark):
    clash = ["1 AS outlier", "2 AS outlier_distance", "3 AS lang_key", "4 AS cov"]
    got = q.reject_outliers(docs(HARD, clash)).collect()
    assert len(got) == len(HARD)
    assert all(r["keep"] for r in got if r["doc_id"] in (1, 2, 3))
    assert q.stage(spark, docs(HARD, clash), "").columns == docs(HARD, clash).columns
    assert q.reject_outliers(docs([])).count() == 0


def test_junk_of_small_languages_goes(docs):
    rows, junk = corpus()
    alone = [(2000 + i, text, f"q{i}", "src0") for i, (_, text, *_) in enumerate(junk)]
    # clean and junk documents of a language of eight rows; a clean one alone in its language
    few = [(3000 + i, rows[i][1], "zz", "src1") for i in range(6)] + [(3100 + i, junk[0][1] + "!" * i, "zz", "src1") for i in range(2)]
    got = {r["doc_id"]: r["keep"] for r in q.reject_outliers(docs(rows + alone + few + [(4000, rows[7][1], "yy", None)])).collect()}
    assert not any(got[i] for i, *_ in alone) and not got[3100] and not got[3101]
    assert all(got[3000 + i] for i in range(6)) and got[4000]
    assert sum(got[i] for i, *_ in rows) >= 0.99 * len(rows)


def test_languages_that_differ_pool_to_the_whole():
    rng = np.random.default_rng(4)
    x, lang = rng.normal(size=(900, q.P)), np.arange(900) % 3
    x += lang[:, None] * 2.0
    parts = [x[lang == k] for k in range(3)]
    import pandas as pd

    frame = pd.DataFrame([{"lang": str(k), "source": "", "n": float(len(p)), "center": q._moments(p)[0], "cov": q._moments(p)[1].ravel()} for k, p in enumerate(parts)])
    got = q._pool_apart(frame).iloc[0]
    assert np.allclose(got["center"], x.mean(axis=0)) and np.allclose(np.reshape(got["cov"], (q.P, q.P)), q._moments(x)[1])
