import numpy as np

from topicspark.llm import pivot_index as p

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {(min(rows[i][0], rows[k][0]), max(rows[i][0], rows[k][0])) for i, k in zip(*np.nonzero(np.triu(s >= threshold, 1)))}


def vectors(n=400, d=32, seed=1, spread=0.25):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    near = base[rng.integers(0, n, n)] + rng.normal(size=(n, d)) * spread * rng.random((n, 1)) * 2
    return [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near]).astype(np.float32))]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def found(df):
    return {(r["left_id"], r["right_id"]) for r in df.collect()}


def test_recall_and_exactness(spark):
    rows = vectors()
    want, got = brute(rows), found(p.near_duplicates(table(spark, rows)))
    assert got <= want and len(want) > 200
    assert len(got) >= 0.9 * len(want)


def test_lists_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(p, "TILE", 20)
    monkeypatch.setattr(p, "BIN", 30)
    rng = np.random.default_rng(2)
    center = rng.normal(size=16)
    rows = [(i, (center + rng.normal(size=16) * 0.05).tolist()) for i in range(150)]
    assert found(p.near_duplicates(table(spark, rows))) == brute([(i, np.float32(v)) for i, v in rows])


def test_hard_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (3, v), (3, v), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0])]
    rows += [(None, v), (9, [1.0, 2.0]), (10, [-1.0, 0.0, 1.0]), (11, [float("inf"), 1.0, 0.0]), (12, [1.0, 2.0, 3.05])]
    df = table(spark, rows).selectExpr("*", "1 AS node", "2 AS tile", "'x' AS unit")
    got = found(p.near_duplicates(df))
    # 1, 2 and 3 have one direction
    assert got == {(1, 2), (1, 3), (1, 12)}
    assert found(p.near_duplicates(table(spark, []))) == set()
    assert found(p.near_duplicates(table(spark, [(1, v)]))) == set()


def test_shared_pivots_are_counted():
    a, b = np.array([[1, 3, 5, 9]]), np.array([[2, 3, 8, 9]])
    n, lowest = p._shared(a, b, 10)
    assert n.tolist() == [2] and lowest.tolist() == [3 * 10 + 9]
    assert p.n_pivots(10**8) / p.n_pivots(10**6) < 10.1


def test_prefixes_are_the_nearest():
    rng = np.random.default_rng(0)
    x, piv = rng.normal(size=(50, 8)).astype(np.float32), rng.normal(size=(30, 8)).astype(np.float32)
    got = p.prefixes(x, piv, 5)
    assert (got == np.sort(np.argsort(-(x @ piv.T), axis=1)[:, :5], axis=1)).all()


def test_classes_like_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32))]
    rows += [(100 + i, (base[i % 5] * (1 + i % 3)).astype(np.float32).tolist()) for i in range(20)]
    rows += [(200 + i, (base[i] + rng.normal(size=16) * 0.08).astype(np.float32).tolist()) for i in range(10)]
    pairs = brute([(i, np.float32(v)) for i, v in rows])
    near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i, _ in rows}
    of = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in of:
                of[k] = i
                todo += near[k]
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in p.near_classes(table(spark, [*rows, (300, None), (301, [0.0] * 16)])).collect()}
    assert got == {i: (of[i], len(near[i])) for i, _ in rows} | {300: (300, 0), 301: (301, 0)}
