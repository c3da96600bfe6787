import itertools
import random
import re

import numpy as np
import pytest

from topicspark.llm import jaccard_join as j
from topicspark.llm.components import components

from .conftest import HARD


def brute(rows, n=3, threshold=0.5):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", t or "")]
        s = frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)]) if w else None
        if s and i is not None:
            sets.setdefault(s, set()).add(i)
    pairs = {(min(v), x) for v in sets.values() for x in v if x != min(v)}
    for (a, v), (b, u) in itertools.combinations(sets.items(), 2):
        if len(a & b) / len(a | b) >= threshold and min(v) != min(u):
            pairs.add((min(min(v), min(u)), max(min(v), min(u))))
    return pairs


def texts(n=150, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 and out:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        out.append((i, " ".join(w)))
    return out


def found(df):
    return {(r["left_id"], r["right_id"]) for r in df.collect()}


def test_like_brute_force(docs):
    rows = texts()
    want, got = brute(rows), found(j.join_similar(docs(rows)))
    assert got <= want
    assert len(want) > 40 and len(got) >= 0.9 * len(want)


def test_splitting_across_tasks_finds_the_same(docs, monkeypatch):
    rows = texts(240, 5)
    monkeypatch.setattr(j, "TASK_SETS", 40)
    monkeypatch.setattr(j, "LIMIT", 4)
    monkeypatch.setattr(j, "LEVELS", 2)
    monkeypatch.setattr(j, "SENT", 10)
    monkeypatch.setattr(j, "TILE", 20)
    want, got = brute(rows), found(j.join_similar(docs(rows)))
    assert got <= want and len(got) >= 0.9 * len(want)


def test_recall_of_pairs_at_the_threshold(docs):
    """Pairs at exactly half within families that share a passage, sketches and all: none is left out of the count."""
    rng, rows, want = random.Random(4), [], set()
    for family in range(6):
        passage = [f"p{family}_{i}" for i in range(12)]
        for k in range(70):
            own = [f"x{family}_{k}_{i}" for i in range(30)]
            # 42 words are 40 trigrams; the second shares 2/3 of them: 27 or 26 of 53 are half of all
            first = passage + own
            second = first[: 2 + 27] + [f"y{family}_{k}_{i}" for i in range(13)]
            for w in (first, second):
                rows.append((len(rows), " ".join(w)))
            sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (first, second)]
            assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) == pytest.approx(27 / 53)
            want.add((len(rows) - 2, len(rows) - 1))
    rng.shuffle(rows)
    got = found(j.join_similar(docs(rows), recall=0.95))
    assert len(want & got) >= 0.93 * len(want)


def test_runs_follow_the_measured_chance():
    rng = np.random.default_rng(1)
    for chance in (0.1, 0.3, 0.7):
        times = rng.binomial(6, chance, 20_000)
        got = j.run_chance({k: int((times == k).sum()) for k in range(1, 7)}, 6)
        assert got == pytest.approx(chance, abs=0.02)
        n = j.n_runs(got)
        assert (1 - (1 - got) ** n) * j.kept_by_sketch() >= 0.95 > (1 - (1 - got) ** (n - 1)) * j.kept_by_sketch()
    assert j.run_chance({1: 3}, 6) == j.LEAST_CHANCE


def links(rows, threshold=0.5):
    """class and number of links of each id, by brute force over all rows."""
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", t or "")]
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    near = {i: {k for k in sets if k != i and sets[i] and len(sets[i] & sets[k]) / len(sets[i] | sets[k]) >= threshold} for i in sets}
    of = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in of:
                of[k] = i
                todo += near[k]
    return {i: (of[i], len(near[i])) for i in sets}


def test_classes_like_brute_force(docs):
    rows = texts(60, 6)
    rows += [(100 + i, rows[i % 7][1]) for i in range(30)] + [(200, ""), (201, None), (202, "two words"), (203, "two words")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.similar_classes(docs(rows)).collect()}
    assert got == links(rows)


def family(n, seed, words=200, most=14):
    """Different texts near to one another, though not each to each, and some near to few of them."""
    rng = random.Random(seed)
    base, out = [f"b{seed}_{i}" for i in range(words)], []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, most if k % 10 else 60)):
            w[rng.randrange(words)] = f"e{rng.randrange(400)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("split", [False, True])
def test_a_family_costs_rows_and_not_pairs(docs, monkeypatch, split):
    """Pairs inside a family of 260 different texts are never rows, yet all its links count, copies one by one."""
    monkeypatch.setattr(j, "TILE", 100)
    if split:
        monkeypatch.setattr(j, "TASK_SETS", 100)
    both = family(260, 1) + family(130, 2)
    rows = list(enumerate(both + both[:20] + [t for _, t in texts(60, 6)] + [None, ""]))
    made, real = [], j.candidates
    monkeypatch.setattr(j, "candidates", lambda *a: made.append(real(*a)) or made[-1])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.similar_classes(docs(rows)).collect()}
    want = links(rows)
    assert sum(n for _, n in want.values()) // 2 > 20_000
    families, pairs = made[0]
    assert pairs.count() < 2_000 and families.count() > 350
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    # what is near to few of a family is found with the recall of single pairs
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(n for _, n in got.values()) >= 0.995 * sum(n for _, n in want.values())
    sure = {r["node"] for r in families.collect()}
    pairs = found(j.join_similar(docs(rows)))
    assert pairs <= brute(rows) and len(pairs) >= 0.995 * len(brute(rows))
    assert {p for p in brute(rows) if p[0] < 260 and p[1] < 260 and p[0] in sure and p[1] in sure} <= pairs


def test_shared_values_and_lowest_nodes():
    rng = np.random.default_rng(2)
    for n_l, n_r, size in ((300, 250, 40), (5, 3, 9), (1, 1, 1)):
        a, b = rng.random((n_l, size)) < rng.random(size), rng.random((n_r, size)) < rng.random(size)
        (x, p), (y, q) = np.nonzero(a), np.nonzero(b)
        assert (j._shared(x, y, n_l, n_r, p, q) == a.astype(int) @ b.T.astype(int)).all()
    near = np.zeros((4, 4), dtype=bool)
    near[[0, 1, 1, 2], [0, 0, 1, 3]] = True
    low_l, low_r = j._lowest(near, np.array([8, 5, 7, 1]), np.array([4, 9, 2, 6]))
    assert low_l.tolist() == [4, 4, 6, 1] and low_r.tolist() == [4, 4, 2, 6]


def test_several_texts_under_one_id(docs):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(1, base), (2, "z " + base), (2, base + " a"), (2, None), (3, "zz yy xx vv uu"), (None, base), (None, base)]
    assert found(j.join_similar(docs(rows))) == {(1, 2)}
    kept = j.stage(docs(rows).sparkSession, docs(rows), "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", base), ("3", "zz yy xx vv uu"), ("None", base), ("None", base)]
    twice = j.stage(docs(rows).sparkSession, docs([(5, "b c d"), (5, "a b c"), (5, "a b c")]), "").collect()
    assert [(r["doc_id"], r["text"]) for r in twice] == [(5, "a b c")]


def test_hard_rows(docs):
    df = j.join_similar(docs(HARD, ["1 AS left_id", "2 AS node", "'x' AS sketch"]))
    assert found(df) == brute([r[:2] for r in HARD])
    assert found(j.join_similar(docs([]))) == set()


def test_large_group_of_copies(docs):
    rows = [(i, "one and the same long text " + "more words " * 5) for i in range(300)]
    assert found(j.join_similar(docs(rows))) == {(0, i) for i in range(1, 300)}


def test_stage_keeps_one_of_each_group(docs, spark):
    rows = texts(90, 8)
    df = docs(rows)
    kept = {r["doc_id"] for r in j.stage(spark, df, "").collect()}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found(j.join_similar(df)):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert kept == {i for i in parent if find(i) == i}
    hard = j.stage(spark, docs(HARD), "")
    assert hard.columns == docs(HARD).columns
    assert sorted(str(r["doc_id"]) for r in hard.collect()) == sorted({str(r[0]) for r in HARD})
    clash = ["1 AS gone_id", "2 AS class_id", "3 AS node", "4 AS _repeated"]
    assert j.stage(spark, docs(HARD, clash), "").columns == docs(HARD, clash).columns


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_shingles(n):
    text = "A b a b c. A b"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    row, gram = j.shingles(data, np.array([0, len(data)]), n)
    w = text.lower().replace(".", "").split()
    assert len(set(zip(*(w[k:] for k in range(n))))) == len(gram) and not row.any()
