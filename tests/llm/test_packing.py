from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicspark.llm import bpe
from topicspark.llm import packing as p

from .conftest import HARD


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1), st.just(40))
def test_plan_places_every_piece_once(histogram, capacity):
    used = Counter()
    for pattern, times in p.plan(histogram, capacity):
        assert sum(pattern) <= capacity and times > 0
        for x in pattern:
            used[x] += times
    assert used == Counter(histogram)


def best_fit_bins(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps[gaps.index(min(fits))] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_no_worse_than_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 100, 300)
    bins = sum(t for _, t in p.plan(dict(Counter(lengths.tolist())), 100))
    assert bins <= best_fit_bins(lengths.tolist(), 100) * 1.02 + 1
    assert bins >= lengths.sum() / 100


def test_complement_is_exact():
    count = np.zeros(21, dtype=np.int64)
    count[[3, 4, 8]] = [2, 1, 1]
    pairs = p.pair_sums(count)
    assert p.complement(count, 8, pairs) == (8,)
    assert p.complement(count, 7, pairs) == (4, 3)
    assert p.complement(count, 6, pairs) == (3, 3)
    assert p.complement(count, 14, pairs) == (8, 3, 3)
    assert p.complement(count, 9, pairs) is None
    assert p.complement(count, 0, pairs) is None


def fewest_bins(lengths, capacity):
    """The optimum, by trying all ways."""
    best = len(lengths)

    def put(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for g in sorted(set(gaps)):
            if g >= lengths[i]:
                rest = list(gaps)
                rest[rest.index(g)] -= lengths[i]
                put(i + 1, rest)
        put(i + 1, [*gaps, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_fill_against_the_optimum():
    rng = np.random.default_rng(9)
    planned = optimal = 0
    for _ in range(60):
        lengths = rng.integers(1, 21, int(rng.integers(1, 10))).tolist()
        own = sum(t for _, t in p.plan(dict(Counter(lengths)), 20))
        fewest = fewest_bins(lengths, 20)
        assert fewest <= own <= fewest + 1
        planned, optimal = planned + own, optimal + fewest
    assert planned <= 1.03 * optimal


def tokens_of(encoder, rows):
    tokens, edge = encoder.encode([t or "" for _, t in rows])
    return [(i, tuple(tokens[a:b].tolist())) for (i, _), a, b in zip(rows, edge[:-1], edge[1:])]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary())


def check(got, rows, capacity, encoder):
    """Every token of op3 is at one place of one sequence, in its order; the fill is returned."""
    assert len({r["bin_id"] for r in got}) == len(got)
    parts = []
    for r in got:
        assert 0 < r["n_tokens"] == len(r["tokens"]) == sum(r["lengths"]) <= capacity
        at = 0
        for i, first, n in zip(r["doc_ids"], r["first_tokens"], r["lengths"], strict=True):
            assert n > 0 and first % capacity == 0
            parts.append((i, first, tuple(r["tokens"][at : at + n])))
            at += n
    want = [(i, a, t[a : a + capacity]) for i, t in tokens_of(encoder, rows) for a in range(0, len(t), capacity)]
    assert Counter(parts) == Counter(want)
    return sum(r["n_tokens"] for r in got) / max(len(got) * capacity, 1)


def test_every_token_is_in_one_sequence(docs, encoder, monkeypatch):
    monkeypatch.setattr(p, "PART_TOKENS", 150)
    rng = np.random.default_rng(1)
    rows = [(i, "word " * int(rng.integers(1, 150))) for i in range(300)]
    assert check(p.sequences(docs(rows), capacity=64).collect(), rows, 64, encoder) > 0.98


def test_spans_are_those_of_the_sequences(docs, encoder):
    rng = np.random.default_rng(2)
    rows = [(i, "some other words " * int(rng.integers(0, 40))) for i in range(80)]
    spans = p.pack(docs(rows), capacity=32).collect()
    count = Counter()
    for r in spans:
        count[r["doc_id"]] += r["n_tokens"]
        assert (r["bin_id"] is None) == (r["n_tokens"] == 0)
    assert count == Counter({i: len(t) for i, t in tokens_of(encoder, rows)})
    places = [(r["bin_id"], k) for r in spans for k in range(r["bin_start"] or 0, (r["bin_start"] or 0) + r["n_tokens"])]
    assert len(set(places)) == len(places) and all(k < 32 for _, k in places)
    got = p.sequences(docs(rows), capacity=32).collect()
    assert Counter((i, a) for r in got for i, a in zip(r["doc_ids"], r["first_tokens"])) == Counter((r["doc_id"], r["first_token"]) for r in spans if r["n_tokens"])


def test_hard_rows(docs, encoder):
    df = docs(HARD, ["1 AS piece", "2 AS n", "3 AS bin_id", "4 AS uid", "5 AS raw"])
    check(p.sequences(df).collect(), [r[:2] for r in HARD], p.CAPACITY, encoder)
    assert {r["doc_id"] for r in p.pack(df).collect()} == {r[0] for r in HARD}
    assert p.sequences(docs([])).count() == 0 and p.pack(docs([])).count() == 0
