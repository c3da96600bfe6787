import base64
import itertools

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from topicspark.llm import bpe

from .conftest import HARD


@pytest.fixture(scope="module")
def real():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary())


def split(tokens, first):
    return [tokens[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


TEXTS = [
    "Hello world, it's 1234 o'clock.", "  two  spaces\n\n\ttabs ", "éèê çà ßtraße Übung", "\U0001f600\U0001f680 emoji", "", " ", "a" * 3000, "don't've we'll", "日本語のテキスト", "<|endoftext|>",
    "   odd spaces line", "abcdefghijklmnopqrstuvwxyz" * 40, "supercalifragilisticexpialidocious antidisestablishmentarianism",
]


def test_like_the_library(real, encoder):
    assert split(*encoder.encode(TEXTS)) == [real.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(real, encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tokens, first = encoder.encode(texts)
    assert split(tokens, first) == [real.encode_ordinary(t) for t in texts]
    data, begin = bpe.decode(encoder.v, tokens, first)
    assert [data.tobytes()[a:b].decode() for a, b in zip(begin[:-1], begin[1:])] == texts


def test_speculation_mostly_holds(encoder, spark, data):
    texts = [r[0] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    words = list(dict.fromkeys(w.encode() for t in texts for w in encoder.pattern.findall(t)))
    _, _, failed = bpe.encode_words(encoder.v, words)
    assert 0 < failed < 0.6 * len(words)


def test_white_space_of_every_kind(real, encoder):
    spaces = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "é", "x", "1", "!", "'s", "日"]
    texts = ["a" + "".join(t) + "b" for k in (1, 2, 3) for t in itertools.product(spaces, repeat=k)]
    assert split(*encoder.encode(texts)) == [real.encode_ordinary(t) for t in texts]


def test_words_of_any_length_are_speculated_on(real, encoder):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), n)) for n in (257, 1000, 5000)] + ["the" * 4000]
    assert split(*encoder.encode(words)) == [real.encode_ordinary(t) for t in words]
    _, _, failed = bpe.encode_words(encoder.v, [b"the" * 200])
    assert failed == 0


def test_two_pieces_of_one_hash(real):
    encoder = bpe.Encoder(bpe.vocabulary())
    encoder.encode(["one two"])
    # both pieces now have the tokens of the first
    encoder.codes.values[encoder.codes.keys != 0] = 0
    assert split(*encoder.encode(["one two", "one"])) == [real.encode_ordinary("one two"), real.encode_ordinary("one")]


def test_numbers_that_are_no_token_are_left_out(spark):
    df = spark.createDataFrame([(1, [72, None, 10**6, -5, 72]), (2, None), (3, [])], "doc_id bigint, tokens array<int>")
    v = bpe.vocabulary()
    got = {r["doc_id"]: r["text"] for r in bpe.decode_tokens(df).collect()}
    assert got == {1: (v.tokens[72] * 2).decode(), 2: None, 3: ""}


def test_long_merges_agree(encoder):
    word = b"the quick brown fox" * 5
    short = bpe._merge_short(word, encoder.v.ranks, 1 << 60)
    assert bpe.merge(word, encoder.v.ranks) == short
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéth "), rng.integers(1, 30))).encode() for _ in range(3000)] + [b"aaaaaaa", b"abababab", b"x"]
    first = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    at, token = bpe.merge_many(encoder.v, np.frombuffer(b"".join(words), np.uint8), first)
    got = np.split(token, np.searchsorted(at, np.arange(1, len(words))))
    assert [g.tolist() for g in got] == [[encoder.v.ranks[t] for t in bpe._merge_short(w, encoder.v.ranks, 1 << 60)] for w in words]


def test_query_round_trips(docs, spark, data):
    got = bpe.query(spark, data)
    assert got.where("NOT round_trip").count() == 0 and got.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_hard_rows(docs):
    df = bpe.encode_texts(docs(HARD, ["1 AS tokens", "2 AS n_tokens"]))
    got = df.collect()
    assert len(got) == len(HARD)
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["tokens"] is None and one["n_tokens"] == 0 and one["round_trip"] is None
    assert next(r for r in got if r["doc_id"] == 2)["tokens"] == []
    back = {r["doc_id"]: r["text"] for r in bpe.decode_tokens(df).collect()}
    assert back == {r[0]: r[1] for r in HARD}
    assert bpe.encode_texts(docs([])).count() == 0


def test_frequent_pieces_outlive_rare_ones(monkeypatch):
    """When too many are known, rare pieces go and frequent ones aren't learnt again; tokens are those of a new encoder."""
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    encoder = bpe.Encoder(bpe.vocabulary())
    often = [f"word{chr(97 + i)} Größe{chr(97 + i)}" for i in range(20)]
    learnt, learn = [], encoder._learn

    def spy(data, start, end, *rest):
        learnt.extend(data[a:b].tobytes().strip() for a, b in zip(start, end))
        learn(data, start, end, *rest)

    monkeypatch.setattr(encoder, "_learn", spy)
    for k in range(12):
        rare = [f" rare{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)} x-{k}-{i}" for i in range(60)]
        given = [" ".join(often * 2), *rare, "", "  "]
        tokens, first = encoder.encode(given)
        want, begin = bpe.Encoder(encoder.v).encode(given)
        assert np.array_equal(tokens, want) and np.array_equal(first, begin)
    assert encoder.codes.n <= 300 + 150 and len(learnt) > 1000
    # the first word has no space before it, so it is another piece
    assert all(learnt.count(w.encode()) <= 2 for t in often for w in t.split())
