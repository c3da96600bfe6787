import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicspark.llm import url_filter as u

PAGES = "page_id bigint, url string, html string"
HARD = [
    (1, None, None), (2, "", ""), (3, "not a url", "x"), (4, "http://", "x"), (5, "HTTP://User:pw@WWW.Casino-Win.example.com:8080/a/b.html?x=1&y=two#top", "x"), (None, "https://a.example.com/1", "x"),
    (6, "https://a.example.com/1", "x"), (6, "https://a.example.com/1", "x"), (7, "https://b.example.org/" + "long-" * 20_000, "x"), (8, "//c.example.net", "x"), (9, "mailto:x", "x"),
]


def toks(spark, url):
    return set(spark.createDataFrame([(url,)], "url string").select(u.tokens(F.col("url")).alias("t")).first()["t"])


def test_tokens(spark):
    got = toks(spark, HARD[4][1])
    assert got == {"host:casino-win.example.com", "h:casino", "h:win", "h:example", "h:com", "t:com", "e:html", "p:a", "p:b", "q:x", "q:y", "v:two", "f:top"}
    assert toks(spark, "") == set()


def made():
    rows = []
    for i in range(400):
        host = ["news", "shop", "blog", "win"][i % 4]
        path = ["free", "item", "post"][i % 3]
        rows.append((f"http://{host}.example.com/{path}/{i}", host == "win" and path == "free" or host == "shop" and i % 10 == 1))
    return rows


def test_rules_like_brute_force(spark):
    rows = made()
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r["items"]): (r["n_bad"], r["n_all"]) for r in u.mine(labelled, 0.05).collect()}
    tokens = [(set(r["t"]), r["bad"]) for r in labelled.select(u.tokens(F.col("url")).alias("t"), "bad").collect()]
    assert got == first_of_equals(brute(tokens, 0.05, u.CONFIDENCE), tokens) and ("h:win", "p:free") in got


def test_matches_like_brute_force(spark):
    rows = made()
    rules = u.mine(spark.createDataFrame(rows, "url string, bad boolean"), 0.05)
    pages = spark.createDataFrame([(i, url, None) for i, (url, _) in enumerate(rows)], PAGES)
    got = {r["page_id"]: (r["keep"], r["n_rules"]) for r in u.filter_urls(pages, rules).collect()}
    sets = [set(r["items"]) for r in rules.collect()]
    for r in pages.select("page_id", u.tokens(F.col("url")).alias("t")).collect():
        n = sum(s <= set(r["t"]) for s in sets)
        assert got[r["page_id"]] == (n == 0, n)


@pytest.mark.parametrize("with_rules", [True, False])
def test_hard_rows(spark, with_rules):
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame(HARD, PAGES).selectExpr("*", "1 AS toks", "2 AS anchor", "3 AS rule")
    labelled = u.labelled_urls(pages, labels) if with_rules else u.labelled_urls(pages.limit(0), labels)
    rules = u.mine(labelled)
    got = u.filter_urls(pages, rules).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in HARD)
    assert all(r["keep"] for r in got if r["page_id"] in (1, 2, 4))
    assert u.filter_urls(pages.limit(0), rules).count() == 0


def test_query_covers_all_pages(spark, data):
    got = u.query(spark, data).collect()
    assert len(got) == spark.read.parquet(f"{data}/pages.parquet").count()


def brute(tokens, support, confidence):
    """All combinations of all tokens; strong ones that hold a smaller strong one are left out."""
    least, sets, every = max(1, round(support * sum(b for _, b in tokens))), Counter(), Counter()
    for t, b in tokens:
        for k in range(1, len(t) + 1):
            for s in itertools.combinations(sorted(t), k):
                every[s] += 1
                sets[s] += b
    z, strong = u.Z, {}
    for s, n in sets.items():
        p, m = n / every[s], every[s]
        if n >= least and (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m) >= confidence:
            strong[s] = (n, m)
    return {s: v for s, v in strong.items() if not any(set(r) < set(s) for r in strong)}


def first_of_equals(rules, tokens):
    """Of tokens of the same rows, the first by name stands for all."""
    cover = {x: frozenset(i for i, (t, _) in enumerate(tokens) if x in t) for t, _ in tokens for x in t}
    first = {}
    for x in sorted(cover):
        first.setdefault(cover[x], x)
    return {s: v for s, v in rules.items() if all(first[cover[x]] == x for x in s)}


def test_planted_combinations_of_four_tokens(spark):
    """Any three of four words are in good URLs as well: the rule is all four."""
    words = ["win", "free", "now", "cash"]
    rows = [(f"http://a{i % 9}.example.com/{'/'.join(words)}/{i}", True) for i in range(60)]
    for k, left in enumerate(words):
        rows += [(f"http://a{i % 9}.example.com/{'/'.join(w for w in words if w != left)}/{k * 1000 + i}", False) for i in range(80)]
    rows += [(f"http://b{i % 9}.example.org/{'x' * (1 + i % 5)}/{i}", i % 10 == 0) for i in range(300)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r["items"]): (r["n_bad"], r["n_all"]) for r in u.mine(labelled, 0.05).collect()}
    tokens = [(set(r["t"]), r["bad"]) for r in labelled.select(u.tokens(F.col("url")).alias("t"), "bad").collect()]
    assert got == first_of_equals(brute(tokens, 0.05, u.CONFIDENCE), tokens)
    assert got[tuple(sorted(f"p:{w}" for w in words))] == (60, 60)


def test_labels_that_say_nothing_of_urls_give_no_rules(spark):
    rows = [(f"http://{['casino', 'news', 'shop'][i % 3]}.example.com/{i}", i % 7 == 0) for i in range(600)]
    assert u.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0


def test_rules_like_unmerged_brute_force(spark):
    # among bad rows h:cheap, h:zzz and host: are one; many good ones have h:cheap. On shop- only two words together tell
    rows = [(f"http://cheap-zzz.example.com/a/{i}", True) for i in range(60)] + [(f"http://cheap-{i % 9}x.example.com/b/{i}", False) for i in range(300)]
    rows += [(f"http://shop-{i % 20}y.example.com/buy/now.html?{i}", True) for i in range(80)]
    rows += [(f"http://shop-{i % 20}y.example.com/buy/{i}", False) for i in range(100)] + [(f"http://shop-{i % 20}y.example.com/x/now?{i}", False) for i in range(100)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r["items"]): (r["n_bad"], r["n_all"]) for r in u.mine(labelled, 0.05).collect()}
    tokens = [(set(r["t"]), r["bad"]) for r in labelled.select(u.tokens(F.col("url")).alias("t"), "bad").collect()]
    assert got == first_of_equals(brute(tokens, 0.05, u.CONFIDENCE), tokens)
    assert any("zzz" in x for s in got for x in s) and ("p:buy", "p:now") in got
    pages = spark.createDataFrame([(i, url, None) for i, (url, _) in enumerate(rows)], PAGES)
    keep = {r["page_id"]: r["keep"] for r in u.filter_urls(pages, u.mine(labelled)).collect()}
    assert [not keep[i] for i in range(len(rows))] == [b for _, b in rows]
