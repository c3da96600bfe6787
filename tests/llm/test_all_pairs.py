import numpy as np
from pyspark.sql import functions as F

from topicspark.llm import jaccard_join as j
from topicspark.llm import pivot_index as p
from topicspark.llm.components import all_pairs

from .test_pivot_index import table


def test_texts_like_brute_force_over_all_rows(docs):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = {1: words, 5: words, 9: words[:-1] + ["x"], 3: words[:-1] + ["x"], 7: ["y", *words[1:]], 8: ["y", *words[1:]], 20: ["other", "words", "here", "now"]}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in texts.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    pairs = j.join_similar(docs([(i, " ".join(w)) for i, w in texts.items()]))
    rows = all_pairs(pairs, F.col("jaccard") == 1.0).collect()
    got = {(r["left_id"], r["right_id"]): round(r["jaccard"], 6) for r in rows}
    assert len(got) == len(rows) and got == {k: round(v, 6) for k, v in want.items() if v >= j.THRESHOLD}
    assert (5, 9) in got


def test_vectors_like_brute_force_over_all_rows(spark):
    v = {1: [1.0, 2.0, 3.0], 2: [2.0, 4.0, 6.0], 3: [1.0, 2.0, 3.0], 12: [1.0, 2.0, 3.05], 11: [2.0, 4.0, 6.1], 13: [-1.0, 0.0, 1.0]}
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v.items()}
    want = {(a, b) for a in v for b in v if a < b and unit[a] @ unit[b] >= 0.9}
    pairs = p.near_duplicates(table(spark, list(v.items())))
    rows = all_pairs(pairs, F.col("shared_pivots").isNull()).collect()
    got = {(r["left_id"], r["right_id"]) for r in rows}
    assert len(got) == len(rows) and got == want
