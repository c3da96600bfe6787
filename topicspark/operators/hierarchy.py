"""Trees of topics. Linkage runs on the driver over a matrix of topics x topics; names come from the counts in the engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.operators import ctfidf
from topicspark.sources.shared import written

#: Topics whose tree is built at most: the matrix of distances has the square of it.
MOST = 5000
#: Topics whose products one task holds, 32 MB; parts that the words are spread over.
BLOCK, WORD_PARTS = 2000, 64
HIERARCHY = (
    "parent_id int, parent_name string, topics array<int>, child_left_id int, child_left_name string, child_right_id int, child_right_name string, distance double"
)
Linkage = Callable[[np.ndarray], np.ndarray]


def valid_distances(x: np.ndarray, n: int | None = None) -> np.ndarray:
    """A square matrix of distances, from a square or condensed one: zero diagonal, symmetric, no negative numbers."""
    x = np.asarray(x, dtype=np.float64)
    if x.ndim == 1:
        size = round((1 + np.sqrt(1 + 8 * len(x))) / 2)
        if size * (size - 1) // 2 != len(x) or (n is not None and n != size):
            raise ValueError("the condensed distances don't fit the number of rows")
        square = np.zeros((size, size))
        square[np.triu_indices(size, 1)] = x
        x = square + square.T
    elif x.ndim != 2 or x.shape[0] != x.shape[1]:
        raise ValueError("distances must be square or condensed")
    x = (x + x.T) / 2
    if (x < -1e-9).any() or not np.isfinite(x).all():
        raise ValueError("distances must not be negative")
    x = np.maximum(x, 0)
    np.fill_diagonal(x, 0)
    return x


def linkage(distances: np.ndarray, method: str = "ward") -> np.ndarray:
    """Rows (left, right, distance, size) of agglomerative clustering by Lance-Williams updates; left < right; of equal
    distances the pair of lowest numbers first. Methods: ward, average, complete, single."""
    d = valid_distances(distances).copy()
    n = len(d)
    if n > MOST:
        raise ValueError(f"more than {MOST} topics; reduce them first")
    np.fill_diagonal(d, np.inf)
    name, size, out = np.arange(n), np.ones(n), []
    alive = np.ones(n, dtype=bool)
    for step in range(n - 1):
        live = np.flatnonzero(alive)
        sub = d[np.ix_(live, live)]
        low = sub.min()
        ii, jj = np.nonzero(sub <= low + 1e-12)
        a, b = name[live[ii]], name[live[jj]]
        pick = np.lexsort((np.maximum(a, b), np.minimum(a, b)))[0]
        i, j = live[ii[pick]], live[jj[pick]]
        i, j = (i, j) if name[i] < name[j] else (j, i)
        rest = live[(live != i) & (live != j)]
        x, y = d[i, rest], d[j, rest]
        if method == "ward":
            total = size[i] + size[j] + size[rest]
            new = np.sqrt(np.maximum(((size[i] + size[rest]) * x**2 + (size[j] + size[rest]) * y**2 - size[rest] * low**2) / total, 0))
        elif method == "average":
            new = (size[i] * x + size[j] * y) / (size[i] + size[j])
        elif method in ("complete", "single"):
            new = np.maximum(x, y) if method == "complete" else np.minimum(x, y)
        else:
            raise ValueError(f"unknown method {method}")
        out.append((name[i], name[j], low, size[i] + size[j]))
        d[i, rest] = d[rest, i] = new
        alive[j] = False
        name[i], size[i] = n + step, size[i] + size[j]
    return np.array(out, dtype=float).reshape(-1, 4)


def unique_heights(heights: Sequence[float], step: float = 1e-8) -> np.ndarray:
    """Rising heights, ties moved apart by a small step, the same each time."""
    out = np.array(heights, dtype=float)
    for i in range(1, len(out)):
        if out[i] <= out[i - 1]:
            out[i] = out[i - 1] + step
    return out


def cut(links: np.ndarray, n_leaves: int, n_clusters: int) -> np.ndarray:
    """Cluster number of each leaf when ``n_clusters`` are left, numbered by the lowest leaf."""
    parent = {}
    for k, (a, b, *_) in enumerate(links[: max(n_leaves - n_clusters, 0)]):
        parent[int(a)] = parent[int(b)] = n_leaves + k

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    roots = [root(i) for i in range(n_leaves)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots], dtype=int)


def topic_distances(rows: DataFrame, topics: list[int]) -> np.ndarray:
    """1 - cosine from a table ``topic_a, topic_b, similarity`` of all pairs."""
    at = {t: i for i, t in enumerate(topics)}
    out = np.ones((len(topics), len(topics)))
    for r in rows.collect():
        out[at[r["topic_a"]], at[r["topic_b"]]] = 1 - r["similarity"]
    return np.clip(out, 0, None)


def ctfidf_similarity(weighted: DataFrame) -> DataFrame:
    """``topic_a, topic_b, similarity`` of all pairs of topics but -1 that share a word.

    Words are spread over the tasks; each multiplies its words x topics matrix, block of topics by block, so a word of
    many topics costs a row of a matrix and not a row for each pair.
    """
    own = weighted.where(F.col("topic").cast("string") != "-1")
    length = written(own.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("l")).where("l > 0"), "lengths")
    # a row a topic, numbered in blocks: numbers needn't be without gaps
    n_blocks = max(1, -(-length.count() // BLOCK))
    rank = F.row_number().over(W.partitionBy("block").orderBy("topic")) - 1
    numbered = written(length.withColumn("block", F.pmod(F.xxhash64("topic"), F.lit(n_blocks)).cast("int")).withColumn("place", rank), "numbered")
    x = own.join(numbered, "topic").select("block", "place", "word", (F.col("weight") / F.col("l")).alias("x"))
    both = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    parts = both.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.pmod(F.xxhash64("word"), F.lit(WORD_PARTS)).alias("part"), "block", "place", "word", "x")

    def multiply(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        word = np.unique(group.column("word").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        block, place, value = (group.column(c).to_numpy() for c in ("block", "place", "x"))
        size = [int(place[block == b].max(initial=-1)) + 1 for b in (lo, hi)]
        total = np.zeros(size)
        order = np.argsort(word, kind="stable")
        step = max(1, (1 << 22) // max(*size, 1))
        for w in range(0, int(word.max()) + 1, step):
            some = order[np.searchsorted(word[order], w) : np.searchsorted(word[order], w + step)]
            sides = []
            for b, n in zip((lo, hi), size):
                m = np.zeros((step, n))
                mine = some[block[some] == b]
                m[word[mine] - w, place[mine]] = value[mine]
                sides.append(m)
            total += sides[0].T @ sides[1]
        i, j = np.nonzero(total)
        return pa.table({"block_a": pa.array(np.full(len(i), lo), pa.int32()), "place_a": i.astype(np.int32), "block_b": pa.array(np.full(len(i), hi), pa.int32()), "place_b": j.astype(np.int32), "s": total[i, j]})

    keys = ["block_a", "place_a", "block_b", "place_b"]
    sums = parts.groupBy("lo", "hi", "part").applyInArrow(multiply, ", ".join(f"{k} int" for k in keys) + ", s double").groupBy(*keys).agg(F.sum("s").alias("similarity"))
    # of two blocks each pair came once
    turned = sums.where("block_a <> block_b").select(F.col("block_b").alias("block_a"), F.col("place_b").alias("place_a"), F.col("block_a").alias("block_b"), F.col("place_a").alias("place_b"), "similarity")
    sums = sums.unionByName(turned)
    for side in ("a", "b"):
        named = numbered.select(F.col("topic").alias(f"topic_{side}"), F.col("block").alias(f"block_{side}"), F.col("place").alias(f"place_{side}"))
        sums = sums.join(named, [f"block_{side}", f"place_{side}"])
    return sums.select("topic_a", "topic_b", "similarity")


def hierarchical_topics(counts: DataFrame, idf: DataFrame, similarity: DataFrame, method: str | Linkage = "ward", n_words: int = 5) -> DataFrame:
    """The merges as HIERARCHY has them, the last first: parents are numbered from the highest topic's number + 1, named by
    the best words of their topics' summed counts under the known idf. Topic -1 takes no part."""
    spark = counts.sparkSession
    topics = sorted(r[0] for r in counts.where("topic <> -1").select("topic").distinct().collect())
    if len(topics) < 2:
        return spark.createDataFrame([], HIERARCHY)
    d = topic_distances(similarity, topics)
    links = method(d) if callable(method) else linkage(d, method)
    heights = unique_heights(links[:, 2])
    n, base = len(topics), topics[-1] + 1
    leaves: dict[int, list[int]] = {i: [t] for i, t in enumerate(topics)}
    number = {i: t for i, t in enumerate(topics)}
    merges = []
    for k, (a, b, *_) in enumerate(links):
        a, b = int(a), int(b)
        leaves[n + k], number[n + k] = sorted(leaves[a] + leaves[b]), base + k
        merges.append((number[n + k], number[a], number[b], leaves[n + k], float(heights[k])))
    names = node_names(counts, idf, [(number[i], t) for i in leaves for t in leaves[i]], n_words)
    rows = [(p, names.get(p, ""), ts, a, names.get(a, ""), b, names.get(b, ""), h) for p, a, b, ts, h in merges]
    return spark.createDataFrame(rows[::-1], HIERARCHY)


def node_names(counts: DataFrame, idf: DataFrame, members: list[tuple[int, int]], n_words: int) -> dict[int, str]:
    """The best words of each node, joined by underscores; (node, topic) pairs are as many as the topics squared at most."""
    nodes = counts.sparkSession.createDataFrame(members, "node int, topic int")
    summed = written(counts.join(F.broadcast(nodes), "topic").groupBy("node", "word").agg(F.sum("n").alias("n")), "nodes")
    best = ctfidf.top_words(ctfidf.under_idf(summed, idf, ("node",)).withColumn("score", F.round("weight", 12)), n_words, ("node",), "score")
    return {r["node"]: "_".join(r["words"]) for r in ctfidf.word_lists(best, ("node",)).collect()}


def tree(hierarchy: DataFrame, max_distance: float | None = None) -> str:
    """The hierarchy as text, a line for each leaf and each parent within ``max_distance``."""
    rows = hierarchy.collect()
    if not rows:
        return ""
    by = {r["parent_id"]: r for r in rows}
    lines: list[str] = ["."]

    def walk(node: int, name: str, lead: str, last: bool) -> None:
        row = by.get(node)
        far = row is not None and max_distance is not None and row["distance"] > max_distance
        here = "" if far else f"{lead}{'└─' if last else '├─'}"
        if row is None:
            lines.append(f"{here}■──{name} ── Topic: {node}")
            return
        if not far:
            lines.append(f"{here}{name}")
        below = lead if far else lead + ("     " if last else "│    ")
        walk(row["child_left_id"], row["child_left_name"], below, False)
        walk(row["child_right_id"], row["child_right_name"], below, True)

    top = max(rows, key=lambda r: (r["distance"], r["parent_id"]))
    walk(top["parent_id"], top["parent_name"], "", True)
    return "\n".join(lines)


def levels(hierarchy: DataFrame, n: int = 10, log: bool = False) -> DataFrame:
    """``level, topic, ancestor``: for ``n`` rising distances, the topmost parent within the distance of each topic; topics
    without one stand for themselves."""
    rows = sorted(hierarchy.collect(), key=lambda r: r["distance"])
    spark = hierarchy.sparkSession
    if not rows:
        return spark.createDataFrame([], "level int, topic int, ancestor int")
    lo, hi = rows[0]["distance"], rows[-1]["distance"]
    cuts = np.geomspace(max(lo, 1e-9), hi, n) if log else np.linspace(lo, hi, n)
    topics = sorted({t for r in rows for t in r["topics"]})
    out = []
    for k, c in enumerate(cuts):
        now = {t: t for t in topics}
        for r in rows:
            if r["distance"] <= c + 1e-12:
                now |= dict.fromkeys(r["topics"], r["parent_id"])
        out += [(k, t, a) for t, a in now.items()]
    return spark.createDataFrame(out, "level int, topic int, ancestor int")


def document_levels(hierarchy: DataFrame, docs: DataFrame, n: int = 10, log: bool = False) -> DataFrame:
    """``level, doc_id, topic, ancestor``: where each document (``doc_id, topic``) is at each of ``n`` levels; outliers are -1 at
    all of them."""
    steps = levels(hierarchy, n, log)
    every = steps.select("level").distinct()
    known = docs.select("doc_id", "topic").join(F.broadcast(steps), "topic")
    alone = docs.where("topic = -1").select("doc_id", "topic").crossJoin(F.broadcast(every)).withColumn("ancestor", F.lit(-1))
    return known.select("level", "doc_id", "topic", "ancestor").unionByName(alone.select("level", "doc_id", "topic", "ancestor"))


def dendrogram(hierarchy: DataFrame) -> DataFrame:
    """``parent_id, side, x_from, y_from, x_to, y_to``: two lines for each merge, from a child up to its parent. Leaves stand
    side by side at height 0, the left child's before the right one's; a parent stands over the middle of its children."""
    rows = {r["parent_id"]: r for r in hierarchy.collect()}
    spark = hierarchy.sparkSession
    place: dict[int, tuple[float, float]] = {}
    if rows:
        todo, order = [max(rows.values(), key=lambda r: (r["distance"], r["parent_id"]))["parent_id"]], []
        while todo:
            at = todo.pop()
            if at in rows:
                todo += [rows[at]["child_right_id"], rows[at]["child_left_id"]]
            else:
                order.append(at)
        place = {t: (float(i), 0.0) for i, t in enumerate(order)}
    out = []
    for p, r in sorted(rows.items(), key=lambda x: (x[1]["distance"], x[0])):
        sides = [place[r["child_left_id"]], place[r["child_right_id"]]]
        place[p] = ((sides[0][0] + sides[1][0]) / 2, float(r["distance"]))
        out += [(p, side, *at, *place[p]) for side, at in zip(("left", "right"), sides)]
    return spark.createDataFrame(out, "parent_id int, side string, x_from double, y_from double, x_to double, y_to double")


def reduce_mapping(similarity: DataFrame, topics: list[int], n_topics: int) -> dict[int, int]:
    """To ``n_topics`` topics (-1 counts as one of them if it exists) by average linkage: each topic goes to the lowest
    number of its cluster."""
    own = sorted(t for t in topics if t != -1)
    n = max(n_topics - (len(own) < len(topics)), 1)
    if n >= len(own):
        return {t: t for t in topics}
    part = cut(linkage(topic_distances(similarity, own), "average"), len(own), n)
    low = {c: min(t for t, p in zip(own, part) if p == c) for c in set(part.tolist())}
    return {t: low[int(c)] for t, c in zip(own, part)} | {t: t for t in topics if t == -1}


def auto_reduce_mapping(vectors: np.ndarray, topics: list[int]) -> dict[int, int]:
    """Topics whose unit vectors a density clustering of two or more puts together go to the lowest number of theirs."""
    from topicspark.operators.cluster import hdbscan

    own = sorted(t for t in topics if t != -1)
    if len(own) < 3:
        return {t: t for t in topics}
    label, _ = hdbscan(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), 2)
    low = {c: min(t for t, x in zip(own, label) if x == c) for c in set(label.tolist()) if c >= 0}
    return {t: low.get(int(c), t) for t, c in zip(own, label)} | {t: t for t in topics if t == -1}
