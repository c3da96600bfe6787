"""Clusters and classes of vectors: Spark ML's estimators, given labels, and density clustering, of more rows than the driver
bears by way of many small k-means clusters that stand for their rows with their numbers and extents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that density clustering takes one by one; of more, this many small clusters at most, which hold all the rows.
MOST_ROWS, BUBBLES = 20_000, 4_000


def as_vector(rows: DataFrame, vector: str = "embedding", name: str = "features") -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).withColumn(name, array_to_vector(F.transform(vector, lambda x: F.nanvl(x.cast("double"), F.lit(0.0)))))


def reduce_dimensions(rows: DataFrame, k: int = 5, vector: str = "embedding", key: str = "doc_id", name: str = "reduced") -> DataFrame:
    """``doc_id, reduced``: the first ``k`` principal components, of vectors moved by the mean."""
    own = as_vector(rows.select(key, vector), vector)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(own)
    return model.transform(own).select(key, vector_to_array("pc").alias(name))


def cluster(rows: DataFrame, k: int = 10, method: str = "kmeans", vector: str = "embedding", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``doc_id, topic``; methods: kmeans, bisecting, mixture (which adds ``probabilities``)."""
    return cluster_and_centers(rows, k, method, vector, key, seed)[0]


def cluster_and_centers(rows: DataFrame, k: int = 10, method: str = "kmeans", vector: str = "embedding", key: str = "doc_id", seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """What cluster() gives and, for kmeans, the center of each topic: rows have the topic of the nearest one."""
    own = as_vector(rows.select(key, vector), vector)
    kinds = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}
    if method not in kinds:
        raise ValueError(f"unknown method {method}")
    model = kinds[method](k=k, seed=seed, featuresCol="features", predictionCol="topic").fit(own)
    out = model.transform(own)
    centers = [c.tolist() for c in model.clusterCenters()] if method == "kmeans" else []
    return (out.select(key, "topic", vector_to_array("probability").alias("probabilities")) if method == "mixture" else out.select(key, "topic")), centers


def classify(rows: DataFrame, labelled: DataFrame, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """``doc_id, topic, probability`` by a logistic regression fitted to the rows that ``labelled`` (``doc_id, topic``) names."""
    own = as_vector(rows.select(key, vector), vector)
    train = own.join(labelled.where("topic >= 0").select(key, F.col("topic").cast("double").alias("label")), key)
    model = LogisticRegression(maxIter=30, regParam=0.01, family="multinomial", featuresCol="features", labelCol="label").fit(train)
    scored = model.transform(own)
    return scored.select(key, F.col("prediction").cast("int").alias("topic"), F.array_max(vector_to_array("probability")).alias("probability"))


def given(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """No clustering: documents have the topic their label says, those without one -1."""
    return rows.select(key).join(labels.select(key, F.col("topic").cast("int").alias("topic")), key, "left").select(key, F.coalesce("topic", F.lit(-1)).alias("topic"))


def density(rows: DataFrame, min_size: int = 10, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """``doc_id, topic, probability`` by hierarchical density clustering; rows without a vector have no row."""
    return approximate_predict(rows, density_model(rows, min_size, vector, key), vector, key, known=True)


def density_model(rows: DataFrame, min_size: int = 10, vector: str = "embedding", key: str = "doc_id", bubbles: int = BUBBLES) -> DataFrame:
    """``point, embedding, weight, radius, topic, strength``: the points that stand for the rows, up to MOST_ROWS rows
    themselves, beyond that centers of small clusters (data bubbles) with the number of their rows and their mean distance.

    Clusters are numbered by their first point, noise is -1. The driver holds MOST_ROWS or ``bubbles`` points, however many
    rows there are.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    n = own.count()
    if n <= MOST_ROWS:
        got = [(r["v"], 1.0, 0.0) for r in own.orderBy(key).collect()]
    else:
        spread = as_vector(own, "v")
        model = KMeans(k=bubbles, seed=42, maxIter=8, initSteps=2, featuresCol="features", predictionCol="at").fit(spread)
        centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "at int, c array<double>")
        away = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        # a row a bubble
        sums = model.transform(spread).join(F.broadcast(centers), "at").groupBy("at").agg(F.count("*").alias("w"), F.avg(away).alias("r"), F.first("c").alias("c"))
        got = [(r["c"], float(r["w"]), float(r["r"])) for r in sums.orderBy("at").collect()]
    x = np.array([g[0] for g in got], dtype=float)
    weight, radius = np.array([g[1] for g in got]), np.array([g[2] for g in got])
    label, strength = hdbscan(x, min_size, weight=weight, radius=radius) if got else (np.zeros(0, int), np.zeros(0))
    out = [(i, v.tolist(), float(w), float(r), int(t), float(p)) for i, (v, w, r, t, p) in enumerate(zip(x, weight, radius, label, strength))]
    return spark.createDataFrame(out, "point int, embedding array<double>, weight double, radius double, topic int, strength double")


def approximate_predict(rows: DataFrame, model: DataFrame, vector: str = "embedding", key: str = "doc_id", known: bool = False) -> DataFrame:
    """``doc_id, topic, probability`` of other rows by a density_model: the topic of the nearest point, the first of equals.
    The probability falls with the distance beyond the point's extent, measured by its cluster's widest; a row further than
    that is -1. With ``known`` the rows are those the model was made of, and keep their point's topic."""
    got = model.orderBy("point").collect()
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, topic int, probability double"
    own = rows.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    if not got:
        return own.select(key, F.lit(-1).alias("topic"), F.lit(0.0).alias("probability"))
    x = np.array([r["embedding"] for r in got])
    topic, strength, radius = (np.array([r[c] for r in got]) for c in ("topic", "strength", "radius"))
    reach = np.zeros(len(x))
    for t in np.unique(topic[topic >= 0]) if not known else ():
        mine = np.flatnonzero(topic == t)
        # how far apart neighbouring points of the cluster are
        gaps = core_distances(x[mine], min(1, len(mine) - 1))
        reach[mine] = 2 * max(float(gaps.max()), float(radius[mine].max())) + 1e-12
    sent = rows.sparkSession.sparkContext.broadcast((x, topic, strength, radius, reach))

    def compute(batches):
        x, topic, strength, radius, reach = sent.value
        square = (x**2).sum(axis=1)
        for batch in batches:
            step = max(16, (1 << 22) // len(x))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                v = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                d = (v**2).sum(axis=1)[:, None] + square - 2 * v @ x.T
                best = d.argmin(axis=1)
                away = np.linalg.norm(v - x[best], axis=1)
                label, p = topic[best].copy(), strength[best].copy()
                if not known:
                    beyond = np.maximum(away - radius[best], 0)
                    share = np.divide(beyond, reach[best], out=np.ones_like(beyond), where=reach[best] > 0)
                    p, label = np.where(share < 1, p * (1 - share), 0.0), np.where(share < 1, label, -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label.astype(np.int32)), pa.array(np.where(label >= 0, p, 0.0))], names=[key, "topic", "probability"])

    return own.mapInArrow(compute, schema)


def membership_vectors(rows: DataFrame, model: DataFrame, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """``doc_id, topic, probability`` of every row with every cluster: shares, of sum 1, of the inverse distances to the
    nearest point of each. As many rows as rows times clusters."""
    got = [r for r in model.orderBy("point").collect() if r["topic"] >= 0]
    own = rows.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    schema = f"{key} {dict(rows.dtypes)[key]}, topic int, probability double"
    if not got:
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r["embedding"] for r in got]), np.array([r["topic"] for r in got])))

    def compute(batches):
        x, topic = sent.value
        names = np.unique(topic)
        for batch in batches:
            step = max(16, (1 << 22) // len(x))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                v = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                d = np.sqrt(np.maximum((v**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * v @ x.T, 0))
                near = 1 / np.maximum(np.stack([d[:, topic == t].min(axis=1) for t in names], axis=1), 1e-9)
                share = near / near.sum(axis=1, keepdims=True)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(names))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(names, part.num_rows).astype(np.int32)), pa.array(share.ravel())], names=[key, "topic", "probability"])

    return own.mapInArrow(compute, schema)


def _spanning_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Prim's tree of the mutual reachability distances, row by row."""
    n = len(x)
    best, source, inside = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(np.linalg.norm(x - x[at], axis=1), core), core[at])
        closer = ~inside & (d < best)
        best[closer], source[closer] = d[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[at]), int(source[at]), at))
    return sorted(edges)


def core_distances(x: np.ndarray, k: int, weight: np.ndarray | None = None, radius: np.ndarray | None = None) -> np.ndarray:
    """The distance within which each point has ``k`` rows beside itself; of a point that stands for more rows than that, the
    part of its extent which holds so many."""
    n = len(x)
    core = np.empty(n)
    for at in range(0, n, 512):
        d = np.sqrt(np.maximum((x[at : at + 512] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[at : at + 512] @ x.T, 0))
        if weight is None:
            core[at : at + 512] = np.partition(d, k, axis=1)[:, k]
            continue
        order = np.argsort(d, axis=1, kind="stable")
        upto = np.cumsum(weight[order], axis=1)
        place = np.minimum((upto >= k + 1).argmax(axis=1), n - 1)
        core[at : at + 512] = np.take_along_axis(d, np.take_along_axis(order, place[:, None], 1), 1)[:, 0]
    if weight is not None and radius is not None:
        inside = radius * np.minimum((k + 1) / weight, 1) ** (1 / x.shape[1])
        core = np.where(weight > k, np.maximum(core, inside), np.maximum(core, radius))
    return core


def hdbscan(
    x: np.ndarray, min_size: int, min_samples: int | None = None, weight: np.ndarray | None = None, radius: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and strengths of membership: the clusters of most excess of mass in the condensed tree of the
    mutual reachability distances. Clusters are numbered by their first row. ``weight`` and ``radius``: how many rows a point
    stands for, and how far they are from it."""
    n = len(x)
    rows = np.ones(n) if weight is None else weight
    k = int(min(min_samples or min_size, max(rows.sum() - 1, 1)))
    if rows.sum() < 2 * min_size or n < 2:
        return np.full(n, -1), np.zeros(n)
    core = core_distances(x, k, None if weight is None or (weight == 1).all() else weight, radius)
    # single linkage
    parent, size, node = list(range(2 * n - 1)), [*rows.tolist()] + [0] * (n - 1), {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step, (d, a, b) in enumerate(_spanning_tree(x, core)):
        ra, rb = find(a), find(b)
        node[n + step] = (ra, rb, d)
        parent[ra] = parent[rb] = n + step
        size[n + step] = size[ra] + size[rb]

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += node[j][:2]
        return out

    # condense: only splits into two parts of min_size or more make new clusters
    born, stability, children, members, fell = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}, {}
    todo = [(2 * n - 2, 0)]
    while todo:
        i, c = todo.pop()
        a, b, d = node[i]
        level = 1 / d if d > 0 else 1e12
        big = [j for j in (a, b) if size[j] >= min_size]
        if len(big) == 2:
            stability[c] += (level - born[c]) * size[i]
            for j in big:
                new = len(born)
                born[new], stability[new], children[new], members[new] = level, 0.0, [], []
                children[c].append(new)
                if j >= n:
                    todo.append((j, new))
                else:
                    # one point that stands for enough rows
                    members[new], fell[j] = [j], level
            continue
        for j in (a, b):
            if size[j] < min_size or j < n:
                own = leaves(j)
                stability[c] += (level - born[c]) * float(rows[own].sum())
                members[c] += own
                fell |= dict.fromkeys(own, level)
        if big and big[0] >= n:
            todo.append((big[0], c))
    chosen: dict[int, bool] = {}
    for c in sorted(born, reverse=True):
        below = sum(stability[j] for j in children[c])
        if c and (not children[c] or stability[c] >= below):
            chosen[c] = True
        else:
            stability[c] = max(below, 0.0) if not c else below
    label, strength = np.full(n, -1), np.zeros(n)
    todo2 = [0]
    found = []
    while todo2:
        c = todo2.pop()
        if chosen.get(c):
            own, rest = [], [c]
            while rest:
                j = rest.pop()
                own += members[j]
                rest += children[j]
            found.append(sorted(own))
        else:
            todo2 += children[c]
    for number, own in enumerate(sorted(found)):
        top = max(fell[i] for i in own)
        label[own] = number
        strength[own] = [min(fell[i] / top, 1.0) for i in own]
    return label, strength
