"""Near duplicates among embeddings by a pivot-permutation index.

Some of the vectors are the reference points (pivots), none near another, so that a large group of copies doesn't fill its
own prefixes with themselves; where too few are left, random directions stand in. Each vector is described by its PREFIX nearest pivots. The index
holds one inverted list for every pair of pivots: two vectors that share at least two pivots of their prefixes, and only
such, meet in a list. Where they meet, shared pivots are counted and sketches of signs compared; what is left is verified
on the whole vectors. The number of pivots grows with the square root of the number of vectors, so the lists stay short.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import textvec as tv
from topicspark.llm.common import table, whole_groups, write_table
from topicspark.llm.components import link_classes

THRESHOLD = 0.9
#: Nearest pivots of a vector, of which two vectors must share SHARED.
PREFIX, SHARED = 8, 2
#: Vectors a list has on average; pivots at least.
LIST_ROWS, LEAST_PIVOTS = 8, 32
#: Cosine of two pivots at most.
APART = 0.7
#: Rows of a list that are compared in one task; vectors that one task verifies.
TILE, BIN = 2000, 8000
#: Standard deviations by which the signs' distance may lie above what it is at the threshold.
SIGMAS = 4.0
U64 = np.uint64


def n_pivots(n: int, prefix: int = PREFIX, list_rows: int = LIST_ROWS) -> int:
    """So many that n vectors with prefix x (prefix - 1) / 2 entries each give lists of ``list_rows`` on average."""
    return max(LEAST_PIVOTS, math.ceil(math.sqrt(n * prefix * (prefix - 1) / list_rows)))


def spread_out(x: np.ndarray, total: int, apart: float = APART) -> np.ndarray:
    """Of unit vectors, those whose cosine with all taken before them is under ``apart``, and random directions up to
    ``total``."""
    kept = np.zeros((0, x.shape[1]), dtype=np.float32)
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        part = part[(part @ kept.T).max(axis=1, initial=-1.0) < apart]
        near, free = part @ part.T >= apart, np.ones(len(part), dtype=bool)
        for i in range(len(part)):
            if free[i]:
                free[i + 1 :] &= ~near[i, i + 1 :]
        kept = np.concatenate((kept, part[free]))
    more = np.random.default_rng(13).normal(size=(max(total - len(kept), 0), x.shape[1]))
    return np.concatenate((kept, more / np.linalg.norm(more, axis=1, keepdims=True))).astype(np.float32)


def furthest(threshold: float) -> int:
    """The distance of 64 signs beyond which a pair isn't verified."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(64 * p + SIGMAS * math.sqrt(64 * p * (1 - p)))


def signs(unit: np.ndarray) -> np.ndarray:
    """64 signs of projections on fixed random directions, as one number."""
    planes = np.random.default_rng(11).normal(size=(unit.shape[1], 64)).astype(np.float32)
    return np.packbits(unit @ planes > 0, axis=1).view(U64)[:, 0]


def prefixes(unit: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, ascending; ties fall to the lower number."""
    k = min(prefix, len(pivots))
    out = np.empty((len(unit), k), dtype=np.int64)
    step = max(1, (1 << 22) // len(pivots))
    for at in range(0, len(unit), step):
        near = unit[at : at + step] @ pivots.T
        part = np.argpartition(-near, k - 1, axis=1)[:, :k]
        cut = np.take_along_axis(near, part, 1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((near == cut).sum(axis=1) > 1)
        part[tied] = np.argsort(-near[tied], axis=1, kind="stable")[:, :k]
        out[at : at + step] = np.sort(part, axis=1)
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float32, copy=False).reshape(-1, dim)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    width = raw.itemsize * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The other way, for values of one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, raw = column.buffers()
    off = np.frombuffer(off, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]].view(kind).reshape(len(column), -1)


def unit_table(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``id, k1, k2, unit`` of the usable rows, k1 and k2 naming the vector, and the dimension: the most frequent one,
    the smaller of equals."""
    own = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    # as many rows as dimensions that occur
    dims = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = int(dims["d"]) if dims else 1
    own = own.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def compute(batches):
        factor = tv.mix(np.arange(1, dim + 1, dtype=U64) * U64(tv.MULT)) | U64(1)
        for batch in batches:
            x = _vectors(batch.column("v"), dim).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            x = x / np.maximum(norm, 1e-300)[:, None]
            unit = (x + 0.0).astype(np.float32)
            bits = unit.view(np.uint32).astype(U64)
            k1, k2 = (tv.mix((tv.mix(bits + U64(salt)) * factor).sum(axis=1, dtype=U64)).view(np.int64) for salt in (1, 1 << 40))
            rows = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(k1), pa.array(k2), _fixed(unit)], names=["id", "k1", "k2", "unit"])
            yield rows.filter(pa.array(norm > 0))

    return own.mapInArrow(compute, "id bigint, k1 bigint, k2 bigint, unit binary"), dim


def _kind(total: int) -> type:
    """What the numbers of so many pivots are kept as."""
    return np.uint16 if total <= 1 << 16 else np.uint32


def postings(sets: DataFrame, pivots: np.ndarray, dim: int, prefix: int = PREFIX) -> DataFrame:
    """``key, node, row``: a row for each pair of pivots in the prefix of each vector; ``row`` is the signs and the prefix."""
    sent = sets.sparkSession.sparkContext.broadcast(pivots)

    def compute(batches):
        pivots = sent.value
        kind = _kind(len(pivots))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit = _matrix(part.column("unit"), np.float32).reshape(-1, dim)
                near = prefixes(unit, pivots, prefix)
                i, j = np.triu_indices(near.shape[1], 1)
                if not len(i):
                    continue
                key = near[:, i] * len(pivots) + near[:, j]
                row = np.concatenate((signs(unit)[:, None].view(kind), near.astype(kind)), axis=1)
                each = pa.array(np.repeat(np.arange(len(unit)), len(i)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column("node").take(each), _fixed(row).take(each)], names=["key", "node", "row"])

    return sets.select("node", "unit").mapInArrow(compute, "key bigint, node bigint, row binary")


def _shared(a: np.ndarray, b: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """How many pivots two prefixes share, and the lowest list in which they meet."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    n = both.sum(axis=1)
    rank = np.cumsum(both, axis=1) * both
    one, two = (np.take_along_axis(a, (rank == k).argmax(axis=1)[:, None], 1)[:, 0].astype(np.int64) for k in (1, 2))
    return n, one * total + two


def meet(lists: pa.Table, total: int, most: int, shared: int) -> tuple[np.ndarray, ...]:
    """(tile, a, b, shared pivots) of the pairs of the lists of one table that are worth verifying. Each pair counts in
    the lowest of its lists only."""
    tile, key, node = (np.asarray(lists.column(c).combine_chunks()) for c in ("tile", "key", "node"))
    side = np.asarray(lists.column("side").combine_chunks())
    row = _matrix(lists.column("row"), _kind(total))
    n_sign = 8 // row.itemsize
    sign, near = np.ascontiguousarray(row[:, :n_sign]).view(U64)[:, 0], row[:, n_sign:]
    out: list[tuple[np.ndarray, ...]] = []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        ok = (np.bitwise_count(sign[a] ^ sign[b]) <= most) & (node[a] != node[b])
        a, b = a[ok], b[ok]
        n, lowest = _shared(near[a], near[b], total)
        ok = (n >= shared) & (lowest == key[a])
        a, b, n = a[ok], b[ok], n[ok]
        out.append((tile[a], np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), n))

    order = np.argsort(tile, kind="stable")
    _, first, size = np.unique(tile[order], return_index=True, return_counts=True)
    split = side[order[first]] > 0
    for m in np.unique(size[~split & (size > 1)]):
        i, j = np.triu_indices(int(m), 1)
        starts = first[~split & (size == m)]
        step = max(1, (1 << 17) // len(i))
        for at in range(0, len(starts), step):
            s = starts[at : at + step, None]
            for c in range(0, len(i), 1 << 18):
                compare(order[(s + i[c : c + (1 << 18)]).ravel()], order[(s + j[c : c + (1 << 18)]).ravel()])
    for f, m in zip(first[split], size[split]):
        own = order[f : f + m]
        left, right = own[side[own] == 1], own[side[own] == 2]
        step = max(1, (1 << 18) // max(len(right), 1))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            compare(np.repeat(part, len(right)), np.tile(right, len(part)))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def candidates(posted: DataFrame, total: int, threshold: float, shared: int) -> DataFrame:
    """``tile, a, b, shared_pivots`` of the pairs to verify, a < b, each once. Lists of more than TILE rows are cut into
    blocks, and blocks meet two by two."""
    most = furthest(threshold)
    long = posted.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("g")).where("g > 1")
    rows = posted.join(long, "key", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumn("lo", F.least("block", "j")).withColumn("hi", F.greatest("block", "j"))
    # 0: all of the tile's rows meet; else those of one block (1) meet those of the other (2)
    side = F.when(F.col("lo") == F.col("hi"), 0).when(F.col("block") == F.col("lo"), 1).otherwise(2)
    rows = rows.select(F.xxhash64("key", "lo", "hi").alias("tile"), "key", "node", "row", side.cast("tinyint").alias("side"))

    def find(batches):
        for group in whole_groups(batches, "tile"):
            tile, a, b, n = meet(group, total, most, shared)
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(a), pa.array(b), pa.array(n.astype(np.int32))], names=["tile", "a", "b", "shared_pivots"])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(find, "tile bigint, a bigint, b bigint, shared_pivots int")


def verify(sets: DataFrame, pairs: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``a, b, cosine, shared_pivots`` of the pairs that reach the threshold. A vector travels to the bins of the lists in
    which it has a candidate."""
    places = pairs.select("tile", F.explode(F.array("a", "b")).alias("node"))
    n_bins = max(1, math.ceil(places.distinct().count() / BIN))
    a_bin = F.pmod(F.xxhash64("tile"), F.lit(n_bins)).cast("int").alias("bin")
    vectors = places.select(a_bin, "node").distinct().join(sets.select("node", "unit"), "node")

    def exact(vectors, pairs):
        node = np.asarray(vectors.column("node").combine_chunks())
        a, b, n = (np.asarray(pairs.column(c).combine_chunks()) for c in ("a", "b", "shared_pivots"))
        if not len(a):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64()), "shared_pivots": pa.array([], pa.int32())})
        order = np.argsort(node, kind="stable")
        unit = _matrix(vectors.column("unit"), np.float32).reshape(-1, dim)[order]
        at_a, at_b = np.searchsorted(node[order], a), np.searchsorted(node[order], b)
        cosine = np.concatenate(
            [np.einsum("ij,ij->i", unit[at_a[s : s + 65536]], unit[at_b[s : s + 65536]], dtype=np.float64) for s in range(0, len(a), 65536)]
        )
        near = cosine >= threshold
        return pa.table({"a": a[near], "b": b[near], "cosine": cosine[near], "shared_pivots": n[near]})

    own = pairs.select(a_bin, "a", "b", "shared_pivots")
    return vectors.groupBy("bin").cogroup(own.groupBy("bin")).applyInArrow(exact, "a bigint, b bigint, cosine double, shared_pivots int")


def near_vectors(vectors: DataFrame, key: str, vector: str, threshold: float, prefix: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """``id, node`` of every usable vector: the smallest id with the same direction stands for it; and ``a, b, cosine,
    shared_pivots`` of the pairs of those that are near. Both are written to the shared folder."""
    units, dim = unit_table(vectors, key, vector)
    one = write_table(units.groupBy("id").agg(F.min(F.struct("k1", "k2", "unit")).alias("s")).select("id", "s.k1", "s.k2", "s.unit"), "units")
    sets = write_table(one.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("unit").alias("unit")), "vectors")
    members = write_table(one.select("k1", "k2", "id").join(sets.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node"), "members")
    n = sets.count()
    # the square root of the number of vectors, times 2.6
    total = n_pivots(n, prefix)
    chosen = sets.select("node", "unit").orderBy(F.xxhash64("node"), "node").limit(total).toArrow()
    if chosen.num_rows < 2:
        return members, vectors.sparkSession.createDataFrame([], "a bigint, b bigint, cosine double, shared_pivots int")
    pivots = spread_out(_matrix(chosen.column("unit"), np.float32).reshape(-1, dim), total)
    posted = write_table(postings(sets, pivots, dim, prefix), "postings")
    pairs = write_table(candidates(posted, len(pivots), threshold, shared), "pairs")
    return members, write_table(verify(sets, pairs, dim, threshold), "near")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """``left_id, right_id, cosine, shared_pivots``: pairs of vectors whose cosine is at least ``threshold``.

    Vectors equal after scaling to length 1 are tied to the smallest of their ids, with cosine 1 and null shared pivots;
    that one stands for them in the other pairs (components.all_pairs gives them all). Null, empty and zero vectors,
    vectors with a null, an infinite or no number in them, vectors of another dimension than most, and rows without an id
    pair with nothing. Of several vectors under one id, one counts (that with the smallest hash). A cosine just at the
    threshold is a pair; ties among pivots fall to the lower number. Ids are integers. An empty table gives no rows.
    Other columns are ignored.
    """
    members, near = near_vectors(vectors, key, vector, threshold, prefix, shared)
    copies = members.where("id <> node").select(
        F.col("node").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("cosine"), F.lit(None).cast("int").alias("shared_pivots")
    )
    return near.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.round("cosine", 6).alias("cosine"), "shared_pivots").unionByName(copies)


def near_classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """``vec_id, class_id, n_links``, a row for each id: the smallest id among the vectors that near pairs connect it with,
    its own if there are none, and how many other vectors are near it, those of its direction counted one by one.

    The pairs are those of near_duplicates, with the same treatment of nulls, unusable vectors and repeated ids.
    """
    members, near = near_vectors(vectors, key, vector, threshold, prefix, shared)
    ids = vectors.select(F.col(key).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    return link_classes(ids.join(members, "id", "left").select("id", F.coalesce("node", "id").alias("node")), near).withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT c.a AS vec_id, c.class_id, coalesce(l.n, 0) AS n_links FROM (SELECT a, min(b) AS class_id FROM r GROUP BY 1) c LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) l USING (a)
"""
