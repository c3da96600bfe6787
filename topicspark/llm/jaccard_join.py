"""Similarity join of texts by their n-grams of words: chosen paths over sketches, then exact Jaccard.

Each set of n-grams is embedded as T min-hash values. From a root, a bucket of sets is split on sampled (place, value)
pairs, each place of the sketch being chosen with probability 1 / (threshold x T) by a hash of the path so far, so all
sets of a bucket choose alike and two sets stay together on a path in proportion to their similarity. Buckets of up to
LIMIT sets are compared pair by pair; sets that are close to their whole bucket are compared with all of it and leave.
Where that would be many pairs, the bucket's close sets are kept as a group instead, a row for each set. Groups that share
a set are one family, whose sets are all compared with each other on the whole n-grams, block by block, and only links
counted, so that a family of many different near copies costs rows in proportion to its size and not to its square.
Runs are independent: how often the pairs near the threshold were found again gives the chance of one run, and runs are
repeated until that chance means the target recall. Candidates are verified on the whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import textvec as tv
from topicspark.llm.common import fresh, one_row_an_id, table, tiles, whole_groups, write_table
from topicspark.llm.components import components, link_classes

N, THRESHOLD, RECALL = 3, 0.5, 0.95
#: Places of a sketch; how far below the threshold a sketch's estimate may lie.
T, SLACK = 64, 0.12
#: Runs before the chance of one is measured; pairs up to so far above the threshold tell it; runs whose pairs are counted apart.
FIRST_RUNS, NEAR, BITS = 5, 0.1, 6
#: Pairs at the threshold on which a measured chance must rest; with fewer, LEAST_CHANCE stands for it.
LEAST_PAIRS, LEAST_CHANCE = 20, 0.3
#: Sets of a bucket that are compared at once; sets that one task begins with; of one bucket, so many times that; levels that
#: are split across tasks.
LIMIT, TASK_SETS, BUCKET, LEVELS = 32, 4096, 16, 4
#: Pairs of a bucket's close sets from which they are a group; pairs with a group up to which a set stays out of it.
GROUP_PAIRS, FEW = 8192, 8
#: Documents whose whole sets one task holds; candidates up to here are sent to every task, 16 bytes each.
TILE, SENT = 1500, 4_000_000

U64 = np.uint64
_SEEDS = tv.mix(np.arange(1, T + 1, dtype=U64) * U64(tv.MULT)) | U64(1)


def kept_by_sketch(threshold: float = THRESHOLD) -> float:
    """Chance that the sketches of a pair at the threshold agree well enough for it to be verified."""
    least = math.ceil((threshold - SLACK) * T)
    return sum(math.comb(T, k) * threshold**k * (1 - threshold) ** (T - k) for k in range(max(least, 0), T + 1))


def n_runs(chance: float, recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has been found and kept by its sketch with the chance ``recall``."""
    miss = 1 - min(recall / kept_by_sketch(threshold), 0.9999)
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(max(chance, 1e-3), 0.999))))


def run_chance(times: dict[int, int], runs: int) -> float:
    """The chance of one run by how many pairs were found in 1, 2, ... of ``runs`` runs: the likeliest value, given that
    pairs found in none are not seen."""
    pairs = sum(times.values())
    if pairs < LEAST_PAIRS:
        return LEAST_CHANCE
    mean = sum(k * n for k, n in times.items()) / pairs
    lo, hi = 1e-6, 1 - 1e-6
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if runs * mid / (1 - (1 - mid) ** runs) < mean else (lo, mid)
    return lo


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of words of each text, ordered by both; a shorter text is one n-gram."""
    w = tv.words(data, offsets)
    h, row = w.hashes(), w.row
    size = len(h)
    whole = np.diff(w.first) >= n
    gram = h * U64(0x9E3779B97F4A7C15)
    last = np.zeros(size, dtype=bool)
    for j in range(1, n):
        same = np.zeros(size, dtype=bool)
        same[: size - j] = row[: size - j] == row[j:]
        gram = gram * U64(0xC2B2AE3D27D4EB4F)
        gram[same] += h[np.flatnonzero(same) + j]
        last = same
    begins = np.zeros(size, dtype=bool)
    begins[w.first[:-1][np.diff(w.first) > 0]] = True
    keep = (last & whole[row]) | (begins & ~whole[row]) if n > 1 else np.ones(size, dtype=bool)
    row, gram = row[keep], tv.mix(gram[keep])
    # rows of a chunk are few: their number and 44 bits of the hash make one key
    bits = max(20, int(len(offsets)).bit_length())
    key = np.unique((row.astype(U64) << U64(64 - bits)) | (gram >> U64(bits)))
    return (key >> U64(64 - bits)).astype(np.int64), key << U64(bits)


def sketches(row: np.ndarray, gram: np.ndarray, n_rows: int) -> np.ndarray:
    """T min-hash values of 32 bits for each row; rows without n-grams are 0."""
    out = np.zeros((n_rows, T), dtype=np.uint32)
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        gram = tv.mix(gram)
        for i, seed in enumerate(_SEEDS):
            low = np.minimum.reduceat((gram ^ seed) * seed, first)
            out[row[first], i] = tv.mix(low) >> U64(32)
    return out


def sketch_table(docs: DataFrame, n: int = N) -> DataFrame:
    """``doc_id, k1, k2, sketch, more``: k1 and k2 name the set, null for documents without words. Rows without an id are
    left out.

    ``sketch`` has the upper 16 bits of each value, enough to compare two sets and to split a bucket; ``more`` has the
    lower ones, which the first split needs too, or sets would meet by chance once there are more than 16 bits can tell.
    """

    def compute(batches):
        for batch in batches:
            for at, to, data, offsets in tv.chunks(batch.column("text")):
                rows = to - at
                row, gram = shingles(data, offsets, n)
                sk = sketches(row, gram, rows)
                have = np.bincount(row, minlength=rows) > 0
                names = []
                for salt in (U64(1), U64(2)):
                    sums = np.zeros(rows, dtype=U64)
                    if len(row):
                        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                        sums[row[first]] = np.add.reduceat(tv.mix(gram + salt), first)
                    names.append(tv.mix(sums).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, rows), *(pa.array(x, mask=~have) for x in names), _binary((sk >> 16).astype(np.uint16)), _binary(sk.astype(np.uint16))],
                    names=["doc_id", "k1", "k2", "sketch", "more"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(compute, "doc_id bigint, k1 bigint, k2 bigint, sketch binary, more binary")


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    width = raw.itemsize * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def _sketches_of(column: pa.Array) -> np.ndarray:
    _, off, raw = column.buffers()
    off = np.frombuffer(off, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, dtype=np.uint16)[off[0] // 2 : off[-1] // 2].reshape(-1, T)


def _chosen(path: np.ndarray, threshold: float) -> np.ndarray:
    """For each path, which places of the sketch are split on."""
    own, which = np.unique(path, return_inverse=True)
    draw = tv.mix(own[:, None] + _SEEDS) >> U64(11)
    return (draw < U64(int((1 << 53) / (threshold * T))))[which]


def children(path: np.ndarray, sk: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, its path) one level down."""
    which, place = np.nonzero(_chosen(path, threshold))
    value = sk[which, place].astype(U64)
    return which, tv.mix(path[which] * U64(tv.MULT) + tv.mix(_SEEDS[place] + value))


def _compare(a: np.ndarray, b: np.ndarray, sk: np.ndarray, least: float, out: list) -> None:
    for at in range(0, len(a), 1 << 15):
        x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        agree = (sk[x] == sk[y]).sum(axis=1)
        near = agree >= least * T
        out.append((x[near], y[near], agree[near]))


def _all_pairs(first: np.ndarray, size: np.ndarray, order: np.ndarray, sk: np.ndarray, least: float, out: list) -> None:
    for m in np.unique(size):
        if m > 1:
            i, j = np.triu_indices(m, 1)
            starts = first[size == m]
            step = max(1, (1 << 15) // len(i))
            for at in range(0, len(starts), step):
                s = starts[at : at + step, None]
                _compare(order[(s + i).ravel()], order[(s + j).ravel()], sk, least, out)


def _join_group(close: np.ndarray, rest: np.ndarray, sk: np.ndarray, least: float, out: list) -> np.ndarray:
    """The sets of ``rest`` that come near more than FEW of the close ones; the pairs of the others go to ``out``."""
    own, joined = np.ascontiguousarray(sk[close].T), [np.zeros(0, dtype=rest.dtype)]
    step = max(1, (1 << 20) // len(close))
    for at in range(0, len(rest), step):
        some = rest[at : at + step]
        agree = np.zeros((len(some), len(close)), dtype=np.uint8)
        for i in range(T):
            agree += sk[some, i][:, None] == own[i]
        near = agree >= least * T
        many = near.sum(axis=1) > FEW
        joined.append(some[many])
        x, y = np.nonzero(near & ~many[:, None])
        out.append((some[x], close[y], agree[x, y].astype(np.int64)))
    return np.concatenate(joined)


def search(path: np.ndarray, sk: np.ndarray, threshold: float, groups: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets whose sketches come near the threshold, from the buckets named by ``path`` down, and in how many
    places the two agree. If ``groups`` is given, it gets (sets, name) of those whose pairs are to be formed later."""
    least = threshold - SLACK
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    index = np.arange(len(path))
    for _ in range(64):
        order = np.argsort(path, kind="stable")
        name, first, size = np.unique(path[order], return_index=True, return_counts=True)
        small = (size > 1) & (size <= LIMIT)
        _all_pairs(first[small], size[small], index[order], sk, least, out)
        down = []
        for f, m in zip(first[size > LIMIT], size[size > LIMIT]):
            own = index[order[f : f + m]]
            values = sk[own]
            mean = np.zeros(m)
            for i in range(T):
                counts = np.bincount(values[:, i])
                mean += counts[values[:, i]] - 1
            close = mean / (T * (m - 1)) >= 0.9 * threshold
            rest = own[~close]
            if groups is not None and np.count_nonzero(close) ** 2 > GROUP_PAIRS:
                groups.append((np.concatenate((own[close], _join_group(own[close], rest, sk, least, out))), path[order[f]]))
            else:
                for k in np.flatnonzero(close):
                    # a close set meets the close ones after it, and all that aren't
                    others = own[(np.arange(m) > k) | ~close]
                    _compare(np.full(len(others), own[k]), others, sk, least, out)
            if len(rest) > 1:
                down.append((rest, path[order[f : f + m]][~close]))
        if not down:
            break
        own, above = np.concatenate([d[0] for d in down]), np.concatenate([d[1] for d in down])
        which, path = children(above, sk[own], threshold)
        index = own[which]
    else:
        order = np.argsort(path, kind="stable")
        _, first, size = np.unique(path[order], return_index=True, return_counts=True)
        _all_pairs(first, size, index[order], sk, least, out)
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _splitter(threshold: float):
    def split(batches):
        for batch in batches:
            path = np.asarray(batch.column("path")).view(U64)
            sk = _sketches_of(batch.column("sketch"))
            if "more" in batch.schema.names:
                sk = (sk.astype(U64) << U64(16)) | _sketches_of(batch.column("more"))
            run = path & U64((1 << BITS) - 1)
            which, path = children(path, sk, threshold)
            path = (path & ~U64((1 << BITS) - 1)) | run[which]
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("node").take(pa.array(which))], names=["path", "node"])

    return split


PAIR = "a bigint, b bigint, agree int, runs bigint"
#: Stands for the places that agree where a row is a set and its group.
GROUP = -1


def _pairs(node: np.ndarray, path: np.ndarray, a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.Table:
    """Each pair once: the places in which it agrees, and a bit for each run that found it."""
    run = np.int64(1) << (path[a] & U64((1 << BITS) - 1)).astype(np.int64)
    low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
    order = np.lexsort((high, low))
    order = order[low[order] < high[order]]
    low, high, agree, run = low[order], high[order], agree[order], run[order]
    first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(low) else np.zeros(0, np.int64)
    every = np.bitwise_or.reduceat(run, first) if len(low) else run
    return pa.table({"a": low[first], "b": high[first], "agree": agree[first].astype(np.int32), "runs": every})


def candidates(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Of sets (``node, sketch, more``), families (``node, family``), all pairs of which are candidates; and distinct
    ``a, b`` (a < b) of no one family that some run brings together and whose sketches agree.

    After FIRST_RUNS runs, as many are added as the measured chance of one run asks for, and it is measured again, until
    the runs made are enough. Pairs within families need no chance, so they don't count in it.
    """
    made, found = 0, None
    more = FIRST_RUNS
    while more > 0:
        for at in range(made, made + more, 1 << BITS):
            new = some_runs(sets, range(at, min(at + (1 << BITS), made + more)), threshold)
            new = new.withColumn("times", F.bit_count("runs")).select("a", "b", "agree", "times")
            found = new if found is None else found.unionByName(new)
        made += more
        found = write_table(found.groupBy("a", "b").agg(F.max("agree").alias("agree"), F.sum("times").cast("int").alias("times")), "pairs")
        families, apart = _families(found)
        near = apart.where(F.col("agree").between(math.ceil(threshold * T), math.floor((threshold + NEAR) * T)))
        # as many rows as runs
        times = {r["times"]: r["n"] for r in near.groupBy("times").agg(F.count("*").alias("n")).collect()}
        more = n_runs(run_chance(times, made), recall, threshold) - made
    return families, apart.select("a", "b")


def _families(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, family`` of the sets in groups, and the pairs without those inside a family."""
    groups = found.where(F.col("agree") == GROUP).select("a", F.col("b").alias("group"))
    least = groups.groupBy("group").agg(F.min("a").alias("b"))
    families = write_table(components(groups.join(least, "group").select("a", "b")).withColumnRenamed("root", "family"), "families")
    pairs = found.where(F.col("agree") != GROUP)
    if not families.take(1):
        return families, pairs
    for c in ("a", "b"):
        pairs = pairs.join(families.select(F.col("node").alias(c), F.col("family").alias(f"_{c}")), c, "left")
    return families, pairs.where("_a IS NULL OR _b IS NULL OR _a <> _b").select(*found.columns)


def some_runs(sets: DataFrame, runs: range, threshold: float) -> DataFrame:
    """``a, b, agree, runs`` of the pairs that the runs of these numbers find, each once. Rows with GROUP in ``agree`` are
    sets a in groups b."""
    salt = (1 << BITS) - 1
    root = [F.xxhash64(F.lit(f"run {r}")).bitwiseAND(F.lit(~salt)).bitwiseOR(F.lit(r & salt)) for r in runs]
    roots = F.explode(F.array(*root))

    def find(batches):
        for group in whole_groups(batches, "path"):
            path = np.asarray(group.column("path")).view(U64)
            sk = _sketches_of(group.column("sketch").chunk(0))
            node, groups = np.asarray(group.column("node")), []
            yield from _pairs(node, path, *search(path, sk, threshold, groups)).to_batches()
            for own, name in groups:
                b, none = np.full(len(own), name).view(np.int64), np.zeros(len(own), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[own], b, (none + GROUP).astype(np.int32), none)], names=["a", "b", "agree", "runs"])
            tv.give_back()

    total = sets.count()
    found = []
    rows = sets.select("node", roots.alias("path"))
    big = sets.select("node", "sketch", "more", roots.alias("path")) if total > TASK_SETS else None
    level = 0
    while True:
        if level == 0 and big is None:
            small = rows
        else:
            # only ids travel until it is known which buckets have more than one set
            rows = write_table(big.mapInArrow(_splitter(threshold), "path bigint, node bigint"), "paths")
            sizes = rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1")
            rows = write_table(rows.join(sizes, "path"), "buckets")
            small = rows.where(F.col("m") <= TASK_SETS * BUCKET)
        inside = small.select("path", "node").join(sets.select("node", "sketch"), "node").select("path", "node", "sketch")
        found.append(inside.repartition("path").sortWithinPartitions("path").mapInArrow(find, PAIR))
        if big is None:
            break
        large = rows.where(F.col("m") > TASK_SETS * BUCKET).select("path", "node")
        if not large.take(1):
            break
        level += 1
        if level == LEVELS:
            found.append(_tiled(large.join(sets.select("node", "sketch"), "node"), threshold))
            break
        big = large.join(sets, "node").select("node", "sketch", "path")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("a", "b").agg(F.max("agree").alias("agree"), F.bit_or("runs").alias("runs"))


def _tiled(rows: DataFrame, threshold: float) -> DataFrame:
    """All pairs of the buckets that splitting leaves large, block against block."""

    def compare(group):
        node, block = np.asarray(group.column("node")), np.asarray(group.column("block"))
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        sk = _sketches_of(group.column("sketch").combine_chunks())
        left, right, out = np.flatnonzero(block == lo), np.flatnonzero(block == hi), []
        for k in left:
            others = right[node[right] > node[k]] if lo == hi else right
            _compare(np.full(len(others), k), others, sk, threshold - SLACK, out)
        a, b, agree = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return _pairs(node, np.asarray(group.column("path")).view(U64), a, b, agree)

    return tiles(rows, "path", "node", TASK_SETS).groupBy("tile").applyInArrow(compare, PAIR)


def grams_of(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """``tile, node, grams``: the n-grams of the documents in ``places`` (``node, tile``), for each of their tiles."""
    spark = docs.sparkSession
    schema = "tile bigint, node bigint, grams binary"
    texts = docs.select("doc_id", "text")

    def rows_of(batch, node, tile_of, which):
        chosen = batch.column("text").take(pa.array(which))
        for at, to, data, offsets in tv.chunks(chosen):
            row, gram = shingles(data, offsets, n)
            first = np.searchsorted(row, np.arange(to - at + 1))
            raw = [gram[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(tile_of[at:to]), pa.array(node[at:to]), pa.array(raw, pa.binary())], names=["tile", "node", "grams"])

    if places.count() <= SENT:
        got = places.orderBy("node").toPandas()
        sent = spark.sparkContext.broadcast((got["node"].to_numpy(np.int64), got["tile"].to_numpy(np.int64)))

        def pick(batches):
            nodes, tile_of = sent.value
            for batch in batches:
                ids = np.asarray(batch.column("doc_id").fill_null(np.iinfo(np.int64).min)).astype(np.int64)
                lo, hi = np.searchsorted(nodes, ids, "left"), np.searchsorted(nodes, ids, "right")
                which = np.repeat(np.arange(len(ids)), hi - lo)
                at = np.arange(len(which)) + np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo)
                if len(which):
                    yield from rows_of(batch, ids[which], tile_of[at], which)

        return texts.mapInArrow(pick, schema)

    def each(batches):
        for batch in batches:
            yield from rows_of(batch, np.asarray(batch.column("node")), np.asarray(batch.column("tile")), np.arange(batch.num_rows))

    return texts.join(places, F.col("doc_id") == F.col("node")).mapInArrow(each, schema)


def verify(docs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """``a, b, jaccard`` of the pairs whose whole sets reach the threshold.

    Each candidate's text goes once to the task of its component; a component of more than TILE documents is cut into
    blocks, and blocks meet two by two.
    """
    roots = write_table(components(pairs), "roots")
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("g"))
    n_tasks = max(1, math.ceil(roots.count() / TILE))
    blocks = roots.join(sizes, "root")

    def tile(lo, hi):
        return F.when(F.col("g") == 1, F.pmod(F.xxhash64("root"), F.lit(n_tasks))).otherwise(F.xxhash64("root", lo, hi))

    def block(c):
        return F.pmod(F.xxhash64(c), F.col("g"))

    places = blocks.withColumn("_b", block("node")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    places = write_table(places.select("node", tile(F.least("_b", "_j"), F.greatest("_b", "_j")).alias("tile")), "places")
    there = pairs.join(blocks, pairs["a"] == blocks["node"]).withColumn("_x", block("a")).withColumn("_y", block("b"))
    there = there.select("a", "b", tile(F.least("_x", "_y"), F.greatest("_x", "_y")).alias("tile"))
    sets = grams_of(docs, places, n)

    def exact(sets, pairs):
        node = np.asarray(sets.column("node").combine_chunks())
        grams = [np.frombuffer(b, dtype=U64) for b in sets.column("grams").to_pylist()]
        order = np.argsort(node, kind="stable")
        size = np.array([len(g) for g in grams], dtype=np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, U64)
        first = np.concatenate(([0], np.cumsum(size)))
        values, code = np.unique(every, return_inverse=True)
        mark = np.zeros(len(values), dtype=bool)
        a, b = (np.asarray(pairs.column(c).combine_chunks()) for c in ("a", "b"))
        by_a = np.argsort(a, kind="stable")
        a, b = a[by_a], b[by_a]
        ia, ib = (order[np.searchsorted(node[order], x)] for x in (a, b)) if len(order) else (a, b)
        share = np.zeros(len(a))
        begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
        for f, t in zip(begin, [*begin[1:], len(a)]):
            own = code[first[ia[f]] : first[ia[f] + 1]]
            mark[own] = True
            for k in range(f, t):
                both = np.count_nonzero(mark[code[first[ib[k]] : first[ib[k] + 1]]])
                share[k] = both / max(len(own) + size[ib[k]] - both, 1)
            mark[own] = False
        near = share >= threshold
        del every, values, code, mark
        tv.give_back()
        return pa.table({"a": a[near], "b": b[near], "jaccard": share[near]})

    return sets.groupBy("tile").cogroup(there.groupBy("tile")).applyInArrow(exact, "a bigint, b bigint, jaccard double").withColumn("jaccard", F.round("jaccard", 6))


def _shared(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int, code_l: np.ndarray, code_r: np.ndarray) -> np.ndarray:
    """How many values each row of the left shares with each of the right; ``left`` and ``right`` are the rows of the codes.
    Values that many rows have go through a product of matrices, the others pair by pair."""
    size = int(max(code_l.max(initial=-1), code_r.max(initial=-1))) + 1
    in_l, in_r = np.bincount(code_l, minlength=size), np.bincount(code_r, minlength=size)
    out = np.zeros((n_left, n_right), dtype=np.float32)
    cost = in_l * in_r
    heavy = cost > 20_000
    column = np.cumsum(heavy) - 1
    own_l, own_r = heavy[code_l], heavy[code_r]
    for at in range(0, int(heavy.sum()), 1024):
        a, b = np.zeros((n_left, 1024), dtype=np.float32), np.zeros((n_right, 1024), dtype=np.float32)
        for m, row, code, own in ((a, left, code_l, own_l), (b, right, code_r, own_r)):
            k = column[code] - at
            here = own & (k >= 0) & (k < 1024)
            m[row[here], k[here]] = 1
        out += a @ b.T
    light = np.flatnonzero((cost > 0) & ~heavy)
    order_l, order_r = np.argsort(code_l, kind="stable"), np.argsort(code_r, kind="stable")
    first_l, first_r = np.concatenate(([0], np.cumsum(in_l))), np.concatenate(([0], np.cumsum(in_r)))
    upto = np.concatenate(([0], np.cumsum(cost[light])))
    flat, at = out.reshape(-1), 0
    while at < len(light):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 20), "right")) - 1)
        some = light[at:to]
        which = np.repeat(np.arange(len(some)), cost[some])
        k = np.arange(len(which)) - np.repeat(upto[at:to] - upto[at], cost[some])
        c = some[which]
        x, y = left[order_l[first_l[c] + k // in_r[c]]], right[order_r[first_r[c] + k % in_r[c]]]
        np.add.at(flat, x * n_right + y, np.float32(1))
        at = to
    return out


def _lowest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column the smallest node that links connect it with, its own without any."""
    back, low_l, low_r = np.ascontiguousarray(near.T), left.copy(), right.copy()
    new_l, new_r = near.any(axis=1), back.any(axis=1)
    for s in np.flatnonzero(new_l):
        if not new_l[s]:
            continue
        rows, all_rows, all_columns = np.array([s]), [], []
        while len(rows):
            new_l[rows] = False
            columns = np.flatnonzero(near[rows].any(axis=0) & new_r)
            new_r[columns] = False
            all_rows.append(rows)
            all_columns.append(columns)
            rows = np.flatnonzero(back[columns].any(axis=0) & new_l) if len(columns) else columns
        rows, columns = np.concatenate(all_rows), np.concatenate(all_columns)
        low_l[rows] = low_r[columns] = min(left[rows].min(), right[columns].min())
    return low_l, low_r


def verify_families(docs: DataFrame, families: DataFrame, sizes: DataFrame | None, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """All pairs of each family that reach the threshold, as ``a, b, jaccard``. With ``sizes`` (``node, m``) no pair is
    given but, for each tile, ``node, near, low``: how many documents its links there lead to, a node counting m times,
    and the smallest node that they connect it with.

    A family of more than TILE sets is cut into blocks, and blocks meet two by two.
    """
    counted = families.groupBy("family").agg(F.ceil(F.count("*") / TILE).cast("int").alias("g"))
    # bounds the tiles of small families: about TILE sets each
    n_tasks = max(1, math.ceil(families.count() / TILE))
    rows = families.join(counted, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    rows = rows.join(sizes, "node") if sizes is not None else rows.withColumn("m", F.lit(1).cast("bigint"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("lo", F.least("block", "_j")).withColumn("hi", F.greatest("block", "_j"))
    tile = F.when(F.col("g") == 1, F.pmod(F.xxhash64("family"), F.lit(n_tasks))).otherwise(F.xxhash64("family", "lo", "hi"))
    rows = rows.select("node", "family", "block", "lo", "hi", "m", tile.alias("tile"))
    grams = write_table(grams_of(docs, families.select("node", F.lit(0).cast("bigint").alias("tile")), n).select("node", "grams"), "grams")
    as_pairs = sizes is None

    def compare(group):
        family = np.asarray(group.column("family").combine_chunks())
        out = []
        for at in (np.flatnonzero(family == f) for f in np.unique(family)):
            own = group.take(pa.array(at)).combine_chunks()
            node, block, m = (np.asarray(own.column(c).combine_chunks()) for c in ("node", "block", "m"))
            lo, hi = own.column("lo")[0].as_py(), own.column("hi")[0].as_py()
            raw = [np.frombuffer(x, dtype=U64) for x in own.column("grams").to_pylist()]
            size = np.array([len(x) for x in raw], dtype=np.int64)
            code = np.unique(np.concatenate(raw), return_inverse=True)[1]
            row = np.repeat(np.arange(len(node)), size)
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            if not len(left) or not len(right):
                continue
            place = np.zeros(len(node), dtype=np.int64)
            place[left], place[right] = np.arange(len(left)), np.arange(len(right))
            is_l, is_r = (block == lo)[row], (block == hi)[row]
            both = _shared(place[row[is_l]], place[row[is_r]], len(left), len(right), code[is_l], code[is_r])
            near = np.zeros(both.shape, dtype=bool)
            for k in range(0, len(left), 256):
                x = both[k : k + 256].astype(np.float64)
                near[k : k + 256] = x / (size[left[k : k + 256], None] + size[right][None, :] - x) >= threshold
            if lo == hi:
                near[np.arange(len(left)), np.arange(len(left))] = False
            if as_pairs:
                x, y = np.nonzero(np.triu(near) if lo == hi else near)
                a, b = node[left[x]], node[right[y]]
                share = both[x, y].astype(np.float64)
                out.append(pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "jaccard": share / (size[left[x]] + size[right[y]] - share)}))
                continue
            low_l, low_r = _lowest(near, node[left], node[right])
            sides = [(left, near, m[right], low_l)] + ([(right, near.T, m[left], low_r)] if lo != hi else [])
            for side, there, weight, low in sides:
                count = np.array([weight[x].sum() for x in there], dtype=np.int64)
                has = count > 0
                out.append(pa.table({"node": node[side[has]], "near": count[has], "low": low[has]}))
        tv.give_back()
        names = ("a", "b", "jaccard") if as_pairs else ("node", "near", "low")
        kinds = (pa.int64(), pa.int64(), pa.float64() if as_pairs else pa.int64())
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})

    schema = "a bigint, b bigint, jaccard double" if as_pairs else "node bigint, near bigint, low bigint"
    return rows.join(grams, "node").groupBy("tile").applyInArrow(compare, schema)


def similar_sets(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, node`` of every document with an id: the smallest id with the same set stands for it (its own without words);
    ``a, b, jaccard`` of the pairs of those whose sets are similar, without pairs inside families; and ``node, family``,
    for verify_families(). All are written to the shared folder."""
    sketched = write_table(sketch_table(docs, n), "sketches")
    named = sketched.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.first("more").alias("more"))
    sets = write_table(named, "sets")
    members = sketched.select("k1", "k2", "doc_id").join(sets.select("k1", "k2", "node"), ["k1", "k2"], "left")
    members = write_table(members.select(F.col("doc_id").alias("id"), F.coalesce("node", "doc_id").alias("node")), "members")
    families, pairs = candidates(sets, threshold, recall)
    return members, write_table(verify(docs, pairs, threshold, n), "similar"), families


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """``left_id, right_id, jaccard``: pairs of documents whose sets of word n-grams have at least this Jaccard similarity.

    Documents with one and the same set are tied to the smallest of their ids, with similarity 1; that one stands for
    them in the other pairs, which hold for each of them alike (components.all_pairs gives them all). Ids are integers.
    Texts of fewer than n words are a single n-gram; texts of any length count whole. Null, empty and wordless texts,
    and rows without an id, pair with nothing. Of several rows with one id the one with the smallest text counts, null
    last. A tie at the threshold is a pair. An empty table gives no rows. Other columns are ignored.
    """
    docs = one_row_an_id(docs.select("doc_id", "text"), "doc_id")
    members, near, families = similar_sets(docs, threshold, n, recall)
    if families.take(1):
        near = near.unionByName(write_table(verify_families(docs, families, None, threshold, n).withColumn("jaccard", F.round("jaccard", 6)), "similar"))
    copies = members.where("id <> node").select(F.col("node").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("jaccard"))
    return near.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "jaccard").unionByName(copies)


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links``, a row for each id: the smallest id among the documents that similar pairs connect it
    with, its own if there are none, and how many other documents it is similar to, copies counted one by one.

    The pairs are those of join_similar, with the same treatment of nulls, short texts and repeated ids.
    """
    docs = one_row_an_id(docs.select("doc_id", "text"), "doc_id")
    members, near, families = similar_sets(docs, threshold, n, recall)
    sizes = write_table(members.groupBy("node").agg(F.count("*").alias("m")), "sizes")
    inside = write_table(verify_families(docs, families, sizes, threshold, n), "inside") if families.take(1) else None
    return link_classes(members, near, sizes, inside).withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_\\x{{80}}-\\x{{10ffff}}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {N - 1}], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {N - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE p.c >= {THRESHOLD} * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT c.a AS doc_id, c.class_id, coalesce(l.n, 0) AS n_links FROM (SELECT a, min(b) AS class_id FROM r GROUP BY 1) c LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) l USING (a)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the copies: of each class of similar ones, the one with the smallest id stays.

    Of several rows with one id the one with the smallest text stays, null last. Rows without an id, and null, empty and
    wordless texts, are no copies and stay. Texts of any length count whole. An empty table gives no rows. All columns
    are kept, whatever their names.
    """
    docs = one_row_an_id(docs, "doc_id")
    classes = similar_classes(docs)
    gone = write_table(classes.where("doc_id <> class_id").select(F.col("doc_id").alias(fresh("gone_id", docs.columns))), "gone")
    name = gone.columns[0]
    if gone.count() > SENT:
        return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    ids = np.sort(gone.toPandas()[name].to_numpy(np.int64))
    sent = spark.sparkContext.broadcast(ids)

    def keep(batches):
        for batch in batches:
            own = np.asarray(batch.column("doc_id").fill_null(np.iinfo(np.int64).min)).astype(np.int64)
            at = np.minimum(np.searchsorted(sent.value, own), max(len(sent.value) - 1, 0))
            there = sent.value[at] == own if len(sent.value) else np.zeros(len(own), dtype=bool)
            yield batch.filter(pa.array(~there))

    return docs.mapInArrow(keep, docs.schema)
