"""Best-fit packing by exact complements, planned on the histogram of lengths in tokens of the BPE vocabulary."""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.llm import bpe
from topicspark.llm import textvec as tv
from topicspark.llm.common import table, whole_groups, write_table

CAPACITY = 2048
#: Tokens of the pieces of one length that are numbered in one task, about.
PART_TOKENS = 16_000_000
#: Bytes of text that are encoded at once, and where memory is scarcer than time: learning new pieces takes several hundred
#: times that for the moment.
CHUNK_BYTES, SMALL_CHUNK = 1 << 19, 1 << 18


def complement(count: np.ndarray, gap: int, pairs: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths whose sum is ``gap``, the longest first; ``pairs`` marks possible pair sums."""
    if gap < 1:
        return None
    if count[gap]:
        return (gap,)
    a = np.arange(gap - 1, (gap - 1) // 2, -1)
    fits = a[(count[a] > 0) & (count[gap - a] > np.where(2 * a == gap, 1, 0))]
    if len(fits):
        return (int(fits[0]), int(gap - fits[0]))
    for a in np.arange(gap - 2, (gap + 2) // 3 - 1, -1):
        # a is the longest of the three
        if not count[a] or not pairs[gap - a]:
            continue
        rest = gap - a
        b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
        c = rest - b
        need_b, need_c = 1 + (b == a) + (b == c), 1 + (c == a) + (c == b)
        fits = np.flatnonzero((count[b] >= need_b) & (count[c] >= need_c))
        if len(fits):
            return (int(a), int(b[fits[0]]), int(c[fits[0]]))
    return None


def pair_sums(count: np.ndarray) -> np.ndarray:
    """Which sums two available lengths can have; lengths used up later leave marks, which the search sees through."""
    there = (count > 0).astype(float)
    n = 1 << (2 * len(there)).bit_length()
    spectrum = np.fft.rfft(there, n)
    return np.fft.irfft(spectrum * spectrum, n)[: len(there)] > 0.5


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, how many such bins). Depends on the lengths that occur, at most ``capacity``, not on the rows.

    From the longest length down, bins are filled exactly by a complement of one, two or three lengths, in as many
    copies as the counts allow. What has no complement is packed best-fit decreasing.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] = n
    bins: list[tuple[tuple[int, ...], int]] = []
    if count[capacity]:
        bins.append(((capacity,), int(count[capacity])))
        count[capacity] = 0
    left: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        pairs = pair_sums(count) if count[length] else None
        while count[length]:
            count[length] -= 1
            others = complement(count, capacity - length, pairs)
            count[length] += 1
            if others is None:
                left.append((length, int(count[length])))
                count[length] = 0
                break
            pattern = (length, *others)
            times = min(int(count[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                count[x] -= times
            bins.append((pattern, times))
    return bins + best_fit(left, capacity)


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, count), longest first; equal bins are kept as one with a multiplicity."""
    gaps: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap].append((pattern, times))

    for length, n in items:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            gap = gaps[at]
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(at)
            used = min(times, n)
            if times > used:
                put(pattern, times - used)
            put((*pattern, length), used)
            n -= used
    return [x for same in open_.values() for x in same]


def segments(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks at which a run of places begins, the bin of the first place of each run, and where in
    their bins the places of the run begin."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    upto: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, times in bins:
        at = 0
        for length in pattern:
            runs[length].append((upto[length], base, at))
            upto[length] += times
            at += length
        base += times
    return {k: tuple(np.array(x) for x in zip(*v)) for k, v in runs.items()}


def _kind(n_tokens: int) -> type:
    return np.uint16 if n_tokens <= 1 << 16 else np.uint32


def pieces_table(docs: DataFrame, key: str, text: str, capacity: int, path: str, with_tokens: bool, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``uid, doc_id, piece, first_token, n_tokens`` and, if asked for, ``raw``: the tokens as numbers of 16 or 32 bits,
    compressed piece by piece, as they are shuffled twice. Written to the shared folder, so that ``uid`` stays."""
    v = bpe.vocabulary(path)
    kind = _kind(len(v.tokens))
    sent = docs.sparkSession.sparkContext.broadcast(v)
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("uid"))

    def cut(batches):
        encoder, codec = bpe.encoder_of(sent.value, path, bpe.PATTERN), pa.Codec("zstd", 1)
        for batch in batches:
            for at, to, data, offsets in tv.chunks(batch.column("text"), chunk):
                tokens, edge = encoder.encode_bytes(data, offsets)
                n = np.diff(edge)
                k = np.maximum(-(-n // capacity), 1)
                doc = np.repeat(np.arange(to - at), k)
                piece = bpe.spread(np.zeros(to - at, np.int64), k)
                first = piece * capacity
                begin = np.append(edge[doc] + first, len(tokens))
                columns = [batch.column("uid").slice(at, to - at).take(pa.array(doc)), batch.column("doc_id").slice(at, to - at).take(pa.array(doc))]
                columns += [pa.array(piece.astype(np.int32)), pa.array(first), pa.array(np.diff(begin).astype(np.int32))]
                if with_tokens:
                    raw = tokens.astype(kind)
                    columns.append(pa.array([codec.compress(raw[a:b], asbytes=True) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "piece", "first_token", "n_tokens", "raw"][: len(columns)])

    schema = f"uid bigint, doc_id {dict(own.dtypes)['doc_id']}, piece int, first_token bigint, n_tokens int" + (", raw binary" if with_tokens else "")
    return write_table(own.mapInArrow(cut, schema), "pieces")


def placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with tokens, without ``uid``, with ``bin_id`` and ``bin_start``: their bin and their place in it."""
    spark = pieces.sparkSession
    some = pieces.where("n_tokens > 0")
    # capacity rows at most, here and broadcast
    histogram = {int(r["n_tokens"]): int(r["c"]) for r in some.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}
    parts = {k: -(-c * k // PART_TOKENS) for k, c in histogram.items()}
    # made of a list it would go through Python on the executors, in workers of another kind that stay there
    table_of_parts = spark.createDataFrame(pa.table({"length": pa.array(list(parts), pa.int32()), "parts": pa.array(list(parts.values()), pa.int32())}))
    some = some.join(F.broadcast(table_of_parts), F.col("n_tokens") == F.col("length")).withColumn("part", F.pmod(F.xxhash64("uid", "piece"), F.col("parts")).cast("int"))
    # a row for each PART_TOKENS tokens and each length
    cells = some.groupBy("n_tokens", "part").agg(F.count("*").alias("c")).toPandas().sort_values(["n_tokens", "part"])
    cells["c"] = cells["c"].astype("int64")
    base, total = np.zeros(capacity + 2, dtype=np.int64), 0
    for k in sorted(parts):
        base[k], total = total, total + parts[k]
    since = np.zeros(total, dtype=np.int64)
    since[base[cells["n_tokens"].astype(int)] + cells["part"].astype(int)] = cells.groupby("n_tokens")["c"].cumsum() - cells["c"]
    sent = spark.sparkContext.broadcast((segments(plan(histogram, capacity)), base, since))
    carried = [c for c in pieces.columns if c != "uid"]
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("n_tokens", "part").orderBy("uid", "piece"))).select(*carried, "part", "rank")

    def place(batches):
        places, base, since = sent.value
        for batch in batches:
            n = np.asarray(batch.column("n_tokens"))
            rank = np.asarray(batch.column("rank")).astype(np.int64) - 1 + since[base[n] + np.asarray(batch.column("part"))]
            out, start = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int32)
            order = np.argsort(n, kind="stable")
            lengths, at = np.unique(n[order], return_index=True)
            for length, rows in zip(lengths.tolist(), np.split(order, at[1:])):
                begin, first, inside = places[length]
                k = np.searchsorted(begin, rank[rows], "right") - 1
                out[rows] = first[k] + rank[rows] - begin[k]
                start[rows] = inside[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(out), pa.array(start)], names=[*carried, "bin_id", "bin_start"])

    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", bin_id bigint, bin_start int")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = bpe.VOCABULARY) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, bin_id, bin_start``: every token of every document is in one bin of
    ``capacity`` tokens, at a place of its own.

    Tokens are those of op3, whole texts of any length. A longer document is cut into full pieces and a rest. A null or
    empty text is one piece of 0 tokens with a null bin. Repeated rows are packed once each. Which of the pieces of equal
    length takes which place is settled by a hash; all such choices are equally good. Keys may be of any type, or null.
    An empty table gives no rows. Other columns are ignored.
    """
    pieces = pieces_table(docs, key, text, capacity, path, False)
    none = pieces.where("n_tokens = 0").drop("uid").withColumn("bin_id", F.lit(None).cast("bigint")).withColumn("bin_start", F.lit(None).cast("int"))
    return placed(pieces, capacity).unionByName(none)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = bpe.VOCABULARY, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``bin_id, n_tokens, tokens, doc_ids, first_tokens, lengths``, a row for each training sequence: the tokens of its
    pieces one after the other, and of each piece the document, its first token there and its length.

    Packed as by pack(); documents without a token are in no sequence. ``chunk``: bytes of text that are encoded at once.
    """
    pieces = pieces_table(docs, key, text, capacity, path, True, chunk)
    kind = _kind(len(bpe.vocabulary(path).tokens))
    own = placed(pieces, capacity).drop("piece")
    own = own.repartition("bin_id").sortWithinPartitions("bin_id", "bin_start")

    def join(batches):
        codec, width = pa.Codec("zstd"), np.dtype(kind).itemsize
        for rows in whole_groups(batches, "bin_id", 4_000):
            bins = np.asarray(rows.column("bin_id").combine_chunks())
            first = np.append(np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1]))), len(bins))
            lengths = np.asarray(rows.column("n_tokens").combine_chunks()).astype(np.int64)
            edge = np.concatenate(([0], np.cumsum(lengths)))[first]
            raw = [codec.decompress(x, n * width, asbytes=True) for x, n in zip(rows.column("raw").to_pylist(), lengths.tolist())]
            tokens = np.frombuffer(b"".join(raw), dtype=kind).astype(np.int32)
            at = pa.array(first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, rows.column(c).combine_chunks()) for c in ("doc_id", "first_token", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bins[first[:-1]]), pa.array(np.diff(edge).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(tokens)), *lists],
                names=["bin_id", "n_tokens", "tokens", "doc_ids", "first_tokens", "lengths"],
            )

    schema = f"bin_id bigint, n_tokens int, tokens array<int>, doc_ids array<{dict(pieces.dtypes)['doc_id']}>, first_tokens array<bigint>, lengths array<int>"
    return own.mapInArrow(join, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences of all the documents, as sequences() gives them."""
    return sequences(docs, chunk=SMALL_CHUNK)
