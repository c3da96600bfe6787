"""Topics of parts of documents: windows of tokens against the topics' weights, summed up for documents or tokens.

A window's vector is count x idf, so its product with a topic is a sum over its tokens of what each token gives to the
topic, and windows need no vectors of their own: running sums over the tokens are enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topicspark.functions import text as tx
from topicspark.functions import vectors as vx
from topicspark.functions.batches import pieces, words_of
from topicspark.operators.embed import Embedder
from topicspark.sources.shared import written

#: Numbers (words x topics) that are sent to every task, 8 bytes each; of a larger table each block of texts gets its words'.
SENT_NUMBERS = 1_000_000
#: Bytes of text of a block, tokens whose windows are computed at once, and numbers (words or documents x topics) held.
BLOCK_BYTES, SLICE, HELD_NUMBERS = 2 << 20, 1 << 16, 1 << 23


def windows_of(sizes: np.ndarray, window: int, stride: int, padding: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end token of each window, and the number of windows of each text, of texts of so many tokens that follow each
    other. A text within one window is one window. With ``padding`` windows also hang over both ends of a text."""
    over = sizes + window - 2 if padding else np.maximum(sizes - window, 0)
    n = np.where(sizes > 0, over // stride + 1, 0)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride + (1 - window if padding else 0)
    start = np.repeat(np.cumsum(sizes) - sizes, n)
    return start + np.maximum(first, 0), start + np.minimum(first + window, np.repeat(sizes, n)), n


def token_windows(docs: DataFrame, window: int = 4, stride: int = 1, topic: str = "topic", english: bool = True) -> DataFrame:
    """``doc_id, window, tokens``: the windows of each document as text, in JVM expressions."""
    w = docs.select("doc_id", tx.words(F.col("text"), english).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(stride))
    rows = w.select("doc_id", "w", F.posexplode(starts).alias("window", "first"))
    return rows.select("doc_id", "window", F.array_join(F.slice("w", F.col("first") + 1, window), " ").alias("tokens"))


def shares(words: np.ndarray, gains: np.ndarray, idf: np.ndarray, window: int, stride: int, padding: bool, least: float, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, similarity of each window to each topic) of one document, or of several of ``sizes`` tokens, values under
    ``least`` as 0. ``words`` are codes, -1 for unknown; ``gains`` has a row for each token: idf x weight / length of the topic."""
    sizes = np.array([len(words)]) if sizes is None else sizes
    first, end, _ = windows_of(sizes, window, stride, padding)
    if not len(first):
        return first, end, np.zeros((0, gains.shape[1]))
    own = np.concatenate((np.zeros((1, gains.shape[1])), np.cumsum(gains, axis=0)))
    products = own[end] - own[first]
    # squared length: every pair of equal tokens in the window, at each distance
    square = np.concatenate(([0.0], np.cumsum(idf * idf)))
    total = square[end] - square[first]
    for k in range(1, min(window, int(sizes.max()))):
        same = np.flatnonzero((words[k:] == words[:-k]) & (words[k:] >= 0))
        if len(same):
            both = np.zeros(len(words) - k + 1)
            both[same + 1] = idf[same + k] * idf[same]
            upto = np.cumsum(both)
            inside = end - k > first
            total[inside] += 2 * (upto[end[inside] - k] - upto[first[inside]])
    length = np.sqrt(np.maximum(total, 0))
    s = np.divide(products, length[:, None], out=np.zeros_like(products), where=length[:, None] > 1e-12)
    s[s < least] = 0
    return first, end, s


def whole_shares(sizes: np.ndarray, codes: np.ndarray, gains: np.ndarray, idf: np.ndarray, least: float) -> np.ndarray:
    """Similarities of documents of ``sizes`` tokens as a whole to each topic; ``gains`` and ``idf`` have a row for each code."""
    pair, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(idf) + codes, return_counts=True)
    doc, code = np.divmod(pair, len(idf))
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    s = np.zeros((len(sizes), gains.shape[1]))
    if len(start):
        length = np.sqrt(np.add.reduceat((n * idf[code]) ** 2, start))[:, None]
        products = np.add.reduceat(n[:, None] * gains[code], start)
        s[doc[start]] = np.divide(products, length, out=np.zeros_like(products), where=length > 1e-12)
    s[s < least] = 0
    return s


def _gains(weighted: DataFrame, idf: DataFrame) -> tuple[DataFrame, dict]:
    """``word, idf, topics, weights``, written: of each word, the topics but -1 that have it and its weights there. And the
    length of each topic that has any."""
    own = weighted.where("topic IS NOT NULL AND cast(topic as string) <> '-1'").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("topic", "weight"))).alias("own"))
    each = idf.select("word", "idf").join(own, "word", "left")
    gains = written(each.select("word", "idf", F.transform("own", lambda t: t["topic"]).alias("topics"), F.transform("own", lambda t: t["weight"]).alias("weights")), "gains")
    long = gains.select(F.explode(F.arrays_zip("topics", "weights")).alias("r")).groupBy("r.topics").agg(F.sqrt(F.sum(F.col("r.weights") * F.col("r.weights"))).alias("length"))
    return gains, {r[0]: r[1] for r in long.where("length > 0").collect()}


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a column of lists; null counts as empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), lists.flatten()


def _blocks(texts: DataFrame, rows: int) -> DataFrame:
    """``block, docs, sizes, words, codes``, written: the texts block by block, as codes of the block's distinct words."""
    kept = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(texts.schema["doc_id"].dataType)), *T.StructType.fromDDL("sizes array<int>, words array<string>, codes binary").fields])

    def cut(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, 1, BLOCK_BYTES, rows):
                sizes, words = words_of(piece.column(1))
                some = sizes > 0
                if some.any():
                    codes = np.asarray(words.indices).astype(np.uint16 if len(words.dictionary) <= 1 << 16 else np.uint32)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (piece.column(0).filter(pa.array(some)), pa.array(sizes[some], pa.int32()), words.dictionary)]
                    yield pa.RecordBatch.from_arrays([pa.array([at]), *lists, pa.array([codes.tobytes()])], names=kept.names)
                    at += 1

    return written(texts.mapInArrow(cut, kept), "blocks")


def embedded_distribution(
    docs: DataFrame, topic_vectors: DataFrame, embedder: Embedder, window: int = 4, stride: int = 1, min_similarity: float = 0.1, english: bool = True,
) -> DataFrame:
    """``doc_id, topic, weight`` of sum 1 a document, by the cosines of the vectors of its windows' texts with those of the
    topics but -1; cosines under ``min_similarity`` count as 0. Each distinct window is embedded once."""
    names, x = vx.matrix(topic_vectors.where("topic <> -1"), "topic", "embedding")
    rows = token_windows(docs, window, stride, english=english)
    each = rows.select("tokens").distinct().select(F.col("tokens").alias("doc_id"), F.col("tokens").alias("text"))
    near = vx.similarities(embedder.embed(each), "doc_id", "embedding", x).withColumnRenamed("doc_id", "tokens")
    topics = docs.sparkSession.createDataFrame([(i, int(t)) for i, t in enumerate(names)], "place int, topic int")
    long = rows.join(near, "tokens").select("doc_id", F.posexplode("similarities").alias("place", "s")).where(F.col("s") >= min_similarity)
    sums = long.groupBy("doc_id", "place").agg(F.sum("s").alias("s"))
    total = sums.groupBy("doc_id").agg(F.sum("s").alias("total"))
    return sums.join(total, "doc_id").where("total > 0").join(F.broadcast(topics), "place").select("doc_id", "topic", (F.col("s") / F.col("total")).alias("weight"))


def approximate_distribution(
    docs: DataFrame, weighted: DataFrame, idf: DataFrame, window: int | None = 4, stride: int = 1, min_similarity: float = 0.1, padding: bool = False,
    by_token: bool = False, english: bool = True,
) -> DataFrame:
    """``doc_id, topic, weight`` of every document and topic with a weight (of sum 1 a document), or, ``by_token``,
    ``doc_id, pos, token, topic, weight``: the sum over the windows that hold the token. Without ``window`` a document is
    one window as a whole, and its weights are the similarities as they are.

    Similarities under ``min_similarity`` count as 0. Documents without words or similar windows have no rows. While words
    x topics fit in SENT_NUMBERS the table goes to every task; beyond, the texts are cut into blocks, which are joined to
    the table by their distinct words and not by each token. The texts aren't shuffled, and a block is computed as a whole.
    """
    spark = docs.sparkSession
    kind = weighted.schema["topic"].dataType
    # words x topics numbers at most, computed once
    gains, length = _gains(weighted, idf)
    topics = sorted(length)
    lengths = np.array([length[t] for t in topics])
    texts = docs.select("doc_id", (F.col("text") if english else tx.words(F.col("text"), False)).alias("w"))
    place = T.StructField("topic", kind), T.StructField("weight", T.DoubleType())
    schema = T.StructType([texts.schema["doc_id"], *(T.StructType.fromDDL("pos int, token string").fields if by_token else ()), *place])
    # documents x topics are held by the block
    most = max(1, HELD_NUMBERS // max(len(topics), 1))

    def given(names: pa.Array, ids: pa.Array, words: pa.Array, sizes: np.ndarray, codes: np.ndarray, each: np.ndarray, dense: Callable[[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The rows of documents of ``sizes`` tokens; ``each`` is the idf of the words, 0 if unknown, ``dense`` gives columns
        of the words' gains."""
        edges = np.concatenate(([0], np.cumsum(sizes)))
        totals = None if by_token else np.zeros((len(sizes), len(topics)))
        width = max(1, HELD_NUMBERS // max(len(each), SLICE))
        for low in range(0, len(topics), width):
            high = min(low + width, len(topics))
            table, a = dense(low, high), 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + SLICE, side="right")) - 1)
                own = codes[edges[a] : edges[b]]
                if window is None:
                    totals[a:b, low:high] = whole_shares(sizes[a:b], own, table, each, min_similarity)
                    a = b
                    continue
                first, end, s = shares(own, table[own], each[own], window, stride, padding, min_similarity, sizes[a:b])
                upto = np.concatenate((np.zeros((1, high - low)), np.cumsum(s, axis=0)))
                if by_token:
                    # the windows that have begun by the token, without those that have ended
                    at = np.arange(len(own))
                    sums = upto[np.searchsorted(first, at, side="right")] - upto[np.searchsorted(end, at, side="right")]
                    p, t = np.nonzero(sums > 1e-9)
                    doc = np.repeat(np.arange(a, b), sizes[a:b])[p]
                    columns = [ids.take(pa.array(doc)), pa.array(p + edges[a] - edges[doc], pa.int32()), words.take(pa.array(own[p])), names.take(pa.array(t + low)), pa.array(sums[p, t])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                else:
                    n = windows_of(sizes[a:b], window, stride, padding)[2]
                    last = np.cumsum(n)
                    totals[a:b, low:high] = upto[last] - upto[last - n]
                a = b
        if not by_token:
            whole = totals.sum(axis=1) if window is not None else np.ones(len(sizes))
            doc, t = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), names.take(pa.array(t)), pa.array(totals[doc, t] / whole[doc])], names=schema.names)

    def columns(n: int, rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> Callable[[int, int], np.ndarray]:
        """Columns of a table of ``n`` rows, given by its numbers."""

        def dense(low: int, high: int) -> np.ndarray:
            table = np.zeros((n, high - low))
            own = (places >= low) & (places < high)
            table[rows[own], places[own] - low] = values[own]
            return table

        return dense

    def placed(lists: pa.Array, weights: pa.Array, each: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the topic, idf x weight / length of the topic) from lists of topics and weights."""
        rows, flat = _flat(lists)
        places = np.asarray(pc.fill_null(pc.index_in(flat, value_set=names), -1))
        some = places >= 0
        return rows[some], places[some], np.asarray(_flat(weights)[1])[some] * each[rows[some]] / lengths[places[some]]

    arrow_kind = {"int": pa.int32(), "bigint": pa.int64()}.get(kind.simpleString(), pa.string())
    if gains.count() * max(len(topics), 1) <= SENT_NUMBERS:
        got = gains.toArrow()
        idfs = np.append(got.column("idf").to_numpy(), 0.0)
        sent = spark.sparkContext.broadcast((got.column("word").combine_chunks(), idfs, placed(got.column("topics"), got.column("weights"), idfs, pa.array(topics, arrow_kind))))

        def compute(batches):
            known, each, (rows, places, values) = sent.value
            names = pa.array(topics, arrow_kind)
            table = columns(len(each), rows, places, values)(0, len(topics))
            vocabulary = dict(zip(known.to_pylist(), range(len(known))))
            for batch in batches:
                for piece in pieces(batch, 1, rows=most):
                    sizes, words = words_of(piece.column(1))
                    of = np.array([vocabulary.get(w, -1) for w in words.dictionary.to_pylist()], dtype=np.int64)
                    own = table[of]
                    yield from given(names, piece.column(0), words.dictionary, sizes, np.asarray(words.indices), each[of], lambda low, high: own[:, low:high])

        return texts.mapInArrow(compute, schema)

    blocks = _blocks(texts, most)
    found = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("code", "word")).join(gains, "word").select("of", "code", "idf", "topics", "weights")

    def compute_block(left: pa.Table, right: pa.Table) -> pa.Table:
        names, out = pa.array(topics, arrow_kind), []
        if left.num_rows:
            ids, sizes, words, codes = (left.column(c).combine_chunks() for c in ("docs", "sizes", "words", "codes"))
            words = words.flatten()
            n, code = len(words), right.column("code").to_numpy()
            each = np.zeros(n)
            each[code] = right.column("idf").to_numpy()
            rows, places, values = placed(right.column("topics"), right.column("weights"), each[code], names)
            codes = np.frombuffer(codes[0].as_buffer(), np.uint16 if n <= 1 << 16 else np.uint32).astype(np.int64)
            out = list(given(names, ids.flatten(), words, np.asarray(sizes.flatten()).astype(np.int64), codes, each, columns(n, code[rows], places, values)))
        return pa.Table.from_batches(out) if out else pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, to_arrow_schema(schema).types)})

    return blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(compute_block, schema)
