"""Words of whole Arrow batches: texts are cut and counted as arrays of bytes and codes, without an object for each word.

The words are those of text.words in English mode, in which all that is left are ASCII letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.functions import text as tx

#: Bytes of text that are worked through at once, some twenty times as many are held; counts that a task holds.
PIECE_BYTES, HELD_ROWS = 8 << 20, 1 << 20
GONE, SPACE = 1, 32
TABLE = bytes(x if chr(x) in "abcdefghijklmnopqrstuvwxyz0123456789" else x + 32 if 65 <= x <= 90 else SPACE if chr(x) in " \n\t" else GONE for x in range(256))


def pieces(batch: pa.RecordBatch, column: int, most: int = 0, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of ``most`` bytes of text (or 8 bytes for each word of a list) and so many ``rows`` at most, but of one row at least."""
    own = batch.column(column)
    size = pc.multiply(pc.list_value_length(own), 8) if pa.types.is_list(own.type) else pc.binary_length(own)
    upto = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(size, 0)), dtype=np.int64)))
    at = 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(upto, upto[at] + (most or PIECE_BYTES), side="right")) - 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(number of words of each text, words of all of them in order). A column of lists is taken as words; null is empty."""
    if pa.types.is_list(texts.type):
        return np.asarray(pc.fill_null(pc.list_value_length(texts), 0)).astype(np.int64), texts.flatten().cast(pa.string()).dictionary_encode()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.string()).dictionary_encode()
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = data[int(edges[0]) : int(edges[-1])].to_pybytes() if data is not None else b""
    edges = edges.astype(np.int64) - int(edges[0])
    raw = np.frombuffer(data.translate(TABLE), np.uint8)
    gone = np.flatnonzero(raw == GONE)
    if len(gone):
        edges = edges - np.searchsorted(gone, edges)
        raw = raw[raw != GONE]
    inside = raw != SPACE
    # a text's first letter begins a word and its last one ends it, whatever the neighbouring text has there
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    for marks, at in ((begins, edges[:-1][edges[:-1] < len(raw)]), (ends, edges[1:][edges[1:] > 0] - 1)):
        marks[at] = inside[at]
    first = np.flatnonzero(begins)
    size = np.flatnonzero(ends) - first + 1
    short = size < 2
    inside[first[short]] = False
    first, size = first[~short], size[~short]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    return np.diff(np.searchsorted(first, edges)), words.dictionary_encode()


def without(sizes: np.ndarray, words: pa.DictionaryArray, stop_words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, their codes) without the stop words."""
    codes = np.asarray(words.indices)
    if not len(stop_words):
        return sizes, codes
    keep = ~np.asarray(pc.is_in(words.dictionary, value_set=stop_words))[codes]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes)), codes[keep]


def _counted(piece: pa.RecordBatch, stop_words: pa.Array, low: int, high: int) -> Iterator[pa.Table]:
    """Counts of the n-grams within the texts, which are the last column, by the columns before it."""
    keys = piece.columns[:-1]
    group = np.zeros(piece.num_rows, np.int64)
    for k in keys:
        coded = k.dictionary_encode(null_encoding="encode")
        _, group = np.unique(group * max(len(coded.dictionary), 1) + np.asarray(coded.indices), return_inverse=True)
    _, row, group = np.unique(group, return_index=True, return_inverse=True)
    sizes, words = words_of(piece.columns[-1])
    sizes, codes = without(sizes, words, stop_words)
    codes, names = codes.astype(np.int64), words.dictionary
    own, left = np.repeat(group, sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    gram = codes
    for k in range(1, high + 1):
        at = slice(None)
        if k > 1:
            # an n-gram is one of a word less, and a word
            at = np.flatnonzero(left >= k)
            pair, number = np.unique(gram[at] * len(words.dictionary) + codes[at + k - 1], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(pair // len(words.dictionary))), words.dictionary.take(pa.array(pair % len(words.dictionary))), " ")
            gram = np.zeros(len(codes), np.int64)
            gram[at] = number
        if k >= low and len(names):
            found, n = np.unique(own[at] * len(names) + gram[at], return_counts=True)
            of = pa.array(row[found // len(names)])
            yield pa.table([*(c.take(of) for c in keys), names.take(pa.array(found % len(names))), pa.array(n)], names=[*(f"k{i}" for i in range(len(keys))), "word", "n"])


def partial_counts(docs: DataFrame, keys: dict[str, Column], text: str = "text", english: bool = True, stop_words: Sequence[str] = (), low: int = 1, high: int = 1) -> DataFrame:
    """``*keys, word, n``: how often each word, or n-gram within a document, of ``low`` to ``high`` words occurs in the texts of
    a task, so that only counts are shuffled. A task may give several counts of a word, which are to be summed."""
    names = list(keys)
    words = F.col(text) if english else tx.words(F.col(text), False)
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), words.alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    gone = pa.array(list(stop_words), pa.string())

    def given(table: pa.Table) -> list[pa.RecordBatch]:
        return table.rename_columns([*names, "word", "n"]).to_batches(max_chunksize=1 << 16)

    def summed(held: list[pa.Table]) -> pa.Table:
        if len(held) == 1:
            return held[0]
        by = held[0].column_names[:-1]
        return pa.concat_tables(held).group_by(by, use_threads=False).aggregate([("n", "sum")]).select([*by, "n_sum"]).rename_columns([*by, "n"])

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for piece in pieces(batch, len(names)):
                for table in _counted(piece, gone, low, high):
                    held.append(table)
                    n += table.num_rows
                if n > HELD_ROWS:
                    held = [summed(held)]
                    n = held[0].num_rows
                    if n > HELD_ROWS // 2:
                        yield from given(held.pop())
                        n = 0
        if held:
            yield from given(summed(held))

    return rows.mapInArrow(count, schema)


def document_ends(docs: DataFrame, span: int, topic: str = "topic", text: str = "text", key: str = "doc_id", english: bool = True, stop_words: Sequence[str] = ()) -> DataFrame:
    """``topic, doc_id, h, e``: the first and the last ``span`` words of each document that has any, without the stop words."""
    rows = docs.select(F.col(topic).alias("topic"), F.col(key).alias("doc_id"), (F.col(text) if english else tx.words(F.col(text), False)).alias("w"))
    gone = pa.array(list(stop_words), pa.string())

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, 2):
                n, coded = words_of(piece.column(2))
                n, codes = without(n, coded, gone)
                some = np.flatnonzero(n)
                first, n = (np.cumsum(n) - n)[some], n[some]
                k = np.minimum(n, span)
                inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                offsets = pa.array(np.concatenate(([0], np.cumsum(k))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(codes[np.repeat(at, k) + inner]))) for at in (first, first + n - k)]
                of = pa.array(some)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(of), piece.column(1).take(of), *lists], names=["topic", "doc_id", "h", "e"])

    kept = [*rows.schema.fields[:2], *T.StructType.fromDDL("h array<string>, e array<string>").fields]
    return rows.mapInArrow(cut, T.StructType(kept))
