"""What the operators of this subpackage share: tables, single rows of an id, tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.sources.shared import shared_dir, spread
from topicspark.sources.shared import written as write_table

__all__ = ["fresh", "one_row_an_id", "shared_dir", "small_batches", "table", "tiles", "whole_groups", "wider", "write_table"]

#: Rows of a batch on its way to Python, at most. The JVM holds one going and one coming for each task, Python some copies.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table, over all cores even if its files are one split."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by BATCH_ROWS, for what the session runs from now on; a lower bound stays. Rows
    are read when a result is written, so the setting must outlast the call that plans it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def one_row_an_id(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``rows`` with one row for each value of ``key``, that with the smallest text, null last; ties fall to the smallest
    other columns. Rows without a key all stay. Only keys are shuffled where none is repeated."""
    many = write_table(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_repeated")).agg(F.count("*").alias("_n")).where("_n > 1").select("_repeated"), "repeated-ids")
    if not many.take(1):
        return rows
    same = rows[key] == many["_repeated"]
    order = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    every = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    chosen = rows.join(many, same, "left_semi").groupBy(key).agg(F.min_by(every, F.struct(F.col(text).isNull(), text, *order)).alias("_row"))
    return rows.join(many, same, "left_anti").unionByName(chosen.select("_row.*"))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it until no column has it, whatever the case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def wider(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with the columns of the DDL ``more`` after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def tiles(rows: DataFrame, key: str, spread: str, tile_rows: int) -> DataFrame:
    """Split groups of more than ``tile_rows`` rows into pairs of blocks, so that no task holds a whole large group.

    Adds ``tile`` (to group by), ``block``, ``lo`` and ``hi``. Two rows of one group meet in exactly one tile when they
    are in different blocks, and in the tile lo = hi = block when in the same one. A group within the limit is one tile.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    n_blocks = F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int")
    return (
        rows.join(counts, key)
        .withColumn("_g", n_blocks)
        .withColumn("block", F.pmod(F.xxhash64(spread), F.col("_g")).cast("int"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        .withColumn("lo", F.least("block", "_j"))
        .withColumn("hi", F.greatest("block", "_j"))
        .withColumn("tile", F.xxhash64(key, "lo", "hi"))
        .drop("_n", "_g", "_j")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows, cut where ``key`` changes; the rows come ordered by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        path = np.asarray(batch.column(key))
        last = int(np.argmax(path == path[-1]))
        ended = bool(held) and (last > 0 or held[-1].column(key)[-1].as_py() != path[0])
        if ended or last:
            ready = [*held, batch.slice(0, last)] if last else held
            if sum(b.num_rows for b in ready) >= least:
                yield pa.Table.from_batches(ready).combine_chunks()
                held = [batch.slice(last)]
                continue
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
