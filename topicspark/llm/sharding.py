"""Sharding over fixed virtual slots with a versioned slot-to-shard map."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.llm.common import table, write_table

N_SLOTS, N_SHARDS, TOLERANCE = 4096, 64, 2
#: Setting of the session with the folder where the maps of the query are kept; without it each run starts from the first map.
MAPS = "topicspark.sharding.maps"


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """Slot of a key: the first 32 bits of its MD5, modulo the slots. A null key counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n_slots).cast("int")


def slot_bytes(slotted: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``slot, n_rows, n_bytes`` for every slot, the empty ones too; ``slotted`` has ``slot`` and ``n_bytes``."""
    every = slotted.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    seen = slotted.groupBy("slot").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    return every.join(seen, "slot", "left").fillna(0, ["n_rows", "n_bytes"])


def first_map(slots: DataFrame, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1 of the map: equal ranges of slots."""
    return slots.withColumn("shard", F.floor(F.col("slot") * n_shards / n_slots).cast("int")).withColumn("version", F.lit(1))


def rebalance(mapped: DataFrame, n_shards: int = N_SHARDS, tolerance: int = TOLERANCE) -> DataFrame:
    """The next version of a map ``slot, n_bytes, shard, version``, moving few slots.

    A shard keeps its largest slots up to ``tolerance`` percent above the mean. The slots beyond that are laid end to
    end, largest first, along the free room of the shards, and a slot goes where its middle falls. Slots without bytes
    stay. A slot keeps its version when its shard stays. All of it is integer arithmetic over the slots, whose number is
    fixed, so it costs the same at every size of the data.
    """
    everything = W.partitionBy(F.lit(0))
    by_size = [F.desc("n_bytes"), F.asc("slot")]
    mapped = mapped.withColumn("total", F.sum("n_bytes").over(everything)).withColumn(
        "within", F.sum("n_bytes").over(W.partitionBy("shard").orderBy(*by_size).rowsBetween(W.unboundedPreceding, 0))
    )
    mapped = mapped.withColumn("stays", F.col("within") * n_shards * 100 <= F.col("total") * (100 + tolerance)).withColumn(
        "stays", F.col("stays") | (F.col("n_bytes") == 0)
    )
    kept = mapped.groupBy("shard").agg(
        F.sum(F.when(F.col("stays"), F.col("n_bytes")).otherwise(0)).alias("kept"), F.max("total").alias("total")
    )
    every = mapped.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("to_shard"))
    # a shard that held no slot has its whole share free
    kept = every.join(kept.withColumnRenamed("shard", "to_shard"), "to_shard", "left").withColumn(
        "total", F.coalesce("total", F.max("total").over(everything), F.lit(0))
    )
    room = kept.withColumn("room", F.greatest(F.floor(F.col("total") / n_shards) + 1 - F.coalesce("kept", F.lit(0)), F.lit(0)))
    room = room.withColumn("upto", F.sum("room").over(W.partitionBy(F.lit(0)).orderBy("to_shard").rowsBetween(W.unboundedPreceding, 0)))
    room = room.select("to_shard", (F.col("upto") - F.col("room")).alias("since"), "upto")
    moving = mapped.where(~F.col("stays")).withColumn(
        "line", F.sum("n_bytes").over(W.partitionBy(F.lit(0)).orderBy(*by_size).rowsBetween(W.unboundedPreceding, 0))
    )
    moving = moving.withColumn("middle", F.col("line") - F.ceil(F.col("n_bytes") / 2))
    moved = moving.join(F.broadcast(room), (F.col("middle") >= F.col("since")) & (F.col("middle") < F.col("upto"))).select("slot", "to_shard")
    new = F.coalesce("to_shard", "shard")
    return mapped.join(F.broadcast(moved), "slot", "left").select(
        "slot", "n_rows", "n_bytes", F.col("shard").alias("old_shard"), new.alias("shard"),
        F.when(new != F.col("shard"), F.col("version") + 1).otherwise(F.col("version")).alias("version"),
    )


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def latest_number(spark: SparkSession, maps: str) -> int:
    """Number of the last map in the folder ``maps``, 0 if there is none."""
    path, fs = _files(spark, maps)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(m[1]) for n in names if (m := re.fullmatch(r"map-([0-9]+)", n))), default=0)


def read_map(spark: SparkSession, maps: str, number: int) -> DataFrame:
    """``slot, shard, version`` of a stored map."""
    return spark.read.schema("slot int, shard int, version int").parquet(f"{maps.rstrip('/')}/map-{number:06d}")


def write_map(mapped: DataFrame, maps: str, number: int) -> None:
    """Store a map whole or not at all: it is written aside and renamed, which fails if another run stored this number."""
    spark, at = mapped.sparkSession, maps.rstrip("/")
    aside = f"{at}/_writing-{uuid.uuid4().hex}"
    mapped.select("slot", "shard", "version").coalesce(1).write.parquet(aside)
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    source, fs = _files(spark, aside)
    target = hadoop.Path(f"{at}/map-{number:06d}")
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(source), fs.makeQualified(target), gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        )
    finally:
        fs.delete(source, True)


def _next_map(sizes: DataFrame, maps: str, n_slots: int, n_shards: int, tolerance: int) -> DataFrame:
    """Rebalances the latest stored map, or the first one if none is stored, and stores the result if it is new."""
    spark = sizes.sparkSession
    number = latest_number(spark, maps)
    if number:
        stored = read_map(spark, maps, number)
        n, n_known, last, most = stored.agg(F.count("*"), F.count_distinct("slot"), F.max("slot"), F.max("shard")).first()
        if (n, n_known, last) != (n_slots, n_slots, n_slots - 1) or most >= n_shards:
            raise ValueError(f"map {number} of {maps} has {n} slots on shards up to {most}; {n_slots} slots on {n_shards} shards were asked for")
        mapped = sizes.join(F.broadcast(stored), "slot")
    else:
        mapped = first_map(sizes, n_slots, n_shards)
    shards = write_table(rebalance(mapped, n_shards, tolerance), "shards")
    if not number or not shards.where("shard <> old_shard").isEmpty():
        write_map(shards, maps, number + 1)
    return shards


def assign_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, n_shards: int = N_SHARDS, tolerance: int = TOLERANCE, maps: str | None = None
) -> DataFrame:
    """``doc_id, slot, n_bytes, first_shard, shard, version`` of every record.

    ``maps`` is a folder where the slot maps are kept, all of them, numbered: the latest is rebalanced for the bytes of
    ``docs``, so records stay where they were unless their shard is too full, and the new map is stored. ``first_shard``
    is the shard before this run. Without ``maps`` the first map is rebalanced and nothing is kept.
    A null or empty text has 0 bytes, a text of any length all of its; keys may be of any type, a null one counts as empty;
    repeated keys share a slot; slots of equal bytes go by their number; an empty table gives no rows; other columns are
    ignored.
    """
    slotted = docs.select(
        F.col(key).alias("doc_id"), slot_of(F.col(key), n_slots).alias("slot"), F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0)).alias("n_bytes")
    )
    sizes = slot_bytes(slotted, n_slots)
    if maps:
        shards = _next_map(sizes, maps, n_slots, n_shards, tolerance)
    else:
        shards = rebalance(first_map(sizes, n_slots, n_shards), n_shards, tolerance)
    # as many rows as slots, whatever the data
    small = F.broadcast(shards.select("slot", F.col("old_shard").alias("first_shard"), "shard", "version"))
    return slotted.join(small, "slot").select("doc_id", "slot", "n_bytes", "first_shard", "shard", "version")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), maps=spark.conf.get(MAPS, None))


SQL = f"""
WITH d AS (SELECT doc_id, ((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT) % {N_SLOTS})::INT AS slot,
                  coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
s AS (SELECT r.i::INT AS slot, coalesce(sum(n_bytes), 0)::BIGINT AS n_bytes
      FROM range({N_SLOTS}) r(i) LEFT JOIN d ON d.slot = r.i GROUP BY 1),
m AS (SELECT slot, n_bytes, (slot * {N_SHARDS} // {N_SLOTS})::INT AS shard FROM s),
t AS (SELECT *, sum(n_bytes) OVER () AS total,
             sum(n_bytes) OVER (PARTITION BY shard ORDER BY n_bytes DESC, slot ROWS UNBOUNDED PRECEDING) AS within FROM m),
k AS (SELECT *, within * {N_SHARDS} * 100 <= total * (100 + {TOLERANCE}) OR n_bytes = 0 AS stays FROM t),
r AS (SELECT shard, greatest(max(total)::BIGINT // {N_SHARDS} + 1 - sum(CASE WHEN stays THEN n_bytes ELSE 0 END)::BIGINT, 0) AS room FROM k GROUP BY 1),
u AS (SELECT shard AS to_shard, sum(room) OVER (ORDER BY shard ROWS UNBOUNDED PRECEDING) AS upto, room FROM r),
v AS (SELECT slot, sum(n_bytes) OVER (ORDER BY n_bytes DESC, slot ROWS UNBOUNDED PRECEDING) - (n_bytes + 1) // 2 AS middle FROM k WHERE NOT stays),
w AS (SELECT slot, to_shard FROM v JOIN u ON middle >= upto - room AND middle < upto)
SELECT d.doc_id, d.slot, d.n_bytes, k.shard AS first_shard, coalesce(w.to_shard, k.shard)::INT AS shard,
       (CASE WHEN coalesce(w.to_shard, k.shard) <> k.shard THEN 2 ELSE 1 END)::INT AS version
FROM d JOIN k ON d.slot = k.slot LEFT JOIN w ON d.slot = w.slot
"""
