"""Tables written to the folder that all executors share, so that nothing is computed twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without it gets a temporary folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="topicspark-")
    atexit.register(shutil.rmtree, at, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{at}")
    return f"file://{at}"


def new_folder(spark: SparkSession, what: str) -> str:
    """A name in the shared folder that nothing else has; what is there is removed by release()."""
    at = f"{shared_dir(spark)}/topicspark-{what}-{uuid.uuid4().hex}"
    _tables.append((spark, at))
    return at


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: its lineage ends there, and it outlives executors. The table is
    removed by release(), or when the Python process ends."""
    spark = df.sparkSession
    at = new_folder(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release() -> None:
    """Removes all that written() has written so far, for long sessions: results that still read it must be stored before."""
    while _tables:
        _remove(*_tables.pop())


_tables: list[tuple[SparkSession, str]] = []
atexit.register(release)


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended already
        pass


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files have fewer splits than there are cores, as small tables do."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
