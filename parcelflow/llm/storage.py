"""Where intermediate tables and files go, and the input tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between the JVM and Python, at most; a longer row is a batch of its own.
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table; with ``spread`` one of fewer partitions than there are cores is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound the Arrow batches of what the session runs from here on: both sides hold one or two at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees; a local one of our own only in a local session without it."""
    if not (where := spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = Path(tempfile.mkdtemp(prefix="spark-")).as_uri()
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: a short lineage that outlives executors."""
    path = path or fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, to be removed when they have served."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = fresh(self.spark, what)
        self.paths.append((out := stored(df, what, path), path))
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove one table; nothing that still has to run may read it."""
        for own, path in self.paths:
            if own is df:
                system, at = file_system(path)
                system.delete_dir(at)
        self.paths = [x for x in self.paths if x[0] is not df]

    def clear(self, keep: DataFrame) -> None:
        """Remove all tables but one."""
        for own, _ in list(self.paths):
            if own is not keep:
                self.drop(own)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_system(path: str):
    """(file system, path on it) of a URL or a plain path, for Python code in tasks."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)
