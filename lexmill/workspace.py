"""The folder in which jobs keep tables that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode with the setting absent."""
    context = spark.sparkContext
    java = context._jsc.sc()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not java.getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not java.getCheckpointDir().isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return java.getCheckpointDir().get().rstrip("/")


#: Tables that kept() wrote and that are still there.
_kept: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read again, without its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table is sent to all executors.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, to be sent to all executors by the join that takes it if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer tasks than there are; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows in an Arrow batch, at most: a row is a whole document here, and executors hold a batch and what they make of it.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within send Python no more than BATCH_ROWS rows at once; after that the session's setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What queries within have shuffled is deleted as each ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that kept() writes within."""
    mark = len(_kept)
    try:
        yield
    finally:
        while len(_kept) > mark:
            removed(spark, _kept.pop())
