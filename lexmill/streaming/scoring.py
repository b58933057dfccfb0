"""Models applied to streams: each micro-batch is scored by the same plan as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..workspace import new_path


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream, with the schema that they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    # A stream's source is a folder: that of the file, with only its name let through.
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All that the stream holds now, scored batch by batch into a folder each, and read as one table.

    A batch that is repeated after a failure overwrites its own folder, so that each
    row is scored once. The same out and checkpoint go on where the last run ended.
    """
    spark = stream.sparkSession
    out, checkpoint = out or new_path(spark, "scored"), checkpoint or new_path(spark, "offsets")

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")
