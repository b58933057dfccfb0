"""Repeatable samples, splits and orders, by hashes of a key instead of a generator's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import unit_draw
from ..workspace import kept


def sample(df: DataFrame, fraction: float, key: str, seed: str = "sample") -> DataFrame:
    """Each row with probability fraction, drawn by its key."""
    return df.filter(unit_draw(F.col(key), seed) < fraction)


def split(df: DataFrame, fraction: float, key: str, seed: str = "split") -> tuple[DataFrame, DataFrame]:
    """Rows drawn with probability fraction, and the others."""
    draw = unit_draw(F.col(key), seed)
    return df.filter(draw < fraction), df.filter(draw >= fraction)


def reservoir(df: DataFrame, k: int, group: str, key: str, seed: str = "reservoir") -> DataFrame:
    """k rows of each group, all of smaller ones: those with least md5 of seed and key."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k).drop("__rank")


def shuffled(df: DataFrame, key: str, seed: str = "shuffle") -> DataFrame:
    """Rows in an order that looks random."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)


def numbered(df: DataFrame, column: str, name: str = "index", kind: str = "int") -> DataFrame:
    """Places 0, 1, ... of distinct values in their order, as a column name of that type; null first.

    Rows are dealt to ranges of the values, of equal size by a sample of them,
    whatever they have in common. The ranges are written once; each is ranked on its
    own and moved by the sizes of those before. More rows than kind can number fail.
    """
    ranges = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)
    parted = kept(ranges.withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = parted.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(column)))
    return local.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__rank") - 1).cast(kind)).select(*df.columns, name)
