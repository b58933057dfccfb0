"""Sums of vectors by key, in long form so that they are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import vector


def vector_sum(df: DataFrame, key: str | list[str], name: str = "vector") -> DataFrame:
    """(key, vector): element-wise sums; null vectors are skipped, a key with none but nulls has a null vector.

    Vectors of a key must have one cardinality, else the job fails.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(*keys, F.col(f"{name}.cardinality").alias("card"), F.explode_outer(f"{name}.features").alias("e")).select(*keys, "card", F.col("e.index").alias("index"), F.col("e.value").alias("value"))
    each = rows.groupBy(*keys, "index").agg(F.sum("value").alias("value"), F.min("card").alias("lo"), F.max("card").alias("hi"))
    entry = F.when(F.col("index").isNotNull() & (F.col("value") != 0), F.struct("index", "value"))
    got = each.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("f"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    checked = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), F.raise_error(F.lit("vectors of different cardinality")).cast("int"))
    return got.select(*keys, F.when(F.col("lo").isNotNull(), vector(checked, F.col("f"))).alias("vector"))


def vector_merge(df: DataFrame, key: str | list[str], power: float | None = None, log: bool = False, name: str = "vector") -> DataFrame:
    """Sums by key, then normalised by a p-norm or log norm if a power is given."""
    got = vector_sum(df, key, name)
    if power is None:
        return got
    return got.withColumn("vector", V.log_normalize(F.col("vector"), power) if log else V.normalize(F.col("vector"), power))
