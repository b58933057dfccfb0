"""k-means steps over array<double> points."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def seeded(points: DataFrame, k: int, key: str = "id") -> DataFrame:
    """points with a first cluster, round robin by an integer key."""
    return points.withColumn("k", F.pmod(F.col(key), F.lit(k)).cast("int"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """A row a point; what is null or lacking is zero."""
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    begin = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), max([dim, *size.tolist()], default=dim)))
    out[row, np.arange(len(flat)) - begin[row]] = flat
    return out


def assign(points: DataFrame, centroids: DataFrame, point: str = "point") -> DataFrame:
    """points with the cluster k of the nearest centroid (k, centroid), the lowest of equals; null coordinates are zeros.

    The centroids come to the driver and travel with the tasks: they are few,
    whatever the number of points.
    """
    known = sorted((r["k"], r["centroid"]) for r in centroids.select("k", "centroid").collect())
    ks, centres = np.array([k for k, _ in known], dtype=np.int32), _matrix(pa.array([c for _, c in known], pa.list_(pa.float64())), 0)
    rest = points.select(*(c for c in points.columns if c != "k"))
    at = rest.columns.index(point)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at), centres.shape[1])
            wide = np.pad(centres, ((0, 0), (0, x.shape[1] - centres.shape[1])))
            far = np.stack([((x - c) ** 2).sum(axis=1) for c in wide], axis=1)
            yield pa.record_batch([*batch.columns, pa.array(ks[far.argmin(axis=1)])], names=[*batch.schema.names, "k"])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("k", IntegerType())]))


def update(points: DataFrame, dim: int, point: str = "point") -> DataFrame:
    """(k, centroid): means by cluster; a null coordinate adds nothing but counts. Empty clusters vanish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count: Counter[int] = Counter()
        for batch in batches:
            k, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)[:, :dim]
            for c in np.unique(k).tolist():
                sums[c] = sums.get(c, 0) + x[k == c].sum(axis=0)
                count[c] += int((k == c).sum())
        for c, total in sums.items():
            yield pa.record_batch([pa.array(np.full(dim, c), pa.int32()), pa.array(np.arange(dim), pa.int32()), pa.array(total), pa.array(np.full(dim, count[c]), pa.int64())], names=["k", "dim", "total", "n"])

    parts = points.select(F.col("k").cast("int"), F.col(point).cast("array<double>").alias("point")).mapInArrow(run, "k int, dim int, total double, n long")
    means = parts.groupBy("k", "dim").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return means.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda e: e["mean"]).alias("centroid"))


def rounds(points: DataFrame, k: int, dim: int, n: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Points with clusters and the centroids, after n rounds of update and assign."""
    at = seeded(points, k, key)
    centroids = update(at, dim)
    for _ in range(n):
        at = assign(points, centroids)
        centroids = update(at, dim)
    return at, centroids


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(k, centroid) from text lines "k v1 v2 ..."; different lengths or a repeated k raise ValueError."""
    parts = F.split(F.trim("value"), "[ \\t]+")
    got = spark.read.text(path).filter("trim(value) <> ''").select(parts[0].cast("int").alias("k"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("centroid"))
    n, distinct, lengths = got.agg(F.count("*"), F.countDistinct("k"), F.countDistinct(F.size("centroid"))).first()
    if distinct != n or lengths > 1:
        raise ValueError("centroids of different lengths, or two for one cluster")
    return got


def write_centroids(centroids: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.col("k").cast("string"), F.array_join(F.transform("centroid", lambda x: x.cast("string")), " "))
    centroids.select(line.alias("value")).write.mode("overwrite").text(path)
