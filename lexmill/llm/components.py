"""Connected components by alternating stars, all in joins and sums over edges, which combine a giant star before they shuffle it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of a partition's own edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[p]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    members = np.array([x for x in parent if root(x) != x], dtype=np.int64)
    roots = np.array([root(int(x)) for x in members], dtype=np.int64)
    for i in range(0, len(members), 100_000):
        yield pa.record_batch([pa.array(members[i : i + 100_000]), pa.array(roots[i : i + 100_000])], names=["u", "v"])


def _large(e: DataFrame) -> DataFrame:
    """Each neighbour that is greater than a vertex moves to the least of the vertex and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each vertex and its lesser neighbours, all that it has here, move to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
    return moved.select("x.*").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of the edges (u long, v long) but the roots; root is the least id of the component.

    Loops, repeated edges and rows with a null are harmless; no edges give no rows.
    Each partition first contracts its own edges, then large-star and small-star
    rounds, logarithmically many, merge the partitions' stars.
    """
    plain = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    e = cut(plain.mapInArrow(_contract, "u long, v long"))
    seen = None
    while True:
        n, h = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, h) == seen or not n:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = (n, h)
        e = cut(_small(_large(e)))
