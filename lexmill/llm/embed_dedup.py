"""Embedding near-dedup by random-hyperplane sign hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, edges_of, groups, id_of, pieces, written
from .textkit import mix, seeds, signed

#: Least cosine of near copies, and probability with which a pair of that cosine shares a bucket.
COSINE, CHANCE = 0.95, 0.98
#: Hyperplanes in a table at least and at most: one for each doubling of the number of vectors, so that a bucket of
#: vectors that aren't near each other stays as small as it is, whatever their number.
BITS = (8, 40)
#: Vectors of a bucket that are compared in one go; larger buckets go block against block.
BLOCK = 2048

VECTORS = "id long, whole long, unit binary, hashes array<long>"


def planes(dim: int, n: int) -> np.ndarray:
    """n fixed normal vectors: two uniform hashes each, by Box and Muller."""
    u = (seeds(2 * dim * n, dim) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    a, b = u[: dim * n], u[dim * n :]
    return (np.sqrt(-2 * np.log1p(-a)) * np.cos(2 * np.pi * b)).reshape(dim, n).astype(np.float32)


def layout(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(hyperplanes in a table, tables) for n vectors."""
    bits = min(max(BITS[0], int(n - 1).bit_length() if n > 1 else 0), BITS[1])
    alike = (1 - np.arccos(min(max(cosine, -1.0), 1.0)) / np.pi) ** bits
    return bits, 1 if alike >= 1 else max(1, int(np.ceil(np.log(1 - CHANCE) / np.log1p(-alike))))


def signatures(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A 64-bit bucket number a table, different for each table and number of dimensions."""
    dim = unit.shape[1]
    on = unit @ planes(dim, tables * bits) >= 0
    code = (on.reshape(len(unit), tables, bits) * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    return mix(code + seeds(tables, dim + 1000)[None, :])


def _hashed(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        begin = np.concatenate([[0], np.cumsum(size)])
        for dim in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == dim)
            x = flat[begin[rows][:, None] + np.arange(dim)]
            with np.errstate(all="ignore"):
                unit = (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
            good = np.isfinite(unit).all(axis=1)
            unit, rows = np.ascontiguousarray(unit[good]), rows[good]
            if not len(rows):
                continue
            unit += 0.0  # no negative zeros
            raw = np.ascontiguousarray(unit).view(np.uint32).astype(np.uint64)
            whole = mix((raw * (seeds(dim, 77) | np.uint64(1))).sum(axis=1, dtype=np.uint64) + np.uint64(dim))
            units = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * dim * 4).astype(np.int32).tobytes()), pa.py_buffer(unit.tobytes())])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(signed(signatures(unit, bits, tables).ravel())))
            yield pa.record_batch([pa.array(ids[rows]), pa.array(signed(whole)), units, lists], names=["id", "whole", "unit", "hashes"])


def stars(ids: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the pairs with cosine of at least least."""
    near = unit @ unit.T >= least
    label, big = np.arange(len(ids)), len(ids)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], big).min(axis=1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    out = label != np.arange(len(ids))
    return ids[label[out]], ids[out]


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            edge, ids = edges_of(table, 3), table.column("id").to_numpy()
            raw = table.column("unit").to_pylist()
            begin = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
            unit, us, vs = np.frombuffer(b"".join(raw), dtype=np.float32), [], []
            for a, b in zip(edge, edge[1:]):
                if b - a > 1:
                    u, v = stars(ids[a:b], unit[begin[a] : begin[b]].reshape(b - a, -1), least)
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, kept_vec_id): each vector to be dropped and the one of its group that stays, the least id.

    Vectors that share a bucket of any table are compared exactly; groups are the
    connected components of pairs with cosine of at least cosine. The number of
    hyperplanes in a table follows that of the vectors, and the number of tables
    keeps the chance of a pair at the least cosine at CHANCE. Vectors of different
    lengths, any of them, are never compared. Rows with a null id, a null or empty
    vector, one with nulls or without a direction (zero, infinite, NaN) are in no
    group. Rows with the same id are one vector of several values; repeated rows
    count once. Other columns are ignored. No rows give none. Ids that aren't
    integers raise ValueError.
    """
    base = vectors.select(id_of(vectors, id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    bits, tables = layout(base.count(), cosine)
    seen = written(base.mapInArrow(lambda batches: _hashed(batches, bits, tables), VECTORS), "vectors")
    # Of equal vectors that of the least id goes on; groups are combined before the shuffle, however large.
    copies = cut(seen.groupBy("whole").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("whole", "first"))
    equal = cut(seen.select("id", "whole").join(copies, "whole").filter("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct())
    firsts = seen.join(copies, "whole", "left").filter("first is null or first = id").dropDuplicates(["id", "whole"]).select("id", "whole", "unit", "hashes")
    spread = firsts.select("id", "whole", F.explode("hashes").alias("h"))
    shared = spread.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts"))
    bucket = spread.join(shared, "h").select("h", "id", "whole", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"))
    blocks = bucket.select("h", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "id", "whole")
    rows = blocks.join(firsts.select("id", "whole", "unit"), ["id", "whole"]).select("h", "i", "j", "id", "unit")
    found = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "id").mapInArrow(_verify(cosine), "u long, v long")
    return components(found.unionByName(equal)).select(F.col("id").alias("vec_id"), F.col("root").alias("kept_vec_id"))
