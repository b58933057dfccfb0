"""Probabilistic latent semantic indexing by EM, over the pairs (document, word) that occur.

Parameters are wide: a column for each topic. p_w (index, t0, t1, ...) holds
P(w|z); p_d (id, t0, ...) holds P(d|z) in the symmetric model and P(z|d) in the
asymmetric one; p_z is one row of P(z). Counts are (id, index, value) or Blocks of
them: parameters go to each block once a word and once a document, and sums by word
and by document come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import kept
from . import blocks
from .blocks import Blocks


def _t(k: int, mark: str = "t") -> list[str]:
    return [f"{mark}{z}" for z in range(k)]


def _plus(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def start_value(key: Column, z: int) -> Column:
    """A positive number by formula, the same on any engine."""
    return F.lit(1.0) + F.pmod(key * 31 + z * 17, F.lit(101)) / F.lit(101.0)


def _by_column(df: DataFrame, key: str, k: int) -> DataFrame:
    """Each topic's column divided by its sum."""
    sums = df.agg(*(F.sum(t).alias(f"__{t}") for t in _t(k)))
    return df.crossJoin(F.broadcast(sums)).select(key, *(F.coalesce(F.try_divide(t, f"__{t}"), F.lit(0.0)).alias(t) for t in _t(k)))


def _by_row(df: DataFrame, key: str, k: int) -> DataFrame:
    whole = _plus([F.col(t) for t in _t(k)])
    return df.select(key, *(F.coalesce(F.try_divide(F.col(t), whole), F.lit(0.0)).alias(t) for t in _t(k)))


def _started(n: DataFrame | Blocks, words: list[Column], docs: list[Column], symmetric: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, whole = len(words), isinstance(n, Blocks)
    w = (n.indices() if whole else n.select("index").distinct()).select("index", *(x.alias(t) for x, t in zip(words, _t(k))))
    d = (n.documents.select("id") if whole else n.select("id").distinct()).select("id", *(x.alias(t) for x, t in zip(docs, _t(k))))
    p_z = w.sparkSession.range(1).select(*(F.lit(1.0 / k).alias(t) for t in _t(k)))
    return _by_column(w, "index", k), (_by_column if symmetric else _by_row)(d, "id", k), p_z


def initial(n: DataFrame | Blocks, k: int, symmetric: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """p_w, p_d, p_z to start from, for counts (id, index, value)."""
    return _started(n, [start_value(F.col("index"), z) for z in range(k)], [start_value(F.col("id"), z + 1) for z in range(k)], symmetric)


def randomly(n: DataFrame | Blocks, k: int, seed: int = 0, symmetric: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """p_w, p_d, p_z to start from, drawn by a seeded hash: uniform in (0, 1) before each is made to sum to one."""

    def draw(key: str, side: int, z: int) -> Column:
        return (F.pmod(F.xxhash64(key, F.lit(side), F.lit(z), F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)

    return _started(n, [draw("index", 0, z) for z in range(k)], [draw("id", 1, z) for z in range(k)], symmetric)


def require_slices(parts: DataFrame, slices: int) -> DataFrame:
    """(part, id, index, value), if the words of each part are those of index modulo slices, else ValueError."""
    if not parts.filter(F.col("part").isNull() | (F.col("part") != F.pmod("index", F.lit(slices)))).isEmpty():
        raise ValueError(f"a word that isn't in its part of {slices}")
    return parts


def _met(n: Blocks, p_w: DataFrame, p_d: DataFrame, p_z: DataFrame | None, k: int, made: Callable, schema: str) -> DataFrame:
    """What made gives for each block's words and its documents: pairs of a chunk, of the entries with parameters, and P(z) P(d|z) P(w|z) of these, a row a topic."""
    prior = np.ones(k) if p_z is None else np.array(p_z.select(*_t(k)).first(), dtype=float)

    def pairs(w: blocks.Words, docs: np.ndarray, chunks: Iterator[blocks.Chunk]) -> Iterator[tuple[blocks.Chunk, np.ndarray]]:
        for c in chunks:
            d = blocks.about(docs, c)
            some = ~np.isnan(d[:, 0])
            if not some.all():
                c = c._replace(place=c.place[some], ids=c.ids.filter(pa.array(some)), sizes=c.sizes[some], at=c.at[keep := some[c.row()]], value=c.value[keep])
                d = d[some]
            if (c := blocks.nonempty(c)) is not None:
                p = np.repeat((blocks.about(docs, c) * prior).T, c.sizes, axis=1)
                p *= np.ascontiguousarray(w.p[c.at].T)
                yield c, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, docs, chunks in blocks.met(batches):
            if docs is not None:
                yield from made(w, pairs(w, docs, chunks))

    words = n.side(blocks.WORDS, n.words.join(p_w, "index"), F.array(*_t(k)))
    return n.meet(run, schema, words, n.side(blocks.DOCS, n.places().join(p_d, "id"), F.array(*_t(k))))


def _shares(c: blocks.Chunk, p: np.ndarray) -> np.ndarray:
    """value * P(z | d, w), zero where all topics are."""
    whole = p.sum(axis=0)
    return p * np.divide(c.value, whole, out=np.zeros_like(whole), where=whole != 0)


def _wide(k: int) -> str:
    return ", ".join(f"{t} double" for t in _t(k))


def expected(n: DataFrame | Blocks, p_w: DataFrame, p_d: DataFrame, p_z: DataFrame | None, k: int) -> DataFrame:
    """(id, index, t0, ...): value * P(z | d, w), zero where all topics are; with p_z the symmetric model."""

    def made(w: blocks.Words, pairs: Iterator[tuple[blocks.Chunk, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for c, p in pairs:
            yield blocks.listed(c.ids.take(pa.array(c.row())), index=w.index[c.at].astype(np.int32), **dict(zip(_t(k), _shares(c, p))))

    n = blocks.of(n)
    return _met(n, p_w, p_d, p_z, k, made, f"id {n.id_type}, index int, {_wide(k)}")


def _step(n: DataFrame | Blocks, p_w: DataFrame, p_d: DataFrame, p_z: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame]:
    """(index, t0, ...) and (id, t0, ...): sums of expected by word and by document; neither leaves its block entry by entry."""

    def made(w: blocks.Words, pairs: Iterator[tuple[blocks.Chunk, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        part, seen, kind = np.zeros_like(w.p), np.zeros(len(w.p), dtype=bool), None
        for c, p in pairs:
            q, kind = _shares(c, p), c.ids.type
            blocks.summed(part, c.at, q.T)
            seen[c.at] = True
            yield blocks.listed(c.ids, index=pa.nulls(len(c.ids), pa.int32()), **dict(zip(_t(k), np.add.reduceat(q, c.begin(), axis=1))))
        found = np.flatnonzero(seen)
        for i in range(0, len(found), blocks.ROWS):
            at = found[i : i + blocks.ROWS]
            yield blocks.listed(pa.nulls(len(at), kind), index=pa.array(w.index[at], pa.int32()), **dict(zip(_t(k), part[at].T.copy())))

    n = blocks.of(n)
    q = kept(_met(n, p_w, p_d, p_z, k, made, f"id {n.id_type}, index int, {_wide(k)}"), "expected")  # read by three sums
    words = q.filter("index is not null").groupBy("index").agg(*(F.sum(t).alias(t) for t in _t(k)))
    return words, q.filter("index is null").select("id", *_t(k))


def symmetric_step(n: DataFrame | Blocks, p_w: DataFrame, p_d: DataFrame, p_z: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    words, docs = _step(n, p_w, p_d, p_z, k)
    sums = docs.agg(*(F.sum(t).alias(t) for t in _t(k)))
    whole = _plus([F.col(t) for t in _t(k)])
    return _by_column(words, "index", k), _by_column(docs, "id", k), sums.select(*(F.coalesce(F.try_divide(F.col(t), whole), F.lit(0.0)).alias(t) for t in _t(k)))


def asymmetric_step(n: DataFrame | Blocks, p_w: DataFrame, p_d: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    words, docs = _step(n, p_w, p_d, None, k)
    return _by_column(words, "index", k), _by_row(docs, "id", k)


def likelihood(n: DataFrame | Blocks, p_w: DataFrame, p_d: DataFrame, p_z: DataFrame | None, k: int) -> DataFrame:
    """(loglik): sum of value * ln of the sum over topics; pairs of probability zero are left out."""

    def made(w: blocks.Words, pairs: Iterator[tuple[blocks.Chunk, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for c, p in pairs:
            whole = p.sum(axis=0)
            some = whole > 0
            if some.any():
                yield pa.record_batch([pa.array([float((c.value[some] * np.log(whole[some])).sum())])], names=["part"])

    return _met(blocks.of(n), p_w, p_d, p_z, k, made, "part double").agg(F.sum("part").alias("loglik"))


def long(p: DataFrame, key: str, k: int) -> DataFrame:
    """(key, topic, value) of wide parameters."""
    return p.select(key, F.posexplode(F.array(*_t(k))).alias("topic", "value"))
