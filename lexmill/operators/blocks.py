"""Sparse rows of documents in blocks, so that words' numbers, weights and models meet documents without a row an entry.

A block has some ten thousand documents and numbers its own words from 0. Its documents
lie in chunks of packed arrays. What is known of words goes to each block once for each
word of the block, instead of once for each entry, and so do sums by word that come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VECTOR
from ..workspace import kept, small_batches

#: Documents of a block, about; entries and words from which a block is closed before.
BLOCK_DOCS, BLOCK_ENTRIES, BLOCK_WORDS = 24_000, 8_000_000, 600_000
#: Entries of a chunk, about, and rows of words in an Arrow batch.
CHUNK, ROWS = 1 << 15, 1 << 16
#: Order of what a block gets: its words, what is known of its documents, their chunks, and what comes after.
WORDS, DOCS, CHUNKS, AFTER = range(4)


class Words(NamedTuple):
    """index of each word that a block got, with its numbers p, a row a word."""

    index: np.ndarray
    p: np.ndarray


class Chunk(NamedTuple):
    """Documents: their places in the block, ids, numbers of entries; and place among Words and value of each entry."""

    place: np.ndarray
    ids: pa.Array
    sizes: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def begin(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about CHUNK entries each."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield lo, hi
        lo = hi


def narrow(value: np.ndarray) -> np.ndarray:
    """Whole numbers as bytes or pairs of bytes where they fit."""
    for kind in (np.uint8, np.uint16):
        if not len(value) or value.min() >= 0 and value.max() <= np.iinfo(kind).max and (value == value.astype(kind)).all():
            return value.astype(kind)
    return value.astype(np.float64)


def _planes(at: np.ndarray) -> bytes:
    """Differences of places, their first bytes before all second ones and so on: small ones leave planes of zeros, which pack well."""
    return np.diff(at.astype(np.int32), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: pa.Buffer) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T.copy().view(np.int32)[:, 0], dtype=np.int32)


def _packed(docs: DataFrame, parts: int, skip: Iterable[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    counted, skip = "values" not in docs.columns, tuple(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        known: dict = dict.fromkeys(skip, -1)
        n, df, size, entries, first = np.zeros(1024), np.zeros(1024, dtype=np.int64), 0, 0, 0
        id_type = item_type = None

        def rows(k: int, **columns) -> pa.RecordBatch:
            types = {"block": pa.int32(), "first": pa.int32(), "ids": pa.list_(id_type), "sizes": pa.list_(pa.int32()), "items": pa.binary(), "vals": pa.binary(), "item": item_type, "at": pa.int32(), "n": pa.float64(), "df": pa.int64()}
            return pa.record_batch([columns[c] if c in columns else pa.array(np.full(k, block, dtype=np.int32)) if c == "block" else pa.nulls(k, t) for c, t in types.items()], names=list(types))

        def closed() -> Iterator[pa.RecordBatch]:
            terms = pa.array([t for t, k in known.items() if k >= 0], item_type)
            for i in range(0, size, ROWS):
                j = min(size, i + ROWS)
                yield rows(j - i, item=terms[i:j], at=pa.array(np.arange(i, j, dtype=np.int32)), n=pa.array(n[i:j]), df=pa.array(df[i:j]))

        for batch in batches:
            ids, items = batch.column(0), batch.column(1)
            id_type, item_type = ids.type, items.type.value_type
            offsets = items.offsets.to_numpy()
            for lo, hi in _pieces(np.diff(offsets)):
                if entries > BLOCK_ENTRIES or size > BLOCK_WORDS:
                    yield from closed()
                    block, known, size, entries, first = block + parts, dict.fromkeys(skip, -1), 0, 0, 0
                    n[:], df[:] = 0, 0
                length = np.diff(offsets[lo : hi + 1])
                flat = items.values[offsets[lo] : offsets[hi]].dictionary_encode()
                local = np.empty(len(flat.dictionary), dtype=np.int64)
                for i, t in enumerate(flat.dictionary.to_pylist()):
                    k = known.get(t)
                    if k is None:
                        k = known[t] = size
                        size += 1
                    local[i] = k
                at, row = local[flat.indices.to_numpy()], np.repeat(np.arange(hi - lo), length)
                keep = at >= 0
                at, row = at[keep], row[keep]
                if counted:
                    pair, value = np.unique(row * max(size, 1) + at, return_counts=True)
                    row, at = np.divmod(pair, max(size, 1))
                else:
                    values = batch.column(2)
                    begin = values.offsets.to_numpy()
                    value = values.values[begin[lo] : begin[hi]].to_numpy(zero_copy_only=False)[keep]
                if size > len(n):
                    more = max(size, 2 * len(n)) - len(n)
                    n, df = np.append(n, np.zeros(more)), np.append(df, np.zeros(more, dtype=np.int64))
                np.add.at(n, at, value)
                np.add.at(df, at, 1)
                sizes = np.bincount(row, minlength=hi - lo).astype(np.int32)
                of = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if kind is None else pa.array(x, kind))
                yield rows(1, first=pa.array([first], pa.int32()), ids=of(ids[lo:hi], None), sizes=of(sizes, pa.int32()), items=pa.array([_planes(at)], pa.binary()), vals=pa.array([narrow(value).tobytes()], pa.binary()))
                first, entries = first + hi - lo, entries + len(at)
        if id_type is not None:
            yield from closed()

    return run


def pack(docs: DataFrame, skip: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Chunks, and words (block, at, item, n, df) of their blocks, of (id, items array) or (id, items, values array<double>); written at once.

    Without values the items of a document are counted, but those to skip. n: sum of
    the values; df: entries. An id is one row.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, ceil(docs.count() / (cores * BLOCK_DOCS)))
    docs = docs.coalesce(parts) if docs.rdd.getNumPartitions() > parts else docs.repartition(parts) if docs.rdd.getNumPartitions() < parts else docs
    kinds = dict(docs.dtypes)
    schema = f"block int, first int, ids array<{kinds['id']}>, sizes array<int>, items binary, vals binary, item {kinds['items'][6:-1]}, at int, n double, df bigint"
    with small_batches(docs.sparkSession):
        found = kept(docs.mapInArrow(_packed(docs, parts, skip), schema), "packed")
    return found.filter("first is not null").select("block", "first", "ids", "sizes", "items", "vals"), found.filter("at is not null").select("block", "at", "item", "n", "df")


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, Iterator[pa.RecordBatch]]]]]:
    """The rows of each block, of each part in its order."""

    def runs() -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 4 + batch.column(1).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                yield *divmod(int(key[lo]), 4), batch.slice(lo, hi - lo)

    for block, found in groupby(runs(), lambda r: r[0]):
        yield block, ((part, (r[2] for r in same)) for part, same in groupby(found, lambda r: r[1]))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length, as rows."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def words_of(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, Words]:
    """Place of each of the block's words among those that it got, -1 for others; one more for words beyond."""
    found = [(b.column("at").to_numpy(), b.column("index").to_numpy(), numbers(b, "p")) for b in batches]
    at, index, p = (np.concatenate(x) for x in zip(*found))
    place = np.full(at.max() + 2, -1, dtype=np.int32)
    place[at] = np.arange(len(at), dtype=np.int32)
    return place, Words(index, p)


def chunks_of(batches: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[Chunk]:
    """Documents with the entries whose words the block got; those without one too."""
    for batch in batches:
        first, ids, sizes, items, vals = (batch.column(c) for c in ("at", "ids", "sizes", "items", "vals"))
        for i in range(batch.num_rows):
            n = sizes[i].values.to_numpy()
            at = _unplaned(items[i].as_buffer())
            kind = {1: np.uint8, 2: np.uint16, 8: np.float64}[vals[i].as_buffer().size // max(len(at), 1) or 1]
            at, value = place[np.minimum(at, len(place) - 1)], np.frombuffer(vals[i].as_buffer(), dtype=kind).astype(np.float64)
            keep = at >= 0
            if not keep.all():
                n = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
                at, value = at[keep], value[keep]
            yield Chunk(first[i].as_py() + np.arange(len(n)), ids[i].values, n, at, value)


def nonempty(c: Chunk) -> Chunk | None:
    """The documents with entries; None if there are none."""
    some = c.sizes > 0
    if some.all() and len(some):
        return c
    return Chunk(c.place[some], c.ids.filter(pa.array(some)), c.sizes[some], c.at, c.value) if some.any() else None


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray | None, Iterator[Chunk]]]:
    """Each block's words, what is known of its documents by their places, and its chunks; blocks without a word have none."""
    for _, parts in parted(batches):
        place = words = docs = None
        for part, found in parts:
            if part == WORDS:
                place, words = words_of(found)
            elif part == DOCS:
                sides = [(b.column("at").to_numpy(), numbers(b, "p")) for b in found]
                at, p = (np.concatenate(x) for x in zip(*sides))
                docs = np.full((at.max() + 2, p.shape[1]), np.nan)
                docs[at] = p
            elif part == CHUNKS and words is not None:
                yield words, docs, chunks_of(found, place)


def about(docs: np.ndarray, c: Chunk) -> np.ndarray:
    """What is known of each document of a chunk; not a number where nothing is."""
    return docs[np.minimum(c.place, len(docs) - 1)]


def summed(into: np.ndarray, at: np.ndarray, q: np.ndarray) -> None:
    """Adds each row of q to the row of into that at names."""
    if len(at):
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        into[at[order][begin]] += np.add.reduceat(q[order], begin, axis=0)


class Sums:
    """Sums by key of values that come in parts; held once a key, about."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, 1 << 21

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        self.parts.append(_totals(key, value))
        self.held += len(self.parts[-1][0])
        if self.held > self.most:
            self.parts = [self.get()]
            self.held = len(self.parts[0][0])
            self.most = max(self.most, 2 * self.held)

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        return _totals(*map(np.concatenate, zip(*self.parts))) if self.parts else (np.zeros(0, dtype=np.int64), np.zeros(0))


def _totals(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(key, return_inverse=True)
    return found, np.bincount(at, weights=value, minlength=len(found))


def listed(ids: pa.Array, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.record_batch([ids, *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values())], names=["id", *columns])


def _none(kind: str) -> Column:
    """An empty array: of null ones, Spark's writer of Arrow batches goes through all before at each row."""
    return F.array().cast(f"array<{kind}>")


@dataclass(frozen=True)
class Blocks:
    """chunks, and words (block, at, index): the index of each word of a block that has one."""

    chunks: DataFrame
    words: DataFrame

    @property
    def id_type(self) -> str:
        return dict(self.chunks.dtypes)["ids"][6:-1]

    @cached_property
    def n(self) -> int:
        """Partitions, of which each has one block, or one in so many."""
        return (self.chunks.agg(F.max("block")).first()[0] or 0) + 1

    def indices(self) -> DataFrame:
        """(index) of all words."""
        return self.words.select("index").distinct()

    def places(self) -> DataFrame:
        """(block, at, id): the place of each document in its block, of those without entries too."""
        return self.chunks.select("block", "first", F.posexplode("ids").alias("k", "id")).select("block", (F.col("first") + F.col("k")).alias("at"), "id")

    @cached_property
    def documents(self) -> DataFrame:
        """(block, at, id) of the documents with entries."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch_block, parts in parted(batches):
                place = None
                for part, found in parts:
                    if part == WORDS:
                        place, _ = words_of(found)
                    elif place is not None:
                        for c in filter(None, map(nonempty, chunks_of(found, place))):
                            yield listed(c.ids, block=np.full(len(c.sizes), batch_block, dtype=np.int32), at=c.place.astype(np.int32))

        return kept(self.meet(run, f"id {self.id_type}, block int, at int", self.side(WORDS, self.words)), "documents")

    def side(self, part: int, rows: DataFrame, p: Column | None = None, tag: Column | None = None) -> DataFrame:
        """Rows (block, at, ...) as one of the parts that a block gets."""
        got = F.col("index") if "index" in rows.columns else F.lit(None).cast("int")
        return rows.select("block", F.lit(part).alias("part"), "at", got.alias("index"), (F.lit(None).cast("string") if tag is None else tag).alias("tag"), (_none("double") if p is None else p).alias("p"))

    def meet(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *sides: DataFrame) -> DataFrame:
        """What run makes of the blocks, each with its chunks and sides in their order."""
        own = self.chunks.select("block", F.lit(CHUNKS).alias("part"), F.col("first").alias("at"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("tag"), _none("double").alias("p"), "ids", "sizes", "items", "vals")
        rows = own
        for s in sides:
            rows = rows.unionByName(s.select("*", _none(self.id_type).alias("ids"), _none("int").alias("sizes"), F.lit(None).cast("binary").alias("items"), F.lit(None).cast("binary").alias("vals")))
        return rows.repartitionById(self.n, "block").sortWithinPartitions("block", "part", "tag", "at").mapInArrow(run, schema)

    def entries(self, change: Callable[[Chunk, Words], np.ndarray] = lambda c, w: c.value, words: DataFrame | None = None, p: Column | None = None) -> DataFrame:
        """(id, index, value): a row an entry; words, p: those that count, with numbers for change."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for w, _, chunks in met(batches):
                for c in filter(None, map(nonempty, chunks)):
                    yield listed(c.ids.take(pa.array(c.row())), index=w.index[c.at].astype(np.int32), value=change(c, w))

        return self.meet(run, f"id {self.id_type}, index int, value double", self.side(WORDS, self.words if words is None else words, p))

    def vectors(self, cardinality: int, change: Callable[[Chunk, Words], np.ndarray] = lambda c, w: c.value, words: DataFrame | None = None, p: Column | None = None) -> DataFrame:
        """(id, vector) of all documents; zeros are dropped."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.full(1, -1, dtype=np.int32), Words(np.zeros(0, dtype=np.int32), np.zeros((0, 0)))
            for _, parts in parted(batches):
                place, w = none
                for part, found in parts:
                    if part == WORDS:
                        place, w = words_of(found)
                    elif part == CHUNKS:
                        for c in chunks_of(found, place):
                            index, value, row = w.index[c.at].astype(np.int32), change(c, w), c.row()
                            order = np.lexsort((index, row))
                            order = order[value[order] != 0]
                            offsets = np.append(0, np.cumsum(np.bincount(row[order], minlength=len(c.sizes)))).astype(np.int32)
                            entries = pa.StructArray.from_arrays([pa.array(index[order]), pa.array(value[order])], names=["index", "value"])
                            sizes = pa.array(np.full(len(c.sizes), cardinality, dtype=np.int32))
                            yield listed(c.ids, vector=pa.StructArray.from_arrays([sizes, pa.ListArray.from_arrays(pa.array(offsets), entries)], names=["cardinality", "features"]))

        return self.meet(run, f"id {self.id_type}, vector {VECTOR.simpleString()}", self.side(WORDS, self.words if words is None else words, p))


def of(freq: DataFrame | Blocks) -> Blocks:
    """Blocks of (id, index, value); written at once. Blocks are what they are."""
    if isinstance(freq, Blocks):
        return freq
    e = F.sort_array(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), F.col("value").cast("double").alias("value"))))
    docs = freq.groupBy("id").agg(e.alias("e")).select("id", F.col("e.index").alias("items"), F.col("e.value").alias("values"))
    chunks, words = pack(docs)
    return Blocks(chunks, words.select("block", "at", F.col("item").alias("index")))
