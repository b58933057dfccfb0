"""Sharding by best-fit-decreasing bin packing."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, without

#: Bytes of text in a shard. Packing is one task's work for each shard: give larger shards for larger corpora.
CAPACITY = 1 << 20
#: Groups of one size that a task ranks; more are ranked in parts.
RANKED = 100_000


class RoomTree:
    """Open bins by remaining room: a 64-way tree of uniform depth, each node a bit set of its children."""

    def __init__(self, most: int) -> None:
        self.levels: list[dict[int, int]] = [defaultdict(int)]
        while most >> (6 * len(self.levels)):
            self.levels.append(defaultdict(int))
        self.bins: dict[int, list[int]] = {}

    def push(self, room: int, bin_no: int) -> None:
        if room in self.bins:
            heapq.heappush(self.bins[room], bin_no)
            return
        self.bins[room] = [bin_no]
        for level in self.levels:
            level[room >> 6] |= 1 << (room & 63)
            room >>= 6

    def pop(self, need: int) -> tuple[int, int] | None:
        """The fullest bin with room for need, the lowest number of equals; taken out."""
        at = need
        for depth, level in enumerate(self.levels):
            if bits := level.get(at >> 6, 0) >> (at & 63) << (at & 63):
                at = (at >> 6 << 6) | ((bits & -bits).bit_length() - 1)
                for lower in reversed(self.levels[:depth]):
                    bits = lower[at]
                    at = (at << 6) | ((bits & -bits).bit_length() - 1)
                break
            at = (at >> 6) + 1
        else:
            return None
        bin_no = heapq.heappop(self.bins[at])
        if not self.bins[at]:
            del self.bins[at]
            x = at
            for level in self.levels:
                level[x >> 6] &= ~(1 << (x & 63))
                if level[x >> 6]:
                    break
                del level[x >> 6]
                x >>= 6
        return at, bin_no


def pack(sizes: Iterable[tuple[int, int]], capacity: int) -> Iterator[tuple[int, int, int]]:
    """Runs (size, rank of the first, bin) for (size, count) pairs in descending order of size.

    Exactly best fit decreasing over the single groups: the fullest bin that takes
    one group of a size is, after that, still the fullest that takes the next, so
    it takes as many as fit at once. Groups above the capacity get bins of their own.
    """
    tree, bins = RoomTree(max(capacity, 1)), 0
    for size, count in sizes:
        rank = 1
        while rank <= count:
            if size > capacity:
                yield size, rank, bins
                bins, rank = bins + 1, rank + 1
                continue
            room, bin_no = tree.pop(size) or (capacity, bins)
            bins = max(bins, bin_no + 1)
            n = min(count - rank + 1, room // size) if size else count
            yield size, rank, bin_no
            rank += n
            tree.push(room - n * size, bin_no)


def assign(groups: DataFrame, capacity: int = CAPACITY, *, ranked: int = RANKED) -> DataFrame:
    """(key, size, shard) for groups (key, size long).

    Packing needs the sizes' histogram only: at most as many rows as there are
    sizes, however many groups there are. One task packs it; every group then finds
    its run by its rank among groups of its size. These are ranked in the order of
    the keys or, if they are more than ranked, in parts by a hash of the key.
    """
    counts = cut(groups.groupBy("size").agg(F.count("*").alias("n")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["size", "rank", "until", "shard"]
        pairs = sorted(((s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), reverse=True)
        count = dict(pairs)
        rows: list[tuple[int, int, int, int]] = []
        before: tuple[int, int, int] | None = None
        for row in chain(pack(pairs, capacity), [None]):
            if before:
                size, rank, shard = before
                rows.append((size, rank, row[1] - 1 if row and row[0] == size else count[size], shard))
            before = row
            if len(rows) == 100_000 or not row and rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                rows = []

    block = lambda rank: F.floor((F.col(rank) - 1) / F.lit(ranked))
    begun = counts.coalesce(1).mapInArrow(runs, "size long, rank long, until long, shard long")
    # A run counts in each block of ranks that it reaches into, from its begin or that of the block.
    begun = begun.withColumn("block", F.explode(F.sequence(block("rank"), block("until")))).select("size", "block", F.greatest("rank", F.col("block") * ranked + 1).alias("rank"), "shard")
    parts = counts.select("size", F.ceil(F.col("n") / F.lit(ranked)).alias("parts"))
    dealt = groups.join(parts, "size").select("key", "size", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"))
    sums = dealt.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = sums.select("size", "part", (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))
    placed = dealt.withColumn("k", F.row_number().over(Window.partitionBy("size", "part").orderBy("key"))).join(before, ["size", "part"]).select("key", "size", (F.col("before") + F.col("k")).alias("rank"))
    both = placed.select("key", "size", block("rank").alias("block"), "rank", F.lit(None).cast("long").alias("shard")).unionByName(begun.select(F.lit(None).cast(groups.schema["key"].dataType).alias("key"), "size", "block", "rank", "shard"))
    order = Window.partitionBy("size", "block").orderBy("rank", F.col("shard").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("key", "size", F.col("shard").isNull().alias("is_group"), F.last("shard", True).over(order).alias("shard"))
    return filled.filter("is_group").select("key", "size", "shard")


def shards(docs: DataFrame, capacity: int = CAPACITY, *, group_col: str = "doc_id", size: Column | None = None, text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """docs with the number of their shard; rows with equal group_col stay together.

    size: what a row takes, by default the bytes of its text, however long; null and
    empty texts count 0. A group larger than the capacity has a shard to itself.
    Rows whose group is null form one group. Repeated rows each take their size.
    Groups of equal size are taken in the order of their keys, or of a hash of the
    key where they are very many. A column named shard_col is replaced. No rows: no
    shards.
    """
    size = F.octet_length(text_col) if size is None else size
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("null"))
    groups = docs.select(key.alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("size")).groupBy("key").agg(F.sum("size").alias("size"))
    placed = assign(cut(groups), capacity).select(F.col("key").alias("__shard_key"), F.col("shard").alias("__shard_no"))
    kept = without(docs, shard_col)
    return docs.join(placed, key == F.col("__shard_key"), "inner").select(*kept, F.col("__shard_no").alias(shard_col))
