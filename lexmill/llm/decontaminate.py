"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_text, pieces
from .textkit import Words, mix, seeds, signed, words

#: Fixed masks over consecutive words: 1 is compared, 0 ignored. Each has 6 of 10 or 11 positions.
MASKS = ("1101100101", "1011010011", "11100010011", "1111110000")
SPAN = max(map(len, MASKS))
#: Words that must agree in an overlap, or all words of an item with fewer.
LEAST_WORDS = 12
#: Least share of agreeing words in an overlap.
LEAST_IDENTITY = 0.8
#: Items of fewer words than this match documents of the same words only, and nothing within a longer text.
SHORTEST = 5
#: Words of all items together up to which they are sent to all executors, 130 MB of keys; beyond, hashes meet in a shuffle.
BROADCAST_WORDS = 500_000


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask at each position, across rows too."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, hash_of_mask(mask), dtype=np.uint64)
    for (j, bit), m in zip(enumerate(mask), seeds(len(mask), 3) | np.uint64(1)):
        if bit == "1":
            out += h[j : j + n] * m
    return mix(out)


def hash_of_mask(mask: str) -> np.uint64:
    return np.uint64(int(mask, 2) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def masks_for(lengths: set[int]) -> list[str]:
    """The masks; for items too short for them, one solid mask as long as the item."""
    return [*MASKS, *("1" * n for n in sorted(lengths) if SHORTEST <= n < SPAN)]


def in_row(w: Words, span: int) -> np.ndarray:
    """Positions at which span words lie in one row."""
    n = len(w.hash) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    left = np.repeat(w.ptr[1:], np.diff(w.ptr))[:n] - np.arange(n)
    return left >= span


def overlap(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first word in the item, words, agreeing words) of the best overlap with doc moved by shift.

    Best: most agreeing words of all runs with identity of LEAST_IDENTITY or more,
    then fewest words, then the first. None if too few words agree.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    at = np.flatnonzero(item[lo:hi] == doc[lo + shift : hi + shift])
    if len(at) < min(LEAST_WORDS, len(item)):
        return None
    # Runs begin and end with agreeing words: from the i-th to the j-th of them, agreeing words
    # less four times the others are score[j] + 1 - score[i]; for each j the least i with 0 or more.
    score = 5 * np.arange(len(at)) - 4 * at
    begin = np.searchsorted(-np.minimum.accumulate(score), -(score + 1), "left")
    agreeing = np.arange(len(at)) - begin + 1
    most = int(agreeing.max())
    if most < min(LEAST_WORDS, len(item)):
        return None
    size = np.where(agreeing == most, at - at[begin] + 1, len(item) + 1)
    end = int(size.argmin())
    return lo + int(at[begin[end]]), int(size[end]), most


class Items(NamedTuple):
    ids: np.ndarray
    words: list[np.ndarray]


def short_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 1 to SHORTEST - 1 words, and a hash of all their words."""
    length = np.diff(w.ptr)
    rows = np.flatnonzero((length > 0) & (length < SHORTEST))
    key = mix(length[rows].astype(np.uint64))
    for k in range(SHORTEST - 1):
        has = length[rows] > k
        key[has] = mix(key[has] * np.uint64(3) + w.hash[w.ptr[rows[has]] + k])
    return rows, key


def _tokens(text: pa.Array) -> list[np.ndarray]:
    return [w.hash[a:b] for w in words(text) for a, b in zip(w.ptr, w.ptr[1:])]


OUT = "doc_id long, item_id long, doc_word long, item_word long, n_words int, n_same int, identity double"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found)) if found else [()] * 6
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
    same = [s / n for s, n in zip(cols[5], cols[4])]
    return pa.record_batch([*arrays, pa.array(same, pa.float64())], names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_same", "identity"])


def _scan_small(docs: DataFrame, items: Items) -> DataFrame:
    """Items known to every task: one pass over the documents, no shuffle."""
    masks = masks_for({len(t) for t in items.words})
    keys, item, place = [], [], []
    for i, t in enumerate(items.words):
        for m in MASKS if len(t) >= SPAN else ["1" * len(t)] if len(t) >= SHORTEST else []:
            s = seed_hashes(t, m)
            keys.append(s)
            item.append(np.full(len(s), i))
            place.append(np.arange(len(s)))
    if not items.words:
        return docs.sparkSession.createDataFrame([], OUT)
    none = np.zeros(0, dtype=np.int64)
    key, item_no, at = np.concatenate([none.view(np.uint64), *keys]), np.concatenate([none, *item]), np.concatenate([none, *place])
    order = np.argsort(key, kind="stable")
    key, item_no, at = key[order], item_no[order], at[order]
    bits = max(16, int(np.ceil(np.log2(len(key) + 1))) + 5)
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, dtype=bool)
    table[key >> shift] = True
    alone: dict[int, list[int]] = {}
    for i, t in enumerate(items.words):
        for k in short_keys(Words(0, np.array([0, len(t)]), t, t, t))[1].tolist():
            alone.setdefault(k, []).append(i)
    known = docs.sparkSession.sparkContext.broadcast((items, masks, key, item_no, at, table, alone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, masks, key, item_no, at, table, alone = known.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found: list[tuple] = []
            for w in words(batch.column(1)):
                tried: set[tuple[int, int, int]] = set()
                row = None
                for r, k in zip(*(x.tolist() for x in short_keys(w))) if alone else ():
                    n = int(w.ptr[r + 1] - w.ptr[r])
                    found.extend((int(ids[w.first + r]), int(items.ids[i]), 0, 0, n, n) for i in alone.get(k, ()))
                for m in masks:
                    s = seed_hashes(w.hash, m)
                    maybe = np.flatnonzero(table[s >> shift])
                    maybe = maybe[in_row(w, len(m))[maybe]]
                    lo = np.searchsorted(key, s[maybe], "left")
                    hi = np.searchsorted(key, s[maybe], "right")
                    if not (hi > lo).any():
                        continue
                    row = w.row if row is None else row
                    for p, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                        r = int(row[p])
                        base = int(w.ptr[r])
                        tried.update((r, int(item_no[x]), p - base - int(at[x])) for x in range(a, b))
                for r, i, d in sorted(tried):
                    if got := overlap(items.words[i], w.hash[w.ptr[r] : w.ptr[r + 1]], d):
                        begin, n, same = got
                        found.append((int(ids[w.first + r]), int(items.ids[i]), begin + d, begin, n, same))
            yield _rows(found)

    return docs.mapInArrow(run, OUT)


def _seed_table(side: DataFrame, masks: list[str], solid: bool) -> DataFrame:
    """(h, id, at) for each mask and position; solid: each text only under the masks of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in words(batch.column(1)):
                length, row = np.diff(w.ptr), w.row
                for m in masks:
                    s, ok = seed_hashes(w.hash, m), in_row(w, len(m))
                    if solid:
                        n = length[row[: len(ok)]]
                        ok = ok & ((n >= SPAN) if m in MASKS else (n == len(m)))
                    p = np.flatnonzero(ok)
                    yield pa.record_batch([pa.array(signed(s[p])), pa.array(ids[w.first + row[p]]), pa.array(p - w.ptr[row[p]])], names=["h", "id", "at"])

    return side.mapInArrow(run, "h long, id long, at long")


def _short_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for w in words(batch.column(1)):
            rows, key = short_keys(w)
            yield pa.record_batch([ids.take(pa.array(w.first + rows)), pa.array(np.diff(w.ptr)[rows].astype(np.int32)), pa.array(signed(key))], names=["id", "n", "h"])


def _scan_large(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Items of any number: hashes of both sides meet in a shuffle; texts join the hits to be verified."""
    masks = masks_for(set(range(SHORTEST, SPAN)))
    a = _seed_table(docs, masks, False).select("h", F.col("id").alias("doc"), F.col("at").alias("p"))
    b = _seed_table(items, masks, True).select("h", F.col("id").alias("item"), F.col("at").alias("q"))
    # The words of a document and an item meet once, with all shifts to be tried.
    hits = a.join(b, "h").select("doc", "item", (F.col("p") - F.col("q")).alias("shift")).groupBy("doc", "item").agg(F.collect_set("shift").alias("shifts"))
    texts = hits.join(items.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item").join(docs.select(F.col("id").alias("doc"), F.col("text").alias("doc_text")), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = []
            cols = [batch.column(k).to_pylist() for k in range(3)]
            for doc, item, shifts, t, u in zip(*cols, _tokens(batch.column(3)), _tokens(batch.column(4))):
                for d in sorted(shifts):
                    if got := overlap(t, u, d):
                        found.append((doc, item, got[0] + d, got[0], got[1], got[2]))
            yield _rows(found)

    long = texts.select("doc", "item", "shifts", "item_text", "doc_text").mapInArrow(run, OUT)
    mine, theirs = docs.mapInArrow(_short_rows, "id long, n int, h long"), items.mapInArrow(_short_rows, "id long, n int, h long")
    same = mine.select(F.col("id").alias("doc_id"), "n", "h").join(theirs.select(F.col("id").alias("item_id"), "n", "h"), ["n", "h"]).distinct()
    zero = F.lit(0).cast("long")
    return long.unionByName(same.select("doc_id", "item_id", zero.alias("doc_word"), zero.alias("item_word"), F.col("n").alias("n_words"), F.col("n").alias("n_same"), F.lit(1.0).alias("identity")))


def overlaps(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_same, identity): the best overlap of each document and item.

    Words are compared in lower case, without punctuation. An overlap is a run of
    words in step on both sides, some replaced by others, of at least LEAST_WORDS
    agreeing words (all of them, for shorter items) and LEAST_IDENTITY. Of several
    overlaps the one with most agreeing words is kept, then most identity, then the
    first. Items of fewer than SHORTEST words match documents that are the same
    words and no more. Texts of any length are searched to the end. Rows with a null
    id and texts without a word match nothing. Repeated rows count once, and several
    texts of one id are its overlaps together. Other columns are ignored. No rows on
    either side give none. Ids that aren't integers raise ValueError.
    """
    docs, items = id_text(docs, id_col, text_col), id_text(items, item_col, text_col)
    size = items.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")), F.lit(0)))).first()[0] or 0
    if size <= broadcast_words:
        rows = items.distinct().orderBy("id", "text").collect()
        found = _scan_small(docs, Items(np.array([r["id"] for r in rows], dtype=np.int64), _tokens(pa.array([r["text"] for r in rows], pa.string()))))
    else:
        found = _scan_large(docs, items)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_same"), F.desc("identity"), "doc_word", "item_word")
    return found.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")
