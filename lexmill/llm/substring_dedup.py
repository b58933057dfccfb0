"""Substring dedup: seed on winnowed anchors, extend both ways, keep maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_text, written
from .textkit import BLANK, mix, signed, words
from .winnowing import anchors

#: Words in an anchor, and k-grams in a window of which the least is the anchor.
K, W = 25, 26
#: Words in the shortest repeat.
LEAST = K + W - 1
#: Anchors that documents share up to which the list of them is sent to all executors, instead of every text through a shuffle.
BROADCAST_HASHES = 2_000_000


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id) of every anchor, once a document."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for w in words(batch.column(1), BLANK):
            a = anchors(w.hash, w.ptr, K, W)
            order = np.lexsort((a.hash, a.row))
            h, r = a.hash[order], a.row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            yield pa.record_batch([pa.array(signed(h[new])), pa.array(ids[w.first + r[new]])], names=["h", "id"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, start, windows) of every anchor that is listed for its document."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        for w in words(batch.column(1), BLANK):
            a = anchors(w.hash, w.ptr, K, W)
            part = lists.slice(w.first, len(w.ptr) - 1)
            size = np.array([0 if s is None else s for s in part.value_lengths().to_pylist()], dtype=np.int64)
            listed = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            salt = mix(np.arange(len(size), dtype=np.uint64) + np.uint64(5))
            hit = np.isin(a.hash ^ salt[a.row], listed ^ np.repeat(salt, size))
            i = np.flatnonzero(hit)
            n = a.begin[i + 1] - a.begin[i]
            flat = np.repeat(a.begin[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(i) else np.zeros(0, np.int64)
            windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(signed(a.window[flat])))
            yield pa.record_batch([pa.array(signed(a.hash[i])), pa.array(ids[w.first + a.row[i]]), pa.array(a.start[a.begin[i]].astype(np.int32)), windows], names=["h", "id", "start", "windows"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive repeated windows; rows come sorted by id and start."""
    names = ["doc_id", "first_word", "n_words", "later"]
    open_run: tuple[int, int, int, bool] | None = None

    def batch_of(rows: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] - r[1] + LEAST for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.bool_())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, start, bits, later = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        place = np.arange(W)
        on = (bits[:, None] >> place) & 1 == 1
        r, o = np.nonzero(on)
        ids, at, late = ids[r], start[r] + o, ((later[r] >> o) & 1).astype(bool)
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (at[1:] - at[:-1] > 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids)) - 1
        rows = list(zip(ids[first].tolist(), at[first].tolist(), at[last].tolist(), np.logical_or.reduceat(late, first).tolist()))
        if open_run:
            if open_run[0] == rows[0][0] and rows[0][1] - open_run[2] <= 1:
                rows[0] = (open_run[0], open_run[1], max(rows[0][2], open_run[2]), rows[0][3] or open_run[3])
            else:
                rows.insert(0, open_run)
        open_run = rows.pop()
        yield batch_of(rows)
    if open_run:
        yield batch_of([open_run])


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, later): maximal runs of words that other documents have too.

    Words are runs of characters without blanks, compared in lower case. A word
    run is repeated if every LEAST consecutive words of it occur in another
    document as well; runs are as long as that holds. later: some part of it
    occurs in a document with a smaller id, so that it can be deleted and the
    earliest copy stays. Repeats within one document alone don't count.

    Every document that has a repeat is listed, the earliest too (later is false
    there), and so are exact and near copies. Texts of any length are searched to
    the end. Rows with a null id or text, and texts of fewer than LEAST words, have
    no repeats. Rows with the same id are one document. Other columns are ignored.
    No rows give no rows. Ids that aren't integers raise ValueError.
    """
    base = id_text(docs, id_col, text_col).filter("text is not null")
    # Least and greatest ids are combined before the shuffle, however frequent an anchor or window is.
    every = written(base.mapInArrow(_anchor_rows, "h long, id long"), "anchors")
    shared = every.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("h")
    lists = written(every.join(shared, "h").groupBy("id").agg(F.collect_set("h").alias("hs")), "lists")
    if (lists.agg(F.sum(F.size("hs"))).first()[0] or 0) <= BROADCAST_HASHES:
        lists = F.broadcast(lists)
    near = base.join(lists, "id").select("id", "text", "hs").mapInArrow(_window_rows, "h long, id long, start int, windows array<long>")
    each = written(near.select("h", "id", "start", F.posexplode("windows").alias("o", "window")), "windows")
    twice = each.groupBy("window").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("window", "lo")
    bit = F.expr("shiftleft(1L, o)")
    flags = each.join(twice, "window").groupBy("h", "id", "start").agg(F.bit_or(bit).alias("bits"), F.bit_or(F.when(F.col("id") > F.col("lo"), bit).otherwise(F.lit(0).cast("long"))).alias("later"))
    lined = flags.select("id", "start", "bits", "later").repartition("id").sortWithinPartitions("id", "start")
    return lined.mapInArrow(_runs, "doc_id long, first_word int, n_words int, later boolean")
