"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_of, id_text, pieces, without, written
from .textkit import buffers, signed, slices, span_hashes, seeds
from .winnowing import anchors

#: Line hashes in a window of which the least is the fingerprint, and so lines in the shortest run that is deleted.
#: 1: every line is a fingerprint, so that a single repeated line is found too; runs are the lines next to one another.
W = 1
#: Lines to be deleted up to which the list of them is sent to all executors, instead of every text through a shuffle.
BROADCAST_LINES = 1_000_000
_LINE = np.where(np.arange(256) == 10, np.uint64(0), seeds(256, 23) | np.uint64(1))


def line_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that aren't empty, and the place of each row's first."""
    part = data[at[0] : at[-1]]
    at = at - at[0]
    inside = part != 10
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][np.diff(at) > 0]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    return span_hashes(_LINE[part], start), np.searchsorted(start, at)


def _rows(w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for i, j in slices(offsets):
                h, ptr = line_hashes(data, offsets[i : j + 1])
                a = anchors(h, ptr, 1, w)
                windows = pa.ListArray.from_arrays(pa.array(a.begin.astype(np.int32)), pa.array(signed(a.window)))
                rows = pa.array(i + a.row)
                first = a.start[a.begin[:-1]] if len(a.row) else a.start
                yield pa.record_batch([pa.array(signed(a.hash)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first.astype(np.int32)), windows], names=["h", "id", "v", "start", "windows"])

    return run


def _clean(w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = batch.num_columns
            text, gone = batch.column(n - 2), batch.column(n - 1)
            hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            counts = np.zeros(batch.num_rows, dtype=np.int32)
            if len(hit):
                out = text.to_pylist()
                for r, starts in zip(hit.tolist(), gone.take(pa.array(hit)).to_pylist()):
                    drop = {s + o for s in starts for o in range(w)}
                    kept, k = [], 0
                    for line in out[r].split("\n"):
                        if not line or k not in drop:
                            kept.append(line)
                        k += bool(line)
                    out[r] = "\n".join(kept)
                    counts[r] = len(drop)
                text = pa.array(out, pa.string())
            yield pa.record_batch([*batch.columns[: n - 2], text, pa.array(counts)], names=[f"c{i}" for i in range(n)])

    return run


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = W, removed_col: str = "lines_removed") -> DataFrame:
    """docs with later repeats of runs of window lines or more deleted, and the number of lines deleted.

    A run is later if the same lines, one after the other, occur before it: in a
    document of smaller id, or earlier in the same document. Lines are compared
    byte by byte; empty lines are neither compared nor deleted. A text may become
    empty; its row stays. Rows with a null id or text stay as they are and count
    for nothing. Rows of one id are ordered by a hash of the text; rows of one id
    and text are one document. Texts of any length are compared to the end. A
    column named removed_col is replaced. No rows give no rows.

    A fingerprint carries the hashes of all windows of which it is the least line;
    equal windows have equal fingerprints at equal places, so the windows to both
    sides of a fingerprint tell how far a match extends. The first occurrence of a
    window is a minimum, combined before its shuffle, however frequent the line.
    """
    kept = docs.select(*without(docs, text_col, removed_col), F.col(text_col).cast("string").alias(text_col))
    base = id_text(docs, id_col, text_col).filter("text is not null").select("id", F.xxhash64("text").alias("v"), "text")
    rows = base.mapInArrow(_rows(window), "h long, id long, v long, start int, windows array<long>")
    each = rows.select("id", "v", "start", F.posexplode("windows").alias("o", "window")).select("window", F.struct("id", "v", (F.col("start") + F.col("o")).alias("line")).alias("at"))
    each = written(each, "lines")
    first = each.groupBy("window").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("window", "first")
    later = each.join(first, "window").filter("at > first")
    gone = written(later.groupBy(F.col("at.id").alias("__id"), F.col("at.v").alias("__v")).agg(F.collect_set("at.line").alias("__gone")), "gone")
    if (gone.agg(F.sum(F.size("__gone"))).first()[0] or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    joined = kept.join(gone, (id_of(kept, id_col) == F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__v")), "left")
    names = kept.columns
    plain = joined.select(*(F.col(f"`{c}`") for c in names), "__gone").toDF(*(f"c{i}" for i in range(len(names) + 1)))
    fields = ", ".join(f"c{i} {plain.schema[i].dataType.simpleString()}" for i in range(len(names))) + f", c{len(names)} int"
    clean = plain.mapInArrow(_clean(window), fields).toDF(*names, removed_col)
    order = [c for c in docs.columns if c.lower() != removed_col.lower()]
    return clean.select(*(F.col(f"`{c}`") for c in order), removed_col)
