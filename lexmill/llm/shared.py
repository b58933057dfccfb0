"""Folders and columns that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..workspace import BATCH_ROWS, kept, shared_dir, small_batches


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    with small_batches(df.sparkSession):
        return kept(df, name)


def without(df: DataFrame, *names: str) -> list[Column]:
    """Columns of df but those of these names, whatever their case."""
    low = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in low]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of no more than so many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows, equal in the first columns, as rows come sorted by these; several groups in a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[-1] for k in range(keys)]
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] == last[k] for k in range(keys)):
            held.append(batch)
            continue
        # Rows are sorted: those that equal the last one are at the end.
        lo, hi = 0, batch.num_rows - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if all(batch.column(k)[mid] == last[k] for k in range(keys)):
                hi = mid
            else:
                lo = mid + 1
        if held or lo:
            yield pa.Table.from_batches([*held, batch.slice(0, lo)])
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held)


def edges_of(table: pa.Table, keys: int) -> np.ndarray:
    """Places where groups of the first columns begin, and the number of rows last."""
    cols = [table.column(k).to_numpy() for k in range(keys)]
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def id_of(df: DataFrame, id_col: str) -> Column:
    """The id as a long; ValueError if its type isn't that of an integer."""
    kind = df.select(F.col(id_col)).schema[0].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError(f"{id_col} is {kind.simpleString()}: ids are integers, number others first")
    return F.col(id_col).cast("long")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key, as a long named id, and the text; rows without a key are dropped."""
    return df.select(id_of(df, id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")


#: Ids up to which a set of rows to be kept or dropped is sent to all executors: 16 MB of longs.
BROADCAST_IDS = 2_000_000


def _joined(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    some = cut(ids.toDF("__some").distinct())
    if some.count() <= BROADCAST_IDS:
        some = F.broadcast(some)
    return docs.join(some, id_of(docs, id_col) == F.col("__some"), how)


def minus(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id_col is among ids (one column); rows without an id stay."""
    return _joined(docs, ids, id_col, "left_anti")


def only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id_col is among ids (one column)."""
    return _joined(docs, ids, id_col, "left_semi")


def once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row an id, that of the least text, null after all others; rows without an id stay."""
    many = cut(docs.filter(F.col(id_col).isNotNull()).groupBy(id_of(docs, id_col).alias("id")).agg(F.count("*").alias("__n")).filter("__n > 1").select("id"))
    if many.isEmpty():
        return docs
    order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    one = docs.join(many, id_of(docs, id_col) == F.col("id"), "left_semi").withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")
    return minus(docs, many, id_col).unionByName(one)
