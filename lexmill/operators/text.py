"""From texts to TF-IDF vectors as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import from_long
from . import blocks
from .blocks import Blocks
from .relational import numbered

TOKEN = "[\\p{L}\\p{N}]+"
ENGLISH_STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def standard(text: Column) -> Column:
    """Lower-case runs of letters and digits but English stop words."""
    return tokens_of(text, ENGLISH_STOP_WORDS)


def simple(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), F.lit(0))


def whitespace(text: Column) -> Column:
    """What blanks part, in the case that it has."""
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def keyword(text: Column) -> Column:
    """The text as one token."""
    return F.when(text.isNotNull(), F.array(text))


#: Analyzers by name.
ANALYZERS: dict[str, Callable[[Column], Column]] = {f.__name__: f for f in (standard, simple, whitespace, keyword)}


def tokens_of(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept; null for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    stop = list(stop_words)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words: Iterable[str] = (), analyzer: str | Callable[[Column], Column] | None = None) -> DataFrame:
    """(name, tokens); rows with a null key or text are dropped.

    analyzer: one of ANALYZERS by name, or any function from a text column to one of
    tokens; by default runs of letters and digits without the stop words given.
    """
    if isinstance(analyzer, str):
        if analyzer not in ANALYZERS:
            raise ValueError(f"unknown analyzer {analyzer!r}")
        analyzer = ANALYZERS[analyzer]
    tokens = analyzer(F.col(text)) if analyzer else tokens_of(F.col(text), stop_words)
    return docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("name"), tokens.alias("tokens"))


def counts(tokens: DataFrame, stop_words: Iterable[str] = ()) -> DataFrame:
    """(name, term, n): occurrences of each term but the stop words in each document."""
    terms, stop = tokens.select("name", F.explode("tokens").alias("term")), list(stop_words)
    return (terms.filter(~F.col("term").isin(stop)) if stop else terms).groupBy("name", "term").agg(F.count("*").alias("n"))


def term_totals(count: DataFrame, least: int = 2) -> DataFrame:
    """(term, n): occurrences in all documents, from least on."""
    return count.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def dictionary(count: DataFrame, least: int = 2) -> DataFrame:
    """(term, index): terms that occur at least so often, numbered from 0 in their order."""
    return numbered(term_totals(count, least).select("term"), "term")


def tf(count: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, index, value): counts of the terms of a dictionary."""
    return count.join(terms, "term").select(F.col("name").alias("id"), "index", F.col("n").cast("double").alias("value"))


def vectors_of(entries: DataFrame, names: DataFrame, cardinality: int) -> DataFrame:
    """(id, vector) for every id of names from (id, index, value); an id without entries has an empty vector."""
    known = from_long(entries, cardinality)
    empty = F.from_json(F.lit(f'{{"cardinality": {cardinality}, "features": []}}'), known.schema["vector"].dataType)
    return names.select("id").join(known, "id", "left").select("id", F.coalesce("vector", empty).alias("vector"))


def tf_vectors(tokens: DataFrame, count: DataFrame, terms: DataFrame, cardinality: int) -> DataFrame:
    """(id, vector) of all documents; those without a term of the dictionary have no entries."""
    return vectors_of(tf(count, terms), tokens.select(F.col("name").alias("id")), cardinality)


def df(freq: DataFrame) -> DataFrame:
    """(index, df): documents with each term."""
    return freq.groupBy("index").agg(F.count("*").alias("df"))


def df_merged(*tables: DataFrame) -> DataFrame:
    """(index, df) of several parts of a corpus together."""
    return reduce(DataFrame.unionByName, tables).groupBy("index").agg(F.sum("df").alias("df"))


def df_distribution(dfs: DataFrame) -> DataFrame:
    """(max_feature, num_feature, max_frequency, total_frequency)."""
    return dfs.agg(F.max("index").alias("max_feature"), F.count("*").alias("num_feature"), F.max("df").alias("max_frequency"), F.sum("df").alias("total_frequency"))


def idf(dfs: DataFrame, total: DataFrame, min_df: int = 1, max_percent: int = 80) -> DataFrame:
    """(index, idf) of the terms of (index, df) that count: ln(N / (df + 1)) + 1.

    total: one row with the number of documents, N. Terms need min_df documents at
    least and floor(N * max_percent / 100) at most; 0 means no upper limit.
    """
    weighed = dfs.crossJoin(F.broadcast(total.toDF("total")))
    most = F.floor(F.col("total") * max_percent / F.lit(100))
    keep = weighed.filter((F.col("df") >= min_df) & ((most == 0) | (F.col("df") <= most)))
    return keep.select("index", (F.log(F.col("total") / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(freq: DataFrame, total: DataFrame, min_df: int = 1, max_percent: int = 80) -> DataFrame:
    """(id, index, value): sqrt(tf) * idf."""
    weights = idf(df(freq), total, min_df, max_percent)
    return freq.join(weights, "index").select("id", "index", (F.sqrt(F.floor("value")) * F.col("idf")).alias("value"))


def _weight(c: blocks.Chunk, w: blocks.Words) -> np.ndarray:
    return np.sqrt(np.floor(c.value)) * w.p[c.at, 0]


def block_tfidf(found: Blocks, weights: DataFrame) -> DataFrame:
    """(id, index, value) as tfidf, from blocks and (index, idf)."""
    return found.entries(_weight, found.words.join(weights, "index"), F.array("idf"))


def block_tfidf_vectors(found: Blocks, weights: DataFrame, cardinality: int) -> DataFrame:
    """(id, vector) of all documents; those without a weighed term have no entries."""
    return found.vectors(cardinality, _weight, found.words.join(weights, "index"), F.array("idf"))


def block_top_terms(found: Blocks, weights: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(id, rank, term, value) as top_terms of block_tfidf. Only what may be among the k heaviest leaves a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, _, chunks in blocks.met(batches):
            for c in filter(None, map(blocks.nonempty, chunks)):
                value, row = _weight(c, w), c.row()
                order = np.lexsort((-value, row))
                least = value[order][c.begin() + np.minimum(c.sizes, k) - 1]
                keep = value >= least[row] - 2e-6  # rounding may make equal what differs by 1e-6
                offsets = np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(c.sizes)))).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array(w.index[c.at[keep]], pa.int32()), pa.array(value[keep])], names=["index", "value"])
                yield blocks.listed(c.ids, best=pa.ListArray.from_arrays(pa.array(offsets), entries))

    best = found.meet(run, f"id {found.id_type}, best array<struct<index:int,value:double>>", found.side(blocks.WORDS, found.words.join(weights, "index"), F.array("idf")))
    ranked = F.slice(F.sort_array(F.transform("best", lambda e: F.struct((-F.round(e["value"], 6)).alias("value"), e["index"].alias("index")))), 1, k)
    rows = best.select("id", F.posexplode(ranked).alias("rank", "e")).select("id", (F.col("rank") + 1).alias("rank"), F.col("e.index").alias("index"), (-F.col("e.value")).alias("value"))
    return rows.join(terms, "index").select("id", "rank", "term", "value")


def block_rows(found: Blocks, rows: DataFrame) -> DataFrame:
    """(id, index, value): entries under the numbers of (id, row) instead of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, docs, chunks in blocks.met(batches):
            for c in filter(None, map(blocks.nonempty, chunks) if docs is not None else ()):
                number = blocks.about(docs, c)[c.row(), 0]
                some = ~np.isnan(number)
                yield blocks.listed(pa.array(number[some].astype(np.int32)), index=w.index[c.at[some]].astype(np.int32), value=c.value[some])

    places = found.places().join(rows, "id")
    return found.meet(run, "id int, index int, value double", found.side(blocks.WORDS, found.words), found.side(blocks.DOCS, places, F.array(F.col("row").cast("double"))))


def row_ids(names: DataFrame, name: str = "name") -> DataFrame:
    """(id, name): names numbered from 0 in their order."""
    return numbered(names.select(F.col(name).cast("string").alias("name")).distinct(), "name", "id").select("id", "name")


def top_terms(weights: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(id, term, value): the k heaviest terms of each document, by rounded weight, then index."""
    order = Window.partitionBy("id").orderBy(F.desc(F.round("value", 6)), "index")
    best = weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(terms, "index").select("id", "rank", "term", F.round("value", 6).alias("value"))
