"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, langid, mixing, near_dedup, sharding
from lexmill.llm.shared import minus, once, small_batches
from lexmill.workspace import new_path, removed, swept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't recognised: ambiguous ones and those without a letter.

    Null and empty texts have no letter and go; rows with a null id and repeated
    rows are judged like others; texts count whole. Equally near languages are
    ambiguous. Other columns, whatever their names, stay. No documents give none.
    """
    names = ("__language", "__lead", "__accepted")
    return langid.identify(docs, langid.train(docs), names=names).filter("__accepted").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; of several rows with one id, that of the least text.

    Rows with a null id stay, all of them; null texts and texts without a word are in
    no group and stay, but a null text goes if its id has another text. Texts are
    compared whole. Of equal rows of one id one stays. Other columns stay. No
    documents give none.
    """
    return once(minus(docs, near_dedup.duplicates(docs).select("doc_id"), "doc_id"), "doc_id", "text")


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap an item of the benchmark.

    All rows of such an id go. Rows with a null id, and null and empty texts, overlap
    nothing and stay. Texts are searched to the end. How good the overlap is, and
    with how many items, doesn't matter, so neither do ties. Other columns stay. No
    documents give none, and an empty benchmark drops none.
    """
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return minus(docs, found.select("doc_id"), "doc_id")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins each source to its target weight.

    Null sources are a source of their own; null and empty texts have no tokens and
    share their source's rate. Rows with a null id draw by their text, and equal rows
    draw alike. Nothing is ranked, so there are no ties. Other columns stay. No
    documents give none.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the number of the shard; copies of a document share one.

    Rows with a null id are one group; null and empty texts take no room; a document
    longer than a shard has one to itself, whole. Equally large documents are taken
    in the order of their ids. Other columns stay, but one named shard is replaced.
    No documents give none.
    """
    return sharding.shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_overlap", benchmark_overlap),
    ("mixture", mixture),
    ("shards", shards),
]

#: Language ID, Order MinHash and spaced seeds aren't expressible in SQL: run() is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage wrote is deleted once the next has read it; the last stays."""
    home = new_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with swept(spark), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
        if k:
            removed(spark, f"{home}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
