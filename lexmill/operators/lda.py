"""Latent Dirichlet allocation by collapsed variational Bayes (CVB0), one pass over the documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_schema
from ..sources.files import RollingStore
from . import blocks
from .blocks import Blocks
from .relational import reservoir


@dataclass(frozen=True)
class Params:
    """topics; alpha and eta smooth; doc_iterations: inner rounds a document; weight: factor of the counts of the pass before."""

    topics: int = 5
    alpha: float = 0.0001
    eta: float = 0.0001
    doc_iterations: int = 10
    weight: float = 1.0


def initial(freq: DataFrame | Blocks, p: Params) -> DataFrame:
    """(index, counts): start counts by formula for every word of (id, index, value)."""
    return _indices(freq).select("index", F.array(*(F.lit(1.0) + F.pmod(F.col("index") * 31 + z * 17, F.lit(101)) / F.lit(101.0) for z in range(p.topics))).alias("counts"))


def randomly(freq: DataFrame | Blocks, p: Params, seed: int = 0) -> DataFrame:
    """(index, counts): start counts uniform in [0, 1) by a seeded hash."""
    draw: list[Column] = [F.pmod(F.xxhash64("index", F.lit(z), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) for z in range(p.topics)]
    return _indices(freq).select("index", F.array(*draw).alias("counts"))


def _indices(freq: DataFrame | Blocks) -> DataFrame:
    return freq.indices() if isinstance(freq, Blocks) else freq.select("index").distinct()


def _inputs(freq: DataFrame | Blocks, model: DataFrame, p: Params) -> tuple[Blocks, DataFrame, np.ndarray, int]:
    """Blocks, their words with the words' counts, counts by topic and number of words.

    Only a block's own words travel to it, once each, so that the model may be of any size.
    """
    size, *sums = model.agg(F.count("*"), *(F.coalesce(F.sum(F.get("counts", z)), F.lit(0.0)) for z in range(p.topics))).first()
    found, zero = blocks.of(freq), F.array(*(F.lit(0.0) for _ in range(p.topics)))
    words = found.side(blocks.WORDS, found.words.join(model, "index", "left"), F.coalesce("counts", zero))
    return found, words, np.array(sums, dtype=float), int(size)


def infer(begin: np.ndarray, value: np.ndarray, counts: np.ndarray, sums: np.ndarray, words: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Topic shares of each document, and value * P(topic | word, document) of each entry.

    begin: first entry of each document, none of them empty. Shares start even.
    """
    # A row a topic, so that sums over topics and over the entries of a document are of whole rows.
    like = np.ascontiguousarray(counts.T) * p.weight
    like += p.eta
    like /= (sums * p.weight + p.eta * words)[:, None]
    sizes = np.diff(np.append(begin, len(value)))
    theta = np.full((p.topics, len(begin)), 1.0 / p.topics)
    q = np.zeros_like(like)
    for _ in range(p.doc_iterations):
        np.multiply(like, np.repeat(theta + p.alpha, sizes, axis=1), out=q)
        q *= value / q.sum(axis=0)
        theta = np.add.reduceat(q, begin, axis=1)
        theta /= theta.sum(axis=0)
    return theta.T, q.T


def _solved(batches: Iterator[pa.RecordBatch], sums: np.ndarray, words: int, p: Params) -> Iterator[tuple[blocks.Words, Iterator[tuple]]]:
    """Each block's words, and its documents with entries, their topic shares and the entries' parts."""
    for w, _, chunks in blocks.met(batches):
        yield w, ((c, *infer(c.begin(), c.value, w.p[c.at], sums, words, p)) for c in filter(None, map(blocks.nonempty, chunks)))


def train(freq: DataFrame | Blocks, model: DataFrame, p: Params) -> DataFrame:
    """(index, counts): the model after one pass, sums of the documents' expected counts."""
    found, side, sums, words = _inputs(freq, model, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, docs in _solved(batches, sums, words, p):
            part = np.zeros_like(w.p)
            for c, _, q in docs:
                blocks.summed(part, c.at, q)
            for i in range(0, len(part), blocks.ROWS):
                yield pa.record_batch([pa.array(w.index[i : i + blocks.ROWS], pa.int32()), *(pa.array(part[i : i + blocks.ROWS, z]) for z in range(p.topics))], names=["index", *(f"t{z}" for z in range(p.topics))])

    schema = "index int, " + ", ".join(f"t{z} double" for z in range(p.topics))
    parts = found.meet(run, schema, side).groupBy("index").agg(*(F.sum(f"t{z}").alias(f"t{z}") for z in range(p.topics)))
    return parts.select("index", F.array(*(f"t{z}" for z in range(p.topics))).alias("counts"))


def inference(freq: DataFrame | Blocks, model: DataFrame, p: Params) -> DataFrame:
    """(id, shares array<double>): P(topic | document)."""
    found, side, sums, words = _inputs(freq, model, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs in _solved(batches, sums, words, p):
            for c, theta, _ in docs:
                yield blocks.listed(c.ids, shares=pa.array(list(theta), pa.list_(pa.float64())))

    return found.meet(run, f"id {found.id_type}, shares array<double>", side)


def perplexity(freq: DataFrame | Blocks, model: DataFrame, p: Params) -> DataFrame:
    """(id, words, loss): sum of the counts, and negative log-likelihood, of each document."""
    found, side, sums, words = _inputs(freq, model, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, docs in _solved(batches, sums, words, p):
            for c, theta, _ in docs:
                share = (theta + p.alpha) / (1 + p.topics * p.alpha)
                like = (w.p[c.at] * p.weight + p.eta) / (sums * p.weight + p.eta * words)
                loss = -c.value * np.log((share[c.row()] * like).sum(axis=1))
                yield blocks.listed(c.ids, words=np.add.reduceat(c.value, c.begin()), loss=np.add.reduceat(loss, c.begin()))

    return found.meet(run, f"id {found.id_type}, words double, loss double", side)


def loss_per_word(scored: DataFrame) -> DataFrame:
    return scored.agg(F.sum("words").alias("words"), F.sum("loss").alias("loss")).select((F.col("loss") / F.col("words")).alias("loss_per_word"))


def finished(model: DataFrame, p: Params) -> DataFrame:
    """(topic, index, value): each topic's counts divided by their sum."""
    rows = model.select("index", F.posexplode("counts").alias("topic", "value"))
    sums = rows.groupBy("topic").agg(F.sum("value").alias("__all"))
    return rows.join(F.broadcast(sums), "topic").select("topic", "index", F.coalesce(F.try_divide("value", "__all"), F.lit(0.0)).alias("value"))


def main_topics(shares: DataFrame) -> DataFrame:
    """(id, topic): the largest share, the lowest topic among equals."""
    at = F.array_max(F.transform("shares", lambda x, i: F.struct(F.round(x, 6).alias("x"), (-i).alias("t"))))
    return shares.select("id", (-at["t"]).cast("int").alias("topic"))


def topic_counts(topics: DataFrame) -> DataFrame:
    return topics.groupBy("topic").agg(F.count("*").alias("n"))


def titles(topics: DataFrame, names: DataFrame, k: int = 10, seed: str = "titles") -> DataFrame:
    """(topic, title): k random documents of each topic, from (id, topic) and (id, title)."""
    return reservoir(topics, k, "topic", "id", seed).join(names, "id").select("topic", "title")


def load_model(store: RollingStore, n: int | None = None) -> DataFrame:
    """(index, counts) of an iteration, the last by default; another schema raises ValueError."""
    return require_schema(store.load(n), index="int", counts="array<double>")


def keywords(finished_model: DataFrame, terms: DataFrame, k: int = 50, digits: int = 9) -> DataFrame:
    """(topic, rank, term, value): the k most probable terms of each topic, by rounded probability, then index."""
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("value", digits)), "index")
    best = finished_model.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(terms, "index").select("topic", "rank", "term", F.round("value", digits).alias("value"))
