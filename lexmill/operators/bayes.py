"""Naive Bayes: the standard kind over weighted terms, and the categorical kind over (feature, value) pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.values import small_label
from ..workspace import small
from . import blocks
from .blocks import Blocks
from .relational import numbered

DEFAULT = "DEFAULT"
ALPHA = 1.0


def label_index(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, index): distinct labels numbered from 0 in their order; null isn't one."""
    return numbered(labels.select(F.col(label).cast("string").alias("label")).filter("label is not null").distinct(), "label")


def label_names(rows: DataFrame, index: DataFrame, column: str = "index") -> DataFrame:
    """rows with the label of an index, DEFAULT for unknown ones."""
    named = index.select(F.col("index").alias("__index"), F.col("label").alias("__label"))
    return rows.join(named, rows[column] == named["__index"], "left").withColumn("label", F.coalesce("__label", F.lit(DEFAULT))).drop("__index", "__label")


def train(entries: DataFrame) -> DataFrame:
    """(label, index, weight): sums of values, from (label, index, value)."""
    return entries.groupBy("label", "index").agg(F.sum("value").alias("weight"))


def block_train(found: Blocks, labels: DataFrame) -> DataFrame:
    """(label, index, weight) as train, of the entries of blocks and (id, label); sums leave a block once a label and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in blocks.parted(batches):
            place = w = tags = None
            sums = blocks.Sums()
            for part, rows in parts:
                if part == blocks.WORDS:
                    place, w = blocks.words_of(rows)
                elif part == blocks.DOCS:
                    at, tags = zip(*((b.column("at").to_numpy(), b.column("tag")) for b in rows))
                    at, tags = np.concatenate(at), pa.chunked_array(tags).combine_chunks().dictionary_encode(null_encoding="encode")
                    order = np.argsort(at, kind="stable")
                    at, code = at[order], tags.indices.to_numpy()[order].astype(np.int64)
                elif w is not None and tags is not None:
                    for c in blocks.chunks_of(rows, place):
                        lo, hi = np.searchsorted(at, (c.place[0], c.place[-1] + 1)) if len(c.place) else (0, 0)
                        doc = at[lo:hi] - c.place[0] if hi > lo else np.zeros(0, dtype=np.int64)
                        size = c.sizes[doc]
                        entry = np.repeat(c.begin()[doc] - np.cumsum(size) + size, size) + np.arange(size.sum())
                        if len(entry):
                            sums.add(np.repeat(code[lo:hi], size) * len(w.index) + c.at[entry], c.value[entry])
            key, value = sums.get()
            for i in range(0, len(key), blocks.ROWS):
                label, at_word = np.divmod(key[i : i + blocks.ROWS], len(w.index))
                yield pa.record_batch([tags.dictionary.take(pa.array(label)), pa.array(w.index[at_word], pa.int32()), pa.array(value[i : i + blocks.ROWS])], names=["label", "index", "weight"])

    docs = found.places().join(labels, "id")
    parts = found.meet(run, "label string, index int, weight double", found.side(blocks.WORDS, found.words), found.side(blocks.DOCS, docs, tag=F.col("label").cast("string")))
    return parts.groupBy("label", "index").agg(F.sum("weight").alias("weight"))


def label_weights(model: DataFrame) -> DataFrame:
    return model.groupBy("label").agg(F.sum("weight").alias("weight"))


def feature_weights(model: DataFrame) -> DataFrame:
    return model.groupBy("index").agg(F.sum("weight").alias("weight"))


def scores(docs: DataFrame | Blocks, model: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(id, label, score) for (id, index, value): sum of value * ln((w + alpha) / (label's weight + alpha * V)).

    V: number of features of the model. A feature that a label lacks has weight 0,
    so only the pairs that the model has go to the blocks that have the feature, and
    the rest is a product with the document's total.
    """
    found, base = blocks.of(docs), float(alpha)
    features = model.agg(F.countDistinct("index").alias("v"))
    bottoms = label_weights(model).crossJoin(features).select("label", (F.lit(base) * F.col("v") + F.col("weight")).alias("p"))
    lift = model.filter("label is not null").select("label", "index", F.log((F.col("weight") + alpha) / F.lit(base)).alias("p"))

    def scored(held: list, lifts: np.ndarray, bottom: float, label: str | None) -> Iterator[pa.RecordBatch]:
        for ids, sizes, at, value in held:
            begin = np.cumsum(sizes) - sizes
            score = np.add.reduceat(value * lifts[at], begin) + np.add.reduceat(value.astype(float), begin) * np.log(base / bottom)
            yield blocks.listed(ids, label=pa.array([label] * len(ids), pa.string()), score=score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in blocks.parted(batches):
            place, w, held = None, None, []
            for part, rows in parts:
                if part == blocks.WORDS:
                    place, w = blocks.words_of(rows)
                elif part == blocks.CHUNKS and w is not None:
                    held = [(c.ids, c.sizes, c.at, blocks.narrow(c.value)) for c in filter(None, map(blocks.nonempty, blocks.chunks_of(rows, place)))]
                elif part == blocks.AFTER and held:
                    # A label's first row, before the block's words, has the bottom of its fractions.
                    label = bottom = lifts = None
                    for b in rows:
                        at, p = b.column("at").to_numpy(), blocks.numbers(b, "p")[:, 0]
                        starts = np.flatnonzero(at < 0)
                        for lo, hi in zip(np.append(0, starts), np.append(starts, len(at))):
                            if hi == lo:
                                continue
                            if at[lo] < 0:
                                if lifts is not None:
                                    yield from scored(held, lifts, bottom, label)
                                label, bottom, lifts = b.column("tag")[int(lo)].as_py(), p[lo], np.zeros(len(w.index))
                                lo += 1
                            lifts[place[at[lo:hi]]] = p[lo:hi]
                    yield from scored(held, lifts, bottom, label)

    all_blocks = found.chunks.select("block").distinct()
    known = found.words.join(lift, "index").select("block", "at", "label", "p").unionByName(all_blocks.crossJoin(small(bottoms)).select("block", F.lit(-1).alias("at"), "label", "p"))
    return found.meet(run, f"id {found.id_type}, label string, score double", found.side(blocks.WORDS, found.words), found.side(blocks.AFTER, known, F.array("p"), F.col("label")))


def best(scored: DataFrame, digits: int = 6) -> DataFrame:
    """(id, label, score): the label of the highest rounded score, the first in order among equals."""
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("rounded"), "label")
    ranked = scored.withColumn("rounded", F.round("score", digits)).withColumn("k", F.row_number().over(order)).filter("k = 1")
    return ranked.select("id", F.when(F.col("rounded").isNull(), DEFAULT).otherwise(F.col("label")).alias("label"), F.col("rounded").alias("score"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(actual, class, n) from (actual, class)."""
    return pairs.groupBy("actual", "class").agg(F.count("*").alias("n"))


def confusion_text(rows: list[Row]) -> str:
    """The counts as a table; lines and columns are the labels that occur as actual or class, DEFAULT last."""
    count = {(r["actual"], r["class"]): r["n"] for r in rows}
    labels = sorted({x for pair in count for x in pair}, key=lambda x: (x == DEFAULT, x))
    short = [small_label(i).ljust(5) for i in range(len(labels))]
    rule, thin = "=" * 55, "-" * 55
    lines = [rule, "Confusion Matrix", thin, "".join(s + "\t" for s in short) + "<--Classified as"]
    for name, s in zip(labels, short):
        cells = [count.get((name, other), 0) for other in labels]
        lines.append("".join(str(n).ljust(5) + "\t" for n in cells) + f" |  {str(sum(cells)).ljust(6)}\t{s} = {name}")
    return "\n".join(lines) + "\n"


def accuracy(pairs: DataFrame) -> DataFrame:
    """(result, n): match and mismatch."""
    same = F.when(F.col("actual").eqNullSafe(F.col("class")), "match").otherwise("mismatch")
    return pairs.select(same.alias("result")).groupBy("result").agg(F.count("*").alias("n"))


def categorical_train(rows: DataFrame) -> DataFrame:
    """(label, feature, value, n) from (label, features map<string,string>)."""
    each = rows.filter("label is not null").select("label", F.explode("features").alias("feature", "value"))
    return each.groupBy("label", "feature", "value").agg(F.count("*").alias("n"))


def categorical_predict(rows: DataFrame, model: DataFrame, prior: str = "reference", documents: DataFrame | None = None) -> DataFrame:
    """(id, label, score) for (id, features): the label of the highest log of N / total * product of (n + 1) / (N + P).

    N: distinct features of the label; P: its (feature, value) pairs; total: sum of
    N. With prior="documents" the first factor is the label's share of documents
    (label, n). Ties go to the first label in order.
    """
    sizes = model.groupBy("label").agg(F.countDistinct("feature").alias("nf"), F.count("*").alias("np"))
    if prior == "reference":
        share = sizes.crossJoin(sizes.agg(F.sum("nf").alias("all"))).select("label", F.log(F.col("nf") / F.col("all")).alias("prior"), F.log((F.col("nf") + F.col("np")).cast("double")).alias("bottom"))
    elif prior == "documents":
        total = documents.agg(F.sum("n").alias("all"))
        share = sizes.join(documents, "label").crossJoin(total).select("label", F.log(F.col("n") / F.col("all")).alias("prior"), F.log((F.col("nf") + F.col("np")).cast("double")).alias("bottom"))
    else:
        raise ValueError(f"unknown prior {prior!r}")
    each = rows.select("id", F.explode("features").alias("feature", "value"))
    hits = each.join(model, ["feature", "value"]).groupBy("id", "label").agg(F.sum(F.log((F.col("n") + 1).cast("double"))).alias("lift"))
    size = rows.select("id", F.size("features").alias("nx"))
    pairs = size.crossJoin(small(share)).join(hits, ["id", "label"], "left")
    scored = pairs.select("id", "label", (F.col("prior") + F.coalesce("lift", F.lit(0.0)) - F.col("nx") * F.col("bottom")).alias("score"))
    return best(scored)
