"""Language ID by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shared import pieces, without
from .textkit import buffers, lower, seeds, slices

#: Labelled rows a language, at most, that the classifiers are fitted on.
SAMPLE_ROWS = 600
FEATURES = 4096
#: Codewords are this many times as long as log2 of the number of languages, beyond the exhaustive code.
LENGTH = 15
ROUNDS = 120
#: Least lead, in nats of weighted loss, of the nearest codeword over the next; less is ambiguous.
MARGIN = 0.3


class Model(NamedTuple):
    """languages: sorted names; code: a row of -1 and 1 a language; weights: FEATURES + 1 by bits; loss: weight of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    loss: np.ndarray


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: every split of the languages in two if those are few, else fixed random ones."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([(1, *x) for x in product((1, -1), repeat=n - 1)][1:]).T.astype(float)
    bits = int(np.ceil(LENGTH * np.log2(n)))
    best, far = None, -1
    for salt in range(40):
        code = np.where((seeds(n * bits, salt + 99) >> np.uint64(40)).reshape(n, bits) & np.uint64(1), 1.0, -1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits).min()
        if least > far:
            best, far = code, least
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row a text: square roots of hashed counts of byte pairs and triples, letters only, of unit length.

    Digits, punctuation and symbols count as blanks, and runs of blanks as one.
    """
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), dtype=np.float32)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    row = np.repeat(np.arange(n), np.diff(offsets))
    first = np.zeros(len(data), dtype=bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[first] = letter[first]
    x, r = np.where(letter, data, 32)[keep].astype(np.uint32), row[keep]
    if not len(x):
        return out
    p1 = np.append(np.uint32(32), x[:-1])
    p2 = np.append(np.uint32(32), p1[:-1])
    new = np.append(True, r[1:] != r[:-1])
    p1[new] = 32
    p2[new | np.append(True, new[:-1])] = 32
    ends = np.searchsorted(r, np.arange(n + 1))
    pair = ((p1 * np.uint32(0x9E3779B1) + x) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
    triple = (((p2 * np.uint32(0x9E3779B1) + p1) * np.uint32(0xC2B2AE35) + x) * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    for i in range(n):
        a, b = ends[i], ends[i + 1]
        if b > a:
            c = np.bincount(pair[a:b], minlength=FEATURES) + np.bincount(triple[a:b], minlength=FEATURES)
            v = np.sqrt(c)
            out[i] = v / np.sqrt(c.sum())
    return out


def fit(texts: list[str], labels: list[str]) -> Model:
    """A binary classifier a bit, of whole texts; deterministic."""
    return fit_features(features(*buffers(lower(pa.array(texts, pa.string())))), labels)


def fit_features(x: np.ndarray, labels: list[str]) -> Model:
    """The same from the features of the texts, by full-batch logistic regression with momentum."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((FEATURES + 1, 1), np.float32), np.ones(1))
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    at = {lang: i for i, lang in enumerate(languages)}
    which = np.array([at[lang] for lang in labels])
    y = code[which].astype(np.float32)
    share = (1.0 / np.bincount(which))[which]
    w, step = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros((x.shape[1], y.shape[1]), np.float32)
    scale = (share / share.sum()).astype(np.float32)[:, None]
    for _ in range(ROUNDS):
        pull = y / (1 + np.exp(np.clip(y * (x @ w), -30, 30)))
        step = 0.9 * step + x.T @ (pull * scale) * 8.0 - 1e-5 * w
        w += step
    loss = np.log1p(np.exp(-y * (x @ w))).mean(axis=0) + 1e-3
    weight = 1.0 / loss
    return Model(languages, code, w, weight / weight.sum())


def decode(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword by weighted logistic loss, the first of equals, and its lead over the next."""
    loss = np.log1p(np.exp(-np.clip(scores[:, None, :] * model.code[None], -30, 30))) @ model.loss
    if loss.shape[1] < 2:
        return np.zeros(len(loss), dtype=int), np.full(len(loss), np.inf)
    two = np.partition(loss, 1, axis=1)
    return loss.argmin(axis=1), two[:, 1] - two[:, 0]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, hash, and the features that aren't 0 of each text, as places and values in one binary each."""
    for batch in batches:
        data, offsets = buffers(lower(batch.column(2)))
        for i, j in slices(offsets, 1 << 19):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = [np.flatnonzero(row) for row in x]
            places = pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary())
            values = pa.array([row[a].tobytes() for row, a in zip(x, at)], pa.binary())
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), places, values], names=["lang", "h", "places", "vals"])


def train(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Fitted on at most rows labelled rows a language: those whose hash is least among rows with a label and a text.

    The hash is of the id and the text; of equal hashes the least text goes first.
    Whole texts, however long, are counted, in Spark; only their features come to
    the driver, of no more than rows times the number of languages. Rows with a null
    label or text are left out, those with a null id aren't, and of repeated rows
    each may be drawn. No labelled rows give a model without languages.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    labelled = docs.select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h")).filter("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    near = F.lit(False)
    for r in counts:
        # About 1.5 times the rows wanted, and a few; then exactly the least.
        part = min(1.0, (1.5 * rows + 50) / r["n"])
        near = near | ((F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(max(r["least"], int(-(2**63) + part * (2**64 - 1))) if part < 1 else 2**63 - 1)))
    first = Window.partitionBy("lang").orderBy("h", "text")
    drawn = labelled.filter(near).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= rows).select("lang", "h", "text")
    got = sorted(tuple(r) for r in drawn.mapInArrow(_feature_rows, "lang string, h long, places binary, vals binary").collect())
    x = np.zeros((len(got), FEATURES), dtype=np.float32)
    for row, (_, _, places, values) in zip(x, got):
        row[np.frombuffer(places, np.uint16)] = np.frombuffer(values, np.float32)
    return fit_features(x, [r[0] for r in got])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", margin: float = MARGIN, names: tuple[str, str, str] = ("language", "lead", "accepted")) -> DataFrame:
    """docs with three more columns: the language, its lead over the next, and whether it is accepted.

    Whole texts are counted, however long. Not accepted: a lead under the margin
    (ambiguous), and texts without a letter or null, whose language is null. Of
    equally near languages the first in order is given, with a lead of 0. Repeated
    rows are rows of their own, with equal results; ids don't count. Columns of docs
    with the same names are replaced. With no language in the model nothing is
    accepted. No rows give none.
    """
    language, lead, accepted = names
    kept = docs.select(*without(docs, *names))
    last = kept.columns.index(next(c for c in kept.columns if c.lower() == text_col.lower()))
    named = [*kept.columns, language, lead, accepted]
    plain = kept.toDF(*(f"c{i}" for i in range(len(kept.columns))))
    schema = StructType([*plain.schema.fields, StructField("tag", StringType()), StructField("far", DoubleType()), StructField("ok", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = pa.array([*model.languages, None], pa.string())
        for batch in pieces(batches):
            data, offsets = buffers(lower(batch.column(last).cast(pa.string())))
            which, far, known = [], [], []
            for i, j in slices(offsets, 1 << 19):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                has = x.any(axis=1)
                if not model.languages:
                    has[:] = False
                    which.append(np.zeros(j - i, int))
                    far.append(np.zeros(j - i))
                else:
                    w, d = decode(model, x @ model.weights[:-1] + model.weights[-1])
                    which.append(w)
                    far.append(np.where(has, d, 0.0))
                known.append(has)
            if not batch.num_rows:
                continue
            has, d = np.concatenate(known), np.concatenate(far)
            w = np.where(has, np.concatenate(which), len(model.languages))
            yield pa.record_batch([*batch.columns, tags.take(pa.array(w)), pa.array(d), pa.array(has & (d >= margin))], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*named)
