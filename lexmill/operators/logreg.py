"""Logistic regression: an ensemble of members, each fitted by one pass of gradient steps over its rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + exp(-x)) if x >= 0 else exp(x) / (1.0 + exp(x))


def fit(rows: list[tuple[int, dict[str, float]]], rate: float = RATE, theta: dict[str, float] | None = None) -> dict[str, float]:
    """Weights after one pass: from zero, without intercept, each row moves the weights of its features."""
    theta = {} if theta is None else theta
    for label, features in rows:
        error = label - sigmoid(sum(x * theta.get(k, 0.0) for k, x in features.items()))
        for k, x in features.items():
            theta[k] = theta.get(k, 0.0) + rate * error * x
    return theta


def train(rows: DataFrame, members: int = 1, rate: float = RATE, key: str = "id", seed: int = 0) -> DataFrame:
    """(member, feature, weight) from (key, label int, features map<string,double>).

    Rows are dealt to members by a hash of the key, and taken in the order of
    another; rows with a null label or without features are skipped. The steps of a
    member follow one another, so more rows are met by more members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        thetas: dict[int, np.ndarray] = {}
        for batch in batches:
            features = batch.column(2)
            keys = features.keys.dictionary_encode()
            known = np.array([place.setdefault(k, len(place)) for k in keys.dictionary.to_pylist()], dtype=np.int64)
            at, x = known[keys.indices.to_numpy(zero_copy_only=False)], features.items.to_numpy(zero_copy_only=False)
            edge = features.offsets.to_numpy()
            for member, label, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), edge, edge[1:]):
                theta = thetas.get(member)
                if theta is None or len(theta) < len(place):
                    theta = thetas[member] = np.append(np.zeros(0) if theta is None else theta, np.full(2 * len(place) - (0 if theta is None else len(theta)), np.nan))
                w = np.nan_to_num(theta[at[a:b]])
                theta[at[a:b]] = w + rate * (label - sigmoid(float(x[a:b] @ w))) * x[a:b]
        names = np.array(list(place), dtype=object)
        for member, theta in thetas.items():
            seen = np.flatnonzero(~np.isnan(theta[: len(names)]))  # features that the member met
            yield pa.record_batch([pa.array(np.full(len(seen), member), pa.int32()), pa.array(names[seen], pa.string()), pa.array(theta[seen])], names=["member", "feature", "weight"])

    used = rows.filter(F.col("label").isNotNull() & (F.size("features") > 0))
    dealt = used.select(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(members)).cast("int").alias("member"), F.col("label").cast("int").alias("label"), "features", F.xxhash64(key, F.lit(seed + 1)).alias("turn"))
    lined = dealt.repartitionById(members, F.col("member")).sortWithinPartitions("member", "turn").select("member", "label", "features")
    return lined.mapInArrow(run, "member int, feature string, weight double")


def predict(rows: DataFrame, model: DataFrame, members: int) -> DataFrame:
    """(id, prediction, score) for (id, features): 1 where the mean of the members' sigmoids is 0.5 or more.

    Features that a member doesn't know add nothing; a member that knows none says 0.5.
    """
    each = rows.select("id", F.explode("features").alias("feature", "x"))
    dots = each.join(model, "feature").groupBy("id", "member").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    said = dots.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("dot")))).alias("sum"), F.count("*").alias("n"))
    score = (F.coalesce("sum", F.lit(0.0)) + (members - F.coalesce("n", F.lit(0))) * 0.5) / members
    return rows.select("id").join(said, "id", "left").select("id", (F.round(score, 9) >= 0.5).cast("int").alias("prediction"), F.round(score, 6).alias("score"))
