"""Models in folders: trained once, merged from their parts, and loaded to classify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import require_schema
from . import bayes, logreg
from .blocks import Blocks

#: Columns of each kind of model.
KINDS: dict[str, dict[str, str]] = {
    "logistic": {"member": "int", "feature": "string", "weight": "double"},
    "bayes": {"label": "string", "index": "int", "weight": "double"},
    "categorical": {"label": "string", "feature": "string", "value": "string", "n": "bigint"},
}


def save(model: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Writes the model, or another part of it, to a folder; the parts of an ensemble may be trained apart."""
    model.select(*(F.col(c).cast(t).alias(c) for c, t in KINDS[kind].items())).write.mode(mode).parquet(f"{path}/{kind}")


class Classifier:
    """A stored model of a kind. Parts are merged: members of an ensemble side by side, counts of Bayes by their sums."""

    def __init__(self, spark: SparkSession, path: str, kind: str) -> None:
        """An unknown kind, or a folder with other columns, raises ValueError."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind of model {kind!r}")
        self.kind, parts = kind, require_schema(spark.read.parquet(f"{path}/{kind}"), **KINDS[kind])
        if kind == "logistic":
            if not parts.groupBy("member", "feature").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
                raise ValueError("two weights of one member for one feature")
            self.model = parts
        else:
            value = "n" if kind == "categorical" else "weight"
            self.model = parts.groupBy(*(c for c in parts.columns if c != value)).agg(F.sum(value).alias(value))

    def predict(self, rows: DataFrame | Blocks) -> DataFrame:
        """(id, prediction, score) for logistic, else (id, label, score).

        rows: (id, features map<string,double>) for logistic, (id, index, value) or Blocks
        of it for bayes, (id, features map<string,string>) for categorical.
        """
        if self.kind == "logistic":
            return logreg.predict(rows, self.model, self.model.select("member").distinct().count())
        if self.kind == "bayes":
            return bayes.best(bayes.scores(rows, self.model), 4)
        return bayes.categorical_predict(rows, self.model)
