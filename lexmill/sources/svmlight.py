"""Lines "label key:number key:number ..." as labels and feature maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import bound


def _mark(c: str) -> str:
    if len(c) != 1:
        raise ValueError("delimiters are single characters")
    return f"\\Q{c}\\E"


def parsed(line: Column, field: str = " ", pair: str = ":") -> Column:
    """struct(label, features map<string,double>), null for a malformed line; of equal keys the last counts.

    Malformed: no label, a field that isn't key and number. Repeated and trailing
    field delimiters are nothing.
    """
    _mark(pair)

    def halves(s: Column) -> Column:
        at = F.locate(pair, s)
        return F.struct(F.substring_index(s, pair, 1).alias("k"), F.when(at > 0, F.substring(s, at + 1, F.length(s))).try_cast("double").alias("v"))

    def features(placed: Column) -> Column:
        # In a sorted array of (key, place, number) the last of a key is the one whose successor has another key.
        last = F.filter(placed, lambda e, i: F.coalesce(F.get(placed, i + 1)["k"] != e["k"], F.lit(True)))
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))

    def whole(parts: Column, pairs: Column) -> Column:
        good = (F.size(parts) > 0) & ~F.contains(parts[0], F.lit(pair)) & F.forall(pairs, lambda e: e["v"].isNotNull() & (e["k"] != ""))
        placed = F.sort_array(F.transform(pairs, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
        return F.when(good, F.struct(parts[0].alias("label"), bound(placed, features).alias("features")))

    def split(parts: Column) -> Column:
        return bound(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), halves), lambda pairs: whole(parts, pairs))

    return bound(F.filter(F.split(line, _mark(field)), lambda s: s != ""), split)


def read(spark: SparkSession, path: str, field: str = " ", pair: str = ":", corrupt: str | None = None) -> DataFrame:
    """(label, features); malformed lines are left out, and written as text to the folder corrupt if one is given."""
    lines = spark.read.text(path)
    rows = lines.filter("trim(value) <> ''").select("value", parsed(F.col("value"), field, pair).alias("p"))
    if corrupt:
        rows.filter("p is null").select("value").write.mode("overwrite").text(corrupt)
    return rows.filter("p is not null").select("p.label", "p.features")


def line_of(label: Column, features: Column, field: str = " ", pair: str = ":") -> Column:
    """The line of a label and a feature map, keys in order."""
    keys = F.array_sort(F.map_keys(features))
    return F.concat_ws(field, label.cast("string"), F.transform(keys, lambda k: F.concat(k, F.lit(pair), F.element_at(features, k).cast("string"))))
