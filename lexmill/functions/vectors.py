"""Arithmetic on single vectors. A null vector gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VECTOR, bound, to_dense, vector


def _values(v: Column) -> Column:
    return F.transform(v["features"], lambda e: e["value"])


def _each(v: Column, change) -> Column:
    """change applied to every stored value; values that become zero are dropped."""
    moved = F.transform(v["features"], lambda e: F.struct(e["index"].alias("index"), change(e["value"]).alias("value")))
    return F.when(v.isNotNull(), vector(v["cardinality"], F.filter(moved, lambda e: e["value"] != 0)))


def zsum(v: Column) -> Column:
    """Sum of the values."""
    return F.aggregate(_values(v), F.lit(0.0), lambda a, x: a + x)


def norm(v: Column, power: float) -> Column:
    """p-norm, for p of 1 or more, or infinity."""
    if power == 1:
        return F.aggregate(_values(v), F.lit(0.0), lambda a, x: a + F.abs(x))
    if power == float("inf"):
        return F.aggregate(_values(v), F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return F.aggregate(_values(v), F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(float(power))), lambda a: F.pow(a, F.lit(1.0 / power)))


def divide(v: Column, by: Column) -> Column:
    """Every value divided by a number; by zero gives a vector without entries."""
    return _each(v, lambda x: F.coalesce(F.try_divide(x, by.cast("double")), F.lit(0.0)))


def times(v: Column, by: Column) -> Column:
    return _each(v, lambda x: x * by.cast("double"))


def norm1(v: Column) -> Column:
    """The vector divided by the sum of absolute values."""
    return divide(v, norm(v, 1))


def normalize(v: Column, power: float) -> Column:
    return divide(v, norm(v, power))


def log_normalize(v: Column, power: float = 2.0) -> Column:
    """ln(1 + x) / (norm * ln p), for p above 1."""
    if power <= 1 or power == float("inf"):
        raise ValueError("the power of a log norm is finite and above 1")
    scale = norm(v, power) * F.log(F.lit(float(power)))
    return _each(v, lambda x: F.coalesce(F.try_divide(F.log1p(x), scale), F.lit(0.0)))


def plus(v: Column, number: Column) -> Column:
    """The number added to every slot, stored or not."""
    slots = F.transform(to_dense(v), lambda x, i: F.struct(i.cast("int").alias("index"), (x + number.cast("double")).alias("value")))
    return F.when(v.isNotNull(), vector(v["cardinality"], F.filter(slots, lambda e: e["value"] != 0)))


def minus(v: Column, number: Column) -> Column:
    return plus(v, -number)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors; those of different cardinality fail the job."""
    # Entries of both in order of their indices: equal ones are next to each other.
    products = lambda both: F.transform(both, lambda e, i: F.when(F.get(both, i + 1)["index"] == e["index"], e["value"] * F.get(both, i + 1)["value"]).otherwise(0.0))
    total = F.aggregate(bound(F.array_sort(F.concat(a["features"], b["features"])), products), F.lit(0.0), lambda s, x: s + x)
    return F.when(a["cardinality"] == b["cardinality"], total).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of different cardinality")).cast("double"))


def max_value(v: Column) -> Column:
    """Largest value; slots that aren't stored are zeros."""
    most = F.array_max(_values(v))
    return F.when(F.size(v["features"]) < v["cardinality"], F.greatest(most, F.lit(0.0))).otherwise(most)


def max_index(v: Column) -> Column:
    """Index of the largest value, the lowest of equals; slots that aren't stored are zeros."""
    best = F.array_max(F.transform(v["features"], lambda e: F.struct(e["value"].alias("value"), (-e["index"]).alias("at"))))
    indices = F.transform(v["features"], lambda e: e["index"])
    # The first slot that isn't stored: entries are sorted, so the first whose place isn't its index.
    gap = F.coalesce(F.array_min(F.filter(F.transform(indices, lambda x, i: F.when(x != i, i.cast("int"))), lambda i: i.isNotNull())), F.size(indices))
    stored = -best["at"]
    return F.when(F.size(indices) >= v["cardinality"], stored).when(best.isNull() | (best["value"] < 0), gap).when(best["value"] == 0, F.least(stored, gap)).otherwise(stored)


def _by_value(v: Column) -> Column:
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(a["index"] - b["index"])
    return F.array_sort(v["features"], order)


def top_values(v: Column, n: int) -> Column:
    """The n largest stored values, descending."""
    return F.transform(F.slice(_by_value(v), 1, n), lambda e: e["value"])


def top_indices(v: Column, n: int) -> Column:
    """Indices of the n largest stored values, descending, the lower index first among equals."""
    return F.transform(F.slice(_by_value(v), 1, n), lambda e: e["index"])


def indices(v: Column) -> Column:
    return F.transform(v["features"], lambda e: e["index"])


def split(v: Column, n: int) -> Column:
    """n parts (part, vector) by index modulo n, without entries too; the cardinality stays."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.struct(p.alias("part"), vector(v["cardinality"], F.filter(v["features"], lambda e: e["index"] % n == p)).alias("vector")))


def regular(v: Column, part: int, modular: int) -> Column:
    """The vector, if all its indices are part modulo modular, else the job fails."""
    off = F.exists(v["features"], lambda e: F.pmod(e["index"], F.lit(modular)) != part)
    return F.when(off, F.raise_error(F.lit(f"an index that isn't {part} modulo {modular}")).cast(VECTOR)).otherwise(v)


def dumped(v: Column) -> Column:
    """The vector as text: cardinality:{index:value,...}."""
    pairs = F.transform(v["features"], lambda e: F.concat_ws(":", e["index"].cast("string"), e["value"].cast("string")))
    return F.concat(v["cardinality"].cast("string"), F.lit(":{"), F.array_join(pairs, ","), F.lit("}"))


# Maps and arrays as vectors; what a map lacks is zero.


def map_length(m: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x * x))


def map_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps; null where one has no length."""
    return F.try_divide(map_product(a, b), map_length(a) * map_length(b))


def map_distance(a: Column, b: Column) -> Column:
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    zero = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    return F.sqrt(F.aggregate(keys, F.lit(0.0), lambda s, k: s + (zero(a, k) - zero(b, k)) * (zero(a, k) - zero(b, k))))


def array_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def array_length(a: Column) -> Column:
    return F.sqrt(array_product(a, a))


def array_cosine(a: Column, b: Column) -> Column:
    return F.try_divide(array_product(a, b), array_length(a) * array_length(b))


def array_distance2(a: Column, b: Column) -> Column:
    """Square of the Euclidean distance; nulls count as zeros."""
    diff = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)
