"""Column types of sparse vectors and conversions between nested and long form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, NumericType, StructField, StructType

ENTRY = StructType([StructField("index", IntegerType()), StructField("value", DoubleType())])
VECTOR = StructType([StructField("cardinality", IntegerType()), StructField("features", ArrayType(ENTRY))])
ENTRIES = "array<struct<index:int,value:double>>"
#: Names that column types go by, in any case.
ALIASES = {"integer": "int", "int": "int", "long": "bigint", "chararray": "string", "string": "string", "text": "string", "bytearray": "binary", "bytes": "binary", "double": "double", "float": "float", "vector": "struct<cardinality:int,features:" + ENTRIES + ">", "stringtuple": "array<string>"}


def type_named(alias: str) -> str:
    """Spark's name of a type alias; unknown ones raise ValueError."""
    try:
        return ALIASES[alias.lower()]
    except KeyError:
        raise ValueError(f"unknown type {alias!r}") from None


def require_schema(df: DataFrame, **columns: str) -> DataFrame:
    """df, if it has these columns with these types, else ValueError."""
    found = dict(df.dtypes)
    for name, kind in columns.items():
        if found.get(name) != kind:
            raise ValueError(f"column {name} is {found.get(name)}, not {kind}")
    return df


def require_vector(df: DataFrame, name: str) -> DataFrame:
    return require_schema(df, **{name: VECTOR.simpleString()})


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once, however often f and the functions in it name it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clean(entries: Column) -> Column:
    """Entries sorted by index without zeros and nulls; of several with one index the last counts. An entry without an index fails the job."""
    index = lambda e: F.coalesce(e["index"].cast("int"), F.raise_error(F.lit("an entry without an index")).cast("int"))
    placed = F.sort_array(F.transform(entries, lambda e, i: F.struct(index(e).alias("index"), i.alias("i"), e["value"].cast("double").alias("value"))))

    def kept(placed: Column) -> Column:
        # The last of an index is the one whose successor has another.
        last = F.filter(placed, lambda e, i: F.coalesce(F.get(placed, i + 1)["index"] != e["index"], F.lit(True)) & e["value"].isNotNull() & (e["value"] != 0))
        return F.transform(last, lambda e: F.struct(e["index"].alias("index"), e["value"].alias("value")))

    return bound(placed, kept)


def vector(cardinality: Column, entries: Column) -> Column:
    """A vector of entries that are sorted, distinct and without zeros already."""
    return F.struct(cardinality.cast("int").alias("cardinality"), entries.cast(ENTRIES).alias("features"))


def to_long(df: DataFrame, key: str = "id", name: str = "vector") -> DataFrame:
    """(key, index, value): a row an entry; vectors without entries have none."""
    return df.select(key, F.explode(f"{name}.features").alias("e")).select(key, "e.index", "e.value")


def from_long(rows: DataFrame, cardinality: int | Column, key: str = "id") -> DataFrame:
    """(key, vector) from (key, index, value); values of one index are summed, zeros dropped."""
    size = F.lit(cardinality) if isinstance(cardinality, int) else cardinality
    each = rows.groupBy(key, "index").agg(F.sum("value").alias("value"))
    entry = F.when(F.col("value") != 0, F.struct(F.col("index").cast("int").alias("index"), F.col("value").cast("double").alias("value")))
    return each.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("f")).select(key, vector(size, F.col("f")).alias("vector"))


def to_dense(v: Column) -> Column:
    """All slots of a vector as array<double>; in one pass over its sorted entries."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def slots(v: Column, entries: Column) -> Column:
        # Each entry with the zeros before it, from the entry before; then the zeros after the last.
        runs = F.transform(entries, lambda e, i: F.concat(zeros(e["index"] - F.coalesce(F.get(entries, i - 1)["index"], F.lit(-1)) - 1), F.array(e["value"])))
        last = F.coalesce(F.get(entries, F.size(entries) - 1)["index"], F.lit(-1))
        return F.when(v.isNotNull(), F.concat(F.flatten(runs), zeros(v["cardinality"] - last - 1)))

    return bound(v, lambda v: bound(v["features"], lambda entries: slots(v, entries)))


def to_sparse(values: Column) -> Column:
    """A vector of the slots of a numeric array that are neither zero nor null."""

    def entries(values: Column) -> Column:
        pairs = F.transform(values, lambda x, i: F.struct(i.cast("int").alias("index"), x.alias("value")))
        return F.when(values.isNotNull(), vector(F.size(values), F.filter(pairs, lambda e: e["value"].isNotNull() & (e["value"] != 0))))

    return bound(values.cast("array<double>"), entries)


def resized(v: Column, cardinality: int) -> Column:
    """The vector with another cardinality; entries beyond it are dropped."""
    return bound(v, lambda v: F.when(v.isNotNull(), vector(F.lit(cardinality), F.filter(v["features"], lambda e: (e["index"] >= 0) & (e["index"] < cardinality)))))


def kind_of(df: DataFrame, name: str) -> str:
    """dense, sparse or cardinality_sparse: what form of vector a column has, by its type; others raise ValueError."""
    kind = df.schema[name].dataType
    entries = kind.elementType if isinstance(kind, ArrayType) else None
    if isinstance(entries, NumericType):
        return "dense"
    if isinstance(entries, StructType) and [f.name for f in entries] == ["index", "value"]:
        return "sparse"
    if kind == VECTOR or isinstance(kind, StructType) and [f.name for f in kind] == ["cardinality", "features"]:
        return "cardinality_sparse"
    raise ValueError(f"{name} is no vector: {kind.simpleString()}")


def to_vector(df: DataFrame, name: str, cardinality: int | None = None) -> DataFrame:
    """df with a column of any form of vector as the canonical one; cardinality is needed for sparse ones, and resizes others."""
    kind, column = kind_of(df, name), F.col(name)
    if kind == "sparse":
        if cardinality is None:
            raise ValueError("sparse entries alone have no cardinality")
        column = bound(column.cast(ENTRIES), lambda e: F.when(e.isNotNull(), vector(F.lit(cardinality), clean(e))))
    elif kind == "dense":
        column = to_sparse(column)
    return df.withColumn(name, column if cardinality is None else resized(column, cardinality))


def converted(v: Column, *, dense: bool = False, sparse: bool = False, sequential: bool = False, float_precision: bool = False, cardinality: int | None = None) -> Column:
    """A vector in another form: all slots (dense) or entries, in order (sequential, which implies sparse), of floats or doubles.

    dense goes neither with sparse nor with sequential (ValueError); cardinality resizes first.
    """
    if dense and (sparse or sequential):
        raise ValueError("a vector is dense, or it is sparse or sequential")
    v = v if cardinality is None else resized(v, cardinality)
    number = "float" if float_precision else "double"
    if dense:
        return to_dense(v).cast(f"array<{number}>")
    entries = f"array<struct<index:int,value:{number}>>"
    return bound(v, lambda v: F.when(v.isNotNull(), (F.sort_array(v["features"]) if sequential else v["features"]).cast(entries)))
