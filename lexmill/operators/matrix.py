"""Matrices in long form: (row, col, value), cells that are absent being zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _cells(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    r = spark.range(rows).select(F.col("id").cast("int").alias("row"))
    return r.crossJoin(spark.range(cols).select(F.col("id").cast("int").alias("col")))


def literally(spark: SparkSession, rows: int, cols: int, value: float) -> DataFrame:
    return _cells(spark, rows, cols).withColumn("value", F.lit(float(value)))


def rand(spark: SparkSession, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """Uniform in [0, 1), the same for the same seed."""
    return _cells(spark, rows, cols).withColumn("value", F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))


def normalize_by(m: DataFrame, *by: str) -> DataFrame:
    """Each value divided by the sum of absolute values over the cells with equal by; zero sums give zeros."""
    sums = m.groupBy(*by).agg(F.sum(F.abs("value")).alias("__norm"))
    return m.join(sums, list(by)).withColumn("value", F.coalesce(F.try_divide("value", "__norm"), F.lit(0.0))).select(*m.columns)


def normalize_rows(m: DataFrame) -> DataFrame:
    return normalize_by(m, "row")


def normalize_columns(m: DataFrame) -> DataFrame:
    return normalize_by(m, "col")


def normalize_z(stack: DataFrame) -> DataFrame:
    """A stack (z, row, col, value): each cell divided by its sum over z; cells of zero are dropped."""
    sums = stack.groupBy("row", "col").agg(F.sum("value").alias("__sum"))
    got = stack.filter("value <> 0").join(sums, ["row", "col"]).withColumn("value", F.coalesce(F.try_divide("value", "__sum"), F.lit(0.0)))
    return got.select("z", "row", "col", "value")


def add(*matrices: DataFrame | None) -> DataFrame:
    """Sum of matrices; None is skipped."""
    all_cells = reduce(DataFrame.unionByName, [m.select("row", "col", "value") for m in matrices if m is not None])
    return all_cells.groupBy("row", "col").agg(F.sum("value").alias("value"))


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("row").agg(F.sum("value").alias("value"))


def col_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("col").agg(F.sum("value").alias("value"))


def zsum(m: DataFrame) -> DataFrame:
    return m.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def as_matrix(v: DataFrame) -> DataFrame:
    """A vector (index, value) as a matrix of one row."""
    return v.select(F.lit(0).alias("row"), F.col("index").alias("col"), "value")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vectors (index, value) multiplied slot by slot."""
    return a.alias("a").join(b.alias("b"), "index").select("index", (F.col("a.value") * F.col("b.value")).alias("value"))


def save(m: DataFrame, path: str, rows: int, cols: int) -> None:
    """Cells, and the shape beside them."""
    spark = m.sparkSession
    m.select("row", "col", "value").write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(rows, cols)], "rows int, cols int").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """The cells and the shape; cells beyond the shape raise ValueError."""
    shape = spark.read.parquet(f"{path}/shape").distinct().collect()
    if len(shape) != 1:
        raise ValueError("parts of different shape")
    m = spark.read.parquet(f"{path}/cells")
    rows, cols = shape[0]
    if not m.filter(~(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))).isEmpty():
        raise ValueError("cells beyond the shape")
    return m, rows, cols
