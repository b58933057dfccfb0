"""Registered plans: arithmetic and sums of sparse vectors, dense forms, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import aggregates, matrix
from ..schema import to_dense, to_long, to_sparse
from ..workspace import small
from .common import SLOTS, VECTOR_SQL, customer_vectors, table, with_nation

def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_nation(customer_vectors(spark, sf_dir), spark, sf_dir)


def _round(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.round("value", 6))


def vector_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(aggregates.vector_sum(_by_nation(spark, sf_dir), "nation"), "nation")


def vector_merge_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(to_long(aggregates.vector_merge(_by_nation(spark, sf_dir), "nation", 2.0), "nation"))


def vector_merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(to_long(aggregates.vector_merge(_by_nation(spark, sf_dir), "nation", 2.0, log=True), "nation"))


def _entries(change):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(to_long(customer_vectors(spark, sf_dir).select("id", change(F.col("vector")).alias("vector"))))

    return query


def _scalar(change, name: str = "result"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return customer_vectors(spark, sf_dir).select("id", change(F.col("vector")).alias(name))

    return query


def _ranked(change, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return customer_vectors(spark, sf_dir).select("id", F.posexplode(change(F.col("vector"))).alias("rank", name))

    return query


def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_nation(spark, sf_dir)
    sums = aggregates.vector_sum(rows, "nation").withColumnRenamed("vector", "whole")
    return rows.join(small(sums), "nation").select("id", V.dot(F.col("vector"), F.col("whole")).alias("result"))


def vector_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = customer_vectors(spark, sf_dir).select("id", F.explode(V.split(F.col("vector"), 4)).alias("p")).select("id", "p.part", "p.vector")
    return parts.select("id", "part", F.size("vector.features").alias("n_entries"), V.zsum(F.col("vector")).alias("total"))


def dense_to_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), to_sparse(F.col("embedding")).alias("vector"))
    return to_long(rows)


def sparse_to_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_vectors(spark, sf_dir).select("id", F.posexplode(to_dense(F.col("vector"))).alias("index", "value"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a map from slot to value, with that of the next id."""
    pairs = F.transform("embedding", lambda x, i: F.struct(i.cast("string").alias("k"), x.cast("double").alias("v")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.map_from_entries(pairs).alias("a"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


def _map(change):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("vec_id", F.round(change(F.col("a"), F.col("b")), 6).alias("result"))

    return query


def _months(spark: SparkSession, sf_dir: str, *by: Column) -> DataFrame:
    """Orders counted by nation (row) and month (col), and by what else is given."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.month("o_orderdate") - 1).alias("col"), *by)
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("row"))
    names = [c for c in orders.columns if c not in ("o_custkey", "col")]
    return orders.join(customer, "o_custkey").groupBy(*names, "row", "col").agg(F.count("*").cast("double").alias("value"))


def matrix_norm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(matrix.normalize_rows(_months(spark, sf_dir)))


def matrix_norm_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(matrix.normalize_columns(_months(spark, sf_dir)))


def matrix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _months(spark, sf_dir)
    return matrix.add(m, None, m.withColumn("value", F.col("value") * 2))


def matrix_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.row_sums(_months(spark, sf_dir))


def matrix_col_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.col_sums(_months(spark, sf_dir))


def matrix_zsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.zsum(_months(spark, sf_dir))


def matrix_normalize_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(matrix.normalize_z(_months(spark, sf_dir, F.col("o_orderstatus").alias("z"))))


QUERIES = {
    "vector_sum_by_key": vector_sum_by_key,
    "vector_merge_l2": vector_merge_l2,
    "vector_merge_log": vector_merge_log,
    "vector_zsum": _scalar(V.zsum),
    "vector_norm1": _entries(V.norm1),
    "vector_divide": _entries(lambda v: V.divide(v, F.lit(8))),
    "vector_times": _entries(lambda v: V.times(v, F.lit(1.5))),
    "vector_plus": _entries(lambda v: V.plus(v, F.lit(2))),
    "vector_minus": _entries(lambda v: V.minus(v, F.lit(3))),
    "vector_dot": vector_dot,
    "vector_maxvalue": _scalar(V.max_value),
    "vector_maxindex": _scalar(V.max_index),
    "vector_topvalue": _ranked(lambda v: V.top_values(v, 5), "value"),
    "vector_topindex": _ranked(lambda v: V.top_indices(v, 5), "index"),
    "vector_indices": _ranked(V.indices, "index"),
    "vector_split": vector_split,
    "dense_to_sparse": dense_to_sparse,
    "sparse_to_dense": sparse_to_dense,
    "map_cosine": _map(V.map_cosine),
    "map_distance": _map(V.map_distance),
    **{f.__name__: f for f in (matrix_norm_rows, matrix_norm_cols, matrix_sum, matrix_row_sums, matrix_col_sums, matrix_zsum, matrix_normalize_z)},
}

_V = f"WITH {VECTOR_SQL}"
_SLOTS = f", slots AS (SELECT range::INTEGER AS index FROM range({SLOTS})), ids AS (SELECT DISTINCT id FROM cv), full_cv AS (SELECT ids.id, slots.index, coalesce(value, 0) AS value FROM ids CROSS JOIN slots LEFT JOIN cv ON cv.id = ids.id AND cv.index = slots.index)"
_ORDER = "row_number() OVER (PARTITION BY id ORDER BY value DESC, index)"
_M = """WITH m AS (SELECT c_nationkey AS row, month(o_orderdate)::INTEGER - 1 AS col, count(*)::DOUBLE AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
"""
_E = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"

ORACLE = {
    "vector_sum_by_key": _V + "SELECT * FROM nv",
    "vector_merge_l2": _V + "SELECT nation, index, round(value / sqrt(sum(value * value) OVER (PARTITION BY nation)), 6) AS value FROM nv",
    "vector_merge_log": _V + "SELECT nation, index, round(ln(1 + value) / (sqrt(sum(value * value) OVER (PARTITION BY nation)) * ln(2)), 6) AS value FROM nv",
    "vector_zsum": _V + "SELECT id, sum(value) AS result FROM cv GROUP BY 1",
    "vector_norm1": _V + "SELECT id, index, round(value / sum(abs(value)) OVER (PARTITION BY id), 6) AS value FROM cv",
    "vector_divide": _V + "SELECT id, index, round(value / 8, 6) AS value FROM cv",
    "vector_times": _V + "SELECT id, index, round(value * 1.5::DOUBLE, 6) AS value FROM cv",
    "vector_plus": _V + _SLOTS + " SELECT id, index, round(value + 2, 6) AS value FROM full_cv WHERE value + 2 <> 0",
    "vector_minus": _V + _SLOTS + " SELECT id, index, round(value - 3, 6) AS value FROM full_cv WHERE value - 3 <> 0",
    "vector_dot": _V + "SELECT id, sum(cv.value * nv.value) AS result FROM cv JOIN customer ON c_custkey = id JOIN nv ON nv.nation = c_nationkey AND nv.index = cv.index GROUP BY 1",
    "vector_maxvalue": _V + _SLOTS + " SELECT id, max(value) AS result FROM full_cv GROUP BY 1",
    "vector_maxindex": _V + _SLOTS + f" SELECT id, index AS result FROM (SELECT *, {_ORDER} AS k FROM full_cv) WHERE k = 1",
    "vector_topvalue": _V + f"SELECT id, (k - 1)::INTEGER AS rank, value FROM (SELECT *, {_ORDER} AS k FROM cv) WHERE k <= 5",
    "vector_topindex": _V + f"SELECT id, (k - 1)::INTEGER AS rank, index FROM (SELECT *, {_ORDER} AS k FROM cv) WHERE k <= 5",
    "vector_indices": _V + "SELECT id, (row_number() OVER (PARTITION BY id ORDER BY index) - 1)::INTEGER AS rank, index FROM cv",
    "vector_split": _V + """SELECT ids.id, part::INTEGER AS part, count(index)::INTEGER AS n_entries, coalesce(sum(value), 0)::DOUBLE AS total
FROM (SELECT DISTINCT id FROM cv) ids CROSS JOIN (SELECT range AS part FROM range(4)) LEFT JOIN cv ON cv.id = ids.id AND cv.index % 4 = part GROUP BY 1, 2""",
    "dense_to_sparse": "SELECT id, index, value::DOUBLE AS value FROM (SELECT vec_id AS id, unnest(embedding) AS value, generate_subscripts(embedding, 1)::INTEGER - 1 AS index FROM embeddings) WHERE value <> 0",
    "sparse_to_dense": _V + _SLOTS + " SELECT * FROM full_cv",
    "map_cosine": f"SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS result FROM {_E}",
    "map_distance": f"SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS result FROM {_E}",
    "matrix_norm_rows": _M + "SELECT row, col, round(value / sum(abs(value)) OVER (PARTITION BY row), 6) AS value FROM m",
    "matrix_norm_cols": _M + "SELECT row, col, round(value / sum(abs(value)) OVER (PARTITION BY col), 6) AS value FROM m",
    "matrix_sum": _M + "SELECT row, col, value * 3 AS value FROM m",
    "matrix_row_sums": _M + "SELECT row, sum(value) AS value FROM m GROUP BY 1",
    "matrix_col_sums": _M + "SELECT col, sum(value) AS value FROM m GROUP BY 1",
    "matrix_zsum": _M + "SELECT sum(value) AS value FROM m",
    "matrix_normalize_z": """WITH s AS (SELECT o_orderstatus AS z, c_nationkey AS row, month(o_orderdate)::INTEGER - 1 AS col, count(*)::DOUBLE AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)
SELECT z, row, col, round(value / sum(value) OVER (PARTITION BY row, col), 6) AS value FROM s""",
}
