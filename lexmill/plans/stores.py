"""Registered plans: sources and sinks, written to the shared folder and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import named
from ..functions.values import feature_map
from ..functions.vectors import dumped
from ..operators import kmeans, matrix
from ..schema import converted, to_long, to_vector
from ..sources import files, gaussian, svmlight
from ..streaming import scoring
from ..workspace import new_path
from .clusters import DIM, K, _kmeans, _points
from .common import SLOTS, VECTOR_SQL, customer_vectors, table

GAUSSIANS = "1000;0,1;5,0.5 500;10,2;-5,1"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line "flag slot:quantity ..." for each order and return flag."""
    fields = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat_ws(":", (F.col("l_partkey") % SLOTS).cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("s")))), lambda e: e["s"]), " ")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(fields.alias("s"))
    return rows.select("l_orderkey", F.concat_ws(" ", "l_returnflag", "s").alias("value"))


def svmlight_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", svmlight.parsed(F.col("value")).alias("p"))
    return rows.select("l_orderkey", "p.label", F.explode("p.features").alias("feature", "value"))


def svmlight_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through text files, summed."""
    path = new_path(spark, "svmlight")
    _lines(spark, sf_dir).select("value").write.text(path)
    rows = svmlight.read(spark, path).select("label", F.explode("features").alias("feature", "value"))
    return rows.groupBy("label", "feature").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def feature_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of "key:number" fields; the field without a number is left out."""
    fields = F.array(F.concat(F.lit("size:"), F.col("p_size").cast("string")), F.concat(F.lit("key:"), F.col("p_partkey").cast("string")), F.concat(F.lit("brand:"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(feature_map(fields)).alias("feature", "value"))


def vector_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vectors")
    files.write_vectors(customer_vectors(spark, sf_dir), path, key_type="long")
    return to_long(files.read_vectors(spark, path, key_type="long"))


def grouped_store_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored by customer modulo 4, and every part read again on its own."""
    path = new_path(spark, "grouped")
    files.write_grouped(customer_vectors(spark, sf_dir).withColumn("part", (F.col("id") % 4).cast("int")), path)
    return reduce(DataFrame.union, [to_long(files.read_part(spark, path, k)).withColumn("part", F.lit(k)) for k in range(4)])


def side_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each part of a grouped store, a part an iteration, until all are done."""
    path, out = new_path(spark, "parts"), new_path(spark, "done")
    files.write_grouped(customer_vectors(spark, sf_dir).withColumn("part", (F.col("id") % 4).cast("int")), path)
    while not (side := files.PartIteration(spark, path, out)).done():
        side.save(to_long(side.part()).agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    return side.results()


def vector_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_vectors(spark, sf_dir).select("id", dumped(F.col("vector")).alias("dumped"))


def vector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and their entries."""
    return customer_vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.size("vector.features")).alias("n_entries"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions called by name, in SQL."""
    named.register(spark)
    customer_vectors(spark, sf_dir).createOrReplaceTempView("customer_vectors")
    return spark.sql("SELECT id, vector_zsum(vector) AS zsum, vector_zsum(vector_times(vector, 2)) AS twice, size(vector_indices(vector)) AS n, confine(vector_max(vector), 0, 50) AS most FROM customer_vectors")


def vector_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense floats, and entries without a cardinality, as canonical vectors and back in order."""
    dense = customer_vectors(spark, sf_dir).withColumn("vector", converted(F.col("vector"), dense=True, float_precision=True))
    sparse = to_vector(dense, "vector").withColumn("vector", converted(F.col("vector"), sequential=True))
    return to_long(to_vector(sparse, "vector", SLOTS))


def row_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "rows")
    files.write_row_ids(customer_vectors(spark, sf_dir).withColumnRenamed("id", "name"), path)
    return to_long(spark.read.parquet(f"{path}/matrix")).join(spark.read.parquet(f"{path}/docIndex"), "id")


def strings_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "strings")
    files.write_strings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("value")), path, "long")
    return files.read_strings(spark, path, "long").select("key", F.posexplode("value").alias("at", "word"))


def matrix_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "matrix")
    nation = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("row"), F.length("c_mktsegment").alias("col")).agg(F.count("*").cast("double").alias("value"))
    matrix.save(nation, path, 25, 32)
    return matrix.load(spark, path)[0]


def rolling_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means centroids, each round a committed table; the last one."""
    points = kmeans.seeded(_points(spark, sf_dir), K)
    store = files.RollingStore(spark, new_path(spark, "rolling"), keep=2)
    got = store.run(lambda: kmeans.update(points, DIM), lambda c: kmeans.update(kmeans.assign(points, c), DIM), 2)
    return got.select("k", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


def gaussian_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaussian.read(spark, GAUSSIANS, seed=7).select("group", "id", F.col("point")[0].alias("x"), F.col("point")[1].alias("y"))


def stream_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of points that arrive as a stream, by centroids fitted before."""
    centroids = kmeans.update(kmeans.seeded(_points(spark, sf_dir), K), DIM)
    points = scoring.stream_of(spark, f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"))
    return scoring.scored(points, lambda batch: kmeans.assign(batch, centroids).select("id", "k"))


QUERIES = {
    f.__name__: f
    for f in (svmlight_parse, svmlight_files, feature_extract, vector_store_roundtrip, grouped_store_part, side_parts, vector_dump, vector_count, sql_functions, vector_conversion, row_id_store, strings_store_roundtrip, matrix_store_roundtrip, rolling_store_roundtrip, gaussian_source, stream_assign)
}

_SVM = f"""WITH s AS (SELECT l_orderkey, l_returnflag AS label, (l_partkey % {SLOTS})::VARCHAR AS feature, last(l_quantity::INTEGER::DOUBLE ORDER BY l_linenumber, (l_partkey % {SLOTS})::VARCHAR || ':' || l_quantity::INTEGER::VARCHAR) AS value
FROM lineitem GROUP BY 1, 2, 3)
"""

ORACLE = {
    "svmlight_parse": _SVM + "SELECT * FROM s",
    "svmlight_files": _SVM + "SELECT label, feature, count(*) AS n, sum(value) AS value FROM s GROUP BY 1, 2",
    "feature_extract": "SELECT p_partkey, 'size' AS feature, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'key', p_partkey::DOUBLE FROM part",
    "vector_store_roundtrip": f"WITH {VECTOR_SQL} SELECT * FROM cv",
    "grouped_store_part": f"WITH {VECTOR_SQL} SELECT *, (id % 4)::INTEGER AS part FROM cv",
    "side_parts": f"WITH {VECTOR_SQL} SELECT (id % 4)::INTEGER AS part, count(*) AS n, sum(value) AS total FROM cv GROUP BY 1",
    "vector_dump": f"WITH {VECTOR_SQL} SELECT id, '{SLOTS}:{{' || string_agg(index || ':' || value, ',' ORDER BY index) || '}}' AS dumped FROM cv GROUP BY 1",
    "vector_count": f"WITH {VECTOR_SQL} SELECT count(DISTINCT id) AS n, count(*) AS n_entries FROM cv",
    "sql_functions": f"WITH {VECTOR_SQL} SELECT id, sum(value) AS zsum, sum(value) * 2 AS twice, count(*)::INTEGER AS n, least(50, max(value))::DOUBLE AS most FROM cv GROUP BY 1",
    "vector_conversion": f"WITH {VECTOR_SQL} SELECT * FROM cv",
    "row_id_store": f"WITH {VECTOR_SQL}, ids AS (SELECT name, (row_number() OVER (ORDER BY name) - 1)::INTEGER AS id FROM (SELECT DISTINCT id::VARCHAR AS name FROM cv)) SELECT ids.id, index, value, name FROM cv JOIN ids ON name = cv.id::VARCHAR",
    "strings_store_roundtrip": "SELECT p_partkey AS key, generate_subscripts(string_split(p_name, ' '), 1)::INTEGER - 1 AS at, unnest(string_split(p_name, ' ')) AS word FROM part",
    "matrix_store_roundtrip": "SELECT c_nationkey AS row, length(c_mktsegment)::INTEGER AS col, count(*)::DOUBLE AS value FROM customer GROUP BY 1, 2",
    "rolling_store_roundtrip": _kmeans(2) + " SELECT k, dim, round(value, 6) AS value FROM c2",
    "stream_assign": _kmeans(1) + " SELECT id, k FROM a1",
}
