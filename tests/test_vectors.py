import time

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from lexmill.functions import vectors as V
from lexmill.operators import aggregates, matrix
from lexmill.schema import VECTOR, clean, converted, from_long, kind_of, require_vector, resized, to_dense, to_long, to_sparse, to_vector, type_named

KEYED = "id string, vector struct<cardinality:int,features:array<struct<index:int,value:double>>>"


def vec(cardinality, entries):
    return (cardinality, sorted(entries.items()))


def frame(spark, *rows):
    return spark.createDataFrame([(str(k), None if r is None else vec(*r)) for k, r in enumerate(rows)], KEYED)


def entries(row):
    return None if row is None else {e["index"]: e["value"] for e in row["features"]}


def apply(spark, change, *rows):
    return [r[0] for r in frame(spark, *rows).orderBy("id").select(change(F.col("vector"))).collect()]


def test_sum(spark):
    df = frame(spark, (5, {0: 1.0, 3: 2.0}), (5, {3: -2.0, 4: 1.0}), None).withColumn("k", F.lit("a"))
    got = aggregates.vector_sum(df, "k").first()
    assert entries(got["vector"]) == {0: 1.0, 4: 1.0} and got["vector"]["cardinality"] == 5
    none = aggregates.vector_sum(frame(spark, None).withColumn("k", F.lit("b")), "k").first()
    assert none["vector"] is None
    empty = aggregates.vector_sum(frame(spark, (4, {})).withColumn("k", F.lit("b")), "k").first()
    assert entries(empty["vector"]) == {} and empty["vector"]["cardinality"] == 4


def test_sum_of_different_cardinality_fails(spark):
    df = frame(spark, (5, {0: 1.0}), (6, {0: 1.0})).withColumn("k", F.lit("a"))
    with pytest.raises(Exception, match="different cardinality"):
        aggregates.vector_sum(df, "k").collect()


def test_merge(spark):
    df = frame(spark, (4, {0: 1.0}), (4, {0: 2.0, 1: 4.0})).withColumn("k", F.lit("a"))
    assert entries(aggregates.vector_merge(df, "k", 2.0).first()["vector"]) == pytest.approx({0: 0.6, 1: 0.8})
    log = entries(aggregates.vector_merge(df, "k", 2.0, log=True).first()["vector"])
    assert log == pytest.approx({0: np.log(4) / (5 * np.log(2)), 1: np.log(5) / (5 * np.log(2))})
    assert entries(aggregates.vector_merge(df, "k").first()["vector"]) == {0: 3.0, 1: 4.0}


def test_scalar_arithmetic(spark):
    rows = (3, {1: 2.0}), (4, {0: 1.0, 3: 3.0}), (2, {}), None
    assert apply(spark, V.zsum, *rows) == [2.0, 4.0, 0.0, None]
    assert [entries(x) for x in apply(spark, V.norm1, *rows)] == [{1: 1.0}, {0: 0.25, 3: 0.75}, {}, None]
    assert [entries(x) for x in apply(spark, lambda v: V.plus(v, F.lit(1)), *rows)] == [{0: 1.0, 1: 3.0, 2: 1.0}, {0: 2.0, 1: 1.0, 2: 1.0, 3: 4.0}, {0: 1.0, 1: 1.0}, None]
    assert [entries(x) for x in apply(spark, lambda v: V.minus(v, F.lit(2)), (3, {1: 2.0}))] == [{0: -2.0, 2: -2.0}]
    assert [entries(x) for x in apply(spark, lambda v: V.times(v, F.lit(0)), *rows)] == [{}, {}, {}, None]
    assert [entries(x) for x in apply(spark, lambda v: V.divide(v, F.lit(2)), *rows)] == [{1: 1.0}, {0: 0.5, 3: 1.5}, {}, None]
    assert [entries(x) for x in apply(spark, lambda v: V.divide(v, F.lit(0)), (3, {1: 2.0}))] == [{}]


def test_norms(spark):
    row = (5, {0: 3.0, 2: -4.0})
    for power, want in ((1, 7.0), (2, 5.0), (3, 91 ** (1 / 3)), (float("inf"), 4.0)):
        assert apply(spark, lambda v, p=power: V.norm(v, p), row) == pytest.approx([want])
    with pytest.raises(ValueError):
        V.log_normalize(F.col("vector"), 1.0)


def test_dot(spark):
    def dots(*rows):
        df = spark.createDataFrame(rows, f"a {VECTOR.simpleString()}, b {VECTOR.simpleString()}")
        return [r[0] for r in df.select(V.dot(F.col("a"), F.col("b"))).collect()]

    assert dots((vec(4, {0: 1.0, 3: 2.0}), vec(4, {3: 4.0})), (vec(4, {0: 1.0}), None), (vec(4, {}), vec(4, {1: 2.0}))) == [8.0, None, 0.0]
    with pytest.raises(SparkRuntimeException, match="different cardinality"):
        dots((vec(4, {0: 1.0}), vec(5, {0: 1.0})))


def test_regular_and_dumped(spark):
    assert apply(spark, V.dumped, (4, {1: 2.0, 3: -1.5}), (2, {}), None) == ["4:{1:2.0,3:-1.5}", "2:{}", None]
    assert [entries(x) for x in apply(spark, lambda v: V.regular(v, 1, 2), (5, {1: 2.0, 3: 1.0}), None)] == [{1: 2.0, 3: 1.0}, None]
    with pytest.raises(SparkRuntimeException, match="modulo 2"):
        apply(spark, lambda v: V.regular(v, 1, 2), (5, {2: 1.0}))


def test_conversions(spark):
    df = spark.createDataFrame([(1, vec(4, {1: 2.0, 3: 0.1})), (2, None), (3, vec(3, {}))], f"id int, vector {VECTOR.simpleString()}")
    dense = df.withColumn("vector", converted(F.col("vector"), dense=True, float_precision=True))
    assert [r[1] for r in dense.collect()] == [pytest.approx([0, 2.0, 0, 0.1]), None, [0.0, 0.0, 0.0]]
    assert [kind_of(x, "vector") for x in (df, dense, df.withColumn("vector", converted(F.col("vector"), sequential=True)))] == ["cardinality_sparse", "dense", "sparse"]
    assert [None if r[1] is None else entries(r[1]) for r in to_vector(dense, "vector", 2).collect()] == [{1: 2.0}, None, {}]
    sparse = df.withColumn("vector", F.reverse("vector.features"))
    assert [None if r[1] is None else (r[1][0], entries(r[1])) for r in to_vector(sparse, "vector", 9).collect()] == [(9, {1: 2.0, 3: 0.1}), None, (9, {})]
    for wrong in (lambda: converted(F.col("vector"), dense=True, sparse=True), lambda: converted(F.col("vector"), dense=True, sequential=True), lambda: to_vector(sparse, "vector"), lambda: kind_of(df, "id")):
        with pytest.raises(ValueError):
            wrong()


def test_extremes(spark):
    rows = (5, {3: -2.0}), (5, {1: 2.0, 3: 2.0}), (2, {0: -1.0, 1: -1.0}), (3, {}), (4, {0: -1.0, 1: -3.0}), None
    assert apply(spark, V.max_value, *rows) == [0.0, 2.0, -1.0, 0.0, 0.0, None]
    assert apply(spark, V.max_index, *rows) == [0, 1, 0, 0, 2, None]
    top = (9, {1: 2.0, 3: 2.0, 5: 9.0})
    assert apply(spark, lambda v: V.top_indices(v, 2), top) == [[5, 1]]
    assert apply(spark, lambda v: V.top_values(v, 5), top) == [[9.0, 2.0, 2.0]]
    assert apply(spark, V.indices, top) == [[1, 3, 5]]


def test_split_sums_to_the_whole(spark):
    df = frame(spark, (6, {1: 2.0, 3: 1.0}))
    parts = df.select("id", F.explode(V.split(F.col("vector"), 3)).alias("p")).select("id", "p.*")
    assert {r["part"]: entries(r["vector"]) for r in parts.collect()} == {0: {3: 1.0}, 1: {1: 2.0}, 2: {}}
    assert entries(aggregates.vector_sum(parts, "id").first()["vector"]) == {1: 2.0, 3: 1.0}


def test_forms(spark):
    df = frame(spark, (4, {1: 2.0}), (0, {}), None)
    assert apply(spark, to_dense, (4, {1: 2.0}), (0, {}), None) == [[0.0, 2.0, 0.0, 0.0], [], None]
    back = df.select("id", to_sparse(to_dense(F.col("vector"))).alias("vector"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert [tuple(r) for r in to_long(df).collect()] == [("0", 1, 2.0)]
    rows = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("a", 3, -1.0)], "id string, index int, value double")
    got = from_long(rows, 9).first()
    assert got["vector"]["cardinality"] == 9 and entries(got["vector"]) == {1: 2.0}
    assert entries(apply(spark, lambda v: resized(v, 2), (4, {1: 2.0, 3: 1.0}))[0]) == {1: 2.0}
    raw = spark.createDataFrame([([(3, 1.0), (1, 0.0), (3, 5.0), (2, None)],)], "e array<struct<index:int,value:double>>")
    assert [tuple(e) for e in raw.select(clean(F.col("e"))).first()[0]] == [(3, 5.0)]


def test_schema_checks(spark):
    df = frame(spark, (1, {}))
    assert require_vector(df, "vector") is df and type_named("CharArray") == "string"
    with pytest.raises(ValueError):
        require_vector(df, "id")
    with pytest.raises(ValueError):
        type_named("decimal")


def test_maps_and_arrays(spark):
    df = spark.createDataFrame([({"a": 3.0, "b": 4.0}, {"b": 2.0, "c": 1.0}, [3.0, None], [0.0, 4.0])], "a map<string,double>, b map<string,double>, x array<double>, y array<double>")
    a, b, x, y = (F.col(c) for c in "abxy")
    got = df.select(V.map_length(a), V.map_product(a, b), V.map_cosine(a, b), V.map_distance(a, b), V.array_distance2(x, y)).first()
    assert tuple(got) == pytest.approx((5.0, 8.0, 8 / (5 * 5**0.5), (9 + 4 + 1) ** 0.5, 25.0))


def test_matrices(spark, tmp_path):
    def dense(m):
        out = np.zeros((3, 4))
        for r in m.collect():
            out[r["row"], r["col"]] = r["value"]
        return out

    one, two, three = (matrix.literally(spark, 3, 4, v) for v in (1, 2, 3))
    assert (dense(matrix.add(one, None, two, three)) == 6).all()
    m = matrix.rand(spark, 3, 4, 5)
    d = dense(m)
    assert (d == dense(matrix.rand(spark, 3, 4, 5))).all() and (0 <= d).all() and (d < 1).all()
    assert np.allclose(dense(matrix.normalize_rows(m)), d / d.sum(axis=1, keepdims=True))
    assert np.allclose(dense(matrix.normalize_columns(m)), d / d.sum(axis=0))
    assert {r["row"]: r["value"] for r in matrix.row_sums(m).collect()} == pytest.approx(dict(enumerate(d.sum(axis=1))))
    assert {r["col"]: r["value"] for r in matrix.col_sums(m).collect()} == pytest.approx(dict(enumerate(d.sum(axis=0))))
    assert matrix.zsum(m).first()[0] == pytest.approx(d.sum())
    stack = one.withColumn("z", F.lit(0)).unionByName(three.withColumn("z", F.lit(1)))
    assert {(r["z"], r["value"]) for r in matrix.normalize_z(stack).collect()} == {(0, 0.25), (1, 0.75)}
    matrix.save(m, f"{tmp_path}/m", 3, 4)
    back, rows, cols = matrix.load(spark, f"{tmp_path}/m")
    assert (rows, cols) == (3, 4) and (dense(back) == d).all()
    matrix.save(m, f"{tmp_path}/n", 2, 4)
    with pytest.raises(ValueError):
        matrix.load(spark, f"{tmp_path}/n")


def test_conversions_of_a_long_vector(spark):
    """In time that grows with the entries: a vector of 20,000 goes to dense and back, and its reversed entries are cleaned, within a minute."""
    n = 20_000
    df = spark.range(1).select(F.struct(F.lit(2 * n).alias("cardinality"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((2 * i).cast("int").alias("index"), (i + 1).cast("double").alias("value"))).alias("features")).cast(VECTOR).alias("vector"))
    began = time.time()
    dense = df.withColumn("vector", converted(F.col("vector"), dense=True))
    sparse = to_vector(dense, "vector").withColumn("vector", F.reverse(converted(F.col("vector"), sequential=True)))
    got = to_vector(sparse, "vector", 2 * n).select(F.size("vector.features"), F.aggregate("vector.features", F.lit(0.0), lambda a, e: a + e["value"])).first()
    assert tuple(got) == (n, n * (n + 1) / 2) and time.time() - began < 60


def test_entries_without_an_index_fail(spark):
    raw = spark.createDataFrame([([(None, 1.0), (1, 2.0)],)], "e array<struct<index:int,value:double>>")
    with pytest.raises(SparkRuntimeException, match="without an index"):
        raw.select(clean(F.col("e"))).collect()
