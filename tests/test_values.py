import pytest
from pyspark.sql import functions as F

from lexmill.functions import values
from lexmill.operators import relational, text


def one(spark, schema, row, *cols):
    return tuple(spark.createDataFrame([row], schema).select(*cols).first())


def test_roll_bag(spark):
    roll = lambda n, size, step: one(spark, "a array<int>", (list(range(1, n + 1)),), values.roll_bag(F.col("a"), size, step))[0]
    assert roll(7, 3, 2) == [[1, 2, 3], [3, 4, 5], [5, 6, 7]]
    assert roll(7, 2, 3) == [[1, 2], [4, 5]]
    assert roll(2, 3, 1) == [] and roll(0, 1, 1) == []
    assert one(spark, "a array<int>", (None,), values.roll_bag(F.col("a"), 2)) == (None,)


def test_json_flatten(spark):
    df = spark.createDataFrame([('{"a":{"b":"x"},"c":[1]}',), ('{"a":{"b":{"d":1}}}',), ("no json",), (None,)], "j string")
    got = [tuple(r) for r in df.select(*values.json_flatten(F.col("j"), "a.b:int,c")).collect()]
    assert got == [("x", "[1]"), ('{"d":1}', None), (None, None), (None, None)]


def test_tuple_sum(spark):
    df = spark.createDataFrame([(1, 2.5), (None, 1.0), (4, None)], "a long, b double")
    assert tuple(values.tuple_sum(df, "a", "b").first()) == (5, 3.5)
    assert tuple(values.tuple_sum(df.limit(0), "a", "b").first()) == (0, 0.0)


def test_small_functions(spark):
    c = F.col("x")
    assert one(spark, "x string", ("/sports/77",), values.label_of(c)) == ("sports",)
    assert one(spark, "x string", ("none",), values.label_of(c)) == (None,)
    assert one(spark, "x string", ("+1",), values.decode(c, "+1", 1, "-1", 0), values.decode(F.lit("z"), "+1", 1), values.decode(F.lit("z"), "a", 1, default=7)) == (1, None, 7)
    assert one(spark, "x array<string>", (["a:1", "b:x", "a:2.5", "c", "d:3:4"],), values.feature_map(c)) == ({"a": 2.5},)
    assert one(spark, "x int", (5,), values.confine(c, F.lit(1), F.lit(3)), values.confine(c, F.lit(7), F.lit(9))) == (3, 7)
    assert one(spark, "x string", ("a/b/c",), values.substring_after(c, "/"), values.substring_after(c, "-")) == ("b/c", "a/b/c")
    assert one(spark, "x map<string,int>", ({"a": 1, "b": 2},), values.map_invert(c)) == ({1: "a", 2: "b"},)
    assert [values.small_label(i) for i in (0, 25, 26, 27)] == ["a", "z", "ba", "bb"]
    draw, key = one(spark, "x long", (3,), values.unit_draw(c, "s"), values.shuffle_key(c))
    assert 0 <= draw < 1 and 0 <= key < 2**31


def test_samples_and_splits(spark):
    df = spark.range(2000)
    a, b = relational.split(df, 0.9, "id")
    n = a.count()
    assert n + b.count() == 2000 and 1740 < n < 1860 and a.join(b, "id").count() == 0
    assert 140 < relational.sample(df, 0.1, "id").count() < 260
    groups = df.withColumn("g", F.when(F.col("id") < 3, 0).otherwise(1))
    assert {r["g"]: r["count"] for r in relational.reservoir(groups, 5, "g", "id").groupBy("g").count().collect()} == {0: 3, 1: 5}
    turned = [r["id"] for r in relational.shuffled(df, "id").collect()]
    assert turned != sorted(turned) and sorted(turned) == list(range(2000))


def test_numbered(spark):
    words = ["b", "", "abc", "a", "ab", "éa", "z", "abd"]
    got = relational.numbered(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    assert [r["w"] for r in got.orderBy("index").collect()] == sorted(words, key=str.encode)
    assert sorted(r["index"] for r in got.collect()) == list(range(8))


def test_text(spark):
    docs = spark.createDataFrame([(1, "The cat, the CAT & a dog's 2nd"), (2, ""), (3, None), (None, "cat"), (4, "dog cat")], "doc_id long, text string")
    tokens = text.tokenize(docs)
    assert {r["name"]: r["tokens"] for r in tokens.collect()} == {1: ["the", "cat", "the", "cat", "a", "dog", "s", "2nd"], 2: [], 4: ["dog", "cat"]}
    assert {r["name"]: r["tokens"] for r in text.tokenize(docs, stop_words=["the", "a"]).collect()}[1] == ["cat", "cat", "dog", "s", "2nd"]
    count = text.counts(tokens)
    terms = text.dictionary(count, 2)
    assert {r["term"]: r["index"] for r in terms.collect()} == {"cat": 0, "dog": 1, "the": 2}
    freq = text.tf(count, terms)
    assert {(r["id"], r["index"]): r["value"] for r in freq.collect()} == {(1, 0): 2.0, (1, 1): 1.0, (1, 2): 2.0, (4, 0): 1.0, (4, 1): 1.0}
    assert tuple(text.df_distribution(text.df(freq)).first()) == (2, 3, 2, 5)
    vectors = {r["id"]: r["vector"] for r in text.tf_vectors(tokens, count, terms, 3).collect()}
    assert set(vectors) == {1, 2, 4} and vectors[2]["features"] == [] and vectors[2]["cardinality"] == 3


def test_tfidf_by_hand(spark):
    freq = spark.createDataFrame([(1, 0, 4.0), *((k, 1, 1.0) for k in range(1, 10))], "id int, index int, value double")
    total = spark.createDataFrame([(10,)], "n long")
    got = {(r["id"], r["index"]): r["value"] for r in text.tfidf(freq, total, max_percent=80).collect()}
    assert got == {(1, 0): pytest.approx(2 * 2.6094379124341)}
    assert len(text.tfidf(freq, total, max_percent=0).collect()) == 10
    assert {r["index"] for r in text.tfidf(freq, total, min_df=2, max_percent=0).collect()} == {1}


def test_analyzers(spark):
    docs = spark.createDataFrame([(1, "The Fox-2  and a café"), (2, None), (None, "x")], "doc_id int, text string")
    got = {name: [r["tokens"] for r in text.tokenize(docs, analyzer=name).collect()] for name in text.ANALYZERS}
    assert got == {"standard": [["fox", "2", "café"]], "simple": [["the", "fox", "and", "a", "café"]], "whitespace": [["The", "Fox-2", "and", "a", "café"]], "keyword": [["The Fox-2  and a café"]]}
    assert text.tokenize(docs, analyzer=lambda c: F.split(c, "o")).first()["tokens"] == ["The F", "x-2  and a café"]
    with pytest.raises(ValueError, match="unknown analyzer"):
        text.tokenize(docs, analyzer="none")


def test_numbers_of_values_with_a_common_start(spark):
    names = [f"https://example.org/{k:05}" for k in range(3000)]
    rows = relational.numbered(spark.createDataFrame([(n,) for n in names], "name string").repartition(7), "name", kind="long")
    assert sorted(map(tuple, rows.collect())) == [(n, k) for k, n in enumerate(names)]
    assert rows.schema["index"].dataType.simpleString() == "bigint"
