import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.sources import files, gaussian, svmlight
from lexmill.streaming import scoring

VECTORS = "id int, vector struct<cardinality:int,features:array<struct<index:int,value:double>>>"


def vectors(spark):
    return spark.createDataFrame([(1, (4, [(0, 1.0), (2, 0.0), (3, 2.0)])), (2, (4, [])), (3, None)], VECTORS)


def plain(df):
    return {r["id"]: None if r["vector"] is None else (r["vector"]["cardinality"], [tuple(e) for e in r["vector"]["features"]]) for r in df.collect()}


def test_vectors(spark, tmp_path):
    files.write_vectors(vectors(spark), f"{tmp_path}/v/deep/er")
    assert plain(files.read_vectors(spark, f"{tmp_path}/v")) == {1: (4, [(0, 1.0), (3, 2.0)]), 2: (4, []), 3: None}
    assert plain(files.read_vectors(spark, f"{tmp_path}/v", cardinality=2))[1] == (2, [(0, 1.0)])
    with pytest.raises(ValueError):
        files.read_vectors(spark, f"{tmp_path}/v", key_type="chararray")


def test_grouped(spark, tmp_path):
    files.write_grouped(vectors(spark).withColumn("part", F.col("id") % 2), f"{tmp_path}/g")
    got = files.read_part(spark, f"{tmp_path}/g", 1)
    assert set(plain(got)) == {1, 3}
    assert "PartitionFilters: [isnotnull(part" in got._jdf.queryExecution().toString()


def test_row_ids(spark, tmp_path):
    named = vectors(spark).select(F.concat(F.lit("n"), (9 - F.col("id")).cast("string")).alias("name"), "vector")
    files.write_row_ids(named, f"{tmp_path}/r")
    assert {r["id"]: r["name"] for r in spark.read.parquet(f"{tmp_path}/r/docIndex").collect()} == {0: "n6", 1: "n7", 2: "n8"}
    assert plain(spark.read.parquet(f"{tmp_path}/r/matrix"))[2] == (4, [(0, 1.0), (2, 0.0), (3, 2.0)])


def test_pairs_and_strings(spark, tmp_path):
    files.write_pairs(spark.createDataFrame([(1, 2)], "key int, value int"), f"{tmp_path}/p", "LONG", "double")
    assert [tuple(r) for r in files.read_pairs(spark, f"{tmp_path}/p", "long", "double").collect()] == [(1, 2.0)]
    files.write_strings(spark.createDataFrame([("a", ["x", "y"])], "key string, value array<string>"), f"{tmp_path}/s")
    assert files.read_strings(spark, f"{tmp_path}/s").first()["value"] == ["x", "y"]
    (tmp_path / "t").write_text("k\t1\nlone\n")
    assert [tuple(r) for r in files.key_values(spark, f"{tmp_path}/t").collect()] == [("k", "1"), ("lone", None)]
    assert files.first_line(spark, f"{tmp_path}/t") == "k\t1" and files.read_lines(spark, f"{tmp_path}/t").count() == 2


def test_rolling_store_resumes(spark, tmp_path):
    store = files.RollingStore(spark, f"file://{tmp_path}/roll")
    assert store.last() == -1
    with pytest.raises(FileNotFoundError):
        store.load()
    step = lambda df: df.select((F.col("x") * 2).alias("x"))
    assert store.run(lambda: spark.range(1).select(F.lit(1).alias("x")), step, 2).first()["x"] == 4
    # A table without its marker isn't committed: the next run makes it anew.
    broken = tmp_path / "roll/iter=3"
    broken.mkdir()
    (broken / "part-0").write_text("torn")
    assert store.last() == 2 and store.run(None, step, 4).first()["x"] == 16
    assert store.load(3).first()["x"] == 8
    kept = files.RollingStore(spark, f"file://{tmp_path}/roll", keep=2)
    kept.save(spark.range(1))
    assert kept.iterations() == [4, 5]


def test_svmlight(spark, tmp_path):
    lines = ["-1 4:0.5 9:1", "+1 2:1 2:7", "1", "bad 3", "bad 3:x", "4:1 5:1", "", "0  7:1e3 "]
    (tmp_path / "s").write_text("\n".join(lines))
    got = {r["label"]: r["features"] for r in svmlight.read(spark, f"{tmp_path}/s", corrupt=f"{tmp_path}/c").collect()}
    assert got == {"-1": {"4": 0.5, "9": 1.0}, "+1": {"2": 7.0}, "1": {}, "0": {"7": 1000.0}}
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/c").collect()) == ["4:1 5:1", "bad 3", "bad 3:x"]
    row = spark.createDataFrame([("x", {"b": 2.0, "a": 1.5})], "label string, features map<string,double>")
    line = row.select(svmlight.line_of(F.col("label"), F.col("features"))).first()[0]
    assert line == "x a:1.5 b:2.0"
    back = spark.createDataFrame([(line.replace(" ", "|").replace(":", "="),)], "v string").select(svmlight.parsed(F.col("v"), "|", "=").alias("p")).first()["p"]
    assert back["features"] == {"b": 2.0, "a": 1.5}
    with pytest.raises(ValueError):
        svmlight.parsed(F.col("v"), "ab")


def test_gaussian(spark):
    df = gaussian.read(spark, "4000;0,1;5,0.5 1000;10,2;-5,1", seed=1)
    for g, n, dims in ((0, 4000, ((0, 1), (5, 0.5))), (1, 1000, ((10, 2), (-5, 1)))):
        x = np.array([r["point"] for r in df.filter(F.col("group") == g).collect()])
        assert x.shape == (n, 2)
        for d, (mean, sd) in enumerate(dims):
            assert abs(x[:, d].mean() - mean) < 5 * sd / n**0.5 and abs(x[:, d].std() / sd - 1) < 0.12
    assert sorted(map(repr, df.collect())) == sorted(map(repr, gaussian.read(spark, "4000;0,1;5,0.5 1000;10,2;-5,1", seed=1).collect()))
    for bad in ("5", "5;1", "5;1,2 6;1,2;3,4"):
        with pytest.raises(ValueError):
            gaussian.groups(bad)


def test_stream_is_scored_once(spark, tmp_path):
    src, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    spark.range(50).write.parquet(src)
    score = lambda df: df.select("id", (F.col("id") * 2).alias("s"))
    run = lambda: scoring.scored(scoring.stream_of(spark, src), score, out, mark)
    assert run().count() == 50
    spark.range(50, 80).write.mode("append").parquet(src)
    got = run()
    assert got.count() == got.select("id").distinct().count() == 80
    assert got.filter("s <> id * 2").isEmpty()


def test_parts_one_after_another(spark, tmp_path):
    files.write_grouped(spark.range(10).withColumn("part", (F.col("id") % 3).cast("int")), f"{tmp_path}/in")
    for k in range(3):
        side = files.PartIteration(spark, f"{tmp_path}/in", f"{tmp_path}/out")  # as if started anew
        assert not side.done()
        side.save(side.part().agg(F.count("*").alias("n")))
    assert side.done() and sorted(map(tuple, side.results().select("part", "n").collect())) == [(0, 4), (1, 3), (2, 3)]
    with pytest.raises(StopIteration):
        side.part()


def test_a_long_line(spark):
    """In time that grows with the fields: 20,000 of them, and of equal keys the last counts, within a minute."""
    n = 20_000
    line = F.concat(F.lit("x "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat_ws(":", (i % 15_000).cast("string"), i.cast("string"))), " "))
    began = time.time()
    got = spark.range(1).select(svmlight.parsed(line).alias("p")).select("p.label", F.size("p.features"), F.element_at("p.features", "7"), F.element_at("p.features", "14999")).first()
    assert tuple(got) == ("x", 15_000, 15_007.0, 14_999.0) and time.time() - began < 60
