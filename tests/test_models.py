import random
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import bayes, classifier, kmeans, lda, logreg, plsi

FREQ = "id int, index int, value double"


def freq(spark, d):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(d) for j, v in enumerate(row) if v], FREQ)


def counts(seed, docs=12, words=15):
    r = np.random.default_rng(seed)
    d = r.poisson(0.4, (docs, words)) + np.where((np.arange(docs) % 2)[:, None] == (np.arange(words) % 2), r.poisson(2.0, (docs, words)), 0)
    d[:, 0] += 1
    d[0] += 1
    return d.astype(float)


def test_standard_bayes(spark):
    entries = spark.createDataFrame([("x", 0, 2.0), ("x", 1, 8.0), ("y", 2, 3.0), ("y", 3, 1.0), ("y", 4, 1.0)], "label string, index int, value double")
    model = bayes.train(entries)
    docs = spark.createDataFrame([(1, 0, 1.0), (2, 2, 2.0), (2, 9, 1.0), (3, 0, 1.0), (3, 2, 1.0)], FREQ)
    got = {(r["id"], r["label"]): r["score"] for r in bayes.scores(docs, model).collect()}
    assert got[1, "x"] == pytest.approx(log(3 / 15)) and got[1, "y"] == pytest.approx(log(1 / 10))
    assert got[2, "y"] == pytest.approx(2 * log(4 / 10) + log(1 / 10))
    best = {r["id"]: r["label"] for r in bayes.best(bayes.scores(docs, model)).collect()}
    assert best[1] == "x" and best[2] == "y"


def test_labels(spark):
    index = bayes.label_index(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "label string"))
    assert {r["label"]: r["index"] for r in index.collect()} == {"a": 0, "b": 1}
    rows = spark.createDataFrame([(1,), (7,), (None,)], "index int")
    assert sorted(r["label"] for r in bayes.label_names(rows, index).collect()) == ["DEFAULT", "DEFAULT", "b"]


def test_confusion(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("b", "b")], "actual string, class string")
    said = bayes.confusion_text(bayes.confusion(pairs).collect())
    lines = [x.split() for x in said.splitlines()]
    assert ["2", "1", "|", "3", "a", "=", "a"] in lines and ["0", "3", "|", "3", "b", "=", "b"] in lines
    assert {r["result"]: r["n"] for r in bayes.accuracy(pairs).collect()} == {"match": 5, "mismatch": 1}


def test_categorical_bayes(spark):
    table = [(k, lab, dict(color=c, shape=s)) for k, (lab, c, s) in enumerate([("p", "red", "round"), ("p", "red", "long"), ("q", "blue", "round"), ("q", "blue", "round")])]
    rows = spark.createDataFrame(table, "id int, label string, features map<string,string>")
    model = bayes.categorical_train(rows)
    got = {r["id"]: (r["label"], r["score"]) for r in bayes.categorical_predict(rows, model).collect()}
    # p: 2 features, pairs red, round, long; q: 2 features, pairs blue, round.
    assert got[0] == ("p", pytest.approx(log(0.5 * 3 / 5 * 2 / 5), abs=1e-6))
    assert got[2] == ("q", pytest.approx(log(0.5 * 3 / 4 * 3 / 4), abs=1e-6))
    with pytest.raises(ValueError):
        bayes.categorical_predict(rows, model, "other")


def test_logistic_regression(spark):
    r = random.Random(1)
    table = []
    for k in range(300):
        y = k % 2
        table.append((k, y, {"a": r.random() + y, "b": r.random() + 1 - y, f"n{r.randrange(5)}": 1.0}))
    table += [(900, None, {"a": 1.0}), (901, 1, {}), (902, 1, None)]
    rows = spark.createDataFrame(table, "id int, label int, features map<string,double>")
    model = logreg.train(rows, 3)
    member, theta = {}, {}
    for x in model.collect():
        theta.setdefault(x["member"], {})[x["feature"]] = x["weight"]
    dealt = rows.filter("label is not null and size(features) > 0").select(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(3)).alias("m"), "label", "features", F.xxhash64("id", F.lit(1)).alias("t")).orderBy("t").collect()
    for m in range(3):
        assert theta[m] == pytest.approx(logreg.fit([(x["label"], x["features"]) for x in dealt if x["m"] == m]))
    said = {x["id"]: x["prediction"] for x in logreg.predict(rows.filter("features is not null"), model, 3).collect()}
    assert sum(said[k] == k % 2 for k in range(300)) >= 270
    assert said[901] == 1 and not member


def test_kmeans(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, None]), (0, [3.0, 4.0]), (1, [9.0, 9.0])], "k int, point array<double>")
    got = {r["k"]: r["centroid"] for r in kmeans.update(rows, 2).collect()}
    assert got == {0: [2.0, 2.0], 1: [9.0, 9.0]}
    centroids = kmeans.update(rows, 2)
    near = kmeans.assign(spark.createDataFrame([(1, [2.0, None]), (2, [8.0, 9.0]), (3, [5.5, 5.5])], "id int, point array<double>"), centroids)
    assert {r["id"]: r["k"] for r in near.collect()} == {1: 0, 2: 1, 3: 0}
    kmeans.write_centroids(centroids, f"{tmp_path}/c")
    assert {r["k"]: r["centroid"] for r in kmeans.read_centroids(spark, f"{tmp_path}/c").collect()} == got
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x").write_text("0 1 2\n0 3 4\n")
    with pytest.raises(ValueError):
        kmeans.read_centroids(spark, f"{tmp_path}/bad")


def _start(n, k, shift=0):
    key = np.arange(n)[:, None]
    return 1 + (key * 31 + (np.arange(k) + shift)[None] * 17) % 101 / 101.0


def wide(df, key, n, k):
    out = np.zeros((n, k))
    for r in df.collect():
        out[r[key]] = [r[f"t{z}"] for z in range(k)]
    return out


def test_plsi_symmetric_against_numpy(spark):
    d, k = counts(1), 3
    n = freq(spark, d)
    w, e, z = plsi.initial(n, k)
    pw, pd, pz = _start(d.shape[1], k), _start(d.shape[0], k, 1), np.full(k, 1 / k)
    pw, pd = pw / pw.sum(axis=0), pd / pd.sum(axis=0)
    last = -np.inf
    for _ in range(3):
        p = pz * pd[:, None] * pw[None]
        like = (d * np.log(p.sum(axis=2))).sum()
        assert plsi.likelihood(n, w, e, z, k).first()[0] == pytest.approx(like) and like > last
        last = like
        q = d[:, :, None] * p / p.sum(axis=2, keepdims=True)
        pw, pd, pz = q.sum(axis=0), q.sum(axis=1), q.sum(axis=(0, 1))
        pw, pd, pz = pw / pw.sum(axis=0), pd / pd.sum(axis=0), pz / pz.sum()
        w, e, z = (x.checkpoint() for x in plsi.symmetric_step(n, w, e, z, k))
        assert np.allclose(wide(w, "index", len(pw), k), pw) and np.allclose(wide(e, "id", len(pd), k), pd)


def test_plsi_asymmetric_against_numpy(spark):
    d, k = counts(2), 2
    n = freq(spark, d)
    w, e, _ = plsi.initial(n, k, symmetric=False)
    pw, pd = _start(d.shape[1], k), _start(d.shape[0], k, 1)
    pw, pd = pw / pw.sum(axis=0), pd / pd.sum(axis=1, keepdims=True)
    last = -np.inf
    for _ in range(3):
        p = pd[:, None] * pw[None]
        like = (d * np.log(p.sum(axis=2))).sum()
        assert plsi.likelihood(n, w, e, None, k).first()[0] == pytest.approx(like) and like > last
        last = like
        q = d[:, :, None] * p / p.sum(axis=2, keepdims=True)
        pw, pd = q.sum(axis=0) / q.sum(axis=(0, 1)), q.sum(axis=1) / q.sum(axis=(1, 2))[:, None]
        w, e = (x.checkpoint() for x in plsi.asymmetric_step(n, w, e, k))
        assert np.allclose(wide(w, "index", len(pw), k), pw) and np.allclose(wide(e, "id", len(pd), k), pd)


def test_lda_against_numpy(spark):
    d, p = counts(3), lda.Params(topics=3, doc_iterations=4)
    n = freq(spark, d)
    model, c = lda.initial(n, p), _start(d.shape[1], 3)
    last = np.inf
    for _ in range(4):
        like = (c + p.eta) / (c.sum(axis=0) + p.eta * len(c))
        theta = np.full((len(d), 3), 1 / 3)
        for _ in range(p.doc_iterations):
            q = like[None] * (theta[:, None] + p.alpha)
            q = q / q.sum(axis=2, keepdims=True) * d[:, :, None]
            theta = q.sum(axis=1)
            theta = theta / theta.sum(axis=1, keepdims=True)
        got = {r["id"]: r["shares"] for r in lda.inference(n, model, p).collect()}
        assert np.allclose([got[i] for i in range(len(d))], theta)
        share = (theta + p.alpha) / (1 + 3 * p.alpha)
        loss = -(d * np.log((share[:, None] * like[None]).sum(axis=2))).sum() / d.sum()
        assert lda.loss_per_word(lda.perplexity(n, model, p)).first()[0] == pytest.approx(loss) and loss < last
        last = loss
        model, c = lda.train(n, model, p).checkpoint(), q.sum(axis=0)
        rows = {r["index"]: r["counts"] for r in model.collect()}
        assert np.allclose([rows[i] for i in range(len(c))], c)
    done = lda.finished(model, p).groupBy("topic").agg(F.sum("value").alias("s")).collect()
    assert [r["s"] for r in done] == pytest.approx([1.0] * 3)
    terms = spark.createDataFrame([(f"t{i}", i) for i in range(d.shape[1])], "term string, index int")
    best = lda.keywords(lda.finished(model, p), terms, 4).collect()
    assert len(best) == 12 and {r["rank"] for r in best} == {1, 2, 3, 4}
    assert sum(r["n"] for r in lda.topic_counts(lda.main_topics(lda.inference(n, model, p))).collect()) == len(d)


def test_random_start_is_repeatable(spark):
    n, p = freq(spark, counts(4)), lda.Params(topics=2)
    a, b, c = (sorted(map(repr, lda.randomly(n, p, s).collect())) for s in (1, 1, 2))
    assert a == b != c


def test_stored_models_are_merged(spark, tmp_path):
    for member, w in ((0, 2.0), (1, -1.0)):
        classifier.save(spark.createDataFrame([(member, "a", w)], "member int, feature string, weight double"), str(tmp_path), "logistic")
    rows = spark.createDataFrame([(1, {"a": 1.0}), (2, {"b": 1.0})], "id int, features map<string,double>")
    want = (1 / (1 + np.exp(-2.0)) + 1 / (1 + np.exp(1.0))) / 2
    got = {r["id"]: (r["prediction"], r["score"]) for r in classifier.Classifier(spark, str(tmp_path), "logistic").predict(rows).collect()}
    assert got == {1: (1, pytest.approx(want, abs=1e-6)), 2: (1, 0.5)}
    classifier.save(spark.createDataFrame([(1, "a", 5.0)], "member int, feature string, weight double"), str(tmp_path), "logistic")
    with pytest.raises(ValueError, match="two weights"):
        classifier.Classifier(spark, str(tmp_path), "logistic")
    with pytest.raises(ValueError, match="unknown kind"):
        classifier.Classifier(spark, str(tmp_path), "forest")
    spark.range(1).write.parquet(f"{tmp_path}/bayes")
    with pytest.raises(ValueError):
        classifier.Classifier(spark, str(tmp_path), "bayes")


def test_members_match_a_plain_loop(spark):
    """Each member's weights are those of one pass over its rows in their order."""
    r = random.Random(4)
    table = [(i, r.randrange(2), {f"f{r.randrange(9)}": r.uniform(-1, 1) for _ in range(4)}) for i in range(80)]
    rows = spark.createDataFrame(table, "id long, label int, features map<string,double>")
    turns = rows.select("id", F.pmod(F.xxhash64("id", F.lit(0)), F.lit(3)).alias("m"), F.xxhash64("id", F.lit(1)).alias("t")).collect()
    at, by = {x["id"]: (x["m"], x["t"]) for x in turns}, {i: (y, f) for i, y, f in table}
    want = {}
    for m in range(3):
        order = sorted((i for i in at if at[i][0] == m), key=lambda i: at[i][1])
        want |= {(m, k): w for k, w in logreg.fit([by[i] for i in order]).items()}
    got = {(x["member"], x["feature"]): x["weight"] for x in logreg.train(rows, 3).collect()}
    assert got == pytest.approx(want)


def test_random_start_and_slices(spark):
    n = freq(spark, counts(3))
    a, b = (plsi.randomly(n, 3, seed=s)[0].orderBy("index").collect() for s in (1, 2))
    assert a != b and all(sum(r[f"t{z}"] for r in a) == pytest.approx(1) for z in range(3))
    d = plsi.randomly(n, 3, symmetric=False)[1].collect()
    assert all(sum(r[f"t{z}"] for z in range(3)) == pytest.approx(1) for r in d)
    parts = n.withColumn("part", F.pmod("index", F.lit(4)))
    assert plsi.require_slices(parts, 4) is parts
    with pytest.raises(ValueError):
        plsi.require_slices(parts, 3)


def test_points_of_several_lengths(spark):
    points = spark.createDataFrame([(1, [1.0, None, 2.0]), (2, [0.1]), (3, None), (4, [])], "id int, point array<double>")
    centroids = spark.createDataFrame([(0, [0.0]), (1, [1.0, 0.0, 2.0])], "k int, centroid array<double>")
    assert {r["id"]: r["k"] for r in kmeans.assign(points, centroids).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
