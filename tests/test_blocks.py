"""Words meet documents in blocks: no query deals a row for each entry of a document."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexmill import catalogue
from lexmill.operators import bayes, blocks, lda, plsi
from lexmill.plans.common import Corpus
from lexmill.sources import files
from lexmill.workspace import new_path

DOCS, TERMS, LENGTH = 3000, 60, 60
FREQ = "id int, index int, value double"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Documents in which each term occurs often, so that their entries are far more than they and the terms are."""
    r, home = random.Random(5), tmp_path_factory.mktemp("corpus")
    texts = [" ".join(f"word{r.randrange(TERMS)}" for _ in range(LENGTH)) for _ in range(DOCS)]
    table = pa.table({"doc_id": pa.array(range(DOCS), pa.int64()), "text": texts, "lang": [("en", "fr")[k % 2] for k in range(DOCS)], "source": ["s"] * DOCS, "n_chars": pa.array(map(len, texts), pa.int64())})
    pq.write_table(table, home / "documents.parquet")
    return str(home), sum(len(set(t.split())) for t in texts)


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


#: Queries of the corpus whose results aren't a row an entry.
WHOLE = ["lda_resumed", "lda_train_step", "lda_perplexity", "lda_loss_per_word", "lda_inference", "topic_counts", "topic_titles", "topic_keywords", "tfidf_vectors", "tfidf_top_terms", "tf_vectors", "row_ids_matrix", "plsi_likelihood", "plsi_posterior", "plsi_sym_step", "accuracy_match", "stdnb_confusion", "stored_bayes", "stdnb_classify"]


@pytest.mark.parametrize("name", WHOLE)
def test_entries_are_not_shuffled(spark, corpus, name):
    home, entries = corpus
    before = shuffled(spark)
    catalogue.QUERIES[name](spark, home).write.format("noop").mode("overwrite").save()
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < entries / 3


def test_blocks_hold_all_entries(spark, monkeypatch):
    """Of many small chunks and blocks; ids without a known word, values that aren't whole, and an id of another type too."""
    for name, most in (("CHUNK", 5), ("ROWS", 3), ("BLOCK_ENTRIES", 20), ("BLOCK_WORDS", 6)):
        monkeypatch.setattr(blocks, name, most)
    r = random.Random(1)
    rows = [(f"d{i}", j, r.choice([1.0, 300.0, 70000.0, 0.5, -2.0])) for i in range(40) for j in r.sample(range(30), r.randrange(1, 9))]
    found = blocks.of(spark.createDataFrame(rows, "id string, index int, value double"))
    assert sorted(map(tuple, found.entries().collect())) == sorted(rows)
    even = found.words.filter("index % 2 = 0")
    assert sorted(map(tuple, found.entries(lambda c, w: c.value * w.p[c.at, 0], even, F.array(F.lit(2.0))).collect())) == sorted((i, j, 2 * v) for i, j, v in rows if j % 2 == 0)
    got = {x["id"]: [(e["index"], e["value"]) for e in x["vector"]["features"]] for x in found.vectors(30, words=even).collect()}
    assert got == {i: sorted((j, v) for k, j, v in rows if k == i and j % 2 == 0) for i in {k for k, _, _ in rows}}
    assert sorted(x["index"] for x in found.indices().collect()) == sorted({j for _, j, _ in rows})


def test_lda_of_blocks(spark):
    r = np.random.default_rng(2)
    freq = spark.createDataFrame([(i, int(j), float(r.integers(1, 5))) for i in range(30) for j in r.choice(40, 12, replace=False)], FREQ).cache()
    p = lda.Params(topics=3, doc_iterations=3)
    found = blocks.of(freq)
    rows = [{x["index"]: x["counts"] for x in lda.train(f, lda.randomly(f, p), p).collect()} for f in (freq, found)]
    assert rows[0].keys() == rows[1].keys() and all(np.allclose(rows[0][k], rows[1][k]) for k in rows[0])
    assert np.isclose(sum(map(sum, rows[1].values())), freq.agg(F.sum("value")).first()[0])


def test_rows_of_one_id_are_one_document(spark, tmp_path):
    """As in SQL: their counts are added; each row has its vector."""
    table = pa.table({"doc_id": pa.array([1, 1, 2, None, 3], pa.int64()), "text": ["cat dog", "cat", "dog bird bird", "cat", None]})
    pq.write_table(table, tmp_path / "documents.parquet")
    entries = {(x["id"], x["index"]): x["value"] for x in catalogue.QUERIES["tf_long"](spark, str(tmp_path)).collect()}
    assert entries == {(1, 1): 2.0, (1, 2): 1.0, (2, 0): 2.0, (2, 2): 1.0}
    vectors = sorted((x["id"], x["n_entries"], x["total"]) for x in catalogue.QUERIES["tf_vectors"](spark, str(tmp_path)).collect())
    assert vectors == [(1, 2, 3.0), (1, 2, 3.0), (2, 2, 3.0)]


def test_bayes_of_blocks(spark, monkeypatch):
    """A document with two labels counts for both, one without for none; a null label has no words of its own."""
    monkeypatch.setattr(blocks, "BLOCK_ENTRIES", 4)
    monkeypatch.setattr(blocks, "CHUNK", 3)
    freq = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 0, 1.0), (3, 2, 4.0), (4, 1, 1.0), (5, 3, 7.0)], FREQ)
    labels = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, None), (4, "x")], "id int, label string")
    found = blocks.of(freq)
    model = bayes.block_train(found, labels).cache()
    assert {(r["label"], r["index"]): r["weight"] for r in model.collect()} == {("x", 0): 2.0, ("x", 1): 2.0, ("y", 0): 3.0, ("y", 1): 1.0, (None, 2): 4.0}
    got = {(r["id"], r["label"]): r["score"] for r in bayes.scores(found, model).collect()}
    weight = {"x": {0: 2, 1: 2}, "y": {0: 3, 1: 1}, None: {}}
    want = {(i, lab): sum(r["value"] * np.log((w.get(r["index"], 0) + 1) / (4 + 3)) for r in freq.collect() if r["id"] == i) for i in range(1, 6) for lab, w in weight.items()}
    assert got == pytest.approx(want)


def test_plsi_of_blocks(spark, monkeypatch):
    """Words and documents without parameters are left out, and so are pairs of probability zero."""
    monkeypatch.setattr(blocks, "CHUNK", 3)
    freq = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 0, 3.0), (2, 2, 1.0), (3, 1, 4.0), (4, 9, 1.0)], FREQ)
    w = spark.createDataFrame([(0, 0.5, 0.0), (1, 0.0, 0.5), (2, 0.25, 0.25)], "index int, t0 double, t1 double")
    d = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, 0.5)], "id int, t0 double, t1 double")
    got = {(r["id"], r["index"]): (r["t0"], r["t1"]) for r in plsi.expected(freq, w, d, None, 2).collect()}
    assert got == {(1, 0): (2.0, 0.0), (1, 1): (0.0, 0.0), (2, 0): (3.0, 0.0), (2, 2): (0.5, 0.5)}
    assert plsi.likelihood(freq, w, d, None, 2).first()[0] == pytest.approx(5 * np.log(0.25) + np.log(0.25))


def test_what_an_iteration_shuffled_is_freed(spark, corpus):
    """Its shuffle files go when it is committed, and the session's setting is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, c = spark.conf.get(name, "false"), Corpus(spark, corpus[0])
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    known = lambda: tracker.shuffleStatuses().size()
    found, p = c.blocks, lda.Params(topics=2, doc_iterations=1)
    store = files.RollingStore(spark, new_path(spark, "lda"))
    model, held = lda.train(found, lda.randomly(found, p), p), known()
    store.save(model)
    assert known() <= held and spark.conf.get(name, "false") == before
