"""Registered plans: k-means, PLSI and LDA."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmeans, lda, plsi
from ..operators.blocks import Blocks
from ..sources import files
from ..workspace import kept, new_path
from .common import CORPUS_SQL, Corpus, table

#: Clusters and slots of the embeddings; topics of PLSI.
K, DIM, Z = 10, 64, 5
LDA = lda.Params(topics=10, doc_iterations=10)
#: Documents in a report of topics' titles.
TITLES = 10


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"))


def _rounded(centroids: DataFrame) -> DataFrame:
    return centroids.select("k", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kmeans.update(kmeans.seeded(_points(spark, sf_dir), K), DIM))


def kmeans_seed_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.rounds(_points(spark, sf_dir), K, DIM, 1)[0].select("id", "k")


def kmeans_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kmeans.rounds(_points(spark, sf_dir), K, DIM, 2)[1])


def _counts(spark: SparkSession, sf_dir: str) -> Blocks:
    return Corpus(spark, sf_dir).blocks


def plsi_sym_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _counts(spark, sf_dir)
    w, d, z = plsi.symmetric_step(n, *plsi.initial(n, Z), Z)
    parts = plsi.long(w, "index", Z).select(F.lit("word").alias("kind"), F.col("index").cast("long").alias("key"), "topic", "value")
    parts = parts.union(plsi.long(d, "id", Z).select(F.lit("document"), F.col("id"), "topic", "value")).union(z.select(F.lit("topic").alias("kind"), F.lit(0).cast("long").alias("key"), F.posexplode(F.array(*(f"t{i}" for i in range(Z))))))
    return parts.withColumn("value", F.round("value", 8))


def plsi_asym_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _counts(spark, sf_dir)
    w, d, _ = plsi.initial(n, Z, symmetric=False)
    w, d = plsi.asymmetric_step(n, w, d, Z)
    parts = plsi.long(w, "index", Z).select(F.lit("word").alias("kind"), F.col("index").cast("long").alias("key"), "topic", "value")
    return parts.union(plsi.long(d, "id", Z).select(F.lit("document"), F.col("id"), "topic", "value")).withColumn("value", F.round("value", 8))


def plsi_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _counts(spark, sf_dir)
    w, d, z = plsi.initial(n, Z)
    return plsi.expected(n, w, d, z, Z).select("id", "index", *(F.round(f"t{i}", 6).alias(f"t{i}") for i in range(Z)))


def plsi_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the start and after one step, for both models."""
    n = _counts(spark, sf_dir)
    w, d, z = plsi.initial(n, Z)
    w1, d1, z1 = plsi.symmetric_step(n, w, d, z, Z)
    v, e, _ = plsi.initial(n, Z, symmetric=False)
    v1, e1 = plsi.asymmetric_step(n, v, e, Z)
    each = [("sym", 0, w, d, z), ("sym", 1, w1, d1, z1), ("asym", 0, v, e, None), ("asym", 1, v1, e1, None)]
    rows = [plsi.likelihood(n, a, b, c, Z).select(F.lit(name).alias("model"), F.lit(step).alias("step"), F.round("loglik", 2).alias("loglik")) for name, step, a, b, c in each]
    return reduce(DataFrame.union, rows)


def lda_train_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _counts(spark, sf_dir)
    rows = lda.train(n, lda.initial(n, LDA), LDA).select("index", F.posexplode("counts").alias("topic", "value"))
    return rows.withColumn("value", F.round("value", 4))


def lda_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _counts(spark, sf_dir)
    return lda.perplexity(n, lda.initial(n, LDA), LDA).select("id", "words", F.round("loss", 4).alias("loss"))


def lda_loss_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _counts(spark, sf_dir)
    return lda.loss_per_word(lda.perplexity(n, lda.initial(n, LDA), LDA)).select(F.round("loss_per_word", 6).alias("loss_per_word"))


def lda_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _counts(spark, sf_dir)
    return lda.inference(n, lda.initial(n, LDA), LDA).select("id", F.posexplode("shares").alias("topic", "value")).withColumn("value", F.round("value", 5))


def _main_topics(spark: SparkSession, sf_dir: str) -> tuple[Corpus, DataFrame]:
    c = Corpus(spark, sf_dir)
    return c, kept(lda.main_topics(lda.inference(c.blocks, lda.initial(c.blocks, LDA), LDA)), "topics")


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lda.topic_counts(_main_topics(spark, sf_dir)[1])


def topic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random documents of each topic, by what they are called."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("title"))
    return lda.titles(_main_topics(spark, sf_dir)[1], docs, TITLES)


def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After one pass from the start by formula."""
    c = Corpus(spark, sf_dir)
    return lda.keywords(lda.finished(kept(lda.train(c.blocks, lda.initial(c.blocks, LDA), LDA), "lda"), LDA), c.terms, digits=7)


def lda_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes from random counts, each a committed iteration of which the last is loaded by its number: sums of the counts."""
    c = Corpus(spark, sf_dir)
    store = files.RollingStore(spark, new_path(spark, "lda"))
    store.run(lambda: lda.randomly(c.blocks, LDA), lambda model: lda.train(c.blocks, model, LDA), 3)
    return lda.load_model(store, 3).agg(F.round(F.sum(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)), 2).alias("total"), F.count("*").alias("n_terms"))


def plsi_random_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the parameters drawn at random: each is a distribution."""
    w, d, z = plsi.randomly(_counts(spark, sf_dir), Z, seed=3)
    each = [plsi.long(w, "index", Z).select(F.lit("word").alias("kind"), "topic", "value"), plsi.long(d, "id", Z).select(F.lit("document").alias("kind"), "topic", "value")]
    return reduce(DataFrame.union, each).groupBy("kind", "topic").agg(F.round(F.sum("value"), 6).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (kmeans_update, kmeans_seed_assign, kmeans_two_rounds, plsi_sym_step, plsi_asym_step, plsi_posterior, plsi_likelihood, lda_train_step, lda_perplexity, lda_loss_per_word, lda_inference, topic_counts, topic_titles, topic_keywords, lda_resumed, plsi_random_start)
}

_KM = """WITH p AS (SELECT vec_id AS id, generate_subscripts(embedding, 1)::INTEGER - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
"""


def _kmeans(n: int) -> str:
    parts = [f"a0 AS (SELECT vec_id AS id, (vec_id % {K})::INTEGER AS k FROM embeddings)", "c0 AS MATERIALIZED (SELECT k, dim, avg(x) AS value FROM p JOIN a0 USING (id) GROUP BY 1, 2)"]
    for i in range(1, n + 1):
        parts.append(f"d{i} AS (SELECT id, k, sum((x - value) * (x - value)) AS d FROM p JOIN c{i - 1} USING (dim) GROUP BY 1, 2)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM d{i}) WHERE r = 1)")
        parts.append(f"c{i} AS MATERIALIZED (SELECT k, dim, avg(x) AS value FROM p JOIN a{i} USING (id) GROUP BY 1, 2)")
    return _KM + ",\n".join(parts)


_START = "1 + ((({key}) * 31 + ({z}) * 17) % 101) / 101.0::DOUBLE"


def _plsi(symmetric: bool) -> str:
    by = "z" if symmetric else "id"
    prior = f"(1.0::DOUBLE / {Z})" if symmetric else "1.0::DOUBLE"
    return f"""WITH {CORPUS_SQL},
zs AS (SELECT range::INTEGER AS z FROM range({Z})),
w0 AS MATERIALIZED (SELECT index, z, v / sum(v) OVER (PARTITION BY z) AS w FROM (SELECT index, z, {_START.format(key="index", z="z")} AS v FROM (SELECT DISTINCT index FROM tf), zs)),
d0 AS MATERIALIZED (SELECT id, z, v / sum(v) OVER (PARTITION BY {by}) AS d FROM (SELECT id, z, {_START.format(key="id", z="z + 1")} AS v FROM (SELECT DISTINCT id FROM tf), zs)),
j AS (SELECT tf.id, tf.index, z, value, w * d * {prior} AS p FROM tf JOIN w0 USING (index) JOIN d0 USING (id, z)),
q AS MATERIALIZED (SELECT id, index, z, value * p / sum(p) OVER (PARTITION BY id, index) AS q FROM j),
w1 AS MATERIALIZED (SELECT index, z, s / sum(s) OVER (PARTITION BY z) AS w FROM (SELECT index, z, sum(q) AS s FROM q GROUP BY 1, 2)),
d1 AS MATERIALIZED (SELECT id, z, s / sum(s) OVER (PARTITION BY {by}) AS d FROM (SELECT id, z, sum(q) AS s FROM q GROUP BY 1, 2)),
z1 AS (SELECT z, s / sum(s) OVER () AS p FROM (SELECT z, sum(q) AS s FROM q GROUP BY 1))
"""


def _lik(symmetric: bool, step: int) -> str:
    z = (f"(SELECT z, 1.0::DOUBLE / {Z} AS p FROM zs)" if step == 0 else "z1") if symmetric else "(SELECT z, 1.0::DOUBLE AS p FROM zs)"
    return _plsi(symmetric) + f""", l AS (SELECT value, sum(w * d * p) AS p FROM tf JOIN w{step} USING (index) JOIN d{step} USING (id, z) JOIN {z} pz USING (z) GROUP BY tf.id, tf.index, value)
SELECT '{"sym" if symmetric else "asym"}' AS model, {step} AS step, round(sum(value * ln(p)), 2) AS loglik FROM l"""


_P = LDA


def _lda() -> str:
    start = f"""WITH {CORPUS_SQL},
zs AS (SELECT range::INTEGER AS z FROM range({_P.topics})),
m AS MATERIALIZED (SELECT index, z, {_START.format(key="index", z="z")} AS c FROM (SELECT DISTINCT index FROM tf), zs),
s AS (SELECT z, sum(c) AS s FROM m GROUP BY 1),
lik AS MATERIALIZED (SELECT index, z, (c + {_P.eta}) / (s + {_P.eta} * (SELECT count(DISTINCT index) FROM m)) AS l FROM m JOIN s USING (z)),
th0 AS (SELECT id, z, 1.0::DOUBLE / {_P.topics} AS th FROM (SELECT DISTINCT id FROM tf), zs)
"""
    for i in range(1, _P.doc_iterations + 1):
        start += f""", q{i} AS MATERIALIZED (SELECT id, index, z, value * p / sum(p) OVER (PARTITION BY id, index) AS q FROM (SELECT tf.id, tf.index, z, value, l * (th + {_P.alpha}) AS p FROM tf JOIN lik USING (index) JOIN th{i - 1} USING (id, z)))
, th{i} AS MATERIALIZED (SELECT id, z, s / sum(s) OVER (PARTITION BY id) AS th FROM (SELECT id, z, sum(q) AS s FROM q{i} GROUP BY 1, 2))
"""
    return start


_LOSS = _lda() + f""", ll AS (SELECT id, index, value, sum(l * (th + {_P.alpha}) / (1 + {_P.topics} * {_P.alpha})) AS p FROM tf JOIN lik USING (index) JOIN th{_P.doc_iterations} USING (id, z) GROUP BY 1, 2, 3)
"""

_MAIN = _lda() + f""", main AS MATERIALIZED (SELECT id, z AS topic FROM (SELECT id, z, row_number() OVER (PARTITION BY id ORDER BY round(th, 6) DESC, z) AS k FROM th{_P.doc_iterations}) WHERE k = 1)
"""

ORACLE = {
    "kmeans_update": _kmeans(0) + " SELECT k, dim, round(value, 6) AS value FROM c0",
    "kmeans_seed_assign": _kmeans(1) + " SELECT id, k FROM a1",
    "kmeans_two_rounds": _kmeans(2) + " SELECT k, dim, round(value, 6) AS value FROM c2",
    "plsi_sym_step": _plsi(True) + """SELECT 'word' AS kind, index::BIGINT AS key, z AS topic, round(w, 8) AS value FROM w1
UNION ALL SELECT 'document', id, z, round(d, 8) FROM d1 UNION ALL SELECT 'topic', 0, z, round(p, 8) FROM z1""",
    "plsi_asym_step": _plsi(False) + "SELECT 'word' AS kind, index::BIGINT AS key, z AS topic, round(w, 8) AS value FROM w1 UNION ALL SELECT 'document', id, z, round(d, 8) FROM d1",
    "plsi_posterior": _plsi(True) + f"SELECT id, index, {', '.join(f'round(max(CASE WHEN z = {i} THEN q END), 6) AS t{i}' for i in range(Z))} FROM q GROUP BY 1, 2",
    "plsi_likelihood": " UNION ALL ".join(f"({_lik(sym, step)})" for sym in (True, False) for step in (0, 1)),
    "lda_train_step": _lda() + f"SELECT index, z AS topic, round(sum(q), 4) AS value FROM q{_P.doc_iterations} GROUP BY 1, 2",
    "lda_inference": _lda() + f"SELECT id, z AS topic, round(th, 5) AS value FROM th{_P.doc_iterations}",
    "lda_perplexity": _LOSS + "SELECT id, sum(value) AS words, round(-sum(value * ln(p)), 4) AS loss FROM ll GROUP BY 1",
    "lda_loss_per_word": _LOSS + "SELECT round(-sum(value * ln(p)) / sum(value), 6) AS loss_per_word FROM ll",
    "topic_counts": _MAIN + "SELECT topic, count(*) AS n FROM main GROUP BY 1",
    "topic_titles": _MAIN + f"""SELECT topic, source || ':' || doc_id AS title FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY md5('titles:' || id::VARCHAR), id) AS k FROM main) JOIN documents ON doc_id = id WHERE k <= {TITLES}""",
    "topic_keywords": _lda() + f""", m1 AS MATERIALIZED (SELECT index, z, sum(q) AS c FROM q{_P.doc_iterations} GROUP BY 1, 2),
f AS (SELECT index, z, round(c / sum(c) OVER (PARTITION BY z), 7) AS value FROM m1),
r AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY value DESC, index) AS rank FROM f)
SELECT z AS topic, rank::INTEGER AS rank, term, value FROM r JOIN dict USING (index) WHERE rank <= 50""",
    "lda_resumed": f"WITH {CORPUS_SQL} SELECT round(sum(value), 2) AS total, count(DISTINCT index) AS n_terms FROM tf",
    "plsi_random_start": f"SELECT kind, range::INTEGER AS topic, 1.0::DOUBLE AS total FROM range({Z}), (VALUES ('word'), ('document')) AS k(kind)",
}
