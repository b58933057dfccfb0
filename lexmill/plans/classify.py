"""Registered plans: labels, naive Bayes of both kinds, logistic regression, confusion reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import label_of, unit_draw
from ..operators import bayes, classifier, logreg, text
from ..operators.blocks import Blocks
from ..workspace import kept, new_path, small, spread
from .common import CORPUS_SQL, Corpus, table

#: Members of the ensemble and buckets of its hashed terms.
MEMBERS, BUCKETS = 4, 1024


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path): documents under paths /lang/doc_id."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))


def label_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("id", label_of(F.col("path")).alias("label"))


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.label_index(label_extract(spark, sf_dir))


def label_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_extract(spark, sf_dir)
    return labels.join(small(bayes.label_index(labels)), "label").select("id", "index")


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the row numbers 0 to 9, of which some are unknown."""
    return bayes.label_names(spark.range(10).select(F.col("id").cast("int").alias("index")), label_index(spark, sf_dir))


def _model(spark: SparkSession, sf_dir: str) -> tuple[Blocks, DataFrame, DataFrame]:
    found, labels = Corpus(spark, sf_dir).blocks, label_extract(spark, sf_dir)
    return found, labels, kept(bayes.block_train(found, labels), "model")


def stdnb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir)[2]


def stdnb_label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.label_weights(_model(spark, sf_dir)[2])


def stdnb_feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.feature_weights(_model(spark, sf_dir)[2])


def stdnb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, model = _model(spark, sf_dir)
    return bayes.scores(found, model).withColumn("score", F.round("score", 4))


def stdnb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, model = _model(spark, sf_dir)
    return bayes.best(bayes.scores(found, model), 4)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stdnb_classify(spark, sf_dir).select("id", F.col("label").alias("class")).join(label_extract(spark, sf_dir).select("id", F.col("label").alias("actual")), "id")


def stdnb_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.confusion(_judged(spark, sf_dir))


def confusion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As many rows as pairs of labels that occur.
    said = bayes.confusion_text(stdnb_confusion(spark, sf_dir).collect())
    return spark.createDataFrame([(said,)], "report string")


def accuracy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.accuracy(_judged(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), "p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), features.alias("features"))


def catnb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.categorical_train(_parts(spark, sf_dir))


def catnb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    return bayes.categorical_predict(rows, bayes.categorical_train(rows))


def catnb_predict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    return bayes.categorical_predict(rows, bayes.categorical_train(rows), "documents", rows.groupBy("label").agg(F.count("*").alias("n")))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, features): share of each bucket of terms in a labelled document."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality").filter("quality is not null")
    bucket = (F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % BUCKETS).cast("string")
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text").join(small(labels), F.col("doc_id") == F.col("id"))
    tokens = spread(labelled).select("id", "quality", F.explode(text.tokens_of(F.col("text"))).alias("term"))
    each = tokens.groupBy("id", "quality", bucket.alias("feature")).agg(F.count("*").alias("n"))
    rows = each.groupBy("id", F.col("quality").alias("label")).agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("feature", "n"))).alias("e"))
    return kept(rows.select("id", "label", F.map_from_entries(F.transform("e", lambda e: F.struct(e["feature"], e["n"] / F.col("all")))).alias("features")), "hashed")


def lr_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logreg.train(_hashed(spark, sf_dir), MEMBERS)


def lr_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on nine rows of ten, tested on the others."""
    rows = _hashed(spark, sf_dir)
    draw = unit_draw(F.col("id"), "lr")
    model = logreg.train(rows.filter(draw < 0.9), MEMBERS)
    tested = rows.filter(draw >= 0.9)
    return logreg.predict(tested, kept(model, "lr"), MEMBERS).join(tested.select("id", F.col("label").alias("actual")), "id")


def lr_score_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by formula instead of training, for two members."""
    return logreg.predict(_hashed(spark, sf_dir), _fixed(spark), 2)


def _fixed(spark: SparkSession) -> DataFrame:
    known = spark.range(BUCKETS).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("member"), F.col("id").cast("string").alias("feature"), (((F.col("id") * 31) % 101 - 50) / 10.0).alias("w"))
    return known.select("member", "feature", (F.col("w") * (F.col("member") + 1)).alias("weight"))


def stored_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on two halves of the documents, each stored, and loaded as one model."""
    found, labels = Corpus(spark, sf_dir).blocks, label_extract(spark, sf_dir)
    path = new_path(spark, "stored")
    for half in (0, 1):
        classifier.save(bayes.block_train(found, labels.filter(F.pmod("id", F.lit(2)) == half)), path, "bayes")
    return classifier.Classifier(spark, path, "bayes").predict(found)


def stored_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _parts(spark, sf_dir), new_path(spark, "stored")
    classifier.save(bayes.categorical_train(rows), path, "categorical")
    return classifier.Classifier(spark, path, "categorical").predict(rows)


def stored_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights by formula, each member stored on its own."""
    path = new_path(spark, "stored")
    for member in (0, 1):
        classifier.save(_fixed(spark).filter(F.col("member") == member), path, "logistic")
    return classifier.Classifier(spark, path, "logistic").predict(_hashed(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (label_extract, label_index, label_to_index, label_names, stdnb_train, stdnb_label_weights, stdnb_feature_weights, stdnb_scores, stdnb_classify, stdnb_confusion, confusion_text, accuracy_match, catnb_counts, catnb_predict, catnb_predict_documents, lr_train, lr_predict, lr_score_fixed, stored_bayes, stored_categorical, stored_logistic)
}

_INDEX = "SELECT lang AS label, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS index FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)"
_NB = f"""WITH {CORPUS_SQL},
lab AS (SELECT doc_id AS id, lang AS label FROM documents),
model AS MATERIALIZED (SELECT label, index, sum(value) AS weight FROM tf JOIN lab USING (id) GROUP BY 1, 2),
"""
_SCORED = (
    _NB
    + """lw AS (SELECT label, sum(weight) AS lw, (SELECT count(DISTINCT index) FROM model)::DOUBLE AS v FROM model GROUP BY 1),
sc AS MATERIALIZED (SELECT tf.id, lw.label, round(sum(tf.value * ln((coalesce(model.weight, 0) + 1) / (lw.lw + lw.v))), 4) AS score
  FROM tf CROSS JOIN lw LEFT JOIN model ON model.label = lw.label AND model.index = tf.index GROUP BY 1, 2),
best AS (SELECT id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS k FROM sc) WHERE k = 1),
judged AS (SELECT id, best.label AS class, lab.label AS actual FROM best JOIN lab USING (id))
"""
)
_CAT = """WITH f AS (SELECT p_partkey AS id, p_type AS label, 'brand' AS feature, p_brand AS value FROM part
  UNION ALL SELECT p_partkey, p_type, 'size', p_size::VARCHAR FROM part
  UNION ALL SELECT p_partkey, p_type, 'name', p_name FROM part),
c AS (SELECT label, feature, value, count(*) AS n FROM f GROUP BY 1, 2, 3)
"""


def _cat(prior: str) -> str:
    return f"""{_CAT}, s AS (SELECT c.label, count(DISTINCT feature) AS nf, count(*) AS np, any_value(docs) AS docs FROM c JOIN (SELECT p_type AS label, count(*) AS docs FROM part GROUP BY 1) USING (label) GROUP BY 1),
p AS (SELECT label, ln({prior}) AS prior, (nf + np)::DOUBLE AS bottom FROM s),
sc AS (SELECT f.id, p.label, any_value(prior) + sum(ln((coalesce(c.n, 0) + 1) / bottom)) AS score
  FROM f CROSS JOIN p LEFT JOIN c ON c.label = p.label AND c.feature = f.feature AND c.value = f.value GROUP BY 1, 2)
SELECT id, label, score FROM (SELECT id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, label) AS k FROM sc) WHERE k = 1"""


ORACLE = {
    "label_extract": "SELECT doc_id AS id, lang AS label FROM documents",
    "label_index": _INDEX,
    "label_to_index": f"WITH i AS ({_INDEX}) SELECT doc_id AS id, index FROM documents JOIN i ON lang = label",
    "label_names": f"WITH i AS ({_INDEX}) SELECT range::INTEGER AS index, coalesce(label, '{bayes.DEFAULT}') AS label FROM range(10) LEFT JOIN i ON index = range",
    "stdnb_train": _NB.rstrip(",\n") + " SELECT * FROM model",
    "stdnb_label_weights": _NB.rstrip(",\n") + " SELECT label, sum(weight) AS weight FROM model GROUP BY 1",
    "stdnb_feature_weights": _NB.rstrip(",\n") + " SELECT index, sum(weight) AS weight FROM model GROUP BY 1",
    "stdnb_scores": _SCORED + "SELECT * FROM sc",
    "stdnb_classify": _SCORED + "SELECT * FROM best",
    "stdnb_confusion": _SCORED + "SELECT actual, class, count(*) AS n FROM judged GROUP BY 1, 2",
    "accuracy_match": _SCORED + "SELECT CASE WHEN actual = class THEN 'match' ELSE 'mismatch' END AS result, count(*) AS n FROM judged GROUP BY 1",
    "catnb_counts": _CAT + "SELECT * FROM c",
    "catnb_predict": _cat("nf / (SELECT sum(nf) FROM s)::DOUBLE"),
    "catnb_predict_documents": _cat("docs / (SELECT count(*) FROM part)::DOUBLE"),
    "lr_score_fixed": f"""WITH tok AS (SELECT doc_id AS id, quality, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
e AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {BUCKETS} AS f, count(*) AS n FROM tok GROUP BY 1, 2),
d AS (SELECT id, sum(n * (((f * 31) % 101 - 50) / 10.0::DOUBLE)) / sum(n) AS dot FROM e GROUP BY 1),
s AS (SELECT id, (1 / (1 + exp(-dot)) + 1 / (1 + exp(-2 * dot))) / 2 AS score FROM d)
SELECT id, (round(score, 9) >= 0.5)::INTEGER AS prediction, round(score, 6) AS score FROM s""",
}
ORACLE["stored_bayes"] = ORACLE["stdnb_classify"]
ORACLE["stored_categorical"] = ORACLE["catnb_predict"]
ORACLE["stored_logistic"] = ORACLE["lr_score_fixed"]
