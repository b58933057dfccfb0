"""Registered plans: from texts to TF-IDF, dictionaries and row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text
from ..workspace import kept, spread
from .common import CORPUS_SQL, MIN_SUPPORT, Corpus, table

TOP = 10


def corpus_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("text").alias("total"))


def weights(spark: SparkSession, sf_dir: str) -> tuple[Corpus, DataFrame]:
    """The corpus, and (index, idf) of its terms."""
    c = Corpus(spark, sf_dir)
    return c, text.idf(c.weighed.select("index", "df"), corpus_total(spark, sf_dir))


def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, idf = weights(spark, sf_dir)
    return text.block_top_terms(c.blocks, idf, c.terms, TOP)


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, idf = weights(spark, sf_dir)
    return text.block_tfidf(c.blocks, idf).withColumn("value", F.round("value", 6))


def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every document, those without a weighed term too."""
    c, idf = weights(spark, sf_dir)
    got = _described(c.of_rows(text.block_tfidf_vectors(c.blocks, idf, c.terms.count())))
    return got.withColumn("total", F.round("total", 4))


def analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by each analyzer."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = [F.size(f(F.col("text"))).alias(name) for name, f in text.ANALYZERS.items()]
    return docs.filter("text is not null").select("doc_id", *sizes)


def corpus_tf_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of all term frequencies."""
    return Corpus(spark, sf_dir).totals.agg(F.sum(F.col("n").cast("double")).alias("total"))


def df_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of two halves of the corpus, merged."""
    freq = kept(Corpus(spark, sf_dir).freq, "tf")
    return text.df_merged(*(text.df(freq.filter(F.pmod("id", F.lit(2)) == k)) for k in (0, 1)))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.tokenize(table(spark, sf_dir, "documents"), stop_words=text.ENGLISH_STOP_WORDS)
    return found.select("name", F.size("tokens").alias("n_tokens"), F.concat_ws(" ", "tokens").alias("joined"))


def term_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).totals.select("term", "n")


def dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).terms


def tf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).freq


def tf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return _described(c.of_rows(c.blocks.vectors(c.terms.count())))


def _described(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", "vector.cardinality", F.size("vector.features").alias("n_entries"), F.aggregate("vector.features", F.lit(0.0), lambda a, e: a + e["value"]).alias("total"))


def df_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).weighed.select("index", "df")


def df_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.df_distribution(df_table(spark, sf_dir))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.row_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name")))


def row_ids_docindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


def row_ids_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    names = _names(spark, sf_dir).select(F.col("name").cast("bigint").alias("id"), F.col("id").alias("row"))
    return text.block_rows(c.blocks, names)


QUERIES = {f.__name__: f for f in (tfidf_top_terms, tfidf, tfidf_vectors, analyzers, corpus_tf_sum, df_merged, tokens, term_min_support, dict_encode, tf_long, tf_vectors, df_table, df_distribution, corpus_total, row_ids_docindex, row_ids_matrix)}

_TFIDF_SQL = f"""WITH {CORPUS_SQL},
total AS (SELECT count(text) AS total FROM documents),
dfs AS (SELECT index, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT index, ln(total / (df + 1)::DOUBLE) + 1 AS idf FROM dfs, total WHERE df >= 1 AND df <= floor(total * 80 / 100.0)),
w AS (SELECT id, index, sqrt(floor(value)) * idf AS value FROM tf JOIN idf USING (index))
"""
_STOP = ", ".join(f"'{w}'" for w in text.ENGLISH_STOP_WORDS)

ORACLE = {
    "tfidf_top_terms": _TFIDF_SQL + f""", r AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY round(value, 6) DESC, index))::INTEGER AS rank FROM w)
SELECT id, rank, term, round(value, 6) AS value FROM r JOIN dict USING (index) WHERE rank <= {TOP}""",
    "tfidf": _TFIDF_SQL + "SELECT id, index, round(value, 6) AS value FROM w",
    "tfidf_vectors": _TFIDF_SQL + """SELECT doc_id AS id, (SELECT count(*) FROM dict)::INTEGER AS cardinality, count(index)::INTEGER AS n_entries, round(coalesce(sum(value), 0), 4) AS total
FROM documents LEFT JOIN w ON w.id = doc_id WHERE text IS NOT NULL GROUP BY 1""",
    "analyzers": f"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({_STOP})))::INTEGER AS standard, len(regexp_extract_all(lower(text), '\\p{{L}}+'))::INTEGER AS simple,
len(regexp_extract_all(text, '[^\\s\\v]+'))::INTEGER AS whitespace, 1 AS keyword FROM documents WHERE text IS NOT NULL""",
    "corpus_tf_sum": f"WITH {CORPUS_SQL} SELECT sum(value) AS total FROM tf",
    "df_merged": f"WITH {CORPUS_SQL} SELECT index, count(*) AS df FROM tf GROUP BY 1",
    "tokens": f"""WITH t AS (SELECT doc_id AS name, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({_STOP})) AS tokens FROM documents WHERE text IS NOT NULL)
SELECT name, len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, ' ') AS joined FROM t""",
    "term_min_support": f"WITH {CORPUS_SQL} SELECT term, sum(n)::BIGINT AS n FROM cnt GROUP BY 1 HAVING sum(n) >= {MIN_SUPPORT}",
    "dict_encode": f"WITH {CORPUS_SQL} SELECT * FROM dict",
    "tf_long": f"WITH {CORPUS_SQL} SELECT * FROM tf",
    "tf_vectors": f"""WITH {CORPUS_SQL} SELECT doc_id AS id, (SELECT count(*) FROM dict)::INTEGER AS cardinality, count(index)::INTEGER AS n_entries, coalesce(sum(value), 0)::DOUBLE AS total
FROM documents LEFT JOIN tf ON tf.id = doc_id WHERE text IS NOT NULL GROUP BY 1""",
    "df_table": f"WITH {CORPUS_SQL} SELECT index, count(*) AS df FROM tf GROUP BY 1",
    "df_distribution": f"WITH {CORPUS_SQL} SELECT max(index) AS max_feature, count(*) AS num_feature, max(df) AS max_frequency, sum(df)::BIGINT AS total_frequency FROM (SELECT index, count(*) AS df FROM tf GROUP BY 1)",
    "corpus_total": "SELECT count(text) AS total FROM documents",
    "row_ids_docindex": "SELECT (row_number() OVER (ORDER BY name) - 1)::INTEGER AS id, name FROM (SELECT DISTINCT doc_id::VARCHAR AS name FROM documents)",
    "row_ids_matrix": f"""WITH {CORPUS_SQL}, ids AS (SELECT (row_number() OVER (ORDER BY name) - 1)::INTEGER AS id, name FROM (SELECT DISTINCT doc_id::VARCHAR AS name FROM documents))
SELECT ids.id, index, value FROM tf JOIN ids ON ids.name = tf.id::VARCHAR""",
}
