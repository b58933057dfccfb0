"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embed_dedup, guessing, langid, line_dedup, mixing, near_dedup, sharding, substring_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), copy_col="copy")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", "lang", "language", "lead", "accepted")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.duplicates(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(table(spark, sf_dir, "pages")).drop("html")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guessing.secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_language": op6_language,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_secrets": op10_secrets,
}

_WEIGHT = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in mixing.WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"

_LINES = "string_split(text, chr(10))"

ORACLE: dict[str, str] = {
    "op7_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM documents
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM l WHERE line <> '') WHERE k > 1
)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text, count(gone.i)::INTEGER AS lines_removed
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
""",
    "op9_url_filter": url_filter.sql(),
    "op3_mixing": f"""
WITH per AS (
  SELECT source AS s, sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0))::BIGINT AS tokens FROM documents GROUP BY 1
), w AS (
  SELECT s, tokens, CASE WHEN tokens > 0 THEN {_WEIGHT.replace("source", "s", 1)} ELSE 0.0::DOUBLE END AS w FROM per
), r AS (
  SELECT s, CASE WHEN tokens > 0 THEN (sum(tokens) OVER ())::DOUBLE * w / (sum(w) OVER ()) / tokens ELSE 1.0::DOUBLE END AS rate FROM w
), d AS (
  SELECT d.*, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS n
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.s
)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n))::INTEGER AS copy FROM d WHERE n > 0
""",
}
