"""What the registered plans share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, text
from ..operators.blocks import Blocks
from ..operators.relational import numbered
from ..schema import from_long
from ..workspace import freed, kept, small

#: Least occurrences of a dictionary's terms.
MIN_SUPPORT = 2
#: Slots of the vectors made of the order lines.
SLOTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Corpus:
    """The documents' words in blocks, with the dictionary; texts are tokenised and counted once, when the blocks are written.

    Rows of one id are one document. Stop words and rare words have no number.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id is not null and text is not null")

    @cached_property
    def repeated(self) -> DataFrame:
        """(id, n) of the documents that are several rows."""
        return kept(self.docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1"), "repeated")

    @cached_property
    def packed(self) -> tuple[DataFrame, DataFrame]:
        docs = self.docs
        if not self.repeated.isEmpty():
            several = docs.join(self.repeated, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
            docs = docs.join(self.repeated, F.col("doc_id") == F.col("id"), "left_anti").unionByName(several)
        return blocks.pack(text.tokenize(docs).toDF("id", "items"), text.ENGLISH_STOP_WORDS)

    @cached_property
    def totals(self) -> DataFrame:
        """(term, n, df): occurrences in all documents, and documents, of the dictionary's terms."""
        sums = self.packed[1].groupBy(F.col("item").alias("term")).agg(F.sum("n").cast("bigint").alias("n"), F.sum("df").alias("df"))
        with freed(self.docs.sparkSession):
            return kept(sums.filter(F.col("n") >= MIN_SUPPORT), "totals")  # ranges are sampled before they are dealt

    @cached_property
    def weighed(self) -> DataFrame:
        """(term, df, index)."""
        totals = self.totals.select("term", "df")
        with freed(self.docs.sparkSession):
            return kept(numbered(totals, "term"), "terms")

    @cached_property
    def terms(self) -> DataFrame:
        return self.weighed.select("term", "index")

    @cached_property
    def blocks(self) -> Blocks:
        chunks, words = self.packed
        known = words.select("block", "at", F.col("item").alias("term")).join(self.terms, "term").select("block", "at", "index")
        with freed(self.docs.sparkSession):
            return Blocks(chunks, kept(known, "words"))

    @property
    def freq(self) -> DataFrame:
        """(id, index, value): a row an entry."""
        return self.blocks.entries()

    def of_rows(self, vectors: DataFrame) -> DataFrame:
        """A vector for each row of the documents, not only for each id."""
        if self.repeated.isEmpty():
            return vectors
        each = vectors.join(small(self.repeated), "id", "left")
        return each.select("id", "vector", F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1)).cast("int")))).select("id", "vector")


def customer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, index, value): quantity that each customer ordered, by slot of the part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.pmod("l_partkey", F.lit(SLOTS)).cast("int").alias("index"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("id", "index").agg(F.sum("l_quantity").alias("value"))


def customer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector) of the customers with orders."""
    return from_long(customer_entries(spark, sf_dir), SLOTS)


def with_nation(vectors: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors with the nation of the customer."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return vectors.join(customer, "id")


# The same in SQL, as parts of a WITH.

CORPUS_SQL = f"""
tok AS (SELECT doc_id AS name, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents WHERE text IS NOT NULL),
cnt AS MATERIALIZED (SELECT name, term, count(*) AS n FROM tok WHERE term NOT IN ({", ".join(f"'{w}'" for w in text.ENGLISH_STOP_WORDS)}) GROUP BY 1, 2),
dict AS MATERIALIZED (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS index FROM (SELECT term FROM cnt GROUP BY 1 HAVING sum(n) >= {MIN_SUPPORT})),
tf AS MATERIALIZED (SELECT name AS id, index, n::DOUBLE AS value FROM cnt JOIN dict USING (term))
"""

VECTOR_SQL = f"""
cv AS MATERIALIZED (SELECT o_custkey AS id, (l_partkey % {SLOTS})::INTEGER AS index, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
nat AS (SELECT c_nationkey AS nation, index, value FROM cv JOIN customer ON c_custkey = id),
nv AS MATERIALIZED (SELECT nation, index, sum(value) AS value FROM nat GROUP BY 1, 2)
"""
