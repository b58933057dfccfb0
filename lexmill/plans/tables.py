"""Registered plans: joins, groups, samples and splits; bags, JSON and single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import relational
from .common import table


def min_support_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).filter("n >= 2")


def group_all_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


def multikey_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def inner_join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their balance by nation and region."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def bincond(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept")
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def decode_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as numbers; those not named have none."""
    return table(spark, sf_dir, "orders").select("o_orderkey", values.decode(F.col("o_orderstatus"), "F", 1, "O", 0).alias("done"))


def collected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the nations of each region, in order."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


def split_90_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = relational.split(table(spark, sf_dir, "documents").select("doc_id"), 0.9, "doc_id")
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 0.1, "doc_id")


def reservoir_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.reservoir(table(spark, sf_dir, "documents").select("doc_id", "source"), 10, "source", "doc_id")


def random_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 8 groups at random."""
    group = F.floor(values.unit_draw(F.col("doc_id"), "group") * 8).cast("int")
    return table(spark, sf_dir, "documents").groupBy(group.alias("grp")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its place in a random order."""
    key = F.md5(F.concat(F.lit("shuffle:"), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(key, F.lit(":"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("turn"))
    return relational.numbered(rows, "turn", "place").select("doc_id", "place")


def distinct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numbered(table(spark, sf_dir, "documents").select("source").distinct(), "source")


def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and ids given to them, which differ."""
    rows = table(spark, sf_dir, "orders").select(F.monotonically_increasing_id().alias("row_id"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_ids"))


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *values.json_flatten(F.col("props"), "k:int,missing.path"))


def _roll(size: int, step: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("bag"))
        rows = turns.select("conv_id", F.posexplode(values.roll_bag(F.col("bag"), size, step)).alias("k", "bag"))
        return rows.select("conv_id", (F.col("k") * step).alias("begin"), F.array_join(F.transform("bag", lambda e: e["text"]), " | ").alias("joined"))

    return query


def tuple_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.tuple_sum(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", "l_extendedprice").withColumn("l_extendedprice", F.round("l_extendedprice", 1))


def value_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        values.confine(F.col("p_size"), F.lit(10), F.lit(40)).alias("confined"),
        values.substring_after(F.col("p_brand"), "#").alias("brand_no"),
        values.substring_after(F.col("p_brand"), "#").try_cast("int").alias("brand_int"),
        F.array_join(F.array_intersect(F.split("p_name", " "), F.array(F.lit("blue"), F.lit("ring"))), ",").alias("common"),
        F.array_join(F.array_except(F.split("p_name", " "), F.array(F.lit("blue"), F.lit("ring"))), ",").alias("rest"),
        F.element_at(values.map_invert(F.create_map(F.lit("a"), "p_size")), F.col("p_size")).alias("inverted"),
    )


QUERIES = {
    f.__name__: f
    for f in (min_support_filter, group_all_sum, multikey_group, inner_join_report, bincond, decode_remap, collected_columns, split_90_10, sample_hash, reservoir_per_group, random_groups, shuffled_order, distinct_rank, unique_ids, json_flatten, tuple_sum, value_helpers)
} | {"roll_bag_2": _roll(2, 1), "roll_bag_3_step2": _roll(3, 2)}


def _draw(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _roll_sql(size: int, step: int) -> str:
    leads = ", ".join(f"lead(text, {i}) OVER o AS t{i}" for i in range(1, size))
    joined = " || ' | ' || ".join(["text", *(f"t{i}" for i in range(1, size))])
    return f"""SELECT conv_id, pos::INTEGER AS begin, {joined} AS joined FROM (SELECT conv_id, row_number() OVER o - 1 AS pos, text, {leads}, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn, text))
WHERE pos % {step} = 0 AND pos + {size} <= n"""


ORACLE = {
    "min_support_filter": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2",
    "group_all_sum": "SELECT sum(l_quantity) AS quantity, count(*) AS n FROM lineitem",
    "multikey_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2",
    "inner_join_report": "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "bincond": "SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS kind, count(*) AS n FROM lineitem GROUP BY 1",
    "decode_remap": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS done FROM orders",
    "collected_columns": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "split_90_10": f"SELECT doc_id, CASE WHEN {_draw('doc_id', 'split')} < 0.9::DOUBLE THEN 'train' ELSE 'test' END AS part FROM documents",
    "sample_hash": f"SELECT doc_id, lang FROM documents WHERE {_draw('doc_id', 'sample')} < 0.1::DOUBLE",
    "reservoir_per_group": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('reservoir:' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 10",
    "random_groups": f"SELECT floor({_draw('doc_id', 'group')} * 8)::INTEGER AS grp, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "shuffled_order": "SELECT doc_id, (row_number() OVER (ORDER BY md5('shuffle:' || doc_id::VARCHAR), doc_id) - 1)::INTEGER AS place FROM documents",
    "distinct_rank": "SELECT source, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS index FROM (SELECT DISTINCT source FROM documents)",
    "unique_ids": "SELECT count(*) AS n, count(*) AS n_ids FROM orders",
    "json_flatten": "SELECT event_id, props->>'k' AS k, props->'missing'->>'path' AS missing_path FROM events",
    "roll_bag_2": _roll_sql(2, 1),
    "roll_bag_3_step2": _roll_sql(3, 2),
    "tuple_sum": "SELECT sum(l_quantity) AS l_quantity, sum(l_linenumber)::BIGINT AS l_linenumber, round(sum(l_extendedprice), 1) AS l_extendedprice FROM lineitem",
    "value_helpers": """SELECT p_partkey, greatest(10, least(40, p_size)) AS confined, split_part(p_brand, '#', 2) AS brand_no, try_cast(split_part(p_brand, '#', 2) AS INTEGER) AS brand_int,
array_to_string(list_filter(string_split(p_name, ' '), lambda x: x IN ('blue', 'ring')), ',') AS common, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('blue', 'ring')), ',') AS rest, 'a' AS inverted FROM part""",
}
