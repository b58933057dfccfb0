"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import without

#: Words are maximal runs of characters other than space, tab, line feed and carriage return.
WORD = "[^ \\t\\n\\r]+"
#: Relative weights of the sources named here; the others have weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
SEED = "mix-1"
#: Sources up to which the table of rates is sent to all executors; beyond, an ordinary join takes it.
BROADCAST_ROWS = 100_000


def rates(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = 1.0, budget: float | None = None, *, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(mix_source, tokens, rate): how many times each source's tokens are to be repeated.

    rate = budget * weight / (sum of weights) / tokens of the source; budget: tokens
    of the mixture, by default those of the corpus. Sources without any token have
    rate 1 and no part in the weights. A null source is a source of its own.
    """
    per = docs.select(F.col(source_col).cast("string").alias("mix_source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).alias("n")).groupBy("mix_source").agg(F.sum("n").alias("tokens"))
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(weight)
    per = per.select("mix_source", "tokens", F.when(F.col("tokens") > 0, weight).otherwise(0.0).alias("w"))
    whole = per.agg(F.sum("w").alias("all_w"), F.sum("tokens").alias("all_t"))
    goal = F.col("all_t").cast("double") if budget is None else F.lit(float(budget))
    rate = F.when(F.col("tokens") > 0, goal * F.col("w") / F.col("all_w") / F.col("tokens")).otherwise(1.0)
    return per.crossJoin(whole).select("mix_source", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = 1.0, budget: float | None = None, seed: str = SEED, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """Each document floor(rate) times, and once more with probability rate - floor(rate).

    The draw is md5(seed, document id) scaled to [0, 1): the same in every run, on
    any cluster. Rows with a null id draw by their text. Repeated rows draw alike.
    Null or empty texts count no tokens and are emitted like the rest of their
    source; texts of any length count whole. No two rows compete, so ties don't
    matter. copy_col: adds the number of the copy, from 1, replacing a column of
    that name; else the columns are those of docs. An empty table stays empty.
    """
    table = rates(docs, weights, default, budget, source_col=source_col, text_col=text_col).select(F.col("mix_source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    # As Arrow: a table of Python rows would start Python workers of another kind on all executors.
    rows = table.limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows <= BROADCAST_ROWS:
        table = F.broadcast(docs.sparkSession.createDataFrame(rows, table.schema))
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / 4294967296.0
    copies = (F.floor("__mix_rate") + F.when(draw < F.col("__mix_rate") - F.floor("__mix_rate"), 1).otherwise(0)).cast("int")
    kept = without(docs, *([copy_col] if copy_col else []))
    joined = docs.join(table, F.col(source_col).cast("string").eqNullSafe(F.col("__mix_source")), "inner")
    many = joined.withColumn("__mix_n", copies).filter("__mix_n > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    return many.select(*kept, *([F.col("__mix_copy").alias(copy_col)] if copy_col else []))
