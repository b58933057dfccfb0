"""Functions on arrays, JSON, labels and single values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import bound


def roll_bag(items: Column, size: int, step: int = 1) -> Column:
    """Full windows of size items that begin at 0, step, 2 * step and so on."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0))), lambda i: (i % step == 0) & (i + size <= F.size(items)))
    return F.when(items.isNotNull(), F.transform(starts, lambda i: F.slice(items, i + 1, size)))


def json_flatten(text: Column, paths: str) -> list[Column]:
    """A string column for each path of "a.b:type,c": text as it is, other values as JSON.

    Missing paths, null values and text that isn't JSON give null; types are ignored.
    """
    names = [p.split(":")[0].strip() for p in paths.split(",")]
    return [F.get_json_object(text, "$" + "".join(f"['{k}']" for k in name.split("."))).alias(name.replace(".", "_")) for name in names]


def tuple_sum(df: DataFrame, *columns: str) -> DataFrame:
    """One row of sums; nulls are skipped, and no rows give zeros."""
    return df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))


def label_of(path: Column) -> Column:
    """Second part of a path such as /label/name; null if there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(2))


def decode(value: Column, *pairs: object, default: object = None) -> Column:
    """decode(x, a, 1, b, 0): 1 where x is a, 0 where it is b, else the default."""
    out = F.lit(default)
    for key, result in reversed(list(zip(pairs[::2], pairs[1::2]))):
        out = F.when(value == F.lit(key), F.lit(result)).otherwise(out)
    return out


def feature_map(fields: Column, delimiter: str = ":") -> Column:
    """Map of an array of "key:number" strings; malformed ones are skipped, of equal keys the last counts."""
    pairs = F.transform(fields, lambda s, i: F.struct(F.element_at(F.split(s, delimiter, 2), 1).alias("k"), i.alias("i"), F.try_element_at(F.split(s, delimiter, 2), F.lit(2)).try_cast("double").alias("v")))

    def last(placed: Column) -> Column:
        # The last of a key is the one whose successor has another.
        found = F.filter(placed, lambda e, i: F.coalesce(F.get(placed, i + 1)["k"] != e["k"], F.lit(True)))
        return F.map_from_entries(F.transform(found, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))))

    return bound(F.sort_array(F.filter(pairs, lambda e: e["v"].isNotNull())), last)


def shuffle_key(key: Column, seed: int = 0) -> Column:
    """A non-negative int that looks random and is the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2147483647)).cast("int")


def unit_draw(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) from md5 of the seed and the key, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def confine(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def map_invert(m: Column) -> Column:
    return F.map_from_arrays(F.map_values(m), F.map_keys(m))


def substring_after(text: Column, mark: str) -> Column:
    """What follows the first mark; the whole text if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise(text)


def small_label(i: int) -> str:
    """0, 25, 26 become a, z, ba."""
    out = ""
    while True:
        out = chr(97 + i % 26) + out
        i //= 26
        if not i:
            return out
