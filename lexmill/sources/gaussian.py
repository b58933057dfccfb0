"""Points drawn from Gaussians."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def groups(spec: str) -> list[tuple[int, list[tuple[float, float]]]]:
    """(count, [(mean, deviation), ...]) for each of the groups "count;mean,sd;mean,sd" that blanks part."""
    out = []
    for group in spec.split():
        count, *dims = group.split(";")
        if not dims:
            raise ValueError(f"no dimension in {group!r}")
        pairs = [tuple(map(float, d.split(","))) for d in dims]
        if any(len(p) != 2 for p in pairs):
            raise ValueError(f"a dimension is a mean and a deviation: {group!r}")
        out.append((int(count), pairs))
    if len({len(p) for _, p in out}) > 1:
        raise ValueError("groups of different dimensions")
    return out


def read(spark: SparkSession, spec: str, seed: int = 0) -> DataFrame:
    """(group, id, point array<double>): normal draws by Box and Muller from a hash, so that a retried task draws the same."""

    def uniform(*key: object):
        return (F.pmod(F.xxhash64("id", *(F.lit(k) for k in key)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    def one(g: int, count: int, dims: list[tuple[float, float]]) -> DataFrame:
        draws = [F.sqrt(-2 * F.log(uniform(seed, g, d, 0))) * F.cos(uniform(seed, g, d, 1) * 6.283185307179586) * sd + mean for d, (mean, sd) in enumerate(dims)]
        return spark.range(count).select(F.lit(g).alias("group"), "id", F.array(*draws).alias("point"))

    parts = [one(g, n, dims) for g, (n, dims) in enumerate(groups(spec))]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "group int, id long, point array<double>")
