"""Tables of vectors, pairs and string lists as Parquet; stores by part, by iteration and by row number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import numbered
from ..schema import VECTOR, require_schema, require_vector, resized, type_named
from ..workspace import freed


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_vectors(spark: SparkSession, path: str, key: str = "id", key_type: str = "int", recursive: bool = True, cardinality: int | None = None) -> DataFrame:
    """(key, vector) of all Parquet files below path; cardinality: resizes. Another schema raises ValueError."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(path)
    require_schema(require_vector(df, "vector"), **{key: type_named(key_type)})
    got = df.select(key, "vector")
    return got if cardinality is None else got.withColumn("vector", resized(F.col("vector"), cardinality))


def write_vectors(df: DataFrame, path: str, key: str = "id", key_type: str = "int", mode: str = "errorifexists") -> None:
    """Key and vector; stored values that are zero are left out."""
    require_vector(df, "vector")
    plain = F.filter("vector.features", lambda e: e["value"].isNotNull() & (e["value"] != 0))
    v = F.when(F.col("vector").isNotNull(), F.struct(F.col("vector.cardinality").alias("cardinality"), F.array_sort(plain).alias("features")).cast(VECTOR))
    df.select(F.col(key).cast(type_named(key_type)).alias(key), v.alias("vector")).write.mode(mode).parquet(path)


def read_pairs(spark: SparkSession, path: str, key_type: str, value_type: str) -> DataFrame:
    """(key, value) with these types."""
    return require_schema(spark.read.parquet(path), key=type_named(key_type), value=type_named(value_type)).select("key", "value")


def write_pairs(df: DataFrame, path: str, key_type: str, value_type: str, mode: str = "errorifexists") -> None:
    df.select(F.col("key").cast(type_named(key_type)).alias("key"), F.col("value").cast(type_named(value_type)).alias("value")).write.mode(mode).parquet(path)


def read_strings(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """(key, value array<string>)."""
    return read_pairs(spark, path, key_type, "stringtuple")


def write_strings(df: DataFrame, path: str, key_type: str = "string", mode: str = "errorifexists") -> None:
    write_pairs(df, path, key_type, "stringtuple", mode)


def write_grouped(df: DataFrame, path: str, part: str = "part", mode: str = "errorifexists") -> None:
    """A folder for each value of part; rows meet by part first, so that each has few files."""
    df.repartition(part).write.mode(mode).partitionBy(part).parquet(path)


def read_part(spark: SparkSession, path: str, value: object, part: str = "part") -> DataFrame:
    """Rows of one part; the others' folders aren't read."""
    return spark.read.parquet(path).filter(F.col(part) == F.lit(value)).drop(part)


def write_row_ids(df: DataFrame, path: str, name: str = "name", mode: str = "errorifexists") -> None:
    """matrix/ (id, vector) and docIndex/ (id, name); ids are places in the order of the names."""
    ids = numbered(df.select(F.col(name).cast("string").alias("name")).distinct(), "name", "id").select("id", "name")
    ids.write.mode(mode).parquet(f"{path}/docIndex")
    index = df.sparkSession.read.parquet(f"{path}/docIndex")
    df.withColumn("__name", F.col(name).cast("string")).join(index, F.col("__name") == index["name"]).select(index["id"], "vector").write.mode(mode).parquet(f"{path}/matrix")


class RollingStore:
    """Numbered tables home/iter=0, home/iter=1 and so on; the last committed one counts.

    A table is committed once its job has left its success marker, so that a job
    that failed is repeated under the same number.
    """

    def __init__(self, spark: SparkSession, home: str, keep: int | None = None) -> None:
        """keep: committed tables that stay; older ones are deleted. None keeps all."""
        self.spark, self.home, self.keep = spark, home.rstrip("/"), keep

    def path(self, n: int) -> str:
        return f"{self.home}/iter={n}"

    def iterations(self) -> list[int]:
        """Numbers of the committed tables, ascending."""
        fs, p = _fs(self.spark, self.home)
        if not fs.exists(p):
            return []
        found = []
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if name.startswith("iter=") and name[5:].isdigit() and fs.exists(_fs(self.spark, f"{self.home}/{name}/_SUCCESS")[1]):
                found.append(int(name[5:]))
        return sorted(found)

    def last(self) -> int:
        """Number of the last committed table, -1 if there is none."""
        return max(self.iterations(), default=-1)

    def load(self, n: int | None = None) -> DataFrame:
        n = self.last() if n is None else n
        if n < 0:
            raise FileNotFoundError(f"no iteration in {self.home}")
        return self.spark.read.parquet(self.path(n))

    def save(self, df: DataFrame) -> int:
        n = self.last() + 1
        with freed(self.spark):
            df.write.mode("overwrite").parquet(self.path(n))
        if self.keep:
            for old in self.iterations()[: -self.keep]:
                fs, p = _fs(self.spark, self.path(old))
                fs.delete(p, True)
        return n

    def run(self, start: Callable[[], DataFrame], step: Callable[[DataFrame], DataFrame], until: int) -> DataFrame:
        """Steps from the last committed table, or from start, until number until is committed."""
        if self.last() < 0:
            self.save(start())
        while self.last() < until:
            self.save(step(self.load()))
        return self.load()


class PartIteration:
    """The parts of a grouped store one after another: each run handles the first whose result isn't there yet."""

    def __init__(self, spark: SparkSession, path: str, out: str, part: str = "part") -> None:
        self.spark, self.path, self.out, self.name = spark, path, out.rstrip("/"), part
        # Names of folders; as many as parts.
        self.parts = sorted(r[0] for r in spark.read.parquet(path).select(part).distinct().collect())

    def _left(self) -> list:
        return [p for p in self.parts if not (fs := _fs(self.spark, f"{self.out}/{self.name}={p}/_SUCCESS"))[0].exists(fs[1])]

    def done(self) -> bool:
        return not self._left()

    def part(self) -> DataFrame:
        """Rows of the part that is next; StopIteration if all are done."""
        if self.done():
            raise StopIteration(f"all {len(self.parts)} parts are done")
        return read_part(self.spark, self.path, self._left()[0], self.name)

    def save(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.out}/{self.name}={self._left()[0]}")

    def results(self) -> DataFrame:
        """Results of all parts, with the part."""
        return self.spark.read.parquet(self.out)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines without their ends."""
    return spark.read.text(path)


def first_line(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).first()
    return row[0] if row else None


def key_values(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """(key, value) of lines; a line without the delimiter has a null value."""
    parts = F.split("value", f"\\Q{delimiter}\\E", 2)
    return spark.read.text(path).select(parts[0].alias("key"), F.try_element_at(parts, F.lit(2)).alias("value"))
