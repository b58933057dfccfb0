"""The vector functions by name, for SQL: temporary functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_VECTOR = "STRUCT<cardinality: INT, features: ARRAY<STRUCT<index: INT, value: DOUBLE>>>"

#: (parameters, type, body) by name.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "vector_zsum": (f"v {_VECTOR}", "DOUBLE", "aggregate(v.features, CAST(0 AS DOUBLE), (a, e) -> a + e.value)"),
    "vector_norm": (f"v {_VECTOR}", "DOUBLE", "aggregate(v.features, CAST(0 AS DOUBLE), (a, e) -> a + abs(e.value))"),
    "vector_times": (f"v {_VECTOR}, x DOUBLE", _VECTOR, "named_struct('cardinality', v.cardinality, 'features', transform(filter(v.features, e -> e.value * x <> 0), e -> named_struct('index', e.index, 'value', e.value * x)))"),
    "vector_indices": (f"v {_VECTOR}", "ARRAY<INT>", "transform(v.features, e -> e.index)"),
    "vector_max": (f"v {_VECTOR}", "DOUBLE", "if(size(v.features) < v.cardinality, greatest(array_max(v.features.value), CAST(0 AS DOUBLE)), array_max(v.features.value))"),
    "label_of": ("path STRING", "STRING", "try_element_at(split(path, '/'), 2)"),
    "shuffle_key": ("key BIGINT, seed INT", "INT", "CAST(pmod(xxhash64(key, seed), 2147483647) AS INT)"),
    "confine": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(high, x))"),
}


def register(spark: SparkSession) -> None:
    """Makes all of FUNCTIONS known to the session's SQL, replacing those of the same names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
