"""The vector functions as SQL functions, and the store's tables as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (parameters, type, body); bodies are plain SQL, so they are planned and optimised like any expression.
FUNCTIONS = {
    "vector_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> coalesce(x * y, 0D)), 0D, (s, x) -> s + x)"),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vector_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN size(a) = size(b) AND aggregate(a, 0D, (s, x) -> s + x * x) > 1e-9 AND aggregate(b, 0D, (s, x) -> s + x * x) > 1e-9 "
        "THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) ELSE 0D END",
    ),
    "vector_preview": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "slice(a, 1, 3)"),
    "quant_scale": ("a ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN array_max(transform(a, x -> abs(x))) < 1e-10 THEN 1D ELSE array_max(transform(a, x -> abs(x))) / 127 END"),
    "is_dead": ("flags INT", "BOOLEAN", "(flags & 1) <> 0"),
    "is_summary": ("flags INT", "BOOLEAN", "(flags & 2) <> 0"),
    "is_delta": ("id BIGINT", "BOOLEAN", "id < 0"),
}


def register(spark: SparkSession, **views: DataFrame) -> None:
    """Create the functions for this session, and a temporary view for each DataFrame named."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
