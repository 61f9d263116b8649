"""Functions for use in SQL text: they are expressions that Spark inlines, not Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, v) -> s + v)"
_LENGTH = "sqrt(aggregate({a}, 0D, (s, x) -> s + x * x))"

FUNCTIONS = {
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN size(a) = size(b) AND {_LENGTH.format(a='a')} * {_LENGTH.format(a='b')} > 0 THEN {_DOT.format(a='a', b='b')} / ({_LENGTH.format(a='a')} * {_LENGTH.format(a='b')}) ELSE 0D END"),
    "squash": ("score DOUBLE", "DOUBLE", "CASE WHEN score > 0 THEN score / (score + 1) ELSE 0D END"),
    "rank_fusion": ("place BIGINT, k INT, weight DOUBLE", "DOUBLE", "CASE WHEN place IS NULL THEN 0D ELSE weight / (k + place) END"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
