"""SQL access to the scalar functions: temporary SQL functions generated from the Column builders.

``register_sql_functions(spark)`` lets a SQL user write
``SELECT dialframe_clean(text) FROM utterances``.  Each function body is the SQL
text of the same Catalyst expression the DataFrame API builds, so both paths
share one definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from dialframe.functions.hangul import has_final_consonant
from dialframe.functions.text import clean_utterance, squeeze_jamo_runs, strip_unicode

_ARG = "dialframe_arg"


# Lambdas do not print back as SQL, so the higher-order function is written out
# (the same expression as ``operators.encode.code_points``; a test compares them).
_CODE_POINTS_SQL = "transform(filter(split(x, '', -1), ch -> ch <> ''), ch -> CAST(ascii(ch) AS BIGINT))"

# name, parameter type, return type, builder (a Column function, or SQL text over ``x``)
SQL_FUNCTIONS: list[tuple[str, str, str, Callable[[Column], Column] | str]] = [
    ("clean", "STRING", "STRING", clean_utterance),
    ("strip", "STRING", "STRING", strip_unicode),
    ("squeeze_jamo", "STRING", "STRING", squeeze_jamo_runs),
    ("has_final_consonant", "STRING", "BOOLEAN", has_final_consonant),
    ("code_points", "STRING", "ARRAY<BIGINT>", _CODE_POINTS_SQL),
]


def expression_sql(spark: SparkSession, build: Callable[[Column], Column], arg_type: str, arg: str) -> str:
    """SQL text of ``build(col)`` with the column renamed to ``arg`` (from the analyzed plan)."""
    probe = spark.createDataFrame([], f"{_ARG} {arg_type}").select(build(F.col(_ARG)).alias("out"))
    expr = probe._jdf.queryExecution().analyzed().expressions().apply(0).child()
    return expr.sql().replace(_ARG, arg)


def register_sql_functions(spark: SparkSession, prefix: str = "dialframe_") -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    names = []
    for name, arg_type, ret, build in SQL_FUNCTIONS:
        body = build if isinstance(build, str) else expression_sql(spark, build, arg_type, "x")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x {arg_type}) RETURNS {ret} RETURN {body}")
        names.append(prefix + name)
    return names
