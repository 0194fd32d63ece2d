"""Queries of the segmentation of packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.segment import answer_fields, packed_values
from marginalia.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values(answer_fields(table(spark, d, "public_questions"), table(spark, d, "private_outputs")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fields by name and number of values, for those of two or more."""
    return p5_found(spark, d).groupBy("field_name", "row_key").agg(F.count("*").alias("n_values")).groupBy("field_name", "n_values").agg(F.count("*").alias("n_fields"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL: dict[str, str] = {}
