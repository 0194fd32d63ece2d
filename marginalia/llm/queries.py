"""The queries of the operators for training data, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import leakage, overlap, packing, pair_defects, reading_level, truncation, unify
from marginalia.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_lines(table(spark, d, "private_outputs"))


def p1_share(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_share(table(spark, d, "private_outputs"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return unify.fields_of(table(spark, d, "public_questions"), table(spark, d, "private_outputs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.changed_rows(_fields(spark, d))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    return unify.unify(_fields(spark, d)).select("field_name", "row_key", "unified", "changed")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return unify.look_alikes(_fields(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "public_questions"), table(spark, d, "private_questions"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, d, "public_questions"), table(spark, d, "private_questions"))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = pair_defects.questions_of(table(spark, d, "public_questions"), table(spark, d, "private_questions"))
    return q, table(spark, d, "private_outputs")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.pair_defects(*_pairs(spark, d))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.defect_counts(*_pairs(spark, d))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.removal_spans(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.levels(table(spark, d, "documents"), table(spark, d, "level_labels"), table(spark, d, "heldout_items")).select("doc_id", "band")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.profile(table(spark, d, "documents"), table(spark, d, "level_labels"), table(spark, d, "heldout_items")).select("source", "band", F.col("n_docs"), "share")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_share, p2_found, p2_unified, p2_forms, p3_found, p3_counts, p4_found, p4_counts, p6_packed, p6_fill, p7_found, p7_spans, p8_found, p8_profile)}


def oracle_sql() -> dict[str, str]:
    """None of these operators can be said in SQL; tests/llm holds them against brute force."""
    return {}
