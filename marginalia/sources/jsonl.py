"""Scans of JSON lines: strict, tolerant, and of answers of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import strip


def scan_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are not blank."""
    return spark.read.text(path).where(strip(F.col("value")) != "")


def tolerant(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds v, the parsed variant; torn and other undecodable lines go."""
    return df.withColumn("v", F.try_parse_json(value)).where("v is not null and schema_of_variant(v) like 'OBJECT%'")


def gold_values(v: Column, path: str = "$.answer") -> Column:
    """A scalar or list answer as an array of texts; null where there is none."""
    many = F.try_variant_get(v, path, "array<string>")
    one = F.try_variant_get(v, path, "string")
    return F.when(many.isNotNull(), many).when(one.isNotNull(), F.array(one))


def questions(df: DataFrame) -> DataFrame:
    """Questions of parsed lines: id, question, options, answer as an array."""
    v = F.col("v")
    return df.select(F.try_variant_get(v, "$.id", "long").alias("id"), F.try_variant_get(v, "$.question", "string").alias("question"), F.try_variant_get(v, "$.options", "array<string>").alias("options"), gold_values(v).alias("answer"))


def done_ids(df: DataFrame) -> DataFrame:
    """The ids that a checkpoint file holds; lines without one are passed over."""
    return tolerant(df).select(F.try_variant_get("v", "$.id", "long").alias("id")).where("id is not null").distinct()


def last_records(df: DataFrame, order: str, schema: T.StructType) -> DataFrame:
    """The last decodable line of each id, typed."""
    x = tolerant(df).withColumn("id", F.try_variant_get("v", "$.id", "long")).where("id is not null")
    last = x.groupBy("id").agg(F.max_by("value", F.struct(order, "value")).alias("value"))
    return last.select(F.from_json("value", schema).alias("r")).select("r.*")


def describe(df: DataFrame) -> dict:
    """Rows, columns with types, and the sorted keys of a scan."""
    return {"row_count": df.count(), "features": dict(df.dtypes), "keys": sorted(df.columns)}
