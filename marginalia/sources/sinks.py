"""Sinks of a run, and the checks that come before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.free import submission_format
from marginalia.functions.text import normal_newlines, strip


class SubmissionError(ValueError):
    pass


def submission(records: DataFrame) -> DataFrame:
    """id, response as handed in."""
    raw = F.coalesce(F.nullif("raw", F.lit("")), F.col("meta.raw"), F.lit(""))
    return records.select("id", submission_format(raw, F.col("response")).alias("response"))


def verify(rows: DataFrame, questions: DataFrame) -> None:
    """Raises with all faults at once: counts, repeats, missing and foreign ids, empty and unboxed responses. One aggregation and two anti joins."""
    n, ids, empty, unboxed = rows.agg(F.count("*"), F.count_distinct("id"), F.count_if(strip(F.coalesce("response", F.lit(""))) == ""), F.count_if(~F.coalesce(F.col("response").contains("\\boxed"), F.lit(False)))).first()
    missing = questions.select("id").join(rows.select("id"), "id", "left_anti").count()
    foreign = rows.select("id").join(questions.select("id"), "id", "left_anti").count()
    wanted = questions.select("id").distinct().count()
    faults = [f"{k}={v}" for k, v in (("row_count_difference", n - wanted), ("duplicates", n - ids), ("missing", missing), ("foreign", foreign), ("empty", empty), ("unboxed", unboxed)) if v]
    if faults:
        raise SubmissionError("; ".join(faults))


def is_sorted(rows: DataFrame) -> bool:
    """Whether a written table's rows stand by ascending id, part by part in the order of file names: within each file and between neighbours."""
    from pyspark.sql import Window

    x = rows.select("id", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    back = F.lag("id").over(Window.partitionBy("file").orderBy("place"))
    per = x.withColumn("back", back).groupBy("file").agg(F.count_if(F.col("back") > F.col("id")).alias("n"), F.min_by("id", "place").alias("first"), F.max_by("id", "place").alias("last")).orderBy("file").collect()  # files
    return all(r["n"] == 0 for r in per) and all(a["last"] <= b["first"] for a, b in zip(per, per[1:]))


def verify_written(spark: SparkSession, path: str, questions: DataFrame) -> None:
    """Reads a written submission and raises unless it is sound and its ids stand in order."""
    rows = spark.read.schema("id long, response string").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    verify(rows, questions)
    if not is_sorted(rows):
        raise SubmissionError("ids are not in order")


def write_csv(rows: DataFrame, path: str) -> None:
    """id,response in the order of ids, quotes doubled as CSV readers expect."""
    (
        rows.select("id", normal_newlines(F.col("response")).alias("response"))
        .repartitionByRange("id")
        .sortWithinPartitions("id")
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("lineSep", "\n")
        .csv(path)
    )


def write_ordered_json(rows: DataFrame, path: str, order: str = "id") -> None:
    """JSON lines in order: the files' names carry it, so nothing is brought into one task."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)
