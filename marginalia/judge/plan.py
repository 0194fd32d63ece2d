"""Judging as a plan: what the JVM can decide never meets Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.boxed import extract_boxed
from marginalia.functions.text import strip
from marginalia.judge.methods import judge_udf
from marginalia.session import ship


def fast_verdict(pred: Column, gold: Column) -> Column:
    """True or false where a look decides, null elsewhere. gold: an array of one or more texts."""
    box = extract_boxed(pred)
    one = F.size(gold) == 1
    g = strip(F.get(gold, F.lit(0)))
    return (
        F.when(pred.isNull() | gold.isNull() | (F.size(gold) == 0) | F.exists(gold, lambda x: x.isNull()), False)
        .when(~pred.contains("\\boxed"), False)
        .when(one & (box != "") & (F.lower(box) == F.lower(g)) & (F.size(F.split(pred, r"\\boxed\{")) == 2), True)
        .when(one & box.rlike(r"^[0-9]{1,15}$") & g.rlike(r"^[0-9]{1,15}$") & (F.size(F.split(pred, r"\\boxed\{")) == 2), box.try_cast("long") == g.try_cast("long"))
        .when(one & box.rlike("^[A-Z]$") & g.rlike("^[A-Z]$") & (F.size(F.split(pred, r"\\boxed\{")) == 2), False)
    )


def judged(df: DataFrame, pred: str, gold: str, name: str = "ok") -> DataFrame:
    """Adds the verdict. The Python function sees nulls where the JVM has decided: an engine evaluates it for all rows of an expression, and a null costs it nothing."""
    ship(df.sparkSession)
    x = df.withColumn("__fast", fast_verdict(F.col(pred), F.col(gold)))
    open_ = F.col("__fast").isNull()
    return x.withColumn(name, F.coalesce("__fast", judge_udf(F.when(open_, F.col(pred)), F.when(open_, F.col(gold))))).drop("__fast")
