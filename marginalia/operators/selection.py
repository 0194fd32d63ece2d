"""Which rows go on: resuming, capping, splitting, mixing and batching.

Python's seeded samples have no distributed form; a row's place in a sample is the
order of md5(seed:key) instead. Counts and determinism are the same, members differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.numbering import hash_key, numbered


def last_wins(lines: DataFrame, key: str = "id", order: str = "line_no") -> DataFrame:
    """The last line of each id. Partial maxima come before the shuffle, so a hot id costs one row per task."""
    last = lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias(order))
    return lines.join(last, [key, order], "left_semi")


def remaining(questions: DataFrame, done: DataFrame) -> DataFrame:
    return questions.join(done.select("id").where("id is not null").distinct(), "id", "left_anti")


def with_reference(rows: DataFrame, reference: DataFrame, key: str = "id") -> DataFrame:
    """Rows with what their reference question supplies where they lack it: a question if theirs is null or blank, options if theirs are null; a row may have no reference. Adds has_reference."""
    r = reference.select(key, F.col("question").alias("__q"), F.col("options").alias("__o"), F.lit(True).alias("has_reference"))
    own = F.nullif(F.trim("question"), F.lit(""))
    x = rows.join(r, key, "left")
    return x.withColumn("question", F.when(own.isNotNull(), F.col("question")).otherwise(F.col("__q"))).withColumn("options", F.coalesce("options", "__o")).withColumn("has_reference", F.coalesce("has_reference", F.lit(False))).drop("__q", "__o")


def capped_by_kind(df: DataFrame, kind: str, caps: dict[bool, int | None], seed: int, key: str = "id") -> DataFrame:
    """At most so many rows of each kind, by hash order; a kind without a cap keeps all its rows and is not sorted."""
    capped = {k: v for k, v in caps.items() if v is not None}
    if not capped:
        return df
    limit = F.lit(None).cast("int")
    for k, v in capped.items():
        limit = F.when(F.col(kind) == k, v).otherwise(limit)
    some = F.coalesce(F.col(kind).isin(*capped), F.lit(False))
    rn = F.row_number().over(Window.partitionBy(kind).orderBy(hash_key(seed, key), key))
    # the plain bound lets the engine cut groups before the shuffle
    kept = df.where(some).withColumn("__rn", rn).where(F.col("__rn") <= max(capped.values())).where(F.col("__rn") <= limit).drop("__rn")
    return kept if all(v is not None for v in caps.values()) else kept.unionByName(df.where(~some))


def holdout_size(n: int, fraction: float) -> int:
    """Rows held out: none or all at the ends, else at least one and at most all but one; halves go to the even number."""
    if fraction <= 0 or n == 0:
        return 0
    if fraction >= 1:
        return n
    return min(max(1, round(n * fraction)), n - 1)


def with_holdout(df: DataFrame, fraction: float, seed: int, key: str = "id") -> DataFrame:
    """Adds held_out."""
    k = holdout_size(df.count(), fraction)
    return numbered(df.withColumn("__h", hash_key(seed, key)), "__h", [key], name="__rn").withColumn("held_out", F.col("__rn") <= k).drop("__rn", "__h")


def weighted(df: DataFrame, group: str, weight: Column, seed: int, key: str) -> DataFrame:
    """Rows by the weight of their group: whole parts are copies, the fraction is a sample of the group (halves to the even number). Adds copy, from 1.

    A weight must be positive, else the query fails; 1 changes nothing.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("__n"))
    rn = numbered(df.withColumn("__h", hash_key(seed, key)), "__h", [key], by=[group], name="__rn")
    weight = F.when(weight > 0, weight).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))
    whole = F.floor(weight)
    extra = F.bround(F.col("__n") * (weight - whole))
    x = rn.join(counts, rn[group].eqNullSafe(counts[group])).drop(counts[group])
    copies = (whole + F.when(F.col("__rn") <= extra, 1).otherwise(0)).cast("int")
    return x.withColumn("__c", copies).where("__c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__c")))).drop("__rn", "__h", "__n", "__c")


def batched(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds batch_id: fixed numbers of rows in the order of the key."""
    return numbered(df, key, name="__rn").withColumn("batch_id", F.floor((F.col("__rn") - 1) / size).cast("long")).drop("__rn")


def verify_budget(df: DataFrame, order: str, letter: str, score: str, share: float = 0.25, least: int = 2) -> DataFrame:
    """Per batch, the first ceil(share * rows) rows with a letter and a score of at least `least` are verified; rows without a letter always, outside the budget. Adds forced."""
    batch = Window.partitionBy("batch_id")
    risky = (F.col(letter) != "") & (F.col(score) >= least)
    used = F.sum(risky.cast("int")).over(batch.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    budget = F.ceil(F.count("*").over(batch) * share)
    return df.withColumn("forced", (F.col(letter) == "") | (risky & (used <= budget)))
