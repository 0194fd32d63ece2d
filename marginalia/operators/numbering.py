"""Row numbers over a whole table, without bringing it into one task.

Rows fall into cells between approximate quantiles of the order key (an id, or a hash of
one), so that outlying keys don't fill one cell; cells are counted, their offsets summed
over the counts, and rows numbered within their cell. Keys should be nearly unique: rows
of one key lie in one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one cell, about, and the most cells (their bounds are part of the plan). A table of one cell is numbered in one task.
RANGE_ROWS, MOST_CELLS = 200_000, 20_000


def hash_key(seed: int, *keys: str) -> Column:
    """A long from the md5 of seed and keys: the same order in every engine that has md5."""
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), F.lit(15)), 16, 10).cast("long")


def with_cells(df: DataFrame, key: str, rows: int = RANGE_ROWS, name: str = "__range") -> DataFrame:
    """Adds `name`: the cell of each row, ascending with the key (a long that isn't null)."""
    from pyspark.ml.feature import Bucketizer

    n = df.count()
    cells = min(MOST_CELLS, -(-n // rows))
    if cells <= 1:
        return df.withColumn(name, F.lit(0.0))
    at = [k / cells for k in range(1, cells)]
    bounds = df.agg(F.percentile_approx(F.col(key).cast("double"), at, max(10_000, 10 * cells))).first()[0]
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    keyed = df.withColumn(f"{name}_key", F.col(key).cast("double"))
    return Bucketizer(splits=splits, inputCol=f"{name}_key", outputCol=name).transform(keyed).drop(f"{name}_key")


def numbered(df: DataFrame, key: str, ties: list[str] | None = None, by: list[str] | None = None, name: str = "rn", rows: int = RANGE_ROWS) -> DataFrame:
    """Adds `name`: the row number from 1 by key (a long that isn't null) and ties, within each value of `by`."""
    by, order = by or [], [key, *(ties or [])]
    ranged = with_cells(df, key, rows)
    sums = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__of"), before.alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    on = F.col("__range") == F.col("__of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return ranged.join(offsets, on).withColumn(name, (within + F.col("__before")).cast("long")).drop("__range", "__of", "__before", *[f"__by_{c}" for c in by])
