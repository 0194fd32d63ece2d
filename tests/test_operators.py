from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators import selection
from marginalia.operators.numbering import hash_key, numbered


def test_numbering_in_ranges_is_a_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3).alias("g"))
    got = [r.k for r in numbered(df, "k", rows=90).orderBy("rn").collect()]
    assert got == sorted(got)
    per = numbered(df, "k", by=["g"], rows=90).groupBy("g").agg(F.max("rn").alias("m"), F.count_distinct("rn").alias("d"), F.count("*").alias("n")).collect()
    assert all(r.m == r.d == r.n for r in per)
    hot = spark.range(500).select(F.lit(1).cast("long").alias("k"), "id")
    assert sorted(r.rn for r in numbered(hot, "k", ["id"], rows=90).collect()) == list(range(1, 501))
    assert numbered(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("n,f,k", [(10, 0.25, 2), (1, 0.5, 0), (10, 0.0, 0), (10, 1.0, 10), (3, 0.01, 1), (0, 0.5, 0)])
def test_holdout(spark, n, f, k):
    assert selection.holdout_size(n, f) == k
    df = selection.with_holdout(spark.range(n), f, 3)
    assert df.where("held_out").count() == k and df.count() == n


def test_weights(spark):
    df = spark.range(10).select("id", F.lit("a").alias("s")).unionByName(spark.range(10, 20).select("id", F.lit(None).cast("string").alias("s")))
    w = lambda x: Counter(r.s for r in selection.weighted(df, "s", F.when(F.col("s") == "a", x).otherwise(1.0), 1, "id").collect())
    assert w(1.25) == {"a": 12, None: 10}
    assert w(0.25) == {"a": 2, None: 10}
    assert w(2.0) == {"a": 20, None: 10}


def test_budget_takes_the_first(spark):
    rows = [(i, 0, "A" if i != 11 else "", 3 if i in (1, 4, 5, 8, 9) else 0) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, batch_id long, letter string, score int")
    forced = [r.id for r in selection.verify_budget(df, "id", "letter", "score").where("forced").orderBy("id").collect()]
    assert forced == [1, 4, 5, 11]


def test_last_line_wins_and_resume(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (2, 3), (None, 9)], "id long, line_no long")
    assert sorted((r.id, r.line_no) for r in selection.last_wins(df).collect()) == [(1, 5), (2, 3)]
    q = spark.range(1, 5).withColumnRenamed("id", "id")
    assert sorted(r.id for r in selection.remaining(q, df).collect()) == [3, 4]


def test_caps(spark):
    df = spark.range(50).select("id", (F.col("id") % 5 == 0).alias("m"))
    n = lambda caps: Counter(r.m for r in selection.capped_by_kind(df, "m", caps, 1).collect())
    assert n({True: 3, False: 7}) == {True: 3, False: 7}
    assert n({True: 3, False: None}) == {True: 3, False: 40}
    assert n({True: None, False: None}) == {True: 10, False: 40}


def test_hash_key_is_an_md5_prefix(spark):
    import hashlib

    r = spark.range(1, 2).select(hash_key(17, "id").alias("h")).first().h
    assert r == int(hashlib.md5(b"17:1").hexdigest()[:15], 16)


def test_outlying_keys_do_not_fill_one_cell(spark):
    from marginalia.operators.numbering import with_cells

    df = spark.range(1000).select(F.when(F.col("id") == 7, F.lit(2**62)).otherwise(F.col("id")).alias("k"))
    cells = with_cells(df, "k", 100).groupBy("__range").count().collect()
    assert len(cells) >= 9 and max(r["count"] for r in cells) <= 250
    got = [r.k for r in numbered(df, "k", rows=100).orderBy("rn").collect()]
    assert got == sorted(got)


def test_sorted_check_by_ranges_is_that_of_one_window(spark, tmp_path):
    import random

    from marginalia.plans.relational import SQL, q_sorted_check

    rng = random.Random(2)
    rows = [(i, rng.choice([None, i, i + rng.randint(0, 3)]), f"r{i % 3}") for i in range(400)]
    spark.createDataFrame(rows, "line_no long, id long, run_stem string").write.parquet(str(tmp_path / "private_outputs.parquet"))
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW private_outputs AS SELECT * FROM '{tmp_path}/private_outputs.parquet/*.parquet'")
    want = sorted(c.execute(SQL["q_sorted_check"]).fetchall())
    for n in (7, 50, 10_000):
        assert sorted((r.run_stem, r.n_out_of_order, r.is_sorted) for r in q_sorted_check(spark, str(tmp_path), n).collect()) == want


def test_weights_must_be_positive(spark):
    df = spark.range(3).select("id", F.lit("a").alias("s"))
    with pytest.raises(Exception, match="positive"):
        selection.weighted(df, "s", F.lit(0.0), 1, "id").collect()


def test_references_fill_what_rows_lack(spark):
    rows = spark.createDataFrame([(1, "own", None), (2, " ", ["x"]), (3, None, None), (9, None, None)], "id long, question string, options array<string>")
    ref = spark.createDataFrame([(1, "r1", ["a"]), (2, "r2", ["b"]), (3, None, None)], "id long, question string, options array<string>")
    got = {r.id: (r.question, r.options, r.has_reference) for r in selection.with_reference(rows, ref).collect()}
    assert got == {1: ("own", ["a"], True), 2: ("r2", ["x"], True), 3: (None, None, True), 9: (None, None, False)}
