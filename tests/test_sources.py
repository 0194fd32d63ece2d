import csv
import json

import pytest
from pyspark.sql import functions as F

from marginalia.sources import adapters, jsonl, schemas, sinks
from marginalia.streaming import resume


def test_checkpoints_with_torn_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "response": "a"}\n\n{"id": 2}\n{"id": 1, "response": "b"}\n{"x": 3}\n{"id": 4, "resp')
    df = jsonl.lines(spark, str(p)).withColumn("pos", F.monotonically_increasing_id())
    assert sorted(r.id for r in jsonl.done_ids(df).collect()) == [1, 2]
    got = {r.id: r.response for r in jsonl.last_records(df, "pos", schemas.RECORD).collect()}
    assert got == {1: "b", 2: None}


def test_answers_of_any_shape(spark):
    lines = [json.dumps({"id": i, "question": "q", "answer": a}) for i, a in enumerate(["B", 7, ["3", "\\frac{1}{2}"], None])] + ['{"id": 4}']
    df = jsonl.tolerant(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.id: r.answer for r in jsonl.questions(df).collect()} == {0: ["B"], 1: ["7"], 2: ["3", "\\frac{1}{2}"], 3: None, 4: None}


def test_strict_scan_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n{"id":')
    with pytest.raises(Exception):
        jsonl.scan_strict(spark, str(tmp_path / "x.jsonl"), schemas.RECORD).collect()


def test_adapters(spark):
    df = spark.createDataFrame([(" ", "p", None, "x", ["a ", ""], "A1", "B1"), ("q", "p", "s", None, [], " ", "B1")], "question string, problem string, solution string, answer string, options array<string>, A string, B string")
    rows = adapters.adapt(df, adapters.ADAPTERS["metamathqa"]).collect()
    assert [(r.question, r.solution, r.final_answer, r.options) for r in rows] == [("p", None, "x", ["a"]), ("q", "s", None, None)]
    u = spark.createDataFrame([(" Math_Cot ", "i", "r"), ("Code", "i", "r")], "task string, instruction string, response string")
    assert adapters.adapt(u, adapters.ADAPTERS["ultrainteract"]).count() == 1


def test_csv_round_trip(spark, tmp_path):
    texts = ['a "quoted", \\frac{1}{2}', "two\r\nlines", "\\boxed{\"}", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, response string")
    sinks.write_csv(df, str(tmp_path / "out"))
    rows = {}
    for f in sorted((tmp_path / "out").glob("*.csv")):
        for r in csv.DictReader(f.open(newline="")):
            rows[int(r["id"])] = r["response"]
    assert rows == {i: t.replace("\r\n", "\n") for i, t in enumerate(texts)}


def test_submission_faults_come_together(spark):
    q = spark.range(1, 4)
    bad = spark.createDataFrame([(1, "\\boxed{1}"), (1, " "), (9, "x")], "id long, response string")
    with pytest.raises(sinks.SubmissionError, match="duplicates=1; missing=2; foreign=1; empty=1; unboxed=2"):
        sinks.verify(bad, q)
    sinks.verify(spark.createDataFrame([(i, "\\boxed{1}") for i in (1, 2, 3)], "id long, response string"), q)


def test_stream_resumes(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "in"
    ev.where("event_id % 2 = 0").write.parquet(str(src))
    stream = lambda: resume.read_stream(spark, str(src), ev.schema)
    for _ in range(2):
        resume.append_batches(stream(), str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    ev.where("event_id % 2 = 1").write.mode("append").parquet(str(src))
    resume.append_batches(stream(), str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "sink"))
    assert got.count() == got.select("event_id").distinct().count() == ev.count()


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from marginalia.streaming.resume import append_batches, read_stream

    df = spark.range(40).selectExpr("id", "id % 7 AS v")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    run = lambda **k: append_batches(read_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "sink"), str(tmp_path / "check"), **k).awaitTermination()
    with pytest.raises(StreamingQueryException):
        run(stop_after=1)
    assert sorted(p.name for p in (tmp_path / "sink").iterdir() if p.is_dir()) == ["batch=0", "batch=1"]
    before = spark.read.parquet(str(tmp_path / "sink")).count()
    assert 0 < before < 40
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == list(range(40))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from marginalia import session

    fake = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})(), "sparkContext": type("X", (), {"master": "spark://x"})()})()
    with pytest.raises(RuntimeError):
        session.checkpoint_folder(fake)


def test_written_submissions_are_read_again(spark, tmp_path):
    q = spark.range(40)
    rows = q.select("id", F.concat(F.lit('a "quoted"\nline \\boxed{'), F.col("id"), F.lit("}")).alias("response"))
    sinks.write_csv(rows.repartition(5), str(tmp_path / "ok"))
    sinks.verify_written(spark, str(tmp_path / "ok"), q)
    rows.orderBy(F.desc("id")).coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "back"))
    with pytest.raises(sinks.SubmissionError, match="order"):
        sinks.verify_written(spark, str(tmp_path / "back"), q)
    with pytest.raises(sinks.SubmissionError, match="missing"):
        sinks.verify_written(spark, str(tmp_path / "ok"), spark.range(41))
