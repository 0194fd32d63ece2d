from pathlib import Path

from pyspark.sql import functions as F

from marginalia import config, run
from marginalia.generate import masked_tokens
from marginalia.sources import sinks


def test_run_stops_and_goes_on(spark, sf, tmp_path):
    q = spark.read.parquet(f"{sf}/private_questions.parquet")
    c = config.RunConfig(limit_mcq=9, limit_free=12, seed=3)
    whole = {r.id: r.response for r in run.answer(q, None, c).collect()}
    assert len(whole) == 21 and all(r.startswith("\\boxed{") for r in whole.values())
    part = run.answer(q, None, c).where("id % 2 = 0").select("id")
    rest = {r.id: r.response for r in run.answer(q, part, c).collect()}
    assert rest == {k: v for k, v in whole.items() if k % 2}
    assert run.answer(q.limit(0), None, c).count() == 0


def test_submission_of_a_run(spark, sf):
    q = spark.read.parquet(f"{sf}/private_questions.parquet")
    rows = run.answer(q, None).select("id", "response")
    sinks.verify(rows, q)


def test_config():
    assert config.RunConfig("public", 100, 200, seed=1).stem == "public_mcq100_free200_seed1"
    assert config.RunConfig().stem == "private"
    t = config.TrainConfig("mcq").with_preset("fast_pilot")
    assert t.most_steps == 120 and t.weights["orca"] == 0.8 and config.TrainConfig().with_preset("none") == config.TrainConfig()
    assert config.TrainConfig("adapt").with_stage_defaults().holdout == 0.3
    assert set(config.TrainConfig().with_stage_defaults().caps) == set(config.DEFAULT_REASONING)
    assert config.resolve_input("private", Path("/a")) == Path("/a/data/private.jsonl")
    assert config.resolve_input("x/y", Path("/a")) == Path("/a/x/y") and config.optional_text(" None ") is None


def test_masks(spark):
    df = spark.createDataFrame([("abc", "de"), ("abcdef", ""), ("abcdefgh", "z")], "prompt_text string, target string")
    rows = masked_tokens(df, lambda s: [ord(c) for c in s], 4).collect()
    assert [(r.input_ids, r.labels) for r in rows] == [([98, 99, 100, 101], [-100, -100, 100, 101]), ([102, 103, 104, 122], [-100, -100, -100, 122])]


def test_prompt_of_the_second_pass_holds_the_text(spark):
    df = spark.createDataFrame([("Q", ["x", "y"], ["A", "B"], "raw text")], "question string, options array<string>, valid array<string>, raw string")
    assert "raw text" in df.select(run.finalizer_prompt().alias("p")).first().p and F is not None


def test_stages():
    c = lambda stage, **k: config.TrainConfig(stage, **k).with_stage_defaults()
    assert (c("reasoning").learning_rate, c("reasoning").most_steps, c("reasoning").full_texts) == (8e-5, 1000, True)
    assert (c("mcq", full_texts=True).learning_rate, c("mcq").most_steps, c("mcq", full_texts=True).full_texts) == (1e-5, 60, False)
    assert c("mixed_reasoning_mcq").most_steps == 1000 and "rejection_replay" in c("rejection_sft").caps
    assert c("adapt").holdout == 0.3 and c("adapt", holdout=0.0).holdout == 0.0 and c("mcq", most_steps=77).most_steps == 77
    b = c("mcq", bridge=True, rejection_path="x")
    assert {"math_mc", "compmath", "rejection_replay"} <= set(b.caps) and b.weights["mcq"] == 1.2 and b.most_steps == 160
    import pytest

    with pytest.raises(ValueError):
        c("other")


def test_sampling_and_stops():
    from marginalia.generate import stop_rule

    greedy = config.Sampling(seed=3).settings()
    assert greedy["temperature"] == 0.0 and greedy["top_k"] == -1 and greedy["seed"] == 3 and "min_tokens" not in greedy
    drawn = config.Sampling(sample=True, top_k=0, no_repeat_ngram=4, least_tokens=99, most_tokens=50).settings()
    assert drawn["temperature"] == 0.6 and drawn["top_k"] == -1 and drawn["min_tokens"] == 49 and drawn["no_repeat_ngram_size"] == 4
    assert set(config.Sampling(no_repeat_ngram=4).settings(frozenset({"max_tokens"}))) == {"max_tokens"}
    letter, free = stop_rule(True), stop_rule(False, 40)
    assert letter("so FINAL: B") and not letter("so FINAL") and free("<think>a</think> \\boxed{3}") and not free("<think>\\boxed{3}") and free("x" * 40)


def test_artifacts(spark, tmp_path):
    import json

    import pytest

    from marginalia import artifacts as A
    from marginalia.operators.selection import with_holdout

    df = spark.createDataFrame([("s", "mcq", None), ("s", "frq", "too_short"), (None, "frq", None)], "source string, kind string, reason string")
    m = A.write_manifest(tmp_path / "m.json", config.TrainConfig("mcq"), df, resumed=True)
    assert json.loads((tmp_path / "m.json").read_text()) == m and m["final_total_count"] == 2 and m["resumed"]
    assert m["sources"] == [{"source": "(none)", "loaded": 1, "accepted": 1, "skipped": {}}, {"source": "s", "loaded": 2, "accepted": 1, "skipped": {"too_short": 1}}]
    split = with_holdout(spark.range(10), 0.3, 1)
    rest = A.write_holdout(split, str(tmp_path / "h")).count()
    assert rest == 7 and spark.read.json(str(tmp_path / "h")).count() == 3
    k = spark.createDataFrame([("letter_only", "full_trace", True), ("x", "full_trace", False), ("x", "letter_only", False)], "k string, mode string, replay boolean")
    got = k.select(A.describe_target(F.col("k")).alias("d"), A.mcq_target_kind(F.col("mode"), F.col("replay")).alias("t")).collect()
    assert [(r.d, r.t) for r in got] == [("boxed letter only", "replay_raw_trace"), ("unknown", "stub_rationale"), ("unknown", "letter_only")]
    with pytest.raises(A.SchemaError):
        A.check_replay_schema(df)
    A.check_replay_schema(spark.createDataFrame([], "question string, filter_passed boolean, raw string"))
    for bad in (tmp_path / "none", tmp_path):
        with pytest.raises(FileNotFoundError):
            A.check_adapter(bad)
    (tmp_path / "adapter_config.json").write_text('{"r": 32}')
    with pytest.raises(FileNotFoundError):
        A.check_adapter(tmp_path)
    (tmp_path / "adapter_model.bin").write_text("x")
    assert A.check_adapter(tmp_path) == tmp_path.resolve() and A.adapter_rank(tmp_path) == 32 and A.adapter_rank() == 16


def test_command_lines(spark, tmp_path):
    import json

    from marginalia import cli

    rows = [{"id": i, "question": f"What is {i} + 1?", "answer": i + 1} for i in range(8)] + [{"id": 50, "question": "Pick", "options": ["x", "y"], "answer": "B"}, {"id": 51, "question": "no answer"}]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n{torn")
    cli.main(["answer", "--input", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "o"), "--limit-free", "0", "--limit-mcq", "none"], spark)
    out = next((tmp_path / "o").rglob("*_outputs"))
    assert spark.read.json(str(out)).count() == 10
    cli.main(["train-set", "--input", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "t"), "--mcq-weight", "2", "--holdout", "0"], spark)
    x = spark.read.json(str(tmp_path / "t" / "examples")).collect()
    assert len(x) == 10 and sum(r.kind == "mcq" for r in x) == 2 and all(r.target_kind == "final_answer_only" for r in x)
    assert json.loads((tmp_path / "t" / "train_config.json").read_text())["final_total_count"] == 9


def test_an_option_named_in_words_is_matched(spark):
    from marginalia.operators import guess

    rows = [(1, "It is late. The total is $\\frac{1}{2}$ and so on", "", ["3", "0.5", "7"]), (2, "The answer is option C", "", ["3", "0.5", "7"]), (3, "nothing here", "", ["3", "0.5", "7"]), (4, "we get $9$", "", None)]
    df = spark.createDataFrame(rows, "id long, primary string, final string, options array<string>").withColumn("valid", F.array(*map(F.lit, "ABC")))
    got = {r.id: tuple(r.guess) for r in guess.guessed(df, "primary", "primary", "final", "valid", "options").collect()}
    assert got[1] == ("B", "mcq_option_match_judger", "option_match_medium")
    assert got[2][0] == "C" and got[2][2] == "answer_phrase_medium" and got[3] == got[4] == ("", "mcq_abstain_no_signal", "none")
