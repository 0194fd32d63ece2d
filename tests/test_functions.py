import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import boxed, free, letters, prompts, quality, think
from marginalia.operators import curate, guess


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


L4 = ["A", "B", "C", "D"]
L10 = [chr(65 + i) for i in range(10)]


def test_boxes(spark):
    t = "so \\boxed{\\frac{1}{2}} and \\boxed{} then \\boxed{A} \\boxed{x{"
    assert one(spark, boxed.extract_all_boxed(F.col("t")), t=t) == ["\\frac{1}{2}", "", "A"]
    t = "\\boxed{\\boxed{B}} \\boxed {C} \\boxed{ d }"
    assert one(spark, boxed.extract_all_boxed(F.col("t")), t=t) == ["\\boxed{B}", "d"]
    assert one(spark, boxed.last_group("t"), t="\\boxed{1} so \\boxed{2}, \\boxed{3}") == ["2", "3"]
    assert one(spark, boxed.last_boxed_string("t"), t="a \\boxed{1} \\fbox{2}") == "\\boxed{1}"


def test_boxes_at_random(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["\\boxed{", "{", "}", "a", " ", "x"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", boxed.extract_boxed_inner(F.col("t")).alias("x"), boxed.too_deep(F.col("t")).alias("deep")).collect()
    for r in rows:
        if not r.deep:
            assert r.x == [i for _, _, i in boxed.scan_boxes(r.t)], r.t


def test_thoughts(spark):
    t = F.col("t")
    assert one(spark, think.visible_answer(t), t="a</think>b</redacted_reasoning> c") == "c"
    assert one(spark, think.strip_thinking_first(t), t="ANSWER</think>") == "ANSWER"
    assert one(spark, think.strip_thinking_last(t), t="ANSWER</think>") == ""
    assert one(spark, think.strip_thinking_first(t), t="<think>x</think> y </think>z") == "y </think>z"
    assert one(spark, think.clean_special_tokens(t), t="<think>x</think>y<|im_end|>") == "xy"


@pytest.mark.parametrize(
    "text,valid,last,first",
    [("\\boxed{B} \\boxed{}", L4, "B", "B"), ("option A then the answer is C", L4, "A", "A"), ("\\boxed{\\text{ j }}", L10, "J", "J"), ("OPTION BETTER", L4, "B", "B"), ("\\boxed{A} \\boxed{C}", L4, "C", "A"), ("nothing", L4, "", ""), ("\\boxed{Z}", L4, "", "")],
)
def test_letters(spark, text, valid, last, first):
    assert one(spark, letters.extract_valid_letter(F.col("t"), F.col("v")), t=text, v=valid) == last
    assert one(spark, letters.extract_first_valid_letter(F.col("t"), F.col("v")), t=text, v=valid) == first


def test_option_phrase_takes_the_last_start(spark):
    f = letters.option_phrase_letter(F.col("t"), F.col("v"))
    assert one(spark, f, t="option A is bad. the answer is C", v=L4) == "C"
    assert one(spark, f, t="the answer is Z. option B matches. choice Q", v=L4) == "B"
    assert one(spark, f, t="", v=L4) == ""
    import re

    rng = random.Random(3)
    words = ["option", "A", "B", "Z", "is", "the", "answer", "choice", "correct", ".", "matches", "final", ":"]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(t, L4) for t in texts], "t string, v array<string>").select("t", f.alias("x"))
    for r in df.collect():
        hits = [(m.start(), k, m[1]) for k, p in enumerate(letters.OPTION_PHRASES) for m in re.finditer(p, r.t.upper()) if m[1] in L4]
        assert r.x == (max(hits)[2] if hits else ""), r.t


def test_risk(spark):
    f = letters.risk_signal(F.col("t"), F.col("v"))
    assert one(spark, f, t="no box", v=L4).asDict() == {"score": 4, "reasons": ["no_boxed_span"]}
    assert one(spark, f, t="\\boxed{601} \\boxed{A}", v=L4).asDict() == {"score": 3, "reasons": ["multi_boxed", "nonletter_boxed"]}


def test_free_answers(spark):
    t, q = F.col("t"), F.col("q")
    assert one(spark, free.ensure_boxed(t), t="thus x = 5") == "thus x = 5\n\n\\boxed{x = 5}"
    assert one(spark, free.ans_slots(t), t="x [ANS] y [ANS]") == 2
    c = one(spark, free.canonical_free(t, q), t="The answers are 3, 4", q="[ANS] [ANS]")
    assert (c.response, c.path) == ("\\boxed{3, 4}", "free_multi_ans_phrase")
    c = one(spark, free.canonical_free(t, q), t="Therefore \\boxed{1}" + "x" * 200 + "\\boxed{2}", q="?")
    assert (c.response, c.path) == ("\\boxed{1}", "free_cue_last")
    c = one(spark, free.canonical_free(t, q), t="\\boxed{1} \\boxed{2}", q="?")
    assert (c.response, c.path) == ("\\boxed{2}", "free_last_boxed")
    assert one(spark, free.after_first_box_cut(t), t="a \\boxed{1} b \\boxed{2} c") == "a \\boxed{1}"
    assert one(spark, free.after_last_box_cut(t), t="a \\boxed{1} b \\boxed{2} c") == "a \\boxed{1} b \\boxed{2}"
    assert one(spark, free.canonical_mcq(t, F.lit("b")), t="why \\boxed{A} so") == "why  so\n\n\\boxed{B}"
    assert one(spark, free.submission_format(t, F.lit("\\boxed{A}")), t="raw") == "raw\n\nFinal answer: \\boxed{A}"
    assert one(spark, free.normalize_answer(t), t="$\\dfrac12$") == "\\frac{1}{2}"


def test_context_of_boxes_is_what_precedes_them(spark):
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice(["\\boxed{1}", "abc ", "therefore ", "y" * 90]) for _ in range(7))
        got = [(r.before, r.inner) for r in one(spark, free.boxes_with_context(F.col("t")), t=text)]
        assert got == [(text[max(0, s - free.CUE_WINDOW) : s], i) for s, _, i in boxed.scan_boxes(text)]


def test_diagnostics_and_gate(spark):
    f = quality.diagnostics(F.col("t"), F.col("t"), F.col("m"), F.col("v"), F.lit(False))
    d = one(spark, f, t="\\boxed{A}", m=True, v=L4)
    assert d.confidence == 9 and d.passes
    d = one(spark, f, t="\\boxed{}", m=False, v=[])
    assert d.reasons == ["empty_boxed"]
    side = lambda c, p: F.struct(F.lit(c).alias("confidence"), F.lit(p).alias("passes"))
    g = quality.deploy_decision(side(7, True), side(8, True), F.lit("b"), F.lit("l"), F.col("t"), F.col("m"), F.col("v"), True)
    assert one(spark, g, t="", m=False, v=[])["reason"] == "strict_confidence_delta_lt_2"
    g = quality.deploy_decision(side(7, True), side(8, True), F.lit("b"), F.lit("l"), F.col("t"), F.col("m"), F.col("v"))
    r = one(spark, g, t="no letter", m=True, v=L4)
    assert (r.winner, r.response, r.reason) == ("base", "b", "lora_no_valid_mcq_letter")


@pytest.mark.parametrize("answer,letter,reason", [("(c)", "C", ""), ("2", "C", ""), ("9", "", "answer_index_out_of_range"), (None, "", "missing_answer"), (" ", "", "empty_answer"), ("blue", "B", ""), ("same", "", "ambiguous_answer_text_duplicate_choice"), ("else", "", "answer_unmapped")])
def test_answer_to_letter(spark, answer, letter, reason):
    df = spark.createDataFrame([(answer, ["red", "Blue", "same", "same"])], "a string, o array<string>")
    r = df.select(curate.answer_to_letter(F.col("a"), F.col("o"), letters.labels(F.col("o"))).alias("x")).first().x
    assert (r.letter, r.reason) == (letter, reason)


def test_prompts(spark):
    df = spark.createDataFrame([("Q?", [" x ", "y"])], "q string, o array<string>")
    p = df.select(prompts.mcq_prompt(F.col("q"), F.col("o")).alias("p")).first().p
    assert p.startswith("Q: Q?\n\nOptions:\nA. x\nB. y\n\nValid choices: [A, B].\n")
    assert one(spark, prompts.free_prompt(F.col("t")), t="a [ANS] b [ANS]").endswith("inside one final \\boxed{...}.")


def test_smart_cut():
    long = "word " * 130
    assert guess.cut_text(long + "\\boxed{A} tail \\boxed{9}", {"A"}) == long + "\\boxed{A}"
    assert guess.cut_text("\\boxed{A} tail ", {"A"}) == "\\boxed{A} tail"
    assert guess.cut_text("x \\boxed{} y \\boxed{2} z", None, first=True) == "x \\boxed{} y \\boxed{2}"
    assert guess.cut_text("x \\boxed{1} z", None) == "x \\boxed{1}"


def test_simple_letters_of_every_script(spark):
    import re

    def simple(t):
        m = re.search(r"\\boxed\{([A-Za-z])\}", t)
        hits = re.findall(r"\b([A-Z])\b", t.upper())
        return m.group(1).upper() if m else hits[-1] if hits else ""

    def marked(t):
        m = re.search(r"FINAL\s*:\s*([A-J])\b", t, flags=re.I) or re.search(r"\\boxed\{\s*([A-J])\s*\}", t, flags=re.I) or re.search(r"\b([A-J])\b", t.upper())
        return m.group(1).upper() if m else ""

    rng = random.Random(8)
    parts = ["A", "b", "J", "z", "é", "ß", "ſ", "答案", "是", "Б", "°", "ｃ", "²", "½", "_", "3", " ", "\u00a0", "\u3000", ".", "，", "FINAL", "fınal", ":", "\\boxed{", "}", "{", "𝔸", "😀", "\n"]
    texts = ["答案是B。", "答案是 B。", "El resultado é A", "90° D", "éA B", "FINAL\u3000:\u00a0c。", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", letters.simple_letter(F.col("t")).alias("a"), letters.marked_letter(F.col("t")).alias("b")).collect()
    assert [(r.t, r.a, r.b) for r in rows] == [(t, simple(t), marked(t)) for t in texts]


def test_lines_of_every_script_are_read(spark, sf):
    from marginalia.plans.judging import answered, q_score_mcq
    from marginalia.plans.texts import q_baseline_letter, responses

    assert q_baseline_letter(spark, sf).count() == responses(spark, sf).count()
    assert q_score_mcq(spark, sf).count() == answered(spark, sf).where("mcq").count()
