import random

from marginalia.llm import truncation
from marginalia.llm.endings import body, is_finished

NAMES = ["Ann", "Bob", "Cyd", "Dan", "Eve"]
STEPS = ["First we read off that {} pears stand against {} plums.", "Adding {} and {} gives the sum, which we keep for later.", "Now consider the remaining {} seeds and distribute them evenly.", "Let me check that once more: {} plus {} is right."]


def text(rng):
    s = " ".join(rng.choice(STEPS).format(rng.randint(2, 99), rng.randint(2, 99)) for _ in range(rng.randint(2, 5)))
    return s + rng.choice([" Hence we get \\boxed{%d}.", " Final answer: \\boxed{%d}", " Answer: D"]).replace("%d", str(rng.randint(2, 99)))


def outputs(spark, rows):
    return spark.createDataFrame(rows, "line_no long, run_stem string, raw string, meta struct<raw:string,id:long>, id string")


def test_finds_cuts_and_only_cuts(spark):
    rng = random.Random(1)
    rows, cut = [], set()
    for i in range(800):
        t = text(rng)
        if i % 10 == 0:
            k = rng.randrange(20, len(t) - 16)
            while t[k - 1] in ".}D" or t[:k].rstrip()[-1] in ".}":
                k -= 1
            t = t[:k]
            cut.add(i)
        rows.append((i, "r", t, (t, 1), "x"))
    got = {r.line_no for r in truncation.cut_lines(outputs(spark, rows)).collect()}
    assert len(got & cut) >= 0.9 * len(cut)
    assert len(got - cut) <= 4


def test_counts_of_contexts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "r", text(rng), None, None) for i in range(60)]
    rows += [(100 + i, "r", rows[0][2], None, None) for i in range(5)]
    t = truncation.texts_of(outputs(spark, rows))
    marks = t.mapInPandas(truncation._marks, "line_no long, col string, lang string, tail string, h long, sure boolean, closed boolean")
    got = {r.tail: r.score for r in truncation.scores(t, marks).collect()}
    import math

    texts = [truncation._DIGITS.sub("0", body(r[2])) for r in rows]
    pad = truncation._PAD
    assert len(got) == len({(pad + x)[-12:] for x in texts})
    for tail, score in got.items():
        p = 0.5
        for n, weight in ((4, 1.0), (8, 2.0), (12, 2.0)):
            end = len({x for x in texts if (pad + x).endswith(tail[-n:])}) - 1
            go = sum(1 for x in set(texts) for k in range(12 + 1, 12 + len(x)) if (pad + x)[k - n : k] == tail[-n:])
            p = (end + weight * p) / (end + go + weight)
        assert abs(score - (math.log(p) - math.log(1 - p))) < 1e-9, tail


def test_the_model_decides(spark, monkeypatch):
    """Without its scores only marked texts come out, and it acquits texts that end like no sentence."""
    rng = random.Random(1)
    rows = [(i, "r", text(rng), None, None) for i in range(400)]
    rows += [(1000 + i, "r", text(rng)[:57].rstrip(" .}"), None, None) for i in range(20)] + [(2000, "r", "So it is ... [truncated]", None, None)]
    df = outputs(spark, rows)
    got = {r.line_no for r in truncation.cut_lines(df).collect()}
    answers = {r[0] for r in rows if r[2].endswith("Answer: D")}
    assert len(got & set(range(1000, 1020))) >= 18 and not got & answers and 2000 in got and len(answers) > 50
    monkeypatch.setattr(truncation, "thresholds", lambda scored: {("en", "raw"): -1e9})
    assert {r.line_no for r in truncation.cut_lines(df).collect()} == {2000}


def test_edges(spark):
    rows = [(1, "a", None, None, None), (2, "a", "", ("  ", 1), "x"), (3, "b", "Fine. [truncated]", None, None), (4, "b", "<think>Never closed.", None, None), (5, "b", "half \ufffd", ("whole.", 1), None), (6, "b", "Done.", ("Open {", 1), None), (6, "b", "Done.", None, None), (7, "c", "ab " * 60_000 + "end.", None, None)]
    got = sorted(r.line_no for r in truncation.cut_lines(outputs(spark, rows)).collect())
    assert got[:3] == [3, 4, 5] and 7 not in got and 1 not in got and 2 not in got
    share = {r.run_stem: (r.n_lines, r.n_cut) for r in truncation.cut_share(outputs(spark, rows)).collect()}
    assert share["a"] == (2, 0) and share["b"][0] == 5
    assert truncation.cut_lines(outputs(spark, [])).count() == 0


def test_endings():
    for t in ("It is so.", "\\boxed{5}", "Answer: D", "| result | \\boxed{5} |", "Find it: ___", "(D) 12", "x is \\boxed{\\frac{1}{2}}.", "结束。"):
        assert is_finished(body(t + " <|im_end|>\n")), t
    for t in ("It is s", "\\boxed", "\\boxed{5", "Using $x", "gives 35", "the result is", "so ... [more]", "is \\boxed{49.", "<think>a.", ""):
        assert not is_finished(body(t)), t


def test_copies_of_a_text_do_not_count_as_continuations(spark):
    rng = random.Random(4)
    rows = [(i, "r", text(rng), None, None) for i in range(40)]
    rows += [(50 + i, "r", f"We count {w} and so the total is 17", None, None) for i, w in enumerate(("pears", "plums"))]
    hot = (60, "r", "Some say the total is 19 but we go on from there.", ("Some say the total is 19 but go on.", 1), None)

    def scores(rows):
        t = truncation.texts_of(outputs(spark, rows))
        marks = t.mapInPandas(truncation._marks, "line_no long, col string, lang string, tail string, h long, sure boolean, closed boolean")
        return sorted((r.lang, r.col, r.tail, round(r.score, 9)) for r in truncation.scores(t, marks).collect())

    once = scores([*rows, hot])
    assert any("total is 0" in r[2] for r in once)
    assert scores([*rows, *[hot] * 3, *[(70 + i, *hot[1:]) for i in range(20)]]) == once
