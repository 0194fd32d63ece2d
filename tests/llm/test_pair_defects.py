import random

import numpy as np
import pytest

from marginalia.llm import pair_defects as P

Q = "In a row of boxes the first contains 337 screws. How many more are needed by Tuesday for the old mill?"
GOOD = "First we add the numbers of the boxes. Then we subtract the rest. So the answer is \\boxed{5}."
CASES = [
    (None, None, "empty"), ("", "x.", "empty"), (" \n", "x.", "empty"), ("N/A", "x.", "empty"), ("-", "x.", "empty"), ("Final answer: \\boxed{}", "x.", "empty"), ("\\boxed{ }", GOOD, "empty"),
    ("I'm sorry, but I cannot help with this exercise.", None, "refusal"),
    ("Unfortunately, I am unable to provide an answer to that. You may want to look at a textbook.", None, "refusal"),
    (Q, None, "copy"), (Q.lower(), None, "copy"), ("Question: " + Q + "\n(A) 3\n(B) 4", None, "copy"), (Q + "\n\n" + Q, None, "copy"),
    (GOOD[:60], None, "truncated"), ("So the answer is \\boxed{", None, "truncated"), ("We add. <think>So", None, "truncated"),
    ("Zuerst addieren wir die Zahlen und erhalten das Ergebnis. Die Lösung lautet daher \\boxed{5}.", None, "other_language"),
    ("首先把两个数相加，得到结果。所以答案是\\boxed{5}。", None, "other_language"),
    (GOOD, None, None), (Q + "\n" + GOOD, None, None), ("\\boxed{5}", GOOD, None), ("\\boxed{5}", None, None), ("\\boxed{5}", GOOD[:60], "truncated"),
    ("I cannot find a smaller value than this, so the minimum is \\boxed{5}.", None, None), ("The limit does not exist, hence \\boxed{\\text{DNE}}.", None, None),
    ("So the fіnаl аnswer is \\boxed{5}.", None, None), ("We add the numbers.\nAnswer: D", None, None),
]


NAMES = ["Ann", "Bob", "Cyd", "Dan", "Eve", "Fay"]
QUESTIONS = {
    "en": ["{} has {} pears and gives {} to a friend. How many pears are left for the others?", "In a row of boxes the first contains {1} screws and the last holds {2}. How many more does {0} need by Tuesday?", "The road to the mill is {1} km long and {0} walks {2} km. What is the rest of the way?"],
    "de": ["{} kauft {} Birnen und gibt davon {} an die Nachbarn. Wie viele Birnen bleiben für die anderen?", "Der Weg zur Mühle ist {1} km lang und {0} geht {2} km. Wie weit ist es noch?"],
}
STEPS = {
    "en": ["First we add {} and {} to get the sum.", "Then we subtract the rest from {}.", "Now consider the remaining {} seeds and share them evenly.", "Let me check that once more, as {} plus {} is right.", "The ratio of {} to {} does not change."],
    "de": ["Zuerst addieren wir {} und {} und erhalten die Summe.", "Dann ziehen wir den Rest von {} ab.", "Die Gleichung für diese Aufgabe lautet $x = {}$.", "Wir prüfen die Lösung, indem wir {} einsetzen."],
}
ENDS = {"en": ["So the answer is \\boxed{%d}.", "Final answer: \\boxed{%d}", "Answer: D"], "de": ["Die Lösung lautet daher \\boxed{%d}.", "Das Ergebnis ist also \\boxed{%d}."]}


def solved(rng, lang):
    n = lambda: rng.randint(2, 99)
    return " ".join(rng.choice(STEPS[lang]).format(n(), n()) for _ in range(rng.randint(2, 4))) + " " + rng.choice(ENDS[lang]).replace("%d", str(n()))


def corpus(seed=1, n=900):
    """Questions and sound answers from which the field can learn."""
    rng = random.Random(seed)
    qs, os = [], []
    for i in range(n):
        lang = "de" if i % 5 == 0 else "en"
        qs.append((1000 + i, rng.choice(QUESTIONS[lang]).format(rng.choice(NAMES), rng.randint(2, 99), rng.randint(2, 99)), None, "x"))
        os.append((5000 + i, 1000 + i, solved(rng, lang), None, "r", "x"))
    return qs, os


def frames(spark, cases=CASES):
    qs, os = corpus()
    q = spark.createDataFrame([(1, Q, ["3", "4"], "x"), (2, None, None, "x"), (None, "null id", None, "x"), *qs], "id long, question string, options array<string>, response string")
    o = spark.createDataFrame([(i, 1, a, b, "r", "x") for i, (a, b, _) in enumerate(cases)] + [(900, 77, "", "", "r", "x"), (901, None, "", "", "r", "x"), (902, 2, "", "", "r", "x"), (902, 2, "", "", "r", "x"), (903, 1, "We add the numbers. " * 20_000 + "It is \\boxed{5}.", None, "r", "x"), *os], "line_no long, id long, response string, raw string, run_stem string, question string")
    return q, o


def test_defects(spark):
    got = [(r.line_no, r.defect) for r in P.pair_defects(*frames(spark)).collect()]
    assert {k: v for k, v in got if k < 900} == {i: d for i, (_, _, d) in enumerate(CASES) if d}
    assert sorted(k for k, _ in got if k >= 900) == [902, 902]
    q, o = frames(spark)
    assert P.pair_defects(q, o.limit(0)).count() == 0
    assert P.pair_defects(q.limit(0), o).count() == 0


def test_without_the_field_only_empty_ones_come_out(spark, monkeypatch):
    monkeypatch.setattr(P, "fit_field", lambda rows, learned: P.ClauseField())  # all weights zero: every clause is an answer
    got = {r.line_no: r.defect for r in P.pair_defects(*frames(spark)).collect() if r.line_no < 900}
    assert got == {i: d for i, (_, _, d) in enumerate(CASES) if d == "empty"}


def test_planted_labels_are_no_rule_of_the_features():
    qs, os = corpus()
    rows = [(q[1], None, o[2]) for q, o in zip(qs, os)]
    seqs, ys = P.planted(rows, {})
    seen = {t for y in ys for t in y}
    assert seen == set(range(5))
    train = [i for i in range(len(seqs)) if i % 4]
    f = P.ClauseField().fit([seqs[i] for i in train], [ys[i] for i in train])
    held = [i for i in range(len(seqs)) if i % 4 == 0]
    right = [np.mean(a == ys[i]) for i, a in zip(held, f.tag([seqs[i] for i in held]))]
    assert 0.9 <= np.mean(right)


def test_field_learns_and_viterbi_is_best():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(200):
        n = rng.integers(1, 6)
        y = rng.integers(0, 5, n)
        x = np.zeros((n, P.N_FEATURES))
        x[:, 0] = 1
        # three tags show in dense features, two in hashed ones
        x[np.arange(n)[y < 3], 1 + y[y < 3]] = 1
        xs.append(P.Clauses(x, [[int(100 + t)] if t >= 3 else [] for t in y], [1] * n, {}))
        ys.append(y)
    f = P.ClauseField().fit(xs, ys, steps=60)
    assert np.mean([np.array_equal(a, b) for a, b in zip(f.tag(xs), ys)]) > 0.95
    import itertools

    f.t = rng.normal(size=f.t.shape)
    for c in xs[:20]:
        e = c.x @ f.w + np.array([f.v[k].sum(axis=0) for k in c.codes])
        score = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(f.t[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(5), repeat=len(c)), key=score)
        assert tuple(f.tag([c])[0]) == best


def test_gradient_matches_differences():
    """One step of the fit climbs the likelihood that brute force gives."""
    import itertools

    rng = np.random.default_rng(1)
    seqs = [P.Clauses(rng.normal(size=(n, P.N_FEATURES)), [[int(rng.integers(9))] for _ in range(n)], [1] * n, {}) for n in (1, 2, 3)]
    ys = [rng.integers(0, 5, len(c)) for c in seqs]

    def likelihood(f):
        total = 0.0
        for c, y in zip(seqs, ys):
            e = c.x @ f.w + np.array([f.v[k].sum(axis=0) for k in c.codes])
            score = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(f.t[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            total += score(y) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(5), repeat=len(c))))
        return total

    before = likelihood(P.ClauseField())
    after = [likelihood(P.ClauseField().fit(seqs, ys, steps=k, penalty=0.0)) for k in (1, 5, 25)]
    assert before < after[0] < after[1] < after[2]


@pytest.mark.parametrize("text,lang", [("The sum of the two is", "en"), ("Wie viele Tage sind es für alle", "de"), ("¿Cuántas manzanas quedan en la tienda?", "es"), ("Combien de litres reste-t-il à la fin ?", "fr"), ("Сколько всего", "ru"), ("还有多少", "zh"), ("$x^2$", "")])
def test_languages(text, lang):
    assert P.main_language(P.votes(text), 0.4) == lang


def test_tags_decide_and_checks_only_take_back():
    def decide(text, tags, spoken):
        c = P.Clauses(np.zeros((2, P.N_FEATURES)), [[], []], [10, 10], spoken)
        return P.decide(text, c, np.array(tags), frozenset({"row"}), "en")

    cut, whole, german, english = "We add. Then we subt", "We add. Then we stop.", {"de": 5.0, "en": 1.0}, {"en": 5.0, "de": 1.0}
    assert decide(cut, [P.ANSWER, P.UNFINISHED], english) == "truncated"
    assert decide(cut, [P.ANSWER, P.ANSWER], english) is None
    assert decide(whole, [P.ANSWER, P.UNFINISHED], english) is None
    assert decide(whole, [P.FOREIGN, P.ANSWER], german) == "other_language"
    assert decide(whole, [P.ECHO, P.ANSWER], german) is None
    assert decide(whole, [P.FOREIGN, P.FOREIGN], english) is None
    assert decide(whole, [P.REFUSAL, P.ANSWER], english) == "refusal"
    assert decide(whole, [P.ECHO, P.ECHO], english) == "copy"


def test_words_of_languages_are_counted_over_all_texts(spark, monkeypatch):
    english = ["First we add the numbers of the boxes and then we stop at the end."] * 5 + [f"First we add the numbers of box {w} and then we stop at the end." for w in ("alpha", "beta", "gamma")]
    german = [f"Zuerst addieren wir die Zahlen und das Ergebnis ist mit dem {w} quitten." for w in ("alpha", "beta", "gamma", "delta")]
    texts = spark.createDataFrame([(t,) for t in [*english, *german, None, "", "我们"]], "text string")
    learned = P.learn_words(texts)
    assert learned["quitten"] == "de" and learned["stop"] == "en" and "alpha" not in learned
    assert "boxes" not in learned  # five copies of one text
    assert P.learn_words(texts.limit(0)) == {}
    seen = {}
    monkeypatch.setattr(P, "FIT_LINES", 1)
    monkeypatch.setattr(P, "learn_words", lambda t: seen.update(n=t.count()) or {})
    q, o = frames(spark)
    P.pair_defects(q, o)
    assert seen["n"] == q.count() + o.count() - 1  # one line has no text to judge
