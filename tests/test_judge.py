import pytest

from marginalia.judge import latex
from marginalia.judge import normal as N
from marginalia.judge.methods import JUDGES, extract, judge, normalize, register
from marginalia.judge.plan import judged

CASES = [
    (r"\boxed{(2,1)}", ["(1,2)"], True),
    (r"\boxed{0.333}", ["1/3"], False),
    (r"\boxed{BA}", ["AB"], True),
    (r"\boxed{1},\boxed{2}", ["1"], False),
    (r"\boxed{\frac{1}{2}}", ["0.5"], True),
    (r"\boxed{x^2+2x+1}", ["(x+1)^2"], True),
    (r"\boxed{[1,2)}", ["[1, 2)"], True),
    (r"\boxed{[1,2)}", ["(1, 2]"], False),
    (r"\boxed{\sqrt{8}}", ["2\\sqrt2"], True),
    (r"\boxed{y=2x+1}", ["2y=4x+2"], True),
    (r"\boxed{10,916}", ["10916"], True),
    (r"\boxed{3 \text{ kg}}", ["3"], True),
    (r"\boxed{3, 4}", ["3", "4"], True),
    (r"\boxed{1.2\times 10^{5}}", ["120000"], True),
    (r"\boxed{-3}", ["3"], False),
    (r"\boxed{\frac12}", ["1/2"], True),
    (r"\boxed{\sin^2 x + \cos^2 x}", ["\\cos^2 x + \\sin^2 x"], True),
    ("5", ["5"], False),
    (None, ["5"], False),
    (r"\boxed{5}", None, False),
    (r"\boxed{5}", [None], False),
    (r"\boxed{" + "(" * 500 + "}", ["1"], False),
    (r"\boxed{0.333333}", ["0.3333333333"], True),
    (r"\boxed{1e5}", ["100000"], True),
    (r"\boxed{\sqrt{x^2}}", ["x"], False),
    (r"\boxed{\ln(x^2)}", ["2\\ln x"], True),
    (r"\boxed{24x+12y=36}", ["2x+y=3"], True),
    (r"\boxed{12x+6y=18}", ["-2x-y=-3"], True),
    (r"\boxed{3x+2y=18}", ["2x+y=3"], False),
    (r"\boxed{A and C}", ["AC"], True),
    (r"\boxed{A and B}", ["AC"], False),
    (r"\boxed{3\pm 2}", ["1,5"], True),
    (r"\boxed{\{1, 2\}}", ["\\{2, 1\\}"], True),
    (r"\boxed{\langle 1, 2\rangle}", ["(1,2)"], True),
    (r"\boxed{" + "+".join(["x"] * 251) + "}", ["251x"], True),
    (r"\boxed{" + "+".join(["x"] * 250) + "}", ["251x"], False),
    (r"\boxed{asin(x)}", ["\\sin^{-1}(x)"], True),
    (r"\boxed{\begin{align*}x+1\end{align*}}", ["1+x"], True),
    (r"\boxed{a = b = 12}", ["12"], True),
    (r"\boxed{1<x<3}", ["1,x,3"], True),
    (r"\boxed{\text{Tues}}", ["Tuesday"], True),
]


@pytest.mark.parametrize("pred,gold,ok", CASES)
def test_judge(pred, gold, ok):
    assert judge(pred, gold) is ok


def test_values():
    for t, v in (("2+3*4", 14), ("2^{10}", 1024), ("\\frac{3}{4}", 0.75), ("-2^2", -4), ("5!", 120), ("\\log_2 8", 3), ("|{-3}|", 3)):
        assert abs(complex(latex.evaluate(latex.read(t))) - v) < 1e-9
    for t in ("", "2+", "\\foo{2}", "((1)"):
        with pytest.raises(latex.Unreadable):
            latex.read(t)


def test_normal_forms():
    assert [normalize(x) for x in ("Mon", "k = 5", "seven", "45^\\circ", "(7)", "12.00", "$3$")] == ["Monday", "5", "7", "45", "7", "12", "3"]
    assert extract("so the answer is 7.") == "7"
    assert extract("x </think> \\boxed{1} and \\boxed{2}") == "2"


STEPS = [
    (N.clean, " .= 5, ", "5"), (N.clean, "\\frac12.", "\\frac12"), (N.clean, "-3!", "-3"),
    (N.drop_commands, "\\text{a \\bf b} {\\rm c}", "a b c"), (N.drop_commands, "\\vec{v}", "v"), (N.drop_commands, "\\textwidth", "\\textwidth"),
    (N.drop_environments, "\\begin{align*}x\\end{align*}", "x"), (N.drop_degrees, "30^{\\circ} 40°", "30 40"), (N.drop_unit, "5 \\text{ kg}", "5"), (N.drop_unit, "7 km", "7"),
    (N.name_functions, "asin(x)", "\\arcsin (x)"), (N.name_functions, "\\sin^{-1}x", "\\arcsin x"), (N.name_functions, "sinx", "\\sin x"),
    (N.plain_arrays, "\\begin{pmatrix}1\\\\2\\end{pmatrix}", "\\begin{array}1\\\\2\\end{array}"), (N.plain_arrays, "1\\\\2", "12"),
    (N.outer_brackets, "((1)(2))", "(1)(2)"), (N.outer_brackets, "(1)(2)", "(1)(2)"), (N.outer_brackets, "\\{[3]\\}", "3"),
    (N.fractions, "\\frac12+\\sqrt3", "\\frac{1}{2}+\\sqrt{3}"), (N.fractions, "sqrt(5)", "\\sqrt{5}"), (N.plus_minus, "(3\\pm2)", "3-2,3+2"), (N.plus_minus, "3", "3"),
    (N.bounds, "1<x<3", "1,x,3"), (N.bounds, "x<3", "x<3"), (N.plain_number, ".50", "0.50"), (N.plain_number, "007.00", "7"), (N.plain_number, "12,345", "12345"),
    (N.set_members, "{b,a or b,for}", ["b", "a", "for"]), (N.split_top, "f(x, y), \\{1, 2\\}, 3", ["f(x, y)", "(1, 2)", "3"]), (N.split_top, "12,345, 6", ["12,345", "6"]),
    (N.truth, " YES ", "True"), (N.truth, "0", "False"), (N.truth, "maybe", None),
]


@pytest.mark.parametrize("step,text,want", STEPS)
def test_steps(step, text, want):
    assert step(text) == want


@pytest.mark.parametrize("text,want", [("we see, 7 is the answer", "7"), ("we see x, 9 is our answer.", "9"), ("The answer is $12$.", "12"), ("answer : 4", "4"), ("# Answer\n\n8", "8"), ("x #### 5", "5"), ("Thus $a$ and $b$", "b"), ("at 3,400 then", "3400"), ("", "")])
def test_extract(text, want):
    assert extract(text) == want


def test_kinds_and_precision():
    assert judge("\\boxed{yes}", ["1"], ["TF"]) and not judge("\\boxed{yes}", ["0"], ["TF"])
    assert judge("\\boxed{3, 4, 5}", ["3", "4"], ["NV", "NV"])  # a surplus prediction is not looked at
    assert not judge("\\boxed{3}", ["3", "4"], ["NV", "NV"]) and not judge("\\boxed{3}", ["3"], ["??"])
    assert judge("\\boxed{3.1, 4}", ["3", "4"], precision=[0.1, 1e-8]) and not judge("\\boxed{3.1, 4.1}", ["3", "4"], precision=[0.1, 1e-8])
    assert judge("\\boxed{B: it grows}", ["B"], ["MCS"]) and judge("\\boxed{A, and also B}", ["AB"], ["MCM"]) is False
    assert judge("\\boxed{A or B}", ["BA"], ["MCM"]) and judge("\\boxed{(1,2)}", ["(2,1)"], ["UOL"]) and not judge("\\boxed{(1,2)}", ["(2,1)"], ["OL"])


def test_fast_path_and_residue_agree(spark):
    rows = [(i, p, g) for i, (p, g, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i long, p string, g array<string>")
    got = {r.i: r.ok for r in judged(df, "p", "g").collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(CASES)}


def test_a_kind_can_be_added():
    register("LEN", lambda a, b, precision=0: len(a) == len(b) == 6)
    try:
        assert judge("\\boxed{abc def}", ["ghi jkl"])
    finally:
        JUDGES.pop("LEN")
