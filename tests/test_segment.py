from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.operators import segment as S
from marginalia.operators.segment import SEEDS, answer_fields, automaton, packed_values, segment

KNOWN = automaton([*SEEDS, "0", "00.0", "0 km", "(0, 0)", "x = 0", "A", "B", "C"])

CASES = [
    ("10,916", ["10,916"]),
    ("(444, \\infty)", ["(444, \\infty)"]),
    ("317 and 228 and 130", ["317", "228", "130"]),
    ("(347, 22) | (319, 62)", ["(347, 22)", "(319, 62)"]),
    ("[155, 160)", ["[155, 160)"]),
    ("[9, 9]", ["9", "9"]),
    ('["67"]', ["67"]),
    ('"left; right" | "up; down"', ["left; right", "up; down"]),
    ("\\frac{298}{5}; \\frac{15}{74};", ["\\frac{298}{5}", "\\frac{15}{74}"]),
    ("332/4 / 44/3", ["332/4", "44/3"]),
    ("338 ;; 317 ; 26", ["338", "317", "26"]),
    ("1,333;1,296;7,697", ["1,333", "1,296", "7,697"]),
    ("A, B, C", ["A", "B", "C"]),
    ("224\n224\n224", ["224", "224", "224"]),
    ("335 \\text{or} 36", ["335", "36"]),
    ("5,625, 11,064, 12,174", ["5,625", "11,064", "12,174"]),
    ("9\u2060,\xad912", ["9\u2060,\xad912"]),
    ("x = 1, 7 km", ["x = 1", "7 km"]),
    ("", []),
    (" \t\n", []),
    (";;,", []),
    ("\u200b", []),
]


@pytest.mark.parametrize("text,values", CASES)
def test_segment(text, values):
    assert segment(text, KNOWN) == values


def test_without_the_dictionary_values_are_cut():
    differ = [t for t, v in CASES if segment(t) != v]
    assert differ == ["10,916", "1,333;1,296;7,697", "5,625, 11,064, 12,174", "9\u2060,\xad912"]


def test_operator_without_its_dictionary_gives_other_rows(spark, monkeypatch):
    fields = ["12,345; 67,890", '"odd, prime"', '"odd, prime"', "odd, prime", "3; 4", "(1, 2)", "(3, 4); (5, 6)"]
    rows = spark.createDataFrame(list(enumerate(fields)), "row_key long, content string").selectExpr("'answer' AS field_name", "*")
    run = lambda: sorted((r.row_key, r.pos, r["item"]) for r in packed_values(rows).collect())
    both = [(4, 1, "3"), (4, 2, "4"), (6, 1, "(3, 4)"), (6, 2, "(5, 6)")]
    assert run() == [(0, 1, "12,345"), (0, 2, "67,890"), *both]
    monkeypatch.setattr(S, "SEEDS", [])
    monkeypatch.setattr(S, "spanning_masks", lambda f, c: f.sparkSession.createDataFrame([], "mask string, count long"))
    assert run() == [(0, 1, "12"), (0, 2, "345"), (0, 3, "67"), (0, 4, "890"), (3, 1, "odd"), (3, 2, "prime"), *both]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["12", "3.5", "(1, 2)", "1,234", "x = 4", "[2, 3)", "7 km", "\\frac{1}{2}", "3/4"]), min_size=1, max_size=6), st.sampled_from(["; ", " | ", ";", "\n", "\t", " and ", ", "]))
def test_joined_values_come_back(values, delimiter):
    if delimiter == "\n" or delimiter == "\t" or len(values) > 0:
        assert segment(delimiter.join(values), KNOWN) == values


def test_long_field_ends():
    assert len(segment(";".join(["12"] * 5000))) == 5000
    assert segment("(" * 3000) == ["(" * 3000]


def test_operator_cases(spark):
    rows = [("answer", 1, "A; B", 5), ("answer", 1, "A; B", 5), ("answer", 2, None, 5), ("answer", 3, "", 5), ("answer", None, "C|D", 5), ("response", 4, "7", 5)]
    df = spark.createDataFrame(rows, "field_name string, row_key long, content string, pos int")
    out = packed_values(df).collect()
    assert sorted((r.row_key or 0, r.pos, r["item"]) for r in out) == [(0, 1, "C"), (0, 2, "D"), (1, 1, "A"), (1, 1, "A"), (1, 2, "B"), (1, 2, "B")]
    assert packed_values(df.limit(0)).count() == 0


def test_last_complete_box_counts(spark):
    q = spark.createDataFrame([(1, "1; 2")], "id long, answer string")
    deep = "\\boxed{" + "{" * 9 + "1" + "}" * 9 + "; 2}"
    texts = ["so \\boxed{1, 2} then \\boxed{3", "\\boxed{3} \\boxed{\\frac{1}{2}; 4}", None, "no box; here", deep, "\\boxed{\\boxed{1}; 5}"]
    o = spark.createDataFrame(list(enumerate(texts)), "line_no long, response string")
    got = {}
    for r in packed_values(answer_fields(q, o)).collect():
        got.setdefault((r.field_name, r.row_key), {})[r.pos] = r["item"]
    assert got[("answer", 1)] == {1: "1", 2: "2"}
    assert got[("response", 0)] == {1: "1", 2: "2"}
    assert got[("response", 1)] == {1: "\\frac{1}{2}", 2: "4"}
    assert got[("response", 4)] == {1: "{" * 9 + "1" + "}" * 9, 2: "2"}
    assert got[("response", 5)] == {1: "\\boxed{1}", 2: "5"}
    assert len(got) == 5


def test_values_that_stand_whole_are_not_cut(spark):
    fields = ["\\{1, 2\\}", "\\{3, 4\\}", "\\{5, 6\\}; \\{7, 8\\}", '"yes, it does"', '"yes, it does"; 4', "yes, it does", "no, 3; 4", "12", "34", "5, 6", "7, 8", "9, 1", "9, 2; 3, 4", "A", "B", "A, B"] + ["A, B"] * 9
    fields += ["\\begin{pmatrix} 1 \\\\ 2 \\end{pmatrix}", "\\begin{pmatrix} 3 \\\\ 4 \\end{pmatrix}; 7", "\\begin{pmatrix} 5 \\\\ 6 \\end{pmatrix}"] + ["if so, go on", "if so, go on; 12"] + ["plum, pear"] * 9 + ["red, blue", "blue, green"] * 6
    rows = spark.createDataFrame(list(enumerate(fields)), "row_key long, content string").selectExpr("'answer' AS field_name", "*")
    got: dict[str, dict[int, str]] = {}
    for r in packed_values(rows).collect():
        got.setdefault(fields[r.row_key], {})[r.pos] = r["item"]
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {
        "\\{5, 6\\}; \\{7, 8\\}": ["\\{5, 6\\}", "\\{7, 8\\}"],
        '"yes, it does"; 4': ["yes, it does", "4"],
        "no, 3; 4": ["no", "3", "4"],
        "5, 6": ["5", "6"], "7, 8": ["7", "8"], "9, 1": ["9", "1"], "9, 2; 3, 4": ["9", "2", "3", "4"], "A, B": ["A", "B"],
        "\\begin{pmatrix} 3 \\\\ 4 \\end{pmatrix}; 7": ["\\begin{pmatrix} 3 \\\\ 4 \\end{pmatrix}", "7"],
        "if so, go on; 12": ["if so, go on", "12"], "plum, pear": ["plum", "pear"],
        "red, blue": ["red", "blue"], "blue, green": ["blue", "green"],
    }


def test_masks_beyond_the_bound_of_the_dictionary_count_too(spark, monkeypatch):
    fields = ["odd, prime", '"odd, prime"', '"odd, prime"', "odd, prime; 3", "[odd, prime; 4]", "é, ö", '"é, ö"', '"é, ö"', "7; é, ö;; 12,345", ";odd, prime"]
    fields += ["x", "x", "y", "x, y, z", "5 km", "6 km", "5 km; 7 km; odd, prime", "[odd, prime]", "\\{1, 2\\}; \\{7, 8\\}", None, "", ";", "; ".join(["odd, prime"] * 40)]
    rows = spark.createDataFrame(list(enumerate(fields)), "row_key long, content string").selectExpr("'answer' AS field_name", "*")
    run = lambda: sorted((r.row_key, r.pos, r["item"]) for r in packed_values(rows).collect())
    whole = run()
    assert (3, 1, "odd, prime") in whole and (8, 2, "é, ö") in whole and not [r for r in whole if r[0] == 0]
    for room in (0, 5, 12, 30):
        monkeypatch.setattr(S, "DICTIONARY_CHARS", room)
        assert run() == whole, room
    monkeypatch.setattr(S, "size_for", lambda *_: 64)  # a full bit set rules out nothing
    assert run() == whole


def test_the_same_cover_is_taken_whichever_way_values_are_known():
    masks = ["p", "p, q", "q, r", "r", "é; 0"]
    for text in ("p, q, r", "[p, q, r, p]", "é; 5; p, q", "p,, q; r", "q, r, q, r"):
        size = 1 << 12
        bits = np.zeros(size // 64, dtype=np.uint64)
        for m in masks:
            for h in [crc32(m.encode() + b"\0")] + [crc32(m[: 1 << k].encode()) for k in range(len(m).bit_length())]:
                bits[h % size // 64] |= np.uint64(1 << h % 64)
        runs = [(i, j) for i, j, m in S._runs(text, bits, max(map(len, masks))) if m in masks]
        assert segment(text, None, runs) == segment(text, automaton(masks))
        assert segment(text, automaton(masks[1:3]), runs[::-1]) == segment(text, automaton(masks))
