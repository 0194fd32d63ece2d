import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.unify import HARMLESS, changed_rows, look_alikes, skeleton, unified, unify

CHANGED = [
    ("\uff13\uff17", "37"), ("𝟑7", "37"), ("a\u00a0b", "a b"), ("3\u200b25", "325"), ("e\u0301tat", "\u00e9tat"), ("оf the", "of the"), ("\\boxed{\u0421}", "\\boxed{C}"), ("\u0391", "A"), ("37 \u0441m\u00b2", "37 cm\u00b2"),
    ("\ufb01nal", "final"), ("Total\uff0e", "Total."), ("Провeрим ответ", "Проверим ответ"), ("所以\\boxed{1\uff17}。", "所以\\boxed{17}。"), ("\u0443 = 9", "y = 9"),
]
KEPT = ["", "plain", "Проверим ответ, а в саду с нами.", "首先把9和4相加，得到13。还有多少？", "θ = 5°", "12π", "183½", "71 cm²", "x\u0304 = 4", "Größe café", "\ufffd", " ", "В конце $x$ равно 5"]


@pytest.mark.parametrize("text,want", CHANGED)
def test_changed(text, want):
    assert unified(text) == want
    assert skeleton(want) == skeleton(text)


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert unified(text) == unicodedata.normalize("NFC", text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcXАВС авсеοΑ１２é\u0301\u200b\u00a0ﬁ，。中$\\{}x ", max_size=30))
def test_unified_is_stable_and_looks_alike(text):
    u = unified(text)
    assert unified(u) == u
    assert skeleton(u) == skeleton(text)
    assert skeleton(skeleton(text)) == skeleton(text)


def test_operator(spark):
    rows = [("answer", 1, "A", 0), ("answer", 2, "\u0410", 0), ("answer", 2, "\u0410", 0), ("answer", 3, None, 0), ("answer", 4, "", 0), ("response", 5, "x" * 200_000 + "\u200b", 0), ("answer", None, "𝟑", 0)]
    df = spark.createDataFrame(rows, "field_name string, row_key long, content string, unified int")
    f = df.select("field_name", "row_key", "content")
    assert sorted((r.field_name, r.row_key or 0) for r in changed_rows(df).collect()) == [("answer", 0), ("answer", 2), ("answer", 2), ("response", 5)]
    out = unify(f).collect()
    assert len(out) == 7 and {(r.row_key, r.unified) for r in out if r.field_name == "answer"} == {(1, "A"), (2, "A"), (3, None), (4, ""), (None, "3")}
    g = look_alikes(f).collect()
    assert [(r.n_rows, r.n_forms, r.unified) for r in g] == [(3, 2, "A")]
    assert changed_rows(df.limit(0)).count() == 0


def test_harmless_texts_are_no_cases():
    import re

    for t, _ in CHANGED:
        assert not re.match(HARMLESS.replace("一-鿿", "\u4e00-\u9fff"), t), t


def test_table_covers_other_scripts(spark):
    from marginalia.llm import unify as U

    t = U.look_alike_table(spark)
    assert len(t) > 300 and t["\u13aa"] == "A" and t["\u0585"] == "o" and t["\u2160"] == "I" and t["\ua4ee"] == "A" and t["\u2c9f"] == "o"
    texts = [("\u13aanswer", "Answer"), ("\\boxed{\ua4ee}", "\\boxed{A}"), ("w\u0585rd", "word"), ("\u0562\u0561\u0580\u0587", None), ("\u0585 \u0562\u0561\u0580", None), ("2\u00b2 \u00bd", None)]
    df = spark.createDataFrame([("answer", i, x) for i, (x, _) in enumerate(texts)], "field_name string, row_key long, content string")
    assert sorted(r.row_key for r in changed_rows(df).collect()) == [0, 1, 2]
    assert {r.row_key: r.unified for r in unify(df).collect()} == {i: w or x for i, (x, w) in enumerate(texts)}


def test_groups_decide(spark, monkeypatch):
    """A row comes out by the form of its groups: where the groups know no other form, the check alone brings none."""
    from marginalia.llm import unify as U

    rows = [("answer", 1, "cat"), ("answer", 2, "\u0441at"), ("answer", 3, "В конце B саду"), ("answer", 4, "с нами в саду"), ("answer", 5, "\uff11\uff12"), ("answer", 6, "\u03b1 = 5")]
    df = spark.createDataFrame(rows, "field_name string, row_key long, content string")
    assert sorted(r.row_key for r in changed_rows(df).collect()) == [2, 3, 5]
    monkeypatch.setattr(U, "_words", lambda shared: lambda batches: (b.assign(h=0, around="L", form="x", skeleton="x", plain=True, changed=True)[["field_name", "row_key", "h", "around", "form", "skeleton", "plain", "changed"]] for b in batches))
    assert changed_rows(df).count() == 0
