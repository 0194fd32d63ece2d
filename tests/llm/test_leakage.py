import random

import numpy as np

from marginalia.llm import leakage

ITEM = "The road between the mill and the old station is 957 km long. A cyclist needs 619 minutes to reach the orchard from the greenhouse. During the week 885 gears were broken on the way to the brewery. Find the total number of melons."
OTHER = "The road between the farm and the new library is 12 km long. A cyclist needs 88 minutes to reach the harbour from the café. During the week 31 plums were broken on the way to the quarry. Find the total number of ropes."


def test_index_equals_brute_force():
    rng = np.random.default_rng(0)
    for n, k in ((1, 2), (7, 2), (300, 3), (2000, 40)):
        t = np.concatenate([rng.integers(1, 1 + k, n), [0]]).astype(np.int32)
        index = leakage.FMIndex(t, 64)
        for m in (1, 2, 4):
            p = rng.integers(1, 2 + k, (60, m))
            lo, hi = index.search(p)
            for q, a, b in zip(p, lo, hi):
                want = [i for i in range(len(t) - m + 1) if (t[i : i + m] == q).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_repeated_texts_are_sorted():
    t = np.array([1, 2, 3] * 400 + [0], dtype=np.int32)
    lo, hi = leakage.FMIndex(t).search(np.array([[1, 2, 3, 1]]))
    assert hi[0] - lo[0] == 399


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")


def test_leaks(spark):
    ws = ITEM.split()
    texts = [
        "Intro. " + ITEM + " The end.",
        "> " + "\n> ".join(" ".join(ws[i : i + 6]) for i in range(0, len(ws), 6)),
        " ".join(ws[: len(ws) * 6 // 10]) + " and now to something else.",
        ITEM.replace("needs", "takes").replace("station", "staiton").upper(),
        " ".join(ws[:20]) + " (see the note above on this) " + " ".join(ws[20:]),
        OTHER,
        "See the one with " + " ".join(ws[5:17]) + " in it.",
        "Find the total number of melons.",
        None, "", " \n", "？",
        ITEM, ITEM,
        ("filler words go here again and again " * 8000) + ITEM,
    ]
    items = spark.createDataFrame([(7, ITEM, 1), (8, OTHER, 1), (9, None, 1), (10, "", 1), (11, "tiny item 77", 1)], "item_id long, item_text string, doc_id int")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(docs(spark, texts), items).collect())
    assert got == [(0, 7), (1, 7), (2, 7), (3, 7), (4, 7), (5, 8), (12, 7), (13, 7), (14, 7)]
    assert leakage.leaked_items(docs(spark, []), items).count() == 0
    assert leakage.leaked_items(docs(spark, texts), items.limit(0)).count() == 0
    spans = {(r.doc_id, texts[r.doc_id][r.first_char : r.end_char]) for r in leakage.removal_spans(docs(spark, texts), items).collect()}
    assert {(0, ITEM), (1, texts[1][2:]), (12, ITEM), (14, ITEM), (5, OTHER)} <= spans and len(spans) == 9


def test_shards_lose_nothing(spark, monkeypatch):
    rng = random.Random(3)
    texts = [f"word{rng.randint(0, 9)} " * rng.randint(1, 80) + (ITEM if i % 4 == 0 else OTHER if i % 4 == 1 else "") for i in range(60)]
    items = spark.createDataFrame([(7, ITEM), (8, OTHER)], "item_id long, item_text string")
    monkeypatch.setattr(leakage, "SHARD_WORDS", 150)
    monkeypatch.setattr(leakage, "ITEM_WORDS", 1)
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs(spark, texts), items).collect()}
    assert got == {(i, 7) for i in range(0, 60, 4)} | {(i, 8) for i in range(1, 60, 4)}


def test_every_copy_in_a_document_gets_a_span(spark):
    gap = " and here is how we go about it with some care "
    texts = ["Intro. " + ITEM + gap + ITEM + gap + ITEM, ITEM + " " + ITEM, ITEM + gap + OTHER]
    items = spark.createDataFrame([(7, ITEM)], "item_id long, item_text string")
    n = len(ITEM.split())
    got = {(r.doc_id, r.first_word, r.end_word) for r in leakage.leaks(docs(spark, texts), items).collect()}
    step = n + len(gap.split())
    assert got == {(0, 1, 1 + n), (0, 1 + step, 1 + step + n), (0, 1 + 2 * step, 1 + 2 * step + n), (1, 0, n), (1, n, 2 * n), (2, 0, n)}
    assert leakage.leaked_items(docs(spark, texts), items).count() == 3


def test_char_spans_give_the_same_words():
    from marginalia.llm.wordfold import words

    rng = random.Random(4)
    pieces = ["cafe\u0301", "one hundred twenty", "然后把结果", "$12{,}5$", "x,y;z", "\n", "word", "**Bold**", "[ANS]", "7\u00a0km", "Ünder", "\\text{or}", "3.5."]
    same = n = 0
    for _ in range(200):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", "  ", "\n", ""]) for _ in range(rng.randint(1, 12)))
        ws = words(text)
        for first in range(len(ws)):
            end = rng.randint(first + 1, len(ws))
            a, b = leakage.char_span(text, ws, first, end)
            assert 0 <= a < b <= len(text)
            n, same = n + 1, same + (words(text[a:b]) == ws[first:end])
    assert same >= 0.85 * n


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (2, 1), (50, 1), (400, 2), (400, 60_000)):
        t = np.concatenate([rng.integers(1, 1 + k, n), [0]]).astype(np.int32)
        assert leakage._suffixes(t).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_without_the_index_nothing_is_found(spark, monkeypatch):
    items = spark.createDataFrame([(7, ITEM)], "item_id long, item_text string")
    shared = type("Shared", (), {"value": [(7, leakage_words(ITEM))]})
    batch = docs(spark, [ITEM]).toPandas()
    assert sum(map(len, leakage._search(shared, False)(iter([batch])))) == 1
    monkeypatch.setattr(leakage.FMIndex, "search", lambda self, p: (np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)))
    assert sum(map(len, leakage._search(shared, False)(iter([batch])))) == 0
    assert items.count() == 1


def leakage_words(text):
    from marginalia.llm.wordfold import words

    return words(text)
