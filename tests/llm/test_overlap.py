import random

from marginalia.llm import overlap
from marginalia.llm.wordfold import quantities, words

SCHEMA = "id long, split string, source string, question string, options array<string>"


def brute(rows):
    out = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] not in ("train", None):
                x, y = (overlap.exercise_words(r[3] or "") for r in (a, b))
                if x and y and quantities(x) == quantities(y) and overlap.same_exercise(x, y):
                    out.add((a[0], b[0]))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    nouns = ["pears", "plums", "lanterns", "ropes", "maps"]
    rows = []
    for i in range(240):
        n = [rng.randint(13, 40) for _ in range(2)]
        t = f"Rimo pays {n[0]} coins for a large box of {rng.choice(nouns)} at the mill. Then {n[1]} {rng.choice(nouns)} are stored there. How many are left for the {rng.choice(['fair', 'farm'])}?"
        if i % 3 == 0 and rows:
            t = rng.choice(rows)[3]
            t = rng.choice([t.upper(), t.replace("coins", "cions"), "Problem 17. " + t, t + " Show all steps of your work.", t.replace("a large", "one large"), t.replace(" ", "\u00a0")])
        rows.append((i, rng.choice(["train", "holdout", "private"]), "s", t, None))
    got = {(r.id_train, r.id_eval) for r in overlap.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and got


def test_edges(spark):
    q = "In a row of boxes the first contains 337 screws and 153 nails. How many are there?"
    rows = [(1, "train", "a", q, None), (2, "holdout", "a", q, None), (3, "private", None, q.replace("337", "three hundred thirty-seven"), None), (4, "private", None, q.replace("337", "338"), None), (5, "train", None, None, None), (6, "holdout", None, "", None), (7, "train", None, "…", None), (8, "train", "a", q, None), (9, None, "a", q, None), (10, "train", "a", "x " * 50_000 + "999", None), (11, "private", "a", "x " * 50_000 + "999", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.id_train, r.id_eval) for r in overlap.overlaps(df).collect())
    assert got == [(1, 2), (1, 3), (8, 2), (8, 3), (10, 11)]
    assert overlap.overlaps(df.limit(0)).count() == 0
    assert overlap.overlaps(df.where("split = 'train'")).count() == 0


def test_many_shards_and_splits_lose_nothing(spark, monkeypatch):
    rows = [(i, "train" if i % 2 else "holdout", "s", f"Ann has {'55 pears and' if i % 3 else 'pears and'} word{i // 2} w{i // 2 % 7} x y z", None) for i in range(120)]
    monkeypatch.setattr(overlap, "EVAL_SHARD", 7)
    monkeypatch.setattr(overlap, "TRAIN_SHARD", 5)
    monkeypatch.setattr(overlap, "FEW_PAIRS", 3)
    got = {(r.id_train, r.id_eval) for r in overlap.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and got


def test_stretches_cover_every_passage_once():
    rng = random.Random(3)
    texts = [[rng.choice(["a", "bb", "ccc", "17", "230", "dddd"]) for _ in range(n)] for n in (1, 2, 3, 5, 9, 60, 0, 4)]
    keys = [rng.choice(["17", "", "230 17"]) for _ in texts]
    row, place, code, heaviest = overlap._passages(texts, keys)
    want = [(r, i, tuple(t[i : i + overlap._size(k)]), k) for r, (t, k) in enumerate(zip(texts, keys)) for i in range(overlap._count(len(t), overlap._size(k)))]
    assert list(zip(row.tolist(), place.tolist())) == [(r, i) for r, i, _, _ in want]
    assert len(set(zip(code.tolist(), [w[2:] for w in want]))) == len({w[2:] for w in want}) == len(set(code.tolist()))
    assert heaviest.tolist() == [max(map(overlap._weight, w[2])) & 0xFFFFFFFF for w in want]
    for shards in (1, 3, 50):
        got = [(r, i) for r, s, first, n in zip(*(x.tolist() for x in overlap._stretches(texts, keys, shards))) for i in range(first, first + n)]
        assert got == [(r, i) for r, i, _, _ in want]
    assert [len(x) for x in overlap._stretches([], [], 3)] == [0, 0, 0, 0]
    assert overlap.covered_words([0, 1, 4], 3, 6) == 6 and overlap.covered_words([], 3, 6) == 0 and overlap.covered_words([0], 5, 2) == 2


def test_the_automaton_and_coverage_decide(spark, monkeypatch):
    a = "Rimo pays 31 coins for a large box of pears at the mill and 44 plums are stored there."
    b = "Of 31 visitors on the ship who came by train from the coast some 44 were asked to leave."
    rows = [(1, "train", "s", a, None), (2, "private", "s", a, None), (3, "private", "s", b, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    # the check alone would let all pairs of equal quantities pass
    monkeypatch.setattr(overlap, "SAME", 0.0)
    monkeypatch.setattr(overlap, "EXTRA", 0.0)
    assert {(r.id_train, r.id_eval) for r in overlap.overlaps(df).collect()} == {(1, 2)}
    monkeypatch.setattr(overlap, "scan", lambda shard: shard.iloc[:0].assign(h_train="", h_eval="", starts=None)[["h_train", "h_eval", "starts"]])
    assert overlap.overlaps(df).count() == 0


def test_counts_come_from_class_sizes(spark):
    q = "In a row of boxes the first contains 337 screws and 153 nails. How many are there?"
    public = spark.createDataFrame([(i, q, "train", "s") for i in range(7)] + [(10, q, "holdout", "a"), (11, "Other 15 words here", "holdout", None)], "id long, question string, split string, source string")
    private = spark.createDataFrame([(20, q, "b"), (21, q, "b"), (22, None, "b")], "id long, question string, source string")
    got = {(r.split, r.source): (r.n_questions, r.n_leaked, r.n_pairs) for r in overlap.overlap_counts(public, private).collect()}
    assert got == {("holdout", "a"): (1, 1, 7), ("holdout", "(none)"): (1, 0, 0), ("private", "b"): (3, 2, 14)}


def test_folding():
    assert words("**Bold** [ANS] ___ café $12{,}$ one hundred twenty-three") == ["bold", "cafe", "12", "123"]
    assert words("one of the two hundred and five") == ["one", "of", "the", "205"]
    assert words("ДЕРЕВЬЕВ деревьев") == [words("деревьев")[0]] * 2
    assert words(None) == words("  ") == []
    assert overlap.exercise_words("(Contest round 26) Add 31 and 44. [5 points]") == ["add", "31", "and", "44"]
