import random

import numpy as np
import pytest

from marginalia.llm import reading_level as R

LOW = ["The cat is on the mat.", "Count to {} with me.", "Look at the red box.", "She has {} big apples.", "Clap your hands {} times.", "Where is the small dog?"]
MID = ["Subtract {} from both sides of the equation.", "The mean of the measurements is the sum divided by {}.", "Two lines with the same slope never meet.", "Write the fraction in lowest terms before you convert it.", "The angles of the triangle add up to 180 degrees."]
HIGH = ["Whenever the bundle acts freely, the quotient carries a canonical structure.", "Hypotheses of tightness are imposed in order to exclude pathological examples.", "The functor is dense, although its graded counterpart need not be compact.", "By duality the annihilator coincides with the closure of the image."]
EXERCISE = ["A cyclist needs {} minutes to reach the mill. The road to the harbour is {} km long. Each of the new shelves holds {} plates. Find the total number of pears."]


def doc(rng, pool, n=8):
    return " ".join(rng.choice(pool).replace("{}", str(rng.randint(2, 90))) for _ in range(n))


def tables(spark, rng, n=90):
    docs, labels = [], []
    for i in range(n):
        band = R.BANDS[i % 3]
        t = doc(rng, (LOW, MID, HIGH)[i % 3])
        if i % 9 < 3:
            t += " " + doc(rng, EXERCISE, 1)
        docs.append((i, t, "s", "xx"))
        if i < 60:
            labels.append((i, band if i != 4 else "primary", "r"))
    docs += [(900, None, "s", "en"), (901, " \n", "s", "en"), (902, "Die Summe der Zahlen ist gleich dem Produkt und wird durch die Zahl geteilt.", "s", "en"), (903, "123 456", None, "en"), (904, doc(rng, LOW, 4000), None, "en"), (5, docs[5][1], "s", "en")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, band string"), spark.createDataFrame(labels + [(0, "university", "x"), (1, "nonsense", "x"), (77777, "primary", "x")], "doc_id long, band string, rater string")


def test_levels(spark):
    d, l = tables(spark, random.Random(1))
    ex = spark.createDataFrame([(i, doc(random.Random(i), EXERCISE, 1)) for i in range(30)], "item_id long, item_text string")
    rows = R.levels(d, l, ex).collect()
    got = {r.doc_id: r.band for r in rows}
    assert np.mean([got[i] == R.BANDS[i % 3] for i in range(60, 90)]) >= 0.9
    assert {900, 901, 902, 903} & got.keys() == set() and got[904] == "primary"
    assert len(rows) == 92  # the repeated document comes out twice
    assert R.levels(d, l.limit(0), ex).count() == 0 and R.levels(d.limit(0), l, ex).count() == 0
    p = R.profile(d, l, ex).collect()
    assert sum(r.n_docs for r in p) == 92 and {r.source for r in p} == {"s", "(none)"}


def test_regression_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    s = x @ np.array([1.5, -1.0, 0.0])
    y = (s > -0.7).astype(int) + (s > 0.9).astype(int)
    m = R.OrdinalRegression().fit(x, y, np.ones(600), penalty=1.0)
    assert np.mean(m.predict(x) == y) > 0.95
    p = m.probability(x)
    assert np.allclose(p.sum(axis=1), 1) and (p > -1e-9).all() and m.cuts[0] < m.cuts[1]


@pytest.mark.parametrize("text,n", [("", 0), ("One. Two! Three?", 3), ("a 3.5 b", 1), ("12 34", 0), ("一。二", 2), (" ".join(["word"] * 100), 5)])
def test_segments(text, n):
    e = R.Words().encode([text, "x"])
    assert len(e.start) == n + 1 and e.n_docs == 2


def test_features_match_plain_loops():
    texts = ["Since the sum is 12, which holds, we stop. Go on\nthen stop", "", "One two one", "1 2"]
    rng = np.random.default_rng(3)
    rarity, grade = rng.random(R.BUCKETS), rng.random(R.BUCKETS)
    words = R.Words()
    e = words.encode(texts)
    keep = np.ones(len(e.start), dtype=bool)
    x = e.features(keep, rarity, grade)
    import re
    import zlib

    bucket = lambda w: zlib.crc32(w.encode()) % R.BUCKETS
    for i, t in enumerate(texts):
        segs = [[w for w in re.findall(r"[a-z]+|\d+", s)] for s in re.split(r"[.\n]", t.lower())]
        segs = [s for s in segs if any(w.isalpha() for w in s)]
        if not segs:
            assert not x[i].any()
            continue
        only = [[w for w in s if w.isalpha()] for s in segs]
        want = [
            [np.mean([rarity[bucket(w)] for w in s]) for s in only],
            [max(rarity[bucket(w)] for w in s) for s in only],
            [np.mean([len(w) for w in s]) for s in only],
            [max(len(w) for w in s) for s in only],
            [np.mean([len(w) > 8 for w in s]) for s in only],
            [sum(w in R.CONNECTIVES for w in s) / len(s) for s in segs],
            [sum(w in R.SUBORDINATORS for w in s) / len(s) for s in segs],
            [np.log(len(s)) for s in segs],
            [np.mean([grade[bucket(w)] for w in s]) for s in only],
        ]
        for k, v in enumerate(want):
            assert np.allclose(x[i, 4 * k : 4 * k + 4], [np.mean(v), *np.quantile(v, [0.25, 0.5, 0.75])])
        flat = ["0" if w.isdigit() else w for s in segs for w in s]
        words = [w for s in only for w in s]
        at = 36
        assert np.allclose(x[i, at : at + R.LENGTHS], [np.mean([min(len(w), R.LENGTHS) == k + 1 for w in words]) for k in range(R.LENGTHS)])
        assert np.allclose(x[i, at + R.LENGTHS : at + R.LENGTHS + R.RARITIES].sum(), 1)
        joins = x[i, at + R.LENGTHS + R.RARITIES : -1]
        assert np.allclose(joins, [np.mean([R._JOIN.get(w, 0) == k for w in words]) for k in range(len(R._JOIN) + 1)])
        assert np.isclose(x[i, -1], np.mean([w not in flat[max(0, j - R.RECENT) : j] for j, w in enumerate(flat)]))


def test_every_family_of_features_counts(spark):
    """The rarity against graded text alone doesn't settle the bands, nor do they all need it."""
    rng = random.Random(5)
    texts = [doc(rng, (LOW, MID, HIGH)[i % 3]) for i in range(240)]
    y = np.arange(240) % 3
    rarity = -np.log(np.bincount(R.Words().encode(texts).bucket, minlength=R.BUCKETS) + 0.5)
    m = R.LevelModel().fit(texts[:120], np.eye(3)[y[:120]], [], rarity)
    right = lambda: np.mean([b == R.BANDS[k] for b, k in zip(m.predict(texts[120:]), y[120:])])
    assert right() >= 0.95
    m.regression.w[32:36] = 0
    assert right() >= 0.6
    m.regression.w[:] = 0
    assert right() < 0.5


def test_an_exercise_does_not_change_the_band():
    rng = random.Random(6)
    texts = [doc(rng, (LOW, MID, HIGH)[i % 3]) for i in range(90)]
    m = R.LevelModel().fit(texts, np.eye(3)[np.arange(90) % 3], EXERCISE, np.ones(R.BUCKETS))
    one = EXERCISE[0].replace("{}", "7")
    assert m.predict([t + "\n" + one for t in texts]) == m.predict(texts)
    assert m.predict([one])[0] in R.BANDS


def test_corpus_counts_cover_all_documents(spark):
    d = spark.createDataFrame([(1, "alpha beta alpha", "s"), (2, "alpha", "s")], "doc_id long, text string, source string")
    r = R.word_rarity(d)
    import zlib

    at = lambda w: r[zlib.crc32(w.encode()) % R.BUCKETS]
    assert at("alpha") < at("beta") < at("gamma") and len(r) == R.BUCKETS
