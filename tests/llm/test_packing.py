from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import packing


def check(sizes, capacity, rows, docs=None, attention=None):
    used, members, cost, pieces = Counter(), Counter(), Counter(), defaultdict(list)
    for s, d, k, first, n, pos in rows:
        assert n > 0 and pos == used[s]
        used[s] += n
        members[s] += 1
        cost[s] += n * n
        pieces[d].append((k, first, n))
    assert not used or max(used.values()) <= capacity
    assert docs is None or max(members.values(), default=0) <= docs
    assert attention is None or all(c <= attention or members[s] == 1 for s, c in cost.items())
    for d, n in sizes:
        p = sorted(pieces.get(d, []))
        assert sum(x[2] for x in p) == n
        assert [x[1] for x in p] == [sum(y[2] for y in p[:i]) for i in range(len(p))]
        assert n > capacity or len(p) <= 1
    return len(used)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=60), st.integers(1, 40))
def test_packs_everything_within_capacity(ns, capacity):
    sizes = list(enumerate(ns))
    n = check(sizes, capacity, packing.pack(sizes, capacity))
    full = sum(ns) / capacity
    assert n <= 2 * full + 1


def test_every_constraint_holds():
    sizes = [(i, 1 + i % 9) for i in range(500)]
    check(sizes, 64, packing.pack(sizes, 64, docs=5), docs=5)
    check(sizes, 64, packing.pack(sizes, 64, attention=200), attention=200)


def test_fill_is_close_to_full():
    import random

    rng = random.Random(1)
    sizes = [(i, rng.randint(20, 400)) for i in range(4000)]
    n = check(sizes, 512, packing.pack(sizes, 512))
    assert sum(s for _, s in sizes) / (n * 512) > 0.99


def test_operator(spark):
    d = spark.createDataFrame([(1, "Two lines with the same slope.", 9), (2, None, 9), (3, "", 9), (4, "  ", 9), (5, "word " * 900, 9), (6, "x" * 50_000, 9), (7, "same", 9), (8, "same", 9)], "doc_id long, text string, n_tokens int")
    lim = spark.createDataFrame([(1, 64), (2, 4096), (3, None), (4, 0)], "limit_id long, capacity_tokens int")
    rows = packing.packed(d, lim).collect()
    assert {r.limit_id for r in rows} == {1, 2} and {r.doc_id for r in rows} == {1, 4, 5, 6, 7, 8}
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(d).collect() if r.n_tokens}
    for limit, cap in ((1, 64), (2, 4096)):
        check(list(sizes.items()), cap, sorted((r.sequence_id, r.doc_id, r.piece, r.first_token, r.n_tokens, r.position) for r in rows if r.limit_id == limit and True) and sorted(((r.sequence_id, r.doc_id, r.piece, r.first_token, r.n_tokens, r.position) for r in rows if r.limit_id == limit), key=lambda x: (x[0], x[5])))
    assert packing.packed(d.limit(0), lim).count() == packing.packed(d, lim.limit(0)).count() == 0
    rep = packing.fill_report(d, lim).collect()
    assert {r.limit_id for r in rep} == {1, 2} and all(r.n_tokens == sum(sizes.values()) for r in rep)


@pytest.mark.parametrize("text", ["Hello world", "été 数学 x²", "a\n\n b", "12345"])
def test_tokens_round_trip(text):
    e = packing.encoding(packing.TOKENIZER)
    assert e.decode(e.encode_ordinary(text)) == text and packing.count_tokens(text) == len(e.encode_ordinary(text))


def brute(sizes, capacity, docs, attention):
    """Best fit over all open sequences, without arrays."""
    wt, wd, wa = packing.WEIGHTS
    open_, n_seq = [], 0
    for n, _ in sorted(((n, d) for d, n in sizes if 0 < n < capacity), key=lambda x: (-x[0], x[1])):
        fits = [(wt * ((r - n) / capacity) ** 2 + wd * ((d - 1) / docs) ** 2 + wa * ((a - n * n) / attention) ** 2, i) for i, (r, d, a) in enumerate(open_) if r >= n and d >= 1 and a >= n * n]
        if fits:
            i = min(fits)[1]
        else:
            open_.append((capacity, docs, max(attention, n * n)))
            i = n_seq
            n_seq += 1
        r, d, a = open_[i]
        open_[i] = (r - n, d - 1, a - n * n)
    return n_seq


def test_equals_best_fit_over_all_sequences_and_every_capacity_binds():
    import random

    rng = random.Random(2)
    inf = float("inf")
    sizes = [(i, rng.choice([rng.randint(1, 12), rng.randint(20, 60), rng.randint(90, 127)])) for i in range(900)]
    docs, attention = 8, packing.ATTENTION * 128 * 128  # the default would be 16 documents
    assert check(sizes, 128, packing.pack(sizes, 128, docs), docs, attention) == brute(sizes, 128, docs, attention)
    groups = lambda **limits: {frozenset(r[1] for r in rows if r[0] == s) for rows in [packing.pack(sizes, 128, **limits)] for s in {r[0] for r in rows}}
    every = groups(docs=docs, attention=attention)
    assert every != groups(docs=inf, attention=attention) and every != groups(docs=docs, attention=inf)
    free = packing.pack(sizes, 128, docs=inf, attention=inf)
    with pytest.raises(AssertionError):
        check(sizes, 128, free, docs, None)
    with pytest.raises(AssertionError):
        check(sizes, 128, free, None, attention)


def test_long_stretches_are_encoded_whole():
    e = packing.encoding(packing.TOKENIZER)
    for t in ("x" * 50_000, "ab1!" * 20_000):
        assert packing.count_tokens(t) == len(e.encode_ordinary(t)) and e.decode(e.encode_ordinary(t)) == t
