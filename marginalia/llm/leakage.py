"""Held-out items in a corpus: an FM-index per shard of documents.

A task joins the folded words of its documents to shards of about SHARD_WORDS words,
numbers the shard's own words, sorts its suffixes once, and keeps the Burrows-Wheeler
transform as a wavelet matrix. All five-word phrases of all items are searched backwards
at once through its ranks; occurrences are located by sampled suffix positions. Hits of
one item in one document are chained, and an exact check aligns item and passage word by
word: the document holds the item if a run of at least half of its words, small changes
and short interruptions allowed, stands there with its numbers.

The corpus is not shuffled, and no task holds more than a shard. Items go to the tasks
together; only if they have more than ITEM_WORDS words, in several passes, so that what
is broadcast has a bound.

Defined results: null, blank and wordless texts hold nothing; repeated documents come
out each; an item of fewer than five words is searched whole; extra columns are not
read; empty tables give no row.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import ship, spread

PHRASE = 5
SHARD_WORDS = 300_000
SAMPLE = 8
ITEM_WORDS = 4_000_000
#: Share of an item's phrases that must be found before its words are aligned.
CANDIDATE = 0.14
#: Share of its words that the run must span (half, less what an edit may take off the ends), of the run and of the item that must be found, and of the run's numbers.
RUN, FOUND, HELD, NUMBERS = 0.46, 0.62, 0.4, 0.6
#: Longest gap within a run, in words of the item and of the document.
ITEM_GAP, DOC_GAP = 8, 25


class FMIndex:
    """Counts and locates phrases in a sequence of small integers (0 ends it and stands nowhere else)."""

    def __init__(self, text: np.ndarray, symbols: int | None = None):
        n, symbols = len(text), max(symbols or 0, int(text.max()) + 1)
        sa = _suffixes(text)
        self.n = n
        self.bwt = text[sa - 1]  # sa 0 takes the end mark
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, (symbols - 1).bit_length())
        seq = self.bwt.astype(np.int64)
        for k in range(self.bits - 1, -1, -1):
            bit = (seq >> k) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            zeros = n - int(ones[-1])
            self.levels.append((ones, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        # where each symbol's block begins on the last level
        start = np.zeros(1 << self.bits, dtype=np.int64)
        u, at = np.unique(seq, return_index=True)
        start[u] = at
        self.block = start
        self.sampled = sa % SAMPLE == 0
        self.samples = sa[self.sampled]
        self.rank_sampled = np.cumsum(self.sampled) - 1

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before place i of the transform, for arrays of queries."""
        i = i.copy()
        for k, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            r = ones[i]
            i = np.where((c >> k) & 1, zeros + r, i - r)
        return i - self.block[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with each phrase; phrases are rows, filled up on the left with -1."""
        m = len(phrases)
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j].astype(np.int64)
            on = (c >= 0) & (hi > lo)
            cc = c[on]
            lo[on] = self.first[cc] + self.rank(cc, lo[on])
            hi[on] = self.first[cc] + self.rank(cc, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of the given suffixes, by steps back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.samples[self.rank_sampled[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt[at].astype(np.int64)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out


def _suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array: sorted by as many symbols as fit into 64 bits, then by prefix doubling of the suffixes not yet told apart."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    k = max(1, min(62 // bits, n))
    key = np.zeros(n, dtype=np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] |= text[j:].astype(np.int64)
    sa = np.argsort(key)
    place = np.arange(n)
    s = key[sa]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
    while True:
        # the places of suffixes that share their first k symbols with a neighbour
        todo = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(todo):
            return sa
        at = sa[todo]
        far = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + far
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[todo] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[todo] = fresh
        rank[at] = todo[np.maximum.accumulate(np.where(fresh, np.arange(len(todo)), 0))]
        k *= 2


def _phrases(items: list[tuple[int, list[str]]]):
    """Words of the items, phrase matrix in them, and for each phrase the (item, place) pairs."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    where: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for k, (_, ws) in enumerate(items):
        ids = [vocabulary[w] for w in ws]
        n = min(PHRASE, len(ids))
        for p in range(len(ids) - n + 1):
            where.setdefault((-1,) * (PHRASE - n) + tuple(ids[p : p + n]), []).append((k, p))
    m = np.array(list(where), dtype=np.int64).reshape(-1, PHRASE)
    owners = list(where.values())
    counts = np.array([len(o) for o in owners], dtype=np.int64)
    flat_item = np.array([k for o in owners for k, _ in o], dtype=np.int64)
    flat_pos = np.array([p for o in owners for _, p in o], dtype=np.int64)
    return list(vocabulary), m, np.concatenate([[0], np.cumsum(counts)]), flat_item, flat_pos


def held_run(item: list[str], passage: list[str]) -> tuple[int, int, int, int] | None:
    """(first, last) word of the item and of the passage of the longest run, if it is long enough."""
    from difflib import SequenceMatcher

    from marginalia.llm.wordfold import alike

    pairs: list[tuple[int, int]] = []
    m = SequenceMatcher(None, item, passage, autojunk=False)
    for tag, i1, i2, j1, j2 in m.get_opcodes():
        if tag == "equal":
            pairs += zip(range(i1, i2), range(j1, j2))
        elif tag == "replace":
            j = j1
            for i in range(i1, i2):
                k = next((k for k in range(j, min(j2, j + 6)) if alike(item[i], passage[k])), None)
                if k is not None:
                    pairs.append((i, k))
                    j = k + 1
    best, run = None, []
    for p in [*pairs, None]:
        if run and (p is None or p[0] - run[-1][0] > ITEM_GAP or p[1] - run[-1][1] > DOC_GAP):
            if best is None or len(run) > len(best):
                best = run
            run = []
        if p is not None:
            run.append(p)
    if not best:
        return None
    a, b = best[0][0], best[-1][0]
    span = b - a + 1
    numbers = [i for i in range(a, b + 1) if item[i][0].isdigit()]
    found = {i for i, _ in best}
    if span < RUN * len(item) or len(best) < max(FOUND * span, HELD * len(item)) or (numbers and sum(i in found for i in numbers) < NUMBERS * len(numbers)):
        return None
    return a, b, best[0][1], best[-1][1]


def held_runs(item: list[str], passage: list[str], hits: np.ndarray) -> list[tuple[int, int, int, int]]:
    """All runs of the passage, by place: what lies before and behind a run is searched again where it holds a hit (places of phrases), until no run is left."""
    out, todo = [], [(0, len(passage))]
    while todo:
        a, b = todo.pop()
        r = held_run(item, passage[a:b]) if b - a >= HELD * len(item) and ((hits >= a) & (hits < b)).any() else None
        if r:
            out.append((r[0], r[1], a + r[2], a + r[3]))
            todo += [(a, a + r[2]), (a + r[3] + 1, b)]
    return sorted(out, key=lambda r: r[2])


def char_span(text: str, ws: list[str], first: int, end: int) -> tuple[int, int]:
    """Where in the text its folded words first to end (without) stand, in characters."""
    from marginalia.llm.wordfold import words

    def begin(t: str, n: int) -> int:
        """Where word n of t begins: one before the shortest prefix that holds n + 1 words."""
        return max(0, bisect.bisect_left(range(len(t) + 1), n + 1, key=lambda e: len(words(t[:e]))) - 1)

    def stop(t: str, n: int) -> int:
        """Where the first n words of t end: before the next one, without white space."""
        return len(t[: begin(t, n) if n < len(words(t)) else len(t)].rstrip())

    pieces = [m.span() for m in re.finditer(r"\S+", text)]
    counts = [len(words(text[a:b])) for a, b in pieces]
    if sum(counts) != len(ws):  # words of several pieces
        return begin(text, first), stop(text, end)
    upto = np.cumsum(counts)
    i, j = int(np.searchsorted(upto, first, side="right")), int(np.searchsorted(upto, end, side="left"))
    (a, b), (c, d) = pieces[i], pieces[j]
    return a + begin(text[a:b], first - int(upto[i]) + counts[i]) if upto[i] - counts[i] < first else a, c + stop(text[c:d], end - int(upto[j]) + counts[j]) if upto[j] > end else d


def _search(shared, chars: bool):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from marginalia.llm.wordfold import words

        items = shared.value
        known, phrases, offset, flat_item, flat_pos = _phrases(items)
        lengths = np.array([len(ws) for _, ws in items])
        need = np.maximum(1, np.ceil(CANDIDATE * (lengths - min(PHRASE, 5) + 1)))
        held: list[tuple[int, list[str], str]] = []
        size = 0

        def shard() -> pd.DataFrame:
            vocabulary: dict[str, int] = {}
            number = vocabulary.setdefault
            ids, starts, at = [], [], 0
            for _, ws, _ in held:
                starts.append(at)
                ids += [number(w, len(vocabulary) + 2) for w in ws]  # 0 end, 1 between documents
                ids.append(1)
                at += len(ws) + 1
            ids.append(0)
            index = FMIndex(np.array(ids, dtype=np.int32), len(vocabulary) + 2)
            # phrases in the shard's own words; those with a word it lacks stand nowhere in it
            own = np.array([*(vocabulary.get(w, -2) for w in known), -1], dtype=np.int64)
            mine = own[phrases]
            there = np.flatnonzero((mine != -2).all(axis=1))
            lo, hi = index.search(mine[there])
            n = hi - lo
            which = np.repeat(there, n)
            rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = index.locate(rows)
            start = np.array(starts, dtype=np.int64)
            doc = np.searchsorted(start, place, side="right") - 1
            word = place - start[doc]
            # one hit for each item that owns the phrase
            k = offset[which + 1] - offset[which]
            rep = np.repeat(np.arange(len(which)), k)
            o = offset[which[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
            order = np.lexsort((flat_pos[o], flat_item[o], doc[rep]))
            doc, word, item, pos = doc[rep][order], word[rep][order], flat_item[o][order], flat_pos[o][order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else np.zeros(0, dtype=bool)
            different = np.concatenate([[True], pos[1:] != pos[:-1]])[: len(doc)] | new
            first = np.flatnonzero(new)
            found = np.add.reduceat(different, first) if len(first) else np.zeros(0)
            out = []
            for g in np.flatnonzero(found >= need[item[first]]):
                a = first[g]
                d, i, w = doc[a], item[a], np.sort(word[a : first[g + 1] if g + 1 < len(first) else len(doc)])
                doc_id, ws, text = held[d]
                item_id, iw = items[i]
                # clusters of hits that lie close enough to be one passage
                for part in np.split(w, np.flatnonzero(np.diff(w) > len(iw) + DOC_GAP) + 1):
                    a, b = max(0, part[0] - len(iw)), min(len(ws), part[-1] + len(iw) + PHRASE)
                    for r in held_runs(iw, ws[a:b], part - a):
                        span = (int(a + r[2]), int(a + r[3]) + 1)
                        out.append((doc_id, item_id, *span, *(char_span(text, ws, *span) if chars else (None, None)), r[1] - r[0] + 1, len(iw)))
            return pd.DataFrame(out, columns=["doc_id", "item_id", "first_word", "end_word", "first_char", "end_char", "n_run", "n_item"]).astype({"first_char": "Int32", "end_char": "Int32"})

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ws = words(text)
                if not ws:
                    continue
                held.append((doc_id, ws, text if chars else ""))
                size += len(ws)
                if size >= SHARD_WORDS:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    return find


def leaks(documents: DataFrame, items: DataFrame, chars: bool = False) -> DataFrame:
    """doc_id, item_id, first_word, end_word (of the folded document), first_char, end_char (of its text, if asked for), n_run, n_item for every passage that holds an item."""
    from marginalia.llm.wordfold import words

    spark = documents.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, first_word int, end_word int, first_char int, end_char int, n_run int, n_item int"
    docs = spread(documents.where("trim(coalesce(text, '')) <> ''").select("doc_id", "text"))

    def passes() -> Iterator[list[tuple[int, list[str]]]]:
        block, size = [], 0
        for r in items.where("item_text is not null").select("item_id", "item_text").orderBy("item_id", "item_text").toLocalIterator():
            if ws := words(r["item_text"]):
                block.append((r["item_id"], ws))
                size += len(ws)
            if size >= ITEM_WORDS:
                yield block
                block, size = [], 0
        if block:
            yield block

    out = None
    for part in passes():
        found = docs.mapInPandas(_search(spark.sparkContext.broadcast(part), chars), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, first_char, end_char (of the text), n_items: the leaked passages of a document, those that overlap merged."""
    from pyspark.sql import Window

    s = leaks(documents, items, chars=True)
    before = Window.partitionBy("doc_id").orderBy("first_char", "end_char", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("first_char", "end_char", "item_id").rowsBetween(Window.unboundedPreceding, 0)
    fresh = s.withColumn("new", F.when(F.col("first_char") < F.max("end_char").over(before), 0).otherwise(1))
    return fresh.withColumn("span", F.sum("new").over(upto)).groupBy("doc_id", "span").agg(F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char"), F.count_distinct("item_id").alias("n_items")).drop("span")
