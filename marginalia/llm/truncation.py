"""Texts stored without their end: a backward character n-gram model.

For the final context of a text (its last characters, read backwards, numbers
reduced to one digit) the model compares how often that context ends a text with
how often a text goes on after it:

    p = (ends of other texts + w * p of the next shorter context) / (those + continuations + w)

and the score is the log-odds of p for the longest context (orders 4, 8, 12). Contexts
are counted per language and column. Every text is scored, and those whose score lies
below the threshold of their language and column are cut: the emptiest place between
the two groups of scores. A text that ends with a notice that more followed, half a
character or a thought that is never closed has been marked as cut and needs no score.
The exact check behind the model only takes back: a text that ends with the mark of a
sentence, braces and dollars in pairs, is finished although its last words are rare.

Counting covers every position of every text. Only contexts that end some text can
be asked for, so a bit set of their hashes, sized by their number, lets the tasks drop
other positions before the shuffle; it never loses a context.

Defined results: null and blank texts are finished; a repeated line counts once in
the model (contexts are counted over distinct texts) and comes out as often as it
stands; extra columns are not read; empty tables give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.endings import BROKEN, body, ends_sentence, has_notice, is_open
from marginalia.operators.bitset import collect_bits, size_for
from marginalia.session import ship, spread

#: Lengths of the contexts, each a multiple of the first.
ORDERS = (4, 8, 12)
#: The odds of a shorter context count like so many texts with the longer one.
SHORTER = 2.0
#: The bit set has BITS_EACH bits for each context, and at most 2 to the power of MOST_BITS (32 MB); beyond that it drops less, and loses nothing.
BITS_EACH, MOST_BITS = 24, 28
#: The threshold is sought in this range of log-odds; the histogram of all languages counts for a language like so many texts of its own.
LOWEST, HIGHEST, PRIOR = -5.0, -1.0, 50
#: Python state of a counting task is merged whenever it holds so many hits.
FLUSH = 1_500_000

_DIGITS = re.compile("[0-9]+")
_HAN, _CYRILLIC = re.compile("[一-鿿]"), re.compile("[Ѐ-ӿ]{3}")
# Common words of the languages told apart.
_COMMON = {
    "en": (" the ", " and ", " that ", " of ", " is ", " we ", " to "),
    "de": (" der ", " die ", " das ", " und ", " wir ", " ist ", " wird ", " durch "),
    "fr": (" le ", " la ", " les ", " et ", " est ", " une ", " dans ", " par "),
    "es": (" el ", " los ", " las ", " y ", " es ", " que ", " por ", " una ", " para "),
}


def language(t: str) -> str:
    """A coarse language of a text: by script, then by its commonest words; English in doubt."""
    if not t.isascii():
        if _HAN.search(t):
            return "zh"
        if _CYRILLIC.search(t):
            return "ru"
    best, most = "en", sum(map(t.count, _COMMON["en"]))
    if most * 40 > len(t):
        return best
    for k in ("de", "fr", "es"):
        n = sum(map(t.count, _COMMON[k]))
        if n > most:
            best, most = k, n
    return best


def texts_of(outputs: DataFrame) -> DataFrame:
    """line_no, raw, other: meta.raw as other, where it differs."""
    raw, meta = F.col("raw"), F.col("meta.raw")
    return outputs.select("line_no", "raw", F.when(~raw.eqNullSafe(meta), meta).alias("other")).where("raw is not null or other is not null")


def _bodies(b: pd.DataFrame) -> Iterator[tuple[int, str, str]]:
    """(line_no, column, body) of the texts of a batch that are not blank."""
    for line, raw, other in zip(b["line_no"], b["raw"], b["other"]):
        if raw is not None and (t := body(raw)):
            yield line, "raw", t
        if other is not None and (t := body(other)):
            yield line, "meta_raw", t


_PAD = "\x01" * ORDERS[-1]


def _reduced(t: str) -> tuple[int, str]:
    """A hash of the body with numbers reduced, and that body."""
    s = _DIGITS.sub("0", t)
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), s


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text: language, final context, a hash of the body, whether it is marked as cut, whether it ends as a sentence does."""
    for b in batches:
        rows = []
        for line, col, t in _bodies(b):
            h, s = _reduced(t)
            rows.append((line, col, language(t), (_PAD + s[-ORDERS[-1] :])[-ORDERS[-1] :], h, t.endswith(BROKEN) or has_notice(t) or is_open(t), ends_sentence(t)))
        yield pd.DataFrame(rows, columns=["line_no", "col", "lang", "tail", "h", "sure", "closed"])


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Language, column, hash and body (numbers reduced) of each text, as `_marks` tells them."""
    for b in batches:
        rows = [(language(t), col, *_reduced(t)) for _, col, t in _bodies(b)]
        if rows:
            yield pd.DataFrame(rows, columns=["lang", "col", "h", "s"])


_M = np.uint64(0x9E3779B97F4A7C15)
_X = np.uint64(0xBF58476D1CE4E5B9)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M) ^ (b + (a >> np.uint64(7)))
    x *= _X
    return x ^ (x >> np.uint64(31))


def _hashes(code: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the context that ends at each place (in the first places: of none)."""
    unit = ORDERS[0]
    h = code.astype(np.uint64) + np.uint64(1)
    base = h.copy()
    for k in range(1, unit):
        nxt = np.zeros_like(base)
        nxt[k:] = h[:-k]
        base = _mix(base, nxt)
    out, acc = [base], base
    for n in range(1, len(ORDERS)):
        far = np.zeros_like(base)
        far[n * unit :] = base[: -n * unit]
        acc = _mix(acc, far)
        out.append(acc)
    return out


def _bits(h: np.ndarray, order: int, size: int) -> np.ndarray:
    return ((h ^ np.uint64(order * 0x5BD1E995)) & np.uint64(size - 1)).astype(np.int64)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hashes of each distinct tail, one row per order."""
    for b in batches:
        if not len(b):
            continue
        code = np.frombuffer("".join(b["tail"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        last = np.arange(1, len(b) + 1) * ORDERS[-1] - 1
        hs = _hashes(code)
        for o, h in zip(ORDERS, hs):
            yield pd.DataFrame({"lang": b["lang"], "col": b["col"], "tail": b["tail"], "n_end": b["n_end"], "ord": np.full(len(b), o, np.int32), "h": h[last].view(np.int64), "bit": _bits(h[last], o, 1 << MOST_BITS)})


def _counter(words: np.ndarray):
    """Counts the continuations of contexts in the bit set, over one task."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inv = np.unique(keys, return_inverse=True)
        return u, np.bincount(inv, weights=n).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pd.DataFrame]:
            for (lang, col, o), parts in held.items():
                u, n = merge(parts)
                yield pd.DataFrame({"lang": lang, "col": col, "ord": np.full(len(u), o, np.int32), "h": u.view(np.int64), "n": n})

        for b in batches:
            groups: dict[tuple[str, str], list[str]] = {}
            for lang, col, t in zip(b["lang"], b["col"], b["s"]):
                groups.setdefault((lang, col), []).append(t)
            for (lang, col), texts in groups.items():
                lens = np.array([len(t) for t in texts])
                code = np.frombuffer((_PAD + _PAD.join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                ends = np.cumsum(lens + len(_PAD)) - 1
                on = code != 1
                on[ends] = False
                for o, h in zip(ORDERS, _hashes(code)):
                    bit = _bits(h, o, 64 * len(words))
                    hit = on & ((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                    u, n = np.unique(h[hit], return_counts=True)
                    held.setdefault((lang, col, o), []).append((u, n))
                    size += len(u)
            if size > FLUSH:
                held = {k: [merge(p)] for k, p in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > FLUSH // 2:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return count


def scores(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """For each language, column and tail: score, the log-odds of the end against continuation."""
    tails = marks.groupBy("lang", "col", "tail").agg(F.count_distinct("h").alias("n_end"))
    ctx = tails.mapInPandas(_contexts, "lang string, col string, tail string, n_end long, ord int, h long, bit long").persist()
    size = size_for(ctx.count(), BITS_EACH, MOST_BITS)
    words = collect_bits(ctx, F.col("bit") % size, size)
    once = texts.mapInPandas(_distinct, "lang string, col string, h long, s string").dropDuplicates(["lang", "col", "h"]).select("lang", "col", "s")
    go_on = once.mapInPandas(_counter(words), "lang string, col string, ord int, h long, n long").groupBy("lang", "col", "ord", "h").agg(F.sum("n").alias("n_go"))
    ends = ctx.groupBy("lang", "col", "ord", "h").agg(F.sum("n_end").alias("n_all"))
    known = ends.join(go_on, ["lang", "col", "ord", "h"], "left").select("lang", "col", "ord", "h", "n_all", F.coalesce("n_go", F.lit(0)).alias("n_go"))
    at = lambda c, o: F.max(F.when(F.col("ord") == o, F.col(c)))
    counts = ctx.join(known, ["lang", "col", "ord", "h"]).groupBy("lang", "col", "tail").agg(*(at(c, o).alias(f"{c}{o}") for o in ORDERS for c in ("n_all", "n_go")))
    p = F.lit(0.5)
    for o, weight in zip(ORDERS, (1.0, *[SHORTER] * (len(ORDERS) - 1))):
        others, go = F.col(f"n_all{o}") - 1, F.col(f"n_go{o}")
        p = (others + weight * p) / (others + go + weight)
    return counts.select("lang", "col", "tail", (F.log(p) - F.log1p(-p)).alias("score"))


def thresholds(scored: DataFrame) -> dict[tuple[str, str], float]:
    """For each language and column the middle of the emptiest place of its histogram of scores, to which that of all languages is added in small."""
    step, width = 0.25, 3
    cells = scored.groupBy("lang", "col", F.floor(F.col("score") / step).alias("cell")).agg(F.sum("n").alias("n"))
    own: dict[tuple[str, str], dict[int, int]] = {}
    every: dict[str, dict[int, int]] = {}
    for r in cells.collect():  # languages x columns x some hundred cells
        for h in (own.setdefault((r["lang"], r["col"]), {}), every.setdefault(r["col"], {})):
            h[r["cell"]] = h.get(r["cell"], 0) + r["n"]
    out = {}
    for (lang, col), h in own.items():
        share = PRIOR / sum(every[col].values())
        load = lambda c: sum(h.get(k, 0) + share * every[col].get(k, 0) for k in range(c - width, c + width + 1))  # noqa: B023, E731
        places = range(int(LOWEST / step), int(HIGHEST / step))
        out[lang, col] = (min((round(load(c), 6), abs(c + 0.5 - (LOWEST + HIGHEST) / 2 / step), c) for c in places)[2] + 0.5) * step
    return out


def cut_texts(outputs: DataFrame) -> DataFrame:
    """line_no, col, lang, score, cut for each text of raw and meta.raw (where it differs)."""
    ship(outputs.sparkSession)
    texts = spread(texts_of(outputs))
    marks = texts.mapInPandas(_marks, "line_no long, col string, lang string, tail string, h long, sure boolean, closed boolean").persist()
    marked = marks.select("line_no", "col", "lang", "tail", "sure", "closed").join(scores(texts, marks), ["lang", "col", "tail"], "left").persist()
    limit = thresholds(marked.where("not sure").groupBy("lang", "col", "score").agg(F.count("*").alias("n")))
    bound = F.lit(None).cast("double")
    for (k, c), v in limit.items():
        bound = F.when((F.col("lang") == k) & (F.col("col") == c), v).otherwise(bound)
    cut = F.col("sure") | (F.coalesce(F.col("score") < bound, F.lit(False)) & ~F.col("closed"))
    return marked.select("line_no", "col", "lang", "score", cut.alias("cut"))


def cut_lines(outputs: DataFrame) -> DataFrame:
    return cut_texts(outputs).where("cut").select("line_no").distinct()


def cut_share(outputs: DataFrame) -> DataFrame:
    """Per run: lines, lines cut and their share."""
    hit = cut_lines(outputs).withColumn("hit", F.lit(1))
    return (
        outputs.select("line_no", "run_stem")
        .join(hit, "line_no", "left")
        .groupBy("run_stem")
        .agg(F.count("*").alias("n_lines"), F.count("hit").alias("n_cut"))
        .withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_lines"), 6))
    )
