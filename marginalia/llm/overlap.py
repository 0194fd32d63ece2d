"""The same or almost the same exercise in train and evaluation data.

Evaluation texts are cut into passages of folded words (PASSAGE words; PLAIN words
where a text has no quantity to tell it from others). The passages are sharded by their
heaviest word (a number, else the longest), so that neighbouring passages mostly stay
together: a stretch of a text goes to the shard of its passages, and every part of a
training text is scanned once, whatever the number of shards. A shard's Aho-Corasick
automaton over its evaluation passages scans the training stretches; matched intervals
of all shards are merged into the coverage of each evaluation record, and records
covered enough are compared word by word (an exact check). A hit counts only between
texts of the same quantities, which that check demands.

Only passages that stand on both sides in texts of the same quantities are sent to
shards: a bit set of the evaluation side's hashed passages (with their quantities) thins
the training side, and one of what is left thins the evaluation side. Both are sized by
the number of passages and lose none. Shards that many training stretches reach are
split: their evaluation side is repeated, their training side is spread. Exact copies
are one class: only one text of a class is scanned, and membership is joined back at
the end.

Defined results: null, blank and wordless questions have no partner; repeated
questions come out each with its own id; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.bitset import collect_bits, size_for
from marginalia.session import ship, spread

#: Words of a passage: three in texts with quantities (misspellings break longer ones), five in those without.
PASSAGE, PLAIN = 3, 5
#: Coverage of an evaluation record from which it is compared word by word.
COVERED = 0.2
#: Share of the shorter text's words that must stand in the longer one in order, and of the longer one's (a remark may be added).
SAME, EXTRA = 0.72, 0.45
#: A short exercise that stands whole in the other text may have this many words of remarks beside it.
WHOLE, REMARK = 0.9, 16
#: Evaluation passages of one automaton, about, and training passages that one task scans.
EVAL_SHARD, TRAIN_SHARD = 60_000, 400_000
#: A bit set has BITS_EACH bits for each passage, at most 2 to the power of MOST_BITS (32 MB); beyond that it drops less.
BITS_EACH, MOST_BITS = 16, 28
#: Up to so many pairs of classes (two hashes and some places each, a few MB) are broadcast to find their texts.
FEW_PAIRS = 50_000


def questions_of(public: DataFrame, private: DataFrame) -> DataFrame:
    """id, split (train or holdout or private), source, question of both tables."""
    a = public.select("id", F.coalesce("split", F.lit("unknown")).alias("split"), "source", "question")
    return a.unionByName(private.select("id", F.lit("private").alias("split"), "source", "question"))


# What numbers an exercise or states its worth; such a number is no quantity of it.
LABELS = frozenset("task problem question exercise example item no nr q ex aufgabe frage ejercicio pregunta problema exercice probleme задача вопрос упражнение".split())
WORTH = frozenset("point points mark marks pt pts punkt punkte punkten puntos points балл балла баллов 分".split())
_ENUMERATED = re.compile(r"^\W{0,4}\d{1,3}\s*[.)．）]\s")


#: A remark in brackets at either end that holds a word and a number ("(contest round 6)", "[5 points]").
_HEAD, _END = re.compile(r"^[\s*#>]*[(\[（][^()\[\]（）$\\]{1,40}[)\]）]"), re.compile(r"[(\[（][^()\[\]（）$\\]{1,40}[)\]）]\W*$")
_NUMBERED = re.compile(r"[^\W\d_]{3,}\W*\d|\d\W*[^\W\d_]{3,}")


@cache
def _folded() -> tuple[frozenset[str], frozenset[str]]:
    from marginalia.llm.wordfold import words

    return frozenset(w for x in LABELS for w in words(x)), frozenset(w for x in WORTH for w in words(x))


def exercise_words(text: str) -> list[str]:
    """The folded words of an exercise without its label and worth."""
    from marginalia.llm.wordfold import alike, words

    labels, worth = _folded()
    for p in (_HEAD, _END):
        if (m := p.search(text)) and _NUMBERED.search(m[0]):
            text = text[: m.start()] + text[m.end() :]
    ws = words(text)
    if len(ws) > 2 and ws[1][0].isdigit() and (ws[0] in labels or len(ws[0]) > 4 and any(alike(ws[0], x) for x in labels if len(x) > 4)):
        ws = ws[2:]
    elif len(ws) > 2 and ws[0][0].isdigit() and _ENUMERATED.match(text):
        ws = ws[1:]
    for at in (0, len(ws) - 2):
        if len(ws) > 4 and ws[at][0].isdigit() and ws[at + 1] in worth:
            ws = ws[:at] + ws[at + 2 :]
            break
    return ws


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from marginalia.llm.wordfold import quantities

    for b in batches:
        ws = [exercise_words(t) for t in b["question"]]
        keys = [" ".join(quantities(w)) for w in ws]
        yield pd.DataFrame({"id": b["id"], "train": b["train"], "folded": [" ".join(w) for w in ws], "key": keys, "n": [_count(len(w), _size(k)) for w, k in zip(ws, keys)]})


def similar(a: list[str], b: list[str]) -> tuple[float, float]:
    """Shares of the shorter and of the longer text's words that have a partner in order (misspellings count as partners)."""
    from difflib import SequenceMatcher

    from marginalia.llm.wordfold import alike

    m = SequenceMatcher(None, a, b, autojunk=False)
    n = sum(x.size for x in m.get_matching_blocks())
    for tag, i1, i2, j1, j2 in m.get_opcodes():
        if tag == "replace":
            j = j1
            for u in a[i1:i2]:
                k = next((k for k in range(j, j2) if alike(u, b[k])), None)
                if k is not None:
                    n, j = n + 1, k + 1
    return n / min(len(a), len(b)), n / max(len(a), len(b))


def same_quantities(a: list[str], b: list[str]) -> bool:
    """Every number of either text stands in the other, in order; small ones may be written as words there."""
    from marginalia.llm.wordfold import _UNITS, digits

    def within(xs: list[str], ws: list[str]) -> bool:
        it = iter(str(_UNITS[w]) if w in _UNITS else w for w in ws if w[0].isdigit() or w in _UNITS)
        return all(any(x == y for y in it) for x in xs)

    return within(digits(a), b) and within(digits(b), a)


def same_exercise(a: list[str], b: list[str]) -> bool:
    if a == b:
        return True
    short, long = similar(a, b)
    added = abs(len(a) - len(b))
    return short >= SAME and (long >= EXTRA or short >= WHOLE and added <= REMARK) and same_quantities(a, b)


def _size(key: str) -> int:
    return PASSAGE if key else PLAIN


def _count(words: int, size: int) -> int:
    """Passages of a text of so many words; a text shorter than a passage is one."""
    return max(1, words - size + 1) if words else 0


@lru_cache(maxsize=200_000)
def _weight(word: str) -> int:
    """How heavy a word is: numbers before words, long ones before short ones; the low half is its hash."""
    return int(word[0].isdigit()) << 48 | min(len(word), 255) << 32 | zlib.crc32(word.encode("utf-8", "surrogatepass"))


_MIX, _LOW = np.uint64(1_000_003), np.uint64(0xFFFFFFFF)


def _passages(texts: list[list[str]], keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each passage of all texts its text and place, a hash of its words and the text's quantities, and the hash of its heaviest word."""
    lens = np.array([len(ws) for ws in texts], dtype=np.int64)
    sizes = np.minimum(np.array([_size(k) for k in keys], dtype=np.int64), lens)
    ranks = np.array([_weight(w) for ws in texts for w in ws], dtype=np.uint64)
    start = np.concatenate([[0], np.cumsum(lens)])[:-1]
    count = np.where(lens > 0, lens - sizes + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, size = start[row] + place, sizes[row]
    code = np.array([zlib.crc32(k.encode()) for k in keys], dtype=np.uint64)[row] if len(keys) else np.zeros(0, dtype=np.uint64)
    heaviest = np.zeros(len(row), dtype=np.uint64)
    for j in range(int(sizes.max()) if len(sizes) else 0):
        on = np.flatnonzero(size > j)
        r = ranks[at[on] + j]
        code[on] = (code[on] * _MIX + (r & _LOW)) & _LOW
        heaviest[on] = np.maximum(heaviest[on], r)
    return row, place, code, heaviest & _LOW


def _stretches(texts: list[list[str]], keys: list[str], shards: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, shard, first passage and number of passages of each run of passages of one shard; passages not in the bit set seen belong to none."""
    row, place, code, heaviest = _passages(texts, keys)
    if seen is not None:
        bit = code & np.uint64(64 * len(seen) - 1)
        on = (seen[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        row, place, heaviest = row[on], place[on], heaviest[on]
    shard = (heaviest % np.uint64(shards)).astype(np.int64)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (shard[1:] != shard[:-1])])[: len(row)]
    first = np.flatnonzero(new)
    return row[first], shard[first], place[first], np.diff(np.append(first, len(row)))


def _codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hashed passages of texts."""
    for b in batches:
        code = _passages([t.split() for t in b["folded"]], b["key"].tolist())[2]
        yield pd.DataFrame({"code": np.unique(code).astype(np.int64)})


def _routed(shards: int, shared):
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.frombuffer(shared.value, dtype="<u8")
        for b in batches:
            texts, keys = [t.split() for t in b["folded"]], b["key"].tolist()
            row, shard, first, n = _stretches(texts, keys, shards, seen)
            cut = [" ".join(texts[r][i : i + k - 1 + _size(keys[r])]) for r, i, k in zip(row.tolist(), first.tolist(), n.tolist())]
            if not len(row):
                continue
            of = lambda c: b[c].to_numpy()[row]  # noqa: B023, E731
            yield pd.DataFrame({"shard": shard, "h": of("h"), "train": of("train"), "key": of("key"), "first": first.astype(np.int32), "n": n.astype(np.int32), "folded": cut})

    return route


_ROUTED = "shard long, h string, train boolean, key string, first int, n int, folded string"


def _bits(texts: DataFrame, passages: int):
    """A bit set of the hashed passages of texts, sent to all tasks."""
    size = size_for(passages, BITS_EACH, MOST_BITS)
    words = collect_bits(texts.mapInPandas(_codes, "code long"), F.col("code") % size, size)
    return texts.sparkSession.sparkContext.broadcast(words.astype("<u8").tobytes())


def scan(shard: pd.DataFrame) -> pd.DataFrame:
    """h_train, h_eval, starts: the passages of evaluation texts that stand in training texts of the same quantities, in one shard."""
    import ahocorasick

    evals, trains = shard[~shard["train"]], shard[shard["train"]]
    found: dict[tuple[str, str], set[int]] = {}
    if len(evals) and len(trains):
        # passage: quantities: (evaluation text, place)
        owners: dict[str, dict[str, list[tuple[str, int]]]] = {}
        for h, key, first, text in zip(evals["h"], evals["key"], evals["first"], evals["folded"]):
            ws, size = text.split(), _size(key)
            for i in range(_count(len(ws), size)):
                owners.setdefault(f" {' '.join(ws[i : i + size])} ", {}).setdefault(key, []).append((h, first + i))
        auto = ahocorasick.Automaton()
        for p, o in owners.items():
            auto.add_word(p, o)
        auto.make_automaton()
        for h, key, text in zip(trains["h"], trains["key"], trains["folded"]):
            # a passage that stands again in a stretch says nothing new
            for o in {id(o): o for _, o in auto.iter(f" {text} ")}.values():
                for e, i in o.get(key, ()):
                    found.setdefault((h, e), set()).add(i)
    return pd.DataFrame([(t, e, sorted(s)) for (t, e), s in found.items()], columns=["h_train", "h_eval", "starts"])


def covered_words(starts: list[int], size: int, words: int) -> int:
    """Words of an evaluation text under the merged intervals of its matched passages."""
    covered = last = 0
    for i in sorted(starts):
        end = min(i + size, words)
        covered += max(0, end - max(i, last))
        last = max(last, end)
    return covered


def _same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = []
        for starts, t, e, key in zip(b["starts"], b["t"], b["e"], b["key"]):
            ws = e.split()
            keep.append(covered_words(set(starts), _size(key), len(ws)) >= COVERED * len(ws) and same_exercise(t.split(), ws))
        yield b.loc[keep, ["h_train", "h_eval"]]


def folded_classes(questions: DataFrame) -> DataFrame:
    """id, train, folded, key, n, h of the questions that have words; h names the class of exact copies."""
    ship(questions.sparkSession)
    q = questions.where("split is not null and trim(coalesce(question, '')) <> ''").select("id", (F.col("split") == "train").alias("train"), "question")
    return spread(q).mapInPandas(_fold, "id long, train boolean, folded string, key string, n long").where("folded <> ''").withColumn("h", F.md5("folded")).persist()


def class_pairs(folded: DataFrame) -> DataFrame:
    """h_train, h_eval of the classes that are the same exercise."""
    spark = folded.sparkSession
    sc = spark.sparkContext
    classes = folded.groupBy("h", "train").agg(*(F.first(c).alias(c) for c in ("folded", "key", "n"))).persist()
    ne, nt = classes.agg(F.coalesce(F.sum(F.when(~F.col("train"), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("train"), F.col("n"))), F.lit(0))).first()
    if not ne or not nt:
        return spark.createDataFrame([], "h_train string, h_eval string")
    shards = max(sc.defaultParallelism, -(-ne // EVAL_SHARD), -(-nt // TRAIN_SHARD))
    evals, trains = classes.where("not train"), classes.where("train")
    t_routed = trains.mapInPandas(_routed(shards, _bits(evals.select("folded", "key"), ne)), _ROUTED).persist()
    left = t_routed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    e_routed = evals.mapInPandas(_routed(shards, _bits(t_routed.select("folded", "key"), left)), _ROUTED)
    routed = t_routed.unionByName(e_routed)
    parts = t_routed.groupBy("shard").agg(F.ceil(F.sum("n") / TRAIN_SHARD).cast("int").alias("parts"))
    # shards without training stretches fall away; the others are split by the training side's size
    own = F.pmod(F.xxhash64("h"), F.col("parts"))
    split = F.when(F.col("train"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    both = routed.join(parts, "shard").withColumn("part", F.explode(split)).select("shard", "part", "h", "train", "key", "first", "folded")
    hits = both.groupBy("shard", "part").applyInPandas(scan, "h_train string, h_eval string, starts array<int>")
    merged = hits.groupBy("h_train", "h_eval").agg(F.flatten(F.collect_list("starts")).alias("starts")).persist()
    # few pairs go to the texts; many make the texts go to them
    small = F.broadcast if merged.count() <= FEW_PAIRS else lambda df: df
    t = trains.select(F.col("h").alias("h_train"), F.col("folded").alias("t")).join(small(merged), "h_train")
    e = evals.select(F.col("h").alias("h_eval"), F.col("folded").alias("e"), "key").join(small(merged.select("h_eval").distinct()), "h_eval")
    return t.join(e, "h_eval").select("h_train", "h_eval", "starts", "t", "e", "key").mapInPandas(_same, "h_train string, h_eval string")


def overlaps(questions: DataFrame) -> DataFrame:
    """questions: id, split, question. Gives id_train, id_eval for each pair of the same exercise."""
    folded = folded_classes(questions)
    t = folded.where("train").select(F.col("h").alias("h_train"), F.col("id").alias("id_train"))
    e = folded.where(~F.col("train")).select(F.col("h").alias("h_eval"), F.col("id").alias("id_eval"))
    return class_pairs(folded).join(t, "h_train").join(e, "h_eval").select("id_train", "id_eval")


def overlap_pairs(public: DataFrame, private: DataFrame) -> DataFrame:
    o = overlaps(questions_of(public, private))
    return o.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).distinct()


def overlap_counts(public: DataFrame, private: DataFrame) -> DataFrame:
    """Per evaluation split and source: its questions, those that stand in train, and their pairs, counted from the sizes of classes."""
    q = questions_of(public, private)
    folded = folded_classes(q)
    sizes = folded.where("train").groupBy(F.col("h").alias("h_train")).agg(F.count("*").alias("n"))
    met = class_pairs(folded).join(sizes, "h_train").groupBy(F.col("h_eval").alias("h")).agg(F.sum("n").alias("n"))
    hit = folded.where("not train").select("id", "h").join(met, "h").select("id", "n")
    return (
        q.where("split <> 'train'")
        .join(hit, "id", "left")
        .groupBy("split", F.coalesce("source", F.lit("(none)")).alias("source"))
        .agg(F.count("*").alias("n_questions"), F.count("n").alias("n_leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    )
