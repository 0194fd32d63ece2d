"""Defective pairs of prompt and response: clauses tagged by a conditional random field.

The judged answer is cut into clauses; a linear-chain conditional random field tags
each as answer, refusal, echo, foreign or unfinished. Its features are the clause's
words and last characters (hashed), and how it stands to its question and its text:
shared words, languages, open braces, place. The words covered by each tag, and the
tag of the last clause, decide the defect of the pair. Emptiness needs no model. The
exact check behind it only takes back: a closed text is not truncated, and a text that
speaks most in its question's language is not in another.

The field is fitted on the driver. Its labels don't come from its features: they are
planted into sound texts of a bounded sample (FIT_LINES lines with a box and as many
without, of at most FIT_LENGTH characters, those first by a hash of their number), which are cut at a random place,
given a question of another language, replaced by their question, or by one of a few
seed refusals. Texts of the sample that the field then finds refusing teach it their
other sentences in further rounds. The words by which languages show are counted over
all distinct questions and answers. All lines are tagged. Lines meet their question by
a shuffled join on its id, of the judged text only; a hot id is split by the engine's
skew handling.

Defined results: null and blank answers are `empty`; lines without a question are
left out; a blank question has no copies and no language; repeated lines come out
each; extra columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.boxed import balanced
from marginalia.llm.endings import body as end_of
from marginalia.llm.endings import BROKEN, has_notice, is_finished, is_open
from marginalia.session import ship

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
FIT_LINES, FIT_LENGTH, STEPS = 3_000, 4_000, 70
#: Rounds in which refusing texts teach the field, and the share of words under refusal that makes a text one.
ROUNDS, LEAD = 3, 0.4
#: Hashed words and endings.
BUCKETS = 1 << 13
#: Share of an answer's words under a tag from which it has that defect; a copy holds next to nothing else. A last clause of a closed text is an echo if so many of its words are the question's.
COVER, WHOLE, ECHOED = 0.5, 0.9, 0.8

# Answers that only hold the place of one.
PLACEHOLDERS = frozenset("n/a na none null nil nan - -- --- – — . .. ... … ? tbd todo empty [ans] [answer] <answer> ___ (none) (empty) no answer".split()) | {"no answer", "not available"}
# Words by which sentences of a language show.
FUNCTION_WORDS = {
    "en": "the and of is to that in it by be from with has we if let then so what how many find both between when each there are this was were were for on not no cannot can will would i am sorry answer final get gives therefore hence next now first because while which their its at as all show solve value result".split(),
    "de": "der die das und ist wird den mit wir eine ein von zu wie viele lautet somit daher damit nicht auch dem des sie es auf für im am zum zur noch nach beträgt danach zuerst alle wenn bleiben werden sind".split(),
    "fr": "le les des est une dans pour et du il la en par un que qui ce ainsi donc reste combien quelle quel on au aux à sont ensuite enfin avec cette puis".split(),
    "es": "el los las que por una para del se con la en es un y lo cuántos cuántas cada entre hay cuál queda quedan así después entonces primero también como al solución respuesta".split(),
}
_SHARED = {w: [k for k, v in FUNCTION_WORDS.items() if w in v] for v in FUNCTION_WORDS.values() for w in v}
# Refusals to begin with, in the commonest words of each language.
SEED_REFUSALS = [
    "I'm sorry, but I can't help with that.", "Sorry, I am not able to answer this.", "As an AI model, I cannot provide this.", "Unfortunately, I must decline.", "I apologize, but I will not do this for you.", "I would rather not do that.", "This is not something I can do for you.", "I am unable to assist with this request.", "I have to refuse.",
    "Es tut mir leid, aber dabei kann ich nicht helfen.", "Leider kann ich diese Frage nicht beantworten.", "Je suis désolé, mais je ne peux pas vous aider.", "Malheureusement, je ne peux pas répondre.", "Lo siento, pero no puedo ayudar con esto.", "No me es posible responder.", "Извините, но я не могу помочь с этим.", "К сожалению, я не могу ответить.", "抱歉，我无法回答这个问题。", "对不起，我不能提供帮助。",
]
# Notices that more followed, and half a character.
NOTICES = ["...", "…", " …", " [truncated]", " [more]", " (continued)", BROKEN, BROKEN]
_CLAUSE = re.compile(r"(?<=[.!?。！？;；])\s*(?=\S)|\n+")
_MATH = re.compile(r"\$[^$]*\$|\\\([^)]*\\\)|\\boxed\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\\[a-zA-Z]+|\d+")
_BOX_ONLY = r"^\s*\\boxed\{(?![\s\u200b-\u200d\u2060\ufeff\u00ad\u00a0]*\}\s*$)" + balanced(6) + r"\}\s*$"


def script_language(text: str) -> str:
    han = cyr = 0
    for c in text:
        if "一" <= c <= "鿿":
            han += 1
        elif "Ѐ" <= c <= "ӿ":
            cyr += 1
    if han >= 2 and han >= cyr:
        return "zh"
    return "ru" if cyr >= 3 else ""


@lru_cache(maxsize=1)
def _signs() -> dict[str, list[tuple[str, float]]]:
    """The languages that a function word shows, and how much."""
    return {w: [(ks[0], 1.0)] if len(ks) == 1 else [(k, 0.4) for k in ks] for w, ks in _SHARED.items()}


_LETTERS = re.compile(r"[^\W\d_]+")


def votes(text: str, learned: dict[str, str] | None = None) -> dict[str, float]:
    """How much each language shows in a text without its formulas: by script, function words, and learned words."""
    plain = _MATH.sub(" ", text) if "$" in text or "\\" in text else text
    s = "" if plain.isascii() else script_language(plain)
    out: dict[str, float] = {}
    if s:
        out[s] = len(plain) / 6 if s == "ru" else float(len(plain))
    signs = _signs()
    for w in _LETTERS.findall(plain.lower()):
        found = signs.get(w)
        if found is not None and len(found) == 1:
            k = found[0][0]
            out[k] = out.get(k, 0) + 1
        elif learned and (k := learned.get(w)):
            out[k] = out.get(k, 0) + 1
        elif found:
            for k, x in found:
                out[k] = out.get(k, 0) + x
    return out


#: Words learned as signs of a language: at most so many, seen so often, and so surely in one language.
LEARNED, SEEN, SURE = 20_000, 3, 0.95


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of a batch each word stands, by the language of the whole text as its function words tell it."""
    for b in batches:
        seen: Counter = Counter()
        for t in b["text"]:
            v = sorted(votes(t).items(), key=lambda x: -x[1])
            if v and v[0][0] not in ("zh", "ru") and v[0][1] >= 4 and (len(v) == 1 or v[0][1] >= 2 * v[1][1]):
                seen.update((w, v[0][0]) for w in set(_LETTERS.findall(_MATH.sub(" ", t).lower())) if len(w) > 1)
        if seen:
            yield pd.DataFrame([(w, k, n) for (w, k), n in seen.items()], columns=["word", "lang", "n"])


def learn_words(texts: DataFrame) -> dict[str, str]:
    """Words that stand in texts of one language only, counted over all distinct texts; at most LEARNED come to the driver."""
    counts = texts.where("text is not null").distinct().mapInPandas(_word_counts, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).persist()
    most = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.max("n").alias("n")).collect()}  # languages
    if not most:
        counts.unpersist()
        return {}
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k in sorted(most) for x in (k, float(most[k]))]), F.col("lang"))
    best = counts.withColumn("share", share).groupBy("word").agg(F.sum("share").alias("all"), F.max_by(F.struct("lang", "n", "share"), F.struct("share", "lang")).alias("b"))
    sure = best.where((F.col("b.n") >= SEEN) & (F.col("b.share") >= SURE * F.col("all")))
    out = {r["word"]: r["lang"] for r in sure.select("word", "b.lang", "b.n").orderBy(F.desc("n"), "word").limit(LEARNED).collect()}
    counts.unpersist()
    return out


def main_language(v: dict[str, float], least: float = 1.0) -> str:
    if not v:
        return ""
    k = max(sorted(v), key=v.__getitem__)
    return k if v[k] >= least else ""


N_FEATURES = 19
_WORD_CODES: dict[str, int] = {}


def _code(feature: str) -> int:
    c = _WORD_CODES.get(feature)
    if c is None:
        if len(_WORD_CODES) > 300_000:
            _WORD_CODES.clear()
        c = _WORD_CODES[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS
    return c


class Clauses:
    """The clauses of a text: dense features, hashed features of each, and numbers of words; votes of all for languages."""

    __slots__ = ("x", "codes", "sizes", "total")

    def __init__(self, x: np.ndarray, codes: list[list[int]], sizes: list[int], total: dict[str, float]):
        self.x, self.codes, self.sizes, self.total = x, codes, sizes, total

    def __len__(self) -> int:
        return len(self.x)


def clauses_of(text: str, q_words: frozenset[str], q_language: str, learned: dict[str, str] | None = None) -> Clauses:
    from marginalia.llm.wordfold import words

    text = end_of(text)
    kept = []
    for p in _CLAUSE.split(text):
        if p and p.strip():
            ws = words(p)
            if ws or "\\boxed" in p or BROKEN in p:
                kept.append((p, ws))
    n = len(kept)
    rows, codes, sizes, total = [], [], [], {}
    for k, (p, ws) in enumerate(kept):
        v = votes(p, learned)
        for lang, x in v.items():
            total[lang] = total.get(lang, 0.0) + x
        lang = main_language(v)
        shared = sum(w in q_words for w in ws) / len(ws) if ws and q_words else 0.0
        last = k == n - 1
        row = [
            1.0,
            shared,
            float(shared >= 0.7),
            float(shared >= 0.85),
            float(shared >= 0.99),
            float(bool(lang) and bool(q_language) and lang != q_language),
            float(bool(lang) and lang == q_language),
            float("\\boxed" in p),
            float(k == 0),
            float("=" in p or "$" in p),
            min(len(ws), 30) / 30,
            *([0.0] * 8),
        ]
        own = [_code("0" if w[0].isdigit() else w) for w in set(ws)]
        if last:
            tail = p.rstrip()
            c = tail[-1:]
            row[11] = 1.0
            row[12] = float(c in ".!?。！？…\"'”»")
            row[13] = float(c in "})]|$")
            row[14] = float(c.isalpha())
            row[15] = float(c.isdigit())
            row[16] = float(text.count("{") != text.count("}"))
            row[17] = float(text.count("$") % 2 == 1)
            row[18] = float(is_open(text) or has_notice(text))
            own += [_code("\x02" + (ws[-1] if ws else "")), _code("\x03" + re.sub(r"\d", "0", tail[-3:].lower()))]
        rows.append(row)
        codes.append(own)
        sizes.append(max(1, len(ws)))
    return Clauses(np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES), codes, sizes, total)


class _Padded:
    """Sequences of about the same length as padded arrays."""

    def __init__(self, seqs: list[Clauses], tags: list[np.ndarray] | None = None):
        n, longest = len(seqs), max(map(len, seqs))
        self.lens = np.array([len(s) for s in seqs])
        self.x = np.zeros((n, longest, N_FEATURES))
        self.on = np.arange(longest)[None, :] < self.lens[:, None]
        for i, s in enumerate(seqs):
            self.x[i, : len(s)] = s.x
        self.flat = np.array([c for s in seqs for cs in s.codes for c in cs], dtype=np.int64)
        self.row = np.repeat(np.flatnonzero(self.on.ravel()), [len(cs) for s in seqs for cs in s.codes])
        if tags is not None:
            self.gold = np.zeros((n, longest, len(TAGS)))
            self.gold[self.on, np.concatenate(tags)] = 1

    def emissions(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        n, longest, _ = self.x.shape
        e = (self.x @ w).reshape(-1, len(TAGS))
        if len(self.flat):
            for k in range(len(TAGS)):
                e[:, k] += np.bincount(self.row, weights=v[self.flat, k], minlength=n * longest)
        return e.reshape(n, longest, len(TAGS))


def _padded(seqs: list[Clauses], tags: list[np.ndarray] | None = None, size: int = 256):
    """Padded groups of sequences by length, and the indices of each."""
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
    for a in range(0, len(order), size):
        ids = order[a : a + size]
        yield ids, _Padded([seqs[i] for i in ids], [tags[i] for i in ids] if tags is not None else None)


class ClauseField:
    """A linear-chain conditional random field over clause features."""

    def __init__(self) -> None:
        k = len(TAGS)
        self.w, self.v, self.t = np.zeros((N_FEATURES, k)), np.zeros((BUCKETS, k)), np.zeros((k, k))

    def fit(self, seqs: list[Clauses], ys: list[np.ndarray], steps: int = STEPS, penalty: float = 1.0) -> "ClauseField":
        """Maximum likelihood with an L2 penalty, by Adam over all sequences."""
        k, n = len(TAGS), len(seqs)
        groups = [g for _, g in _padded(seqs, ys)]
        params = [self.w, self.v, self.t]
        m, r = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            grads = [-penalty * p for p in params]
            for g in groups:
                longest = g.x.shape[1]
                e = g.emissions(self.w, self.v)
                alpha, beta = np.empty_like(e), np.zeros_like(e)
                alpha[:, 0] = e[:, 0]
                for l in range(1, longest):
                    alpha[:, l] = np.where(g.on[:, l, None], _lse(alpha[:, l - 1, :, None] + self.t, 1) + e[:, l], alpha[:, l - 1])
                for l in range(longest - 2, -1, -1):
                    beta[:, l] = np.where(g.on[:, l + 1, None], _lse(self.t[None] + (e[:, l + 1] + beta[:, l + 1])[:, None, :], 2), 0.0)
                z = _lse(alpha[:, -1], 1)
                gap = (g.gold - np.exp(alpha + beta - z[:, None, None])) * g.on[:, :, None]
                for l in range(longest - 1):
                    both = g.on[:, l + 1]
                    p = np.exp(alpha[both, l, :, None] + self.t + (e[both, l + 1] + beta[both, l + 1])[:, None, :] - z[both, None, None])
                    grads[2] += np.einsum("ni,nj->ij", g.gold[both, l], g.gold[both, l + 1]) - p.sum(axis=0)
                grads[0] += np.einsum("nlf,nlk->fk", g.x, gap)
                flat = gap.reshape(-1, k)
                for c in range(k):
                    grads[1][:, c] += np.bincount(g.flat, weights=flat[g.row, c], minlength=BUCKETS)
            for q, (p, d) in enumerate(zip(params, grads)):
                d = d / n
                m[q] = 0.9 * m[q] + 0.1 * d
                r[q] = 0.99 * r[q] + 0.01 * d * d
                p += 0.15 * (m[q] / (1 - 0.9**step)) / (np.sqrt(r[q] / (1 - 0.99**step)) + 1e-6)
        return self

    def tag(self, seqs: list[Clauses]) -> list[np.ndarray]:
        """The best tags of many sequences at once (Viterbi over padded arrays, grouped by length)."""
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(seqs)
        for ids, g in _padded(seqs, size=512):
            e, lens, longest = g.emissions(self.w, self.v), g.lens, g.x.shape[1]
            score, back = e[:, 0], np.zeros((len(ids), longest, len(TAGS)), dtype=np.int8)
            for l in range(1, longest):
                c = score[:, :, None] + self.t
                back[:, l] = c.argmax(axis=1)
                score = np.where((l < lens)[:, None], c.max(axis=1) + e[:, l], score)
            at = score.argmax(axis=1)
            tags = np.zeros((len(ids), longest), dtype=int)
            for l in range(longest - 1, -1, -1):
                tags[:, l] = at
                at = np.where((l < lens) & (l > 0), back[np.arange(len(ids)), l, at], at)
            for r, i in enumerate(ids):
                out[i] = tags[r, : lens[r]]
        return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis=axis)) + m.squeeze(axis)


def _question_side(question: str | None, options, learned: dict[str, str] | None = None) -> tuple[frozenset[str], str, list[str]]:
    from marginalia.llm.unify import unified
    from marginalia.llm.wordfold import words

    text = unified(question or "")
    ws = words(text)
    extra = {"question", "options"}
    for i, o in enumerate(options if options is not None else ()):
        extra |= {chr(97 + i % 26), *words(o or "")}
    return frozenset(ws) | extra if ws else frozenset(), main_language(votes(text, learned), 0.4), ws


def visible(text: str) -> str:
    """What stands behind the thoughts; the thoughts too where nothing but a formula stands behind them."""
    if "</think>" not in text:
        return text
    shown = text.rsplit("</think>", 1)[-1]
    return shown if re.search(r"[^\W\d_]{2}", _MATH.sub(" ", end_of(shown))) or not shown.strip() else text


def is_empty(text: str | None) -> bool:
    """Null, blank, a placeholder, or an empty box as the answer."""
    if text is None:
        return True
    t = visible(end_of(text)).strip("​‌‍⁠﻿­ \t\r\n\u00a0")
    if not t or t.lower().strip(" .!") in PLACEHOLDERS or t.lower() in PLACEHOLDERS:
        return True
    boxes = re.findall(r"\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}", t)
    return bool(boxes) and not boxes[-1].strip("​‌‍⁠﻿­ \t\r\n\u00a0")


def decide(text: str, c: Clauses, tags: np.ndarray, q_words: frozenset[str], q_language: str) -> str | None:
    """The defect of a pair that is not empty, by the words each tag covers, and the tag of the last clause. The exact check only takes back: an answer in a box is no refusal and no copy, a closed text is not truncated, and a text that speaks most in the question's language is not in another."""
    closed = is_finished(end_of(text))
    if not len(c):  # no clause to tag: symbols only
        return None if closed else "truncated"
    if tags[-1] == UNFINISHED and closed:
        tags = tags.copy()
        tags[-1] = ECHO if c.x[-1, 1] >= ECHOED else ANSWER
    cover = np.bincount(tags, weights=c.sizes, minlength=len(TAGS))
    total = cover.sum()
    solved = bool((c.x[:, 7] > 0).any())
    rest = total - cover[ECHO]
    if cover[REFUSAL] and not solved and cover[REFUSAL] >= COVER * max(1.0, rest):
        return "refusal"
    if q_words and not solved and cover[ECHO] >= WHOLE * total:
        return "copy"
    if tags[-1] == UNFINISHED:
        return "truncated"
    if cover[FOREIGN] and cover[FOREIGN] >= COVER * max(1.0, rest - cover[UNFINISHED]):
        mostly = main_language(c.total)
        if q_language and mostly and mostly != q_language and c.total[mostly] > c.total.get(q_language, 0.0):
            return "other_language"
    return None


def _cut(text: str, rng: random.Random) -> str | None:
    """The text cut at a random place (each fourth in its box) where it is not finished, at times with a notice."""
    for _ in range(8):
        first = text.rfind("\\boxed") + 1 if rng.random() < 0.25 else min(12, len(text) - 1)
        t = text[: rng.randrange(first, len(text))].rstrip() if len(text) > 13 else ""
        if rng.random() < 0.15:
            t += rng.choice(NOTICES)
        if t and not is_finished(t):
            return t
    return None


def _copied(question: str, options, rng: random.Random) -> str:
    t = rng.choice(["", "", "Question: ", "Problem: "]) + question
    if options is not None and len(options) and rng.random() < 0.5:
        t += "\n" + "\n".join(f"({chr(65 + i % 26)}) {o}" for i, o in enumerate(options))
    return rng.choice([t, t, t.lower(), t + "\n\n" + question])


def planted(rows, learned: dict[str, str]) -> tuple[list[Clauses], list[np.ndarray]]:
    """Sequences with labels, planted into the sound ones of rows: (question, options, text)."""
    from marginalia.llm.unify import unified

    rng = random.Random(7)
    sound = []
    for q, o, t in rows:
        if q and t and not is_empty(t):
            t = end_of(visible(unified(t)))
            if is_finished(t) and "\\boxed" in t:
                side = _question_side(q, o, learned)
                sound.append((q, o, t, side, main_language(votes(t, learned))))
    asked: dict[str, list] = {}
    for _, _, _, side, _ in sound:
        if side[1]:
            asked.setdefault(side[1], []).append(side)
    seqs, ys = [], []

    def put(text: str, side, label) -> None:
        c = clauses_of(text, side[0], side[1], learned)
        if len(c):
            seqs.append(c)
            ys.append(label(c))

    def answered(c: Clauses) -> np.ndarray:
        y = np.full(len(c), ANSWER)
        return y

    def last(c: Clauses) -> np.ndarray:
        y = answered(c)
        y[-1] = UNFINISHED
        return y

    def spoken(c: Clauses) -> np.ndarray:
        y = np.full(len(c), FOREIGN)
        y[[i for i, n in enumerate(c.sizes) if n < 2]] = ANSWER
        return y

    every = lambda tag: lambda c: np.full(len(c), tag)
    for q, o, t, side, lang in sound:
        if lang and side[1] and lang != side[1]:
            continue  # it may be in another language than its question
        r = rng.randrange(10)
        if r < 3:
            put(t, side, answered)
        elif r == 3:
            echo = len(clauses_of(q, side[0], side[1], learned))
            put(q + "\n" + t, side, lambda c: np.array([ECHO] * min(echo, len(c)) + [ANSWER] * max(0, len(c) - echo)))
        elif r < 6:
            if cut := _cut(t, rng):
                put(cut, side, last)
        elif r in (6, 9):
            put(_copied(q, o, rng), side, every(ECHO))
        elif r == 7:
            others = [k for k in sorted(asked) if k != lang]
            if lang and others:
                put(t, rng.choice(asked[rng.choice(others)]), spoken)
        else:
            put(" ".join(rng.sample(SEED_REFUSALS[:9], rng.choice([1, 1, 2]))), side, every(REFUSAL))
    sides = [s[3] for s in sound] or [_question_side("How many are left for the old school?", None, learned)]
    for t in SEED_REFUSALS * 2:
        put(t, rng.choice(sides), every(REFUSAL))
    return seqs, ys


def fit_field(rows, learned: dict[str, str]) -> ClauseField:
    """rows: (question, options, text). Fits on planted labels, then again, in rounds, with the texts of the sample that refuse and solve nothing."""
    from marginalia.llm.unify import unified

    seqs, ys = planted(rows, learned)
    field = ClauseField().fit(seqs, ys)
    open_ = []
    for q, o, t in rows:
        if q and t and "\\boxed" not in t and not is_empty(t):
            side = _question_side(q, o, learned)
            c = clauses_of(visible(unified(t)), side[0], side[1], learned)
            if len(c):
                open_.append(c)
    for _ in range(ROUNDS):
        covers = (np.bincount(tags, weights=c.sizes, minlength=len(TAGS)) for c, tags in zip(open_, field.tag(open_)))
        more = [c for c, cover in zip(open_, covers) if cover[REFUSAL] >= LEAD * cover.sum()]
        if not more:
            break
        field.fit(seqs + more, ys + [np.full(len(c), REFUSAL) for c in more], steps=STEPS // 2)
    return field


def judged(outputs: DataFrame) -> DataFrame:
    """line_no, id, text, sound: the answer judged of each line; sound where the raw text that should be judged is null."""
    only = F.coalesce(F.col("response").rlike(_BOX_ONLY), F.lit(False))
    return outputs.select("line_no", "id", F.when(only, F.col("raw")).otherwise(F.col("response")).alias("text"), (only & F.col("raw").isNull()).alias("sound"))


def pair_defects(questions: DataFrame, outputs: DataFrame) -> DataFrame:
    """questions: id, question, options. Gives line_no, defect for each defective pair."""
    spark = outputs.sparkSession
    ship(spark)
    j = judged(outputs)
    q = questions.where("id is not null").groupBy("id").agg(F.min_by("question", F.struct(F.col("question").isNull(), "question")).alias("question"), F.min_by("options", F.struct(F.col("options").isNull(), F.size("options"))).alias("options"))
    short = j.where(f"not sound and length(text) <= {FIT_LENGTH}")
    first = lambda d: d.orderBy(F.xxhash64("line_no"), "line_no").limit(FIT_LINES)
    box = F.col("text").contains("\\boxed")
    some = first(short.where(box)).unionByName(first(short.where(~box)))
    sample = [(r["question"], r["options"], r["text"]) for r in some.join(q.where(f"length(question) <= {FIT_LENGTH}"), "id").select("line_no", "question", "options", "text").orderBy("line_no").collect()]
    learned = learn_words(j.where("not sound").select("text").union(questions.select("question")))
    field = spark.sparkContext.broadcast((fit_field(sample, learned), learned))

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from marginalia.llm.unify import unified

        f, learned = field.value
        for b in batches:
            found: list[tuple[int, str]] = []
            held = []
            sides: dict = {}
            for line, i, text, question, options in zip(b["line_no"], b["id"], b["text"], b["question"], b["options"]):
                if is_empty(text):
                    found.append((line, "empty"))
                    continue
                text = unified(text)
                side = sides.get(i)
                if side is None:
                    side = sides[i] = _question_side(question, options, learned)
                held.append((line, text, clauses_of(visible(text), side[0], side[1], learned), side[0], side[1]))
            for (line, text, c, qw, ql), tags in zip(held, f.tag([h[2] for h in held])):
                d = decide(text, c, tags, qw, ql)
                if d:
                    found.append((line, d))
            yield pd.DataFrame(found, columns=["line_no", "defect"])

    pairs = j.where("not sound").drop("sound").join(q, "id").select("line_no", "id", "text", "question", "options")
    return pairs.mapInPandas(tag, "line_no long, defect string")


def questions_of(public: DataFrame, private: DataFrame) -> DataFrame:
    return public.select("id", "question", "options").unionByName(private.select("id", "question", "options"))


def defect_counts(questions: DataFrame, outputs: DataFrame) -> DataFrame:
    """Lines per run and defect."""
    return pair_defects(questions, outputs).join(outputs.select("line_no", "run_stem"), "line_no").groupBy("run_stem", "defect").agg(F.count("*").alias("n_lines"))
