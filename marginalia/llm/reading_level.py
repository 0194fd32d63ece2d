"""Reading level of documents: regularised ordinal regression over text features.

Features of a document: word rarity in the whole corpus, lengths of words and segments,
connectives, and a proxy of clause depth (subordinators per word), each as mean and
quartiles over the segments; shares of words by length, by rarity, and by the connective
they are; lexical diversity; and one bounded rarity against graded text (how far a word
stands in demanding rather than in easy graded documents). A proportional-odds model
with an L2 penalty, fitted on the driver from a bounded sample of labelled documents,
weighs them; the rarity against graded text is cross-fitted, so that the regression
sees honest values.

Segments that stand in the held-out items (half of their word triples) carry no
weight, unless the whole text is made of them, and quartiles bear a few odd segments:
an exercise put into a text doesn't change its band.

Corpus counts cover all documents. Words are hashed to BUCKETS, so what goes to the
tasks has a fixed size. Texts are read by one pattern; all else is arithmetic on
arrays of a batch.

Defined results: null, blank and wordless texts and texts in other languages have no
band; repeated documents come out each; a document of two bands counts half for
each; without labels nothing comes out; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import ship, spread

BANDS = ("primary", "secondary", "university")
#: The regression is fitted on at most so many labelled documents, those first by a hash of their id.
LABELLED = 6_000
#: Hashed words: two tables of 64-bit numbers, 1 MB each.
BUCKETS = 1 << 17
#: A stretch without a mark is cut into segments of at most so many words; a word is new if it didn't stand among so many before it.
SEGMENT, RECENT = 24, 40
#: Share of a segment's word triples that stand in held-out items from which it counts as an exercise.
EXERCISE = 0.5
FOLDS, PENALTY, ROUNDS = 5, 15.0, 300
#: A worker forgets its words beyond so many (they are looked up anew; results don't change).
REMEMBERED = 400_000

# Words that join or subordinate clauses.
CONNECTIVES = frozenset("because since although therefore hence thus however whenever provided unless whereas while consequently moreover furthermore notwithstanding whose which that if when so then but or as than".split())
SUBORDINATORS = frozenset("which that whose whenever unless although provided where because since if when while whereas notwithstanding".split())
_LANGUAGES = {
    "en": "the and of is to that are in it by be from with has",
    "de": "der die das und ist wird den mit wir ein eine von zu",
    "fr": "le les des est une dans pour et du on il la en",
    "es": "el los las que por una para del se con la es en",
}
_SETS = [frozenset(v.split()) for v in _LANGUAGES.values()]
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[.!?;:]+(?=\s|$)|[。！？；\n]+")
_FOREIGN = re.compile("[Ѐ-ӿ一-鿿]")
#: Columns of a word's properties.
LETTERS, WORD, LONG, JOINS, SUBORDINATES, EN, DE, FR, ES, FOREIGN, JOIN = range(11)
_JOIN = {w: k for k, w in enumerate(sorted(CONNECTIVES | SUBORDINATORS), 1)}
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Properties of words, kept between the batches of a worker. Word 0 is a break."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"\n": 0, "0": 1}
        self._rows, self._codes = [[0.0] * 11, [0.0] * 11], [0, zlib.crc32(b"0")]
        self._seen = 0

    def _add(self, t: str) -> int:
        if t[0].isdigit():
            k = 1
        elif not t[0].isalpha():
            k = 0
        else:
            k = len(self._rows)
            self._rows.append([len(t), 1.0, len(t) > 8, t in CONNECTIVES, t in SUBORDINATORS, *(t in v for v in _SETS), bool(_FOREIGN.search(t)), _JOIN.get(t, 0)])
            self._codes.append(zlib.crc32(t.encode("utf-8", "surrogatepass")))
        self.index[t] = k
        return k

    def encode(self, texts: list[str]) -> "Encoded":
        if len(self.index) > REMEMBERED:
            self.clear()
        get, add = self.index.get, self._add
        parts, lens = [], []
        for t in texts:
            ids = [k if (k := get(w)) is not None else add(w) for w in _TOKEN.findall(t.lower())]
            ids.append(0)
            parts += ids
            lens.append(len(ids))
        if self._seen != len(self._rows):
            self.rows, self.codes, self._seen = np.array(self._rows, dtype=np.float64).T.copy(), np.array(self._codes, dtype=np.uint64), len(self._rows)
        return Encoded(np.array(parts, dtype=np.int64), np.array(lens, dtype=np.int64), self)


class Encoded:
    """The words of many documents in segments: flat arrays (props by column), and the place of each segment and document in them."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, words: Words):
        self.n_docs = len(lens)
        doc = np.repeat(np.arange(len(lens)), lens)
        seg = np.cumsum(ids == 0) - (ids == 0)
        on = ids > 0
        ids, doc, seg = ids[on], doc[on], seg[on]
        if len(ids):
            # long stretches into equal parts
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            size = np.diff(np.append(first, len(seg)))
            parts = -(-size // SEGMENT)
            place = np.arange(len(seg)) - np.repeat(first, size)
            part = place * np.repeat(parts, size) // np.repeat(size, size)
            new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (part[1:] != part[:-1])])
            seg = np.cumsum(new) - 1
            letters = np.bincount(seg, weights=words.rows[WORD][ids])
            keep = letters[seg] > 0  # segments of numbers only say nothing
            ids, doc, seg = ids[keep], doc[keep], seg[keep]
        self.props, code = words.rows[:, ids], words.codes[ids]
        self.ids, self.doc, self.code, self.bucket = ids, doc, code, (code % BUCKETS).astype(np.int64)
        self.start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(ids) else np.zeros(0, dtype=np.int64)
        self.size = np.diff(np.append(self.start, len(ids)))
        self.seg_doc = doc[self.start]

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each three words in a row, and the segment of each."""
        seg = np.repeat(np.arange(len(self.start)), self.size)
        c = self.code
        if len(c) < 3:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        h = ((c[:-2] * _MIX + c[1:-1]) * _MIX + c[2:]) * _MIX
        same = seg[2:] == seg[:-2]
        return h[same], seg[2:][same]

    def main(self, exercises: np.ndarray) -> np.ndarray:
        """Which segments are no exercise (all of a document that has no other)."""
        keep = np.ones(len(self.start), dtype=bool)
        if len(exercises) and len(keep):
            h, seg = self.triples()
            hit = np.bincount(seg, weights=exercises[np.minimum(np.searchsorted(exercises, h), len(exercises) - 1)] == h, minlength=len(keep))
            keep = hit < EXERCISE * np.maximum(1, self.size - 2)
            alive = np.bincount(self.seg_doc[keep], minlength=self.n_docs) > 0
            keep |= ~alive[self.seg_doc]
        return keep

    def english(self, keep: np.ndarray) -> np.ndarray:
        """By script and function words, whatever the language column says; words of no language count as English."""
        of = lambda k: np.add.reduceat(self.props[k], self.start) if len(self.start) else np.zeros(0)
        per_doc = lambda v: np.bincount(self.seg_doc[keep], weights=v[keep], minlength=self.n_docs)
        n, foreign = per_doc(np.ones(len(keep))), per_doc((of(FOREIGN) > 0).astype(float))
        en, de, fr, es = (per_doc(of(k)) for k in (EN, DE, FR, ES))
        return (n > 0) & (2 * foreign < n) & (en >= np.maximum(np.maximum(de, fr), es))

    def features(self, keep: np.ndarray, rarity: np.ndarray, grade: np.ndarray) -> np.ndarray:
        """One row per document (zeros where it has no segment)."""
        out = np.zeros((self.n_docs, N_FEATURES))
        if not keep.any():
            return out
        word = self.props[WORD]
        add = lambda v: np.add.reduceat(v, self.start)
        n = add(word)
        rare, letters = rarity[self.bucket] * word, self.props[LETTERS]
        cols = [
            add(rare) / n,
            np.maximum.reduceat(rare, self.start),
            add(letters) / n,
            np.maximum.reduceat(letters, self.start),
            add(self.props[LONG]) / n,
            add(self.props[JOINS]) / self.size,
            add(self.props[SUBORDINATES]) / self.size,
            np.log(self.size),
            add(grade[self.bucket] * word) / n,
        ]
        doc = self.seg_doc[keep]
        count = np.bincount(doc, minlength=self.n_docs)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        some = count > 0
        for k, v in enumerate(cols):
            v = v[keep]
            out[some, 4 * k] = (np.bincount(doc, weights=v, minlength=self.n_docs) / np.maximum(1, count))[some]
            v = v[np.lexsort((v, doc))]
            for j, q in enumerate((0.25, 0.5, 0.75), 1):
                at = q * (count - 1)
                lo = np.floor(at).astype(np.int64)
                a, b = first + np.maximum(0, lo), first + np.minimum(np.maximum(0, lo + 1), np.maximum(0, count - 1))
                out[some, 4 * k + j] = (v[a[some]] * (1 - (at - lo)[some])) + v[b[some]] * (at - lo)[some]
        # diversity: words that didn't stand among the last ones of their document
        words = np.repeat(keep, self.size)
        ids, d = self.ids[words], self.doc[words]
        place = np.arange(len(ids))
        order = np.lexsort((place, ids, d))
        near = (np.diff(ids[order]) == 0) & (np.diff(d[order]) == 0) & (np.diff(place[order]) <= RECENT)
        again = np.bincount(d[order][1:][near], minlength=self.n_docs)
        # shares of words by length, by rarity and by the connective they are
        of = lambda k: self.props[k][words]
        real, rare = of(WORD) > 0, rarity[self.bucket[words]]
        n_words = np.maximum(1, np.bincount(d, weights=real, minlength=self.n_docs))[:, None]
        at = 4 * len(cols)
        for k, values in ((LENGTHS, of(LETTERS).astype(np.int64) - 1), (RARITIES, (rare - RAREST_FROM).astype(np.int64)), (len(_JOIN) + 1, of(JOIN).astype(np.int64))):
            cell = np.clip(values, 0, k - 1)
            out[:, at : at + k] = np.bincount((d * k + cell)[real], minlength=self.n_docs * k).reshape(self.n_docs, k) / n_words
            at += k
        out[~some] = 0
        out[some, -1] = (1 - again / np.maximum(1, np.bincount(d, minlength=self.n_docs)))[some]
        return out


#: Cells of word length, and of rarity from RAREST_FROM on (natural logarithms, one wide).
LENGTHS, RARITIES, RAREST_FROM = 12, 10, 3.0
N_FEATURES = 36 + LENGTHS + RARITIES + len(_JOIN) + 1 + 1
GRADED = slice(32, 36)


def graded_rarity(pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each bucket, how far its words stand in demanding (1) rather than easy (-1) graded documents. pairs: (document, bucket), each once; weights: documents by band."""
    doc, bucket = pairs
    level = weights @ np.array([-1.0, 0.0, 1.0])
    return np.bincount(bucket, weights=level[doc], minlength=BUCKETS) / (np.bincount(bucket, weights=weights.sum(axis=1)[doc], minlength=BUCKETS) + 1.0)


class OrdinalRegression:
    """Proportional odds: P(band <= k) = logistic(cut_k - w x), fitted with an L2 penalty by gradient steps (Adam)."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> "OrdinalRegression":
        on = weight > 0
        self.mean, self.scale = x[on].mean(axis=0), x[on].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        n, k = float(on.sum()), z.shape[1]
        p = np.concatenate([np.zeros(k), [-1.0, 0.5]])  # weights, first cut, log of the step to the second
        m, v = np.zeros_like(p), np.zeros_like(p)
        sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
        for t in range(1, ROUNDS + 1):
            w, c1, step = p[:k], p[k], math.exp(p[k + 1])
            s = z @ w
            g1, g2 = sig(c1 - s), sig(c1 + step - s)
            d1, d2 = g1 * (1 - g1), g2 * (1 - g2)
            prob = np.choose(y, [g1, g2 - g1, 1 - g2]).clip(1e-9)
            # derivatives of the log-likelihood by the two cut values
            a = np.choose(y, [d1, -d1, 0 * d1]) / prob * weight
            b = np.choose(y, [0 * d2, d2, -d2]) / prob * weight
            grad = np.concatenate([-(z.T @ (a + b)), [(a + b).sum(), step * b.sum()]])
            grad[:k] -= penalty * w
            grad /= n
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            p = p + 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w, self.cuts = p[:k], (p[k], p[k] + math.exp(p[k + 1]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self.score(x)
        return (s > self.cuts[0]).astype(int) + (s > self.cuts[1]).astype(int)

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = self.score(x)
        g1, g2 = 1 / (1 + np.exp(-(self.cuts[0] - s))), 1 / (1 + np.exp(-(self.cuts[1] - s)))
        return np.stack([g1, g2 - g1, 1 - g2], axis=1)


class LevelModel:
    """Rarity against graded text and regression together."""

    def fit(self, texts: list[str], weights: np.ndarray, exercises: list[str], rarity: np.ndarray) -> "LevelModel":
        words = Words()
        self.exercises, self.rarity = np.unique(words.encode(exercises).triples()[0]), rarity
        enc = words.encode(texts)
        keep = enc.main(self.exercises)
        use = enc.english(keep)
        weights = weights * use[:, None]
        self.fitted = bool(weights.any())
        if not self.fitted:
            return self
        pairs = np.unique(enc.doc * BUCKETS + enc.bucket)
        pairs = np.stack([pairs // BUCKETS, pairs % BUCKETS])
        fold, y = np.arange(len(texts)) % FOLDS, np.tile(np.arange(3), len(texts))
        for again in (False, True):
            x = np.zeros((len(texts), N_FEATURES))
            for f in range(FOLDS) if len(texts) >= 2 * FOLDS else (-1,):
                x_f = enc.features(keep, rarity, graded_rarity(pairs, weights * (fold != f)[:, None]))
                x = np.where((fold == f)[:, None] | (f < 0), x_f, x)
            self.regression = OrdinalRegression().fit(np.repeat(x, 3, axis=0), y, weights.ravel())
            if not again and len(texts) >= 10 * FOLDS:
                # a grade that the cross-fitted model finds next to impossible is taken for a slip of the rater
                weights = weights * ((self.regression.probability(x) * weights).sum(axis=1) >= 0.03)[:, None]
        self.grade = graded_rarity(pairs, weights)
        return self

    def predict(self, texts: list[str], words: Words | None = None) -> list[str | None]:
        """The band of each English text with words, else None."""
        if not self.fitted or not texts:
            return [None] * len(texts)
        enc = (words or Words()).encode(texts)
        keep = enc.main(self.exercises)
        bands = self.regression.predict(enc.features(keep, self.rarity, self.grade))
        return [BANDS[b] if e else None for b, e in zip(bands, enc.english(keep))]


def word_rarity(documents: DataFrame) -> np.ndarray:
    """For each bucket of hashed words, minus the log of its share among all words of the corpus; counted in the JVM, by map-side combined buckets."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:['’]\p{L}+)?"), F.lit(0)))
    counts = documents.where("text is not null").select(word.alias("w")).groupBy((F.crc32("w") % BUCKETS).alias("b")).count()
    n = np.full(BUCKETS, 0.5)
    for b, c in counts.collect():  # at most BUCKETS rows
        n[b] += c
    return -np.log(n / n.sum())


def fit(documents: DataFrame, labels: DataFrame, exercises: DataFrame | None = None) -> LevelModel | None:
    ship(documents.sparkSession)
    graded = labels.where(F.col("band").isin(*BANDS)).groupBy("doc_id").agg(*[F.count_if(F.col("band") == b).alias(b) for b in BANDS])
    sample = graded.join(documents.where("text is not null").select("doc_id", "text"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = sample.collect()
    if not rows:
        return None
    w = np.array([[r[b] for b in BANDS] for r in rows], dtype=float)
    w /= w.sum(axis=1, keepdims=True)
    ex = [r[0] for r in exercises.select("item_text").where("item_text is not null").collect()] if exercises is not None else []  # held-out items: a table that doesn't grow
    return LevelModel().fit([r["text"] for r in rows], w, ex, word_rarity(documents))


def levels(documents: DataFrame, labels: DataFrame, exercises: DataFrame | None = None) -> DataFrame:
    """doc_id, source, band for every English document."""
    spark = documents.sparkSession
    ship(spark)
    schema = "doc_id long, source string, band string"
    model = fit(documents, labels, exercises)
    if model is None or not model.fitted:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, words = shared.value, Words()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "band": m.predict(b["text"].tolist(), words)})

    return spread(documents.where("text is not null").select("doc_id", "text", "source")).mapInPandas(grade, schema).where("band is not null")


def profile(documents: DataFrame, labels: DataFrame, exercises: DataFrame | None = None) -> DataFrame:
    """Documents per band and source, and the band's share of its source."""
    n = levels(documents, labels, exercises).groupBy(F.coalesce("source", F.lit("(none)")).alias("source"), "band").agg(F.count("*").alias("n_docs"))
    of = F.sum("n_docs").over(Window.partitionBy("source"))
    return n.withColumn("share", F.round(F.col("n_docs") / of, 6))
