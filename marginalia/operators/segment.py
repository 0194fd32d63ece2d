"""Several values packed in one field: dictionary-guided segmentation.

Every field value is *masked* (each digit becomes 0, invisible characters go, wide
forms become plain), so that the dictionary of known whole values stays small:
`250 km` and `317 km` are the one mask `000 km`. The dictionary is counted over all
fields, a multi-pattern automaton finds every known mask in a packed field, and
dynamic programming picks the cover of least cost. A delimiter inside a legitimate
value is protected since a cover with the known whole value is cheaper than one with
its parts; no rule of shapes does so. What the dictionary lacks is covered by unknown
pieces, and a piece that breaks a bracket or a quote costs more than one that does not.

A mask with delimiters enters the dictionary (`spanning_masks`) if the data show that
it is whole:

- brackets or quotes hold it together, or a part would break a bracket;
- it stands in quotes, and not all its parts stand elsewhere;
- it stands in different fields, and none of its parts ever stands without the others.

The best supported masks go to the tasks as the automaton; if the dictionary is larger,
the fields meet the rest of it by a join (`_known_runs`), with the same result.

SEEDS are the masks known before anything is counted: numbers with thousands commas,
which no count can tell from lists of numbers.

Defined results: null, empty and blank fields, fields of one value and fields
whose pieces are all empty give no row; repeated rows and repeated values are
kept, each with its position; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.boxed import last_box, last_box_deep, too_deep
from marginalia.operators.bitset import collect_bits, size_for
from marginalia.session import ship

#: The masks sent to every task are held to so many characters in all (16 MB), the best supported first; the fields meet the rest by a join.
DICTIONARY_CHARS = 16_000_000
#: The bit set of the rest's masks and their beginnings: bits for each of them, and 2 ** 28 bits (32 MB) at most.
BITS_EACH, MOST_BITS = 16, 28
#: A mask with delimiters may be whole if it stands so often: in quotes, between stronger delimiters, or as a field.
SUPPORT = 2
#: Masks known whole before counting: numbers with thousands commas.
SEEDS = [f"{'0' * k},000{tail}" for k in (1, 2, 3) for tail in ("", ".0", ".00", ",000")]

_INVISIBLE = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
_HAS_DELIMITER = r"[,;|\t\n/，；｜／\uFF0F]|(?i)\b(?:and|or|und|oder|et|ou|y|o|и|или)\b|\\text|\\\\|、|或|和"
_DELIMITER = re.compile(r"\s*(?:[,;|\t\n]|\\text\s*\{\s*(?:and|or)\s*\}|\\\\|(?<=\s)/(?=\s)|(?<=[\s}\])])(?:and|or)(?=[\s\\(\[{])|、)\s*")
#: Costs of the cover: a delimiter; a known value; an unknown piece, which costs more the longer it is; a piece that breaks a bracket or a quote.
DELIMITER, KNOWN, UNKNOWN, LETTER, BROKEN = 0.5, 1.0, 1.5, 0.01, 6.0


def plain(text: str) -> tuple[str, list[int]]:
    """The text without invisible characters and in plain width, and for each of its characters the place in the original (one more for the end)."""
    out, at = [], []
    for i, c in enumerate(text):
        if ord(c) in _INVISIBLE:
            continue
        if ord(c) > 127:
            n = unicodedata.normalize("NFKC", c)
            c = n if len(n) == 1 else c
        out.append(c)
        at.append(i)
    at.append(len(text))
    return "".join(out), at


_DIGIT = re.compile(r"\d")


def mask(text: str) -> str:
    return _DIGIT.sub("0", plain(text)[0]).strip()


def mask_column(c: Column) -> Column:
    """The same mask in the JVM, for printable ASCII values."""
    return F.trim(F.translate(c, "123456789", "000000000"))


def automaton(masks):
    import ahocorasick

    a = ahocorasick.Automaton()
    for m in masks:
        if m:
            a.add_word(m, len(m))
    if len(a):
        a.make_automaton()
        return a
    return None


def segment(text: str, known=None, runs=()) -> list[str]:
    """The values of a field, in order; one value gives a list of one, a blank field an empty one. known: an automaton over masks of whole values; runs: the first and last stretch of more values known whole."""
    return [item for item, *_ in _pieces(text, known, runs)[1]]


_OPEN, _CLOSE = "([{", ")]}"


def _boundaries(body: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """Where stretches between delimiters begin and end, and the depth of brackets (of any kind) and parity of quotes before each."""
    begins, ends = [0], []
    for m in _DELIMITER.finditer(body):
        ends.append(m.start())
        begins.append(m.end())
    ends.append(len(body))
    depths, parity, depth, quote, at = [], [], 0, 0, 0
    for e in ends:
        depths.append(depth)
        parity.append(quote)
        for c in body[at:e]:
            if c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth -= 1
            elif c == '"':
                quote ^= 1
        at = e
    depths.append(depth)
    parity.append(quote)
    return begins, ends, depths, parity


def _body(text: str) -> tuple[str, list[int]]:
    """The plain field without its brackets, and for each of its characters the place in the original."""
    s, at = plain(text)
    lo, hi = 0, len(s)
    while lo < hi and s[lo].isspace():
        lo += 1
    while hi > lo and s[hi - 1].isspace():
        hi -= 1
    if hi - lo >= 2 and s[lo] == "[" and s[hi - 1] == "]" and _closes(s, lo, hi):
        lo, hi = lo + 1, hi - 1
    return s[lo:hi], at[lo:hi]


def _pieces(text: str, known=None, runs=()) -> tuple[str, list[tuple[str, int, int, bool]]]:
    """The plain field without its brackets, and for each value the text, its place there and whether it is quoted."""
    body, at = _body(text)
    if not body:
        return "", []
    begins, ends, depths, parity = _boundaries(body)
    n = len(begins)
    # A graph over the stretches: an edge (i, j) covers the stretches i to j as one value. Its shortest path is the best cover.
    edges: list[dict[int, float]] = [{} for _ in range(n)]
    closing: dict[tuple[int, int], int] = {}
    for i in range(n - 1, -1, -1):
        broken = depths[i + 1] != depths[i] or parity[i + 1] != parity[i] or _half_quoted(body[begins[i] : ends[i]])
        edges[i][i] = UNKNOWN + LETTER * (ends[i] - begins[i]) + BROKEN * broken
        # the shortest run of stretches from here that leaves no bracket or quote open
        closing[depths[i + 1], parity[i + 1]] = i
        j = closing.get((depths[i], parity[i])) if broken else None
        if j is not None and j > i:
            edges[i][j] = UNKNOWN + LETTER * (ends[j] - begins[i])
        if broken and (j := _single_quoted(body, begins, ends, i)) is not None:
            edges[i][j] = UNKNOWN + LETTER * (ends[j] - begins[i])
    whole = [(j, i) for i, j in runs]
    if known is not None:
        start_at, end_at = {b: i for i, b in enumerate(begins)}, {e: i for i, e in enumerate(ends)}
        for end, length in known.iter(_DIGIT.sub("0", body)):
            i, j = start_at.get(end - length + 1), end_at.get(end + 1)
            if i is not None and j is not None and i <= j:
                whole.append((j, i))
    # in the order of their ends, whichever way they were found: the first of equal covers is taken
    for j, i in sorted(whole):
        edges[i][j] = min(KNOWN, edges[i].get(j, KNOWN))
    best, back = [math.inf] * n + [0.0], [0] * n
    for i in range(n - 1, -1, -1):
        for j, c in edges[i].items():
            if begins[i] == ends[j]:
                c = 0.0  # an empty piece doesn't count
            c += best[j + 1] + (DELIMITER if j + 1 < n else 0.0)
            if c < best[i]:
                best[i], back[i] = c, j
    out, i = [], 0
    while i < n:
        a, b = begins[i], ends[back[i]]
        i = back[i] + 1
        while a < b and body[a].isspace():
            a += 1
        while b > a and body[b - 1].isspace():
            b -= 1
        quoted = b - a >= 2 and body[a] == body[b - 1] and body[a] in "\"'"
        start, end = a, b
        if quoted:
            a, b = a + 1, b - 1
        item = text[at[a] : at[b - 1] + 1].strip() if b > a else ""
        if plain(item)[0].strip():
            out.append((item, start, end, quoted))
    return body, out


def _half_quoted(piece: str) -> bool:
    """Begins with a single quote that it doesn't close."""
    return piece[:1] == "'" and not (len(piece) > 1 and piece[-1] == "'")


def _single_quoted(body: str, begins: list[int], ends: list[int], i: int) -> int | None:
    """The stretch that closes a single quote opened at stretch i, the next one that ends in such a quote."""
    if not _half_quoted(body[begins[i] : ends[i]]):
        return None
    return next((j for j in range(i + 1, len(begins)) if body[ends[j] - 1 : ends[j]] == "'"), None)


_STRONG = re.compile(r"[;|\t\n]")
_PAIRS = [("{", "}"), ("(", ")"), ("[", "]"), ("\\begin", "\\end"), ("\\left", "\\right")]


def _broken(part: str) -> bool:
    """Whether a part holds one side of a pair only, so that it cannot be a value."""
    return any(part.count(a) != part.count(b) for a, b in _PAIRS)


def _key(m: str) -> int:
    return int.from_bytes(blake2b(m.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How masks stand in different fields: alone, quoted, listed (several pieces between stronger delimiters, in the field owner), or as a piece of the listed mask owner."""
    seeds = automaton(SEEDS)
    for b in batches:
        seen: Counter = Counter()
        for text, copies in zip(b["content"], b["n"]):
            body, pieces = _pieces(text, seeds)
            if len(pieces) == 1:
                seen[mask(pieces[0][0]), "quoted" if pieces[0][3] else "alone", 0] += copies
                continue
            field = _key(mask(body))
            groups: list[list[tuple[str, int, int, bool]]] = []
            for k, p in enumerate(pieces):
                if not k or _STRONG.search(body[pieces[k - 1][2] : p[1]]):
                    groups.append([])
                groups[-1].append(p)
            for g in groups:
                if len(g) == 1:
                    seen[mask(g[0][0]), "quoted" if g[0][3] else "alone", 0] += copies
                    continue
                m = mask(body[g[0][1] : g[-1][2]])
                seen[m, "listed", field] += copies
                owner = _key(m)
                for item, _, _, quoted in g:
                    seen[mask(item), "quoted" if quoted else "piece", owner] += copies
        rows = [(m, how, owner, n) for (m, how, owner), n in seen.items() if m]
        yield pd.DataFrame(rows, columns=["mask", "how", "owner", "n"])


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of a mask and what joins them; a mask that holds delimiters and is one piece, as brackets or quotes hold it together, stands for itself."""
    for b in batches:
        rows = []
        for m, n, in_quotes, apart in zip(b["mask"], b["n"], b["in_quotes"], b["apart"]):
            body, pieces = _pieces(m)
            of = (m, _key(m), n, in_quotes, apart)
            if len(pieces) == 1 and _DELIMITER.search(body):
                rows.append((*of, "whole", m, False))
            elif len(pieces) > 1:
                rows += [(*of, "part", x, _broken(x)) for x in {mask(p[0]) for p in pieces}]
        if rows:
            yield pd.DataFrame(rows, columns=["whole", "key", "n", "in_quotes", "apart", "role", "mask", "broken"])


def spanning_masks(fields: DataFrame, candidate: Column) -> DataFrame:
    """mask, count of the values that hold delimiters and yet are whole, by the evidence named above. Copies of one field show nothing: a list may be copied too."""
    foreign = F.col("content").rlike(r"[^\x20-\x7e]")
    distinct = fields.where(candidate | foreign).groupBy("content").agg(F.count("*").alias("n"))
    inner = distinct.mapInPandas(_evidence, "mask string, how string, owner long, n long")
    outer = fields.where(~candidate & ~foreign).groupBy(mask_column(F.col("content")).alias("mask")).agg(F.count("*").alias("n")).select("mask", F.lit("alone").alias("how"), F.lit(0).cast("long").alias("owner"), "n")
    of = lambda how: F.coalesce(F.sum(F.when(F.col("how") == how, F.col("n"))), F.lit(0))
    at = lambda how: F.when(F.col("how") == how, F.col("owner"))
    stands = inner.unionByName(outer).groupBy("mask").agg(
        *(of(h).alias(h) for h in ("alone", "quoted", "listed")), F.min(at("piece")).alias("least"), F.max(at("piece")).alias("most"), (F.min(at("listed")) < F.max(at("listed"))).alias("apart")
    ).persist()
    often = stands.where(f"quoted + listed + alone >= {SUPPORT}").select("mask", (F.col("quoted") + F.col("listed") + F.col("alone")).alias("n"), (F.col("quoted") >= SUPPORT).alias("in_quotes"), F.coalesce("apart", F.lit(False)).alias("apart"))
    parts = often.mapInPandas(_parts, "whole string, key long, n long, in_quotes boolean, apart boolean, role string, mask string, broken boolean")
    known = stands.select("mask", (F.col("alone") + F.col("quoted") > 0).alias("single"), "least", "most")
    elsewhere = F.coalesce(F.col("single"), F.lit(False)) | F.coalesce((F.col("least") != F.col("key")) | (F.col("most") != F.col("key")), F.lit(False))
    shown = F.bool_or(F.col("role") == "whole") | F.bool_or("broken") | (F.bool_or("in_quotes") & ~F.bool_and(elsewhere)) | (F.bool_or("apart") & ~F.bool_or(elsewhere))
    return parts.join(known, "mask", "left").groupBy("whole").agg(F.max("n").alias("count"), shown.alias("shown")).where("shown").select(F.col("whole").alias("mask"), "count")


def _closes(s: str, lo: int, hi: int) -> bool:
    """Whether the bracket at lo is closed by the one at hi - 1."""
    depth = 0
    for i in range(lo, hi):
        if s[i] == "[":
            depth += 1
        elif s[i] == "]":
            depth -= 1
            if depth == 0:
                return i == hi - 1
        elif s[i] == ")" and depth == 1 and "(" not in s[lo:i]:
            return False
    return False


def _runs(text: str, bits: np.ndarray, longest: int) -> Iterator[tuple[int, int, str]]:
    """The runs of stretches of a field (first, last, mask) that may be a mask of the bit set: it holds the beginnings of masks of 1, 2, 4, 8, ... characters, and whole masks by the hash with a zero at the end."""
    body, _ = _body(text)
    begins, ends, *_ = _boundaries(body)
    masked, room = _DIGIT.sub("0", body), 64 * len(bits) - 1

    def missing(crc: int) -> bool:
        crc &= room
        return not int(bits[crc >> 6]) >> (crc & 63) & 1

    for i, a in enumerate(begins):
        crc, at, step, j = 0, a, 1, i
        while j < len(ends) and ends[j] - a <= longest:
            # the next place to look at: the end of the beginning, or of the run
            to = min(a + step, ends[j])
            crc, at = crc32(masked[at:to].encode(), crc), to
            if to == a + step:
                if missing(crc):
                    break
                step *= 2
            if to == ends[j]:
                if to > a and not missing(crc32(b"\0", crc)):
                    yield i, j, masked[a:to]
                j += 1


def _known_runs(contents: DataFrame, masks: DataFrame) -> DataFrame:
    """key (of a content), runs: where one of the masks stands as a run of stretches, each as first * 2 ** 32 + last. Masks and runs meet by a shuffled join; a bit set of bounded size only spares it runs that meet nothing."""
    masks = masks.select("mask").persist()
    hashes = F.expr("concat(array(crc32(concat(mask, '\\0'))), transform(sequence(0, length(bin(length(mask))) - 1), k -> crc32(substring(mask, 1, shiftleft(1, k)))))")
    n, longest = masks.agg(F.coalesce(F.sum(F.size(hashes)), F.lit(0)), F.coalesce(F.max(F.length("mask")), F.lit(0))).first()
    size = size_for(n, BITS_EACH, MOST_BITS)
    shared = contents.sparkSession.sparkContext.broadcast(collect_bits(masks.select(F.explode(hashes).alias("h")), F.col("h") % size, size))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, i << 32 | j, m) for key, text in zip(b["key"], b["content"]) for i, j, m in _runs(text, shared.value, longest)]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "run", "mask"])

    found = contents.select("key", "content").distinct().mapInPandas(look, "key string, run long, mask string")
    return found.join(masks, "mask", "left_semi").groupBy("key").agg(F.collect_list("run").alias("runs"))


def packed_values(fields: DataFrame) -> DataFrame:
    """fields: field_name, row_key, content. Gives field_name, row_key, pos, item for every field of two or more values.

    Fields without any delimiter character stay in the JVM, where ASCII: they only feed
    the dictionary (one map-side combined count). Candidates go to Python twice: once each
    different one, for the values that hold delimiters and are whole, and once to be cut.
    A dictionary beyond DICTIONARY_CHARS takes them there once more, each different one, to
    be looked up in what the tasks were not sent.
    """
    spark = fields.sparkSession
    ship(spark)
    f = fields.where(F.col("content").isNotNull()).select("field_name", "row_key", "content")
    candidate = F.col("content").rlike(_HAS_DELIMITER)
    masks = (
        f.where(~candidate & ~F.col("content").rlike(r"[^\x20-\x7e]"))
        .groupBy(mask_column(F.col("content")).alias("mask"))
        .count()
        .where("count > 1 and mask <> ''")
        .select("mask", "count", F.lit(0).alias("spans"))
        .unionByName(spanning_masks(f, candidate).withColumn("spans", F.lit(1)))
    )
    known, room, rest = list(SEEDS), DICTIONARY_CHARS, None
    for r in masks.orderBy(F.desc("spans"), F.desc("count"), "mask").toLocalIterator():
        room -= len(r["mask"])
        if room < 0:
            spans, count = F.col("spans"), F.col("count")
            rest = masks.where((spans < r["spans"]) | ((spans == r["spans"]) & ((count < r["count"]) | ((count == r["count"]) & (F.col("mask") >= F.lit(r["mask"]))))))
            break
        known.append(r["mask"])
    shared = spark.sparkContext.broadcast(known)
    packed = f.where(candidate)
    if rest is not None:
        keyed = packed.withColumn("key", F.sha2("content", 256))
        packed = keyed.join(_known_runs(keyed, rest), "key", "left").select("field_name", "row_key", "content", "runs")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(shared.value)
        for b in batches:
            names, keys, pos, items = [], [], [], []
            for name, key, text, runs in zip(b["field_name"], b["row_key"], b["content"], b.get("runs", [None] * len(b))):
                values = segment(text, a, () if runs is None else [(r >> 32, r & 0xFFFFFFFF) for r in map(int, runs)])
                if len(values) > 1:
                    names += [name] * len(values)
                    keys += [key] * len(values)
                    pos += range(1, len(values) + 1)
                    items += values
            if names:
                yield pd.DataFrame({"field_name": names, "row_key": pd.array(keys, dtype="Int64"), "pos": pd.array(pos, dtype="Int32"), "item": items})

    return packed.mapInPandas(cut, "field_name string, row_key long, pos int, item string")


def answer_fields(questions: DataFrame, outputs: DataFrame) -> DataFrame:
    """The fields of the problem: the whole answer, and the content of the last complete box of the response."""
    ship(questions.sparkSession)
    a = questions.select(F.lit("answer").alias("field_name"), F.col("id").alias("row_key"), F.col("answer").alias("content"))
    boxes, r = outputs.where(F.col("response").contains("\\boxed{")), F.col("response")
    for rows, content in ((boxes.where(~too_deep(r)), last_box(r)), (boxes.where(too_deep(r)), last_box_deep(r))):
        a = a.unionByName(rows.select(F.lit("response").alias("field_name"), F.col("line_no").alias("row_key"), content.alias("content")))
    return a
