"""One consistent form for texts that look alike, and the skeleton that groups them.

`skeleton`: decompose, replace every character by its prototype, decompose again.
Equal skeletons mean equal looks. Prototypes of letters of all scripts come from the
confusables of the Unicode standard, as ICU holds them (`look_alike_table`); the fixed
tables say which Cyrillic and Greek letters may be swapped in a word.

`changed_rows` groups the words of all fields by equal skeleton (and by the script of
the text around them, as a lone letter is at home in its own script). The form of a
group is the plain one that stands most often, or the skeleton's own if none does; a
row with a word in another form is a case if the check agrees that its text has another
consistent form.

`unified`: the form to keep. It removes invisible characters, makes non-breaking blanks
plain, wide and font variants plain, composes accents, and gives a look-alike letter the
script of its word (or, for a word of look-alikes only, of the text around it; in
formulas and boxes Latin).

Rows of harmless characters only never leave the JVM.

Defined results: null gives null, empty and blank texts stay as they are; repeated
rows come out each; extra columns are not read; empty tables give no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import ship, spread

# Characters that show nothing, and blanks that don't break.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
BLANKS = "\u00a0\u2007\u202f"
# Letters of other scripts and the Latin letters they look like.
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "υ": "u", "α": "a"}
#: Greek letters that are symbols when they stand alone, though they resemble Latin ones.
GREEK_SYMBOLS = frozenset("νιρκυα")
_LATIN_TO_CYRILLIC = {v: k for k, v in CYRILLIC.items() if k not in "ЅІЈѕіјһԁԛԝїЇ"}
#: Letters of blackboard bold that name sets of numbers are signs of their own.
_KEPT = frozenset("ℂℍℕℙℚℝℤ")
#: Texts of these characters only are never a case: ASCII, composed Latin letters, Chinese, some signs.
HARMLESS = r"^[\x00-\x7fÀ-ÖØ-öø-ÿ°²³½¼¾¿¡×÷·«»—–‘’“”„…π∞√≤≥≠≈一-鿿。、《》]*$"


@lru_cache(maxsize=100_000)
def plain_form(c: str) -> str:
    """The plain characters for a wide, narrow or font variant, ligature, blank or invisible character; otherwise itself."""
    if c in INVISIBLE:
        return ""
    if c in BLANKS:
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith(("<font>", "<wide>", "<narrow>")) and c not in _KEPT:
        return unicodedata.normalize("NFKC", c)
    if "ﬀ" <= c <= "ﬆ":
        return unicodedata.normalize("NFKC", c)
    return c


#: Look-alikes of Latin letters and digits in other scripts, as `use` sets them in a process.
OTHER: dict[str, str] = {}
_tables: dict[str, dict[str, str]] = {}


def look_alike_table(spark: SparkSession) -> dict[str, str]:
    """For each letter or number of a script other than Latin, Cyrillic and Greek that Unicode's confusables give the skeleton of a plain letter or digit, that letter; from ICU, which comes with Spark."""
    app = spark.sparkContext.applicationId
    if app not in _tables:
        checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
        skeletons = lambda cs: checker.getSkeleton("\n".join(cs)).split("\n")
        plain = [c for c in map(chr, range(0x30, 0x7B)) if c.isalnum()]
        by_skeleton: dict[str, list[str]] = {}
        for c, k in zip(plain, skeletons(plain)):
            by_skeleton.setdefault(k, []).append(c)
        others = [c for i in (*range(0x250, 0x370), *range(0x530, 0xD800), *range(0xF900, 0x20000)) if unicodedata.category(c := chr(i))[0] in "LN" and plain_form(c) == c and not _chinese(c)]
        kind = lambda c: (c.isupper(), c.islower(), c.isdigit())
        table = {}
        for c, k in zip(others, skeletons(others)):
            if k in by_skeleton:
                table[c] = next((x for x in by_skeleton[k] if kind(x) == kind(c)), by_skeleton[k][-1])
        _tables[app] = table
    return _tables[app]


def use(table: dict[str, str]) -> None:
    """Set the look-alikes of other scripts in this process."""
    if table != OTHER:
        OTHER.clear()
        OTHER.update(table)
        prototype.cache_clear()
        _suspect.cache_clear()


@lru_cache(maxsize=100_000)
def prototype(c: str) -> str:
    p = plain_form(c)
    return "".join(CYRILLIC.get(x) or GREEK.get(x) or OTHER.get(x) or x for x in p)


def skeleton(text: str) -> str:
    d = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", "".join(map(prototype, d)))


def _chinese(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x370 <= o < 0x400:
        return "G"
    return "O" if c in OTHER else "?"


_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*")
_FORMULA = re.compile(r"\$[^$]*\$|\\\(.*?\\\)|\\boxed\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\\[a-zA-Z]+", re.S)


def _plain_text(text: str) -> str:
    out, n = [], len(text)
    for i, c in enumerate(text):
        p = c if ord(c) < 128 else plain_form(c)
        if p != c and "！" <= c <= "｠" and not c.isalnum() and unicodedata.category(c)[0] == "P":
            # Wide punctuation belongs to Chinese sentences: keep it next to Chinese characters.
            before = next((x for x in reversed(text[max(0, i - 6) : i]) if not x.isspace()), "")
            after = next((x for x in text[i + 1 : i + 7] if not x.isspace()), "")
            if any(x and (_chinese(x) or "　" <= x <= "〿") for x in (before, after)):
                p = c
        out.append(p)
    return unicodedata.normalize("NFC", "".join(out)) if n else text


def _homoglyphs(text: str) -> str:
    spans = [m.span() for m in _FORMULA.finditer(text)]
    words = list(_WORD.finditer(text))
    here = {_script(c) for c in text}
    if not here & {"C", "G", "O"}:
        return text
    # a word of look-alikes only is at home where letters of unknown scripts stand
    strange = "O" in here and any(_script(c) == "?" and c.isalpha() and not _chinese(c) for c in text)

    def inside(i: int) -> bool:
        return any(a <= i < b for a, b in spans)

    def certain(w: str) -> str:
        """The script of the letters of w that look like no other."""
        s = {"L": 0, "C": 0, "G": 0}
        for c in w:
            k = _script(c)
            if k == "L" and c not in _LATIN_TO_CYRILLIC or k == "C" and c not in CYRILLIC or k == "G" and c not in GREEK and len(w) > 1:
                s[k] += 1
        best = max(s, key=lambda k: s[k])
        return best if s[best] else ""

    sure = [("" if inside(m.start()) else certain(m[0])) for m in words]
    latin, cyrillic = sum(len(m[0]) for m, s in zip(words, sure) if s == "L"), sum(len(m[0]) for m, s in zip(words, sure) if s == "C")
    around = "C" if cyrillic > latin else "L"
    out, last = [], 0
    for k, m in enumerate(words):
        w = m[0]
        if "O" in here and any(c in OTHER for c in w) and all(c in OTHER or _script(c) in "LCG" for c in w) and not (strange and all(c in OTHER for c in w)):
            out.append(text[last : m.start()] + "".join(OTHER.get(c, c) for c in w))
            last = m.end()
            continue
        scripts = {_script(c) for c in w} - {"?", "O"}
        if scripts == {"L"} and around == "L" or not scripts:
            continue
        formula = inside(m.start())
        own = certain(w)
        if len(scripts) == 1:
            if own:  # letters of one script, and some look like no other
                continue
            only = scripts.pop()
            if only == "G":
                if len(w) == 1 and w in GREEK_SYMBOLS:
                    continue
                target = "L"
            elif only == "C":
                target = "L" if formula or around == "L" else "C"
            else:  # Latin look-alikes in a Cyrillic text
                near = [sure[j] for j in (k - 1, k + 1) if 0 <= j < len(words)]
                target = "C" if not formula and len(w) == 1 and w in _LATIN_TO_CYRILLIC and near and all(x == "C" for x in near) else "L"
        else:
            target = own if own in "LC" and own else ("C" if around == "C" and not formula and "G" not in scripts else "L")
        if target == "L":
            new = "".join(CYRILLIC.get(c) or GREEK.get(c) or c for c in w)
        else:
            new = "".join(_LATIN_TO_CYRILLIC.get(c, c) if _script(c) == "L" else c for c in w)
        if new != w:
            out.append(text[last : m.start()] + new)
            last = m.end()
    return "".join(out) + text[last:] if out else text


#: Without any of these characters a text only needs its accents composed.
_SUSPECT = re.compile("[\u00a0\u00ad\u034f\u0370-\u03ff\u0400-\u052f\u061c\u180e\u2000-\u200f\u2028-\u202f\u2060-\u206f\u2100-\u214f\u3000\ufb00-\ufb29\ufe10-\ufe6f\ufeff-\uffee\U0001d400-\U0001d7ff\U0001ee00-\U0001eeff\U0001fbf0-\U0001fbf9]")


@lru_cache(maxsize=1)
def _suspect():
    return re.compile("[" + "".join(map(re.escape, OTHER)) + "]") if OTHER else re.compile("(?!)")


def unified(text: str) -> str:
    """The consistent form; the same for the consistent form itself."""
    if text.isascii():
        return text
    if not _SUSPECT.search(text) and not _suspect().search(text):
        return unicodedata.normalize("NFC", text)
    for _ in range(4):  # a letter put right may decide its neighbours
        u = unicodedata.normalize("NFC", _homoglyphs(_plain_text(text)))
        if u == text:
            break
        text = u
    return text


def fields_of(questions: DataFrame, outputs: DataFrame) -> DataFrame:
    a = outputs.select(F.lit("response").alias("field_name"), F.col("line_no").alias("row_key"), F.col("response").alias("content"))
    b = questions.select(F.lit("answer").alias("field_name"), F.col("id").alias("row_key"), F.col("answer").alias("content"))
    return a.unionByName(b)


def _forms(shared):
    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use(shared.value)
        for b in batches:
            u = [unified(t) for t in b["content"]]
            changed = [x != t for x, t in zip(u, b["content"])]
            yield pd.DataFrame({"field_name": b["field_name"], "row_key": b["row_key"], "content": b["content"], "unified": u, "skeleton": [skeleton(t) for t in b["content"]], "changed": changed})

    return forms


def unify(fields: DataFrame) -> DataFrame:
    """field_name, row_key, content, unified, skeleton, changed for every field; null stays null.

    A field of harmless characters takes a path without Python: it is its own
    unified form, and its skeleton is computed only where a letter could carry an
    accent (plain ASCII is its own skeleton).
    """
    spark = fields.sparkSession
    ship(spark)
    c = F.col("content")
    ascii_ = c.rlike(r"^[\x00-\x7f]*$")
    same = fields.where(c.isNull() | ascii_).select("field_name", "row_key", "content", c.alias("unified"), c.alias("skeleton"), F.lit(False).alias("changed"))
    rest = fields.where(c.isNotNull() & ~ascii_).mapInPandas(_forms(spark.sparkContext.broadcast(look_alike_table(spark))), "field_name string, row_key long, content string, unified string, skeleton string, changed boolean")
    return same.unionByName(rest)


_SPACE = re.compile("[ \\t\\n\\r]+")
_DIGITS = {ord(str(d)): "0" for d in range(1, 10)}


def _words(shared):
    """The words of a text that may not be in their group's form: those that are not ASCII, and in Cyrillic texts those of Latin look-alikes only."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use(shared.value)
        for b in batches:
            rows = []
            for name, key, text in zip(b["field_name"], b["row_key"], b["content"]):
                u, h = unified(text), int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                cyrillic = sum("\u0400" <= c <= "\u052f" for c in text)
                certain = any("\u0400" <= c <= "\u052f" and c not in CYRILLIC for c in text)
                around = "C" if certain and 2 * cyrillic > sum(c.isalpha() for c in text) else "L"
                for w in {w.translate(_DIGITS) for w in _SPACE.split(text)}:
                    alike = bool(w) and w.isalpha() and all(c in _LATIN_TO_CYRILLIC or c in CYRILLIC for c in w)
                    if not w.isascii() or cyrillic and alike:
                        own = ("C" if "\u0400" <= w[0] else "L") == around if alike else unified(w) == w
                        rows.append((name, key, h, around, w, skeleton(w).translate(_DIGITS), own, u != text))
            yield pd.DataFrame(rows, columns=["field_name", "row_key", "h", "around", "form", "skeleton", "plain", "changed"]).astype({"row_key": "Int64"})

    return words


def changed_rows(fields: DataFrame) -> DataFrame:
    """The rows to be changed: those with a word that isn't in the form of its group of equal skeletons, and whose text has another consistent form."""
    spark = fields.sparkSession
    ship(spark)
    c = F.col("content")
    shared = spark.sparkContext.broadcast(look_alike_table(spark))
    schema = "field_name string, row_key long, h long, around string, form string, skeleton string, plain boolean, changed boolean"
    words = spread(fields.where(c.isNotNull() & ~c.rlike(HARMLESS)).select("field_name", "row_key", "content")).mapInPandas(_words(shared), schema)
    seen = words.groupBy("field_name", "row_key", "h", "around", "form", "skeleton", "plain", "changed").agg(F.count("*").alias("copies")).persist()
    wanted = seen.groupBy("skeleton", "around", "form", "plain").agg(F.sum("copies").alias("n"))
    # plain ASCII words are their own skeletons; they are combined before the shuffle, and those of a wanted group kept
    ascii_ = fields.where(c.isNotNull()).select(F.explode(F.split(F.translate(c, "123456789", "000000000"), "[ \\t\\n\\r]+")).alias("form")).where(F.col("form").rlike(r"^[\x21-\x7e]+$"))
    known = ascii_.groupBy("form").agg(F.count("*").alias("n")).join(wanted.select(F.col("skeleton").alias("form")).distinct(), "form", "left_semi")
    members = wanted.where("plain").select("skeleton", "around", "form", "n").unionByName(known.select(F.col("form").alias("skeleton"), F.lit("L").alias("around"), "form", "n"))
    home = members.groupBy("skeleton", "around", "form").agg(F.sum("n").alias("n")).groupBy("skeleton", "around").agg(F.max_by("form", F.struct("n", "form")).alias("home"))
    odd = seen.join(home, ["skeleton", "around"], "left").where("form <> coalesce(home, skeleton) and changed")
    return odd.groupBy("field_name", "row_key", "h").agg(F.max("copies").alias("copies")).select("field_name", "row_key", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k")).drop("k")


def look_alikes(fields: DataFrame) -> DataFrame:
    """Groups of originals by equal skeleton that hold more than one form: group, rows, forms, the unified form most used.

    Counted in two steps, first by form, so that a skeleton shared by a third of all rows is summed from one row per form.
    """
    by_form = unify(fields).where("content is not null").groupBy(F.xxhash64("skeleton").alias("h"), F.sha2("skeleton", 256).alias("group_key"), F.xxhash64("content").alias("form"), "field_name").agg(F.count("*").alias("n"), F.min("unified").alias("unified"))
    return (
        by_form.groupBy("h", "group_key", "field_name")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_forms"), F.max_by("unified", F.struct("n", "unified")).alias("unified"))
        .where("n_forms > 1")
        .select("field_name", "group_key", "n_rows", "n_forms", "unified")
    )
