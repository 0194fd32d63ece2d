"""Texts as comparable words: without differences of writing.

Case, accents, look-alikes, invisible characters, mark-up, punctuation, blanks for
an answer and line breaks go; numbers written in English words become digits; a
Chinese character counts as a word.
"""

from __future__ import annotations

import re
import unicodedata

from marginalia.llm.unify import skeleton

_UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"hundred": 100, "thousand": 1000}
NUMBER_WORDS = _UNITS.keys() | _TENS.keys() | _SCALES.keys()
_ANSWER_BLANK = re.compile(r"\[\s*ans\s*\]|_{2,}")
_LATEX = re.compile(r"\\(?:text|mathrm|mathbf|textbf|left|right|quad|displaystyle)\b|\\[,;:! ]")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[⺀-鿿豈-﫿぀-ヿ]|[^\W\d_⺀-鿿豈-﫿぀-ヿ]+(?:'[^\W\d_]+)?")
#: Numbers below it may be words of the wording ("one of the"); they say nothing about the quantities.
SMALL = 13


def words(text: str) -> list[str]:
    """The folded words of a text, in order; null and blank give none."""
    if not text:
        return []
    s = text.casefold()
    if not s.isascii():
        s = skeleton(s).casefold()
    if not s.isascii():
        s = "".join(c for c in s if not unicodedata.combining(c)).replace("’", "'")
    s = _ANSWER_BLANK.sub(" ", s)
    if "\\" in s:
        s = _LATEX.sub(" ", s)
    return _numbers(_TOKEN.findall(s))


def _numbers(tokens: list[str]) -> list[str]:
    if _UNITS.keys().isdisjoint(tokens) and _TENS.keys().isdisjoint(tokens):  # no numbers in words
        return [t if t[0].isalpha() else (t.replace(",", "").lstrip("0") or "0") if t[0].isdigit() else t for t in tokens]
    out, i, n = [], 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t[0].isdigit():
            t = t.replace(",", "")
            out.append(t.lstrip("0") or "0")
            i += 1
            continue
        if t not in _UNITS and t not in _TENS:
            out.append(t)
            i += 1
            continue
        total, group, j, used = 0, 0, i, 0
        last = 10_000
        while j < n:
            w = tokens[j]
            if w in _UNITS and last > 19:
                if last < 100 and _UNITS[w] > 9:
                    break
                group, last = group + _UNITS[w], min(last, _UNITS[w])
            elif w in _TENS and last >= 100:
                group, last = group + _TENS[w], 20
            elif w == "hundred" and 0 < group < 20:
                group, last = group * 100, 100
            elif w == "thousand" and group:
                total, group, last = total + group * 1000, 0, 1000
            elif w == "and" and last in (100, 1000) and j + 1 < n and (tokens[j + 1] in _UNITS or tokens[j + 1] in _TENS):
                j += 1
                continue
            else:
                break
            j += 1
            used += 1
        value = total + group
        if used == 1 and value < SMALL:
            out.append(tokens[i])
            i += 1
        else:
            out.append(str(value))
            i = j
    return out


def quantities(ws: list[str]) -> list[str]:
    """The numbers of at least SMALL, in order: they name an exercise in any way of writing."""
    return [w for w in ws if w[0].isdigit() and (len(w) > 2 or "." in w or int(w) >= SMALL)]


def digits(ws: list[str]) -> list[str]:
    return [w for w in ws if w[0].isdigit()]


def alike(a: str, b: str) -> bool:
    """The same word but for a misspelling: one edit in short words, two in long ones (a swap of neighbours is one)."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if a[0].isdigit() or b[0].isdigit() or abs(la - lb) > 1 or min(la, lb) < 3:
        return False
    if sorted(a) == sorted(b):
        return sum(x != y for x, y in zip(a, b)) <= 3
    limit = 1 if max(la, lb) < 8 else 2
    p = 0
    while p < min(la, lb) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(la, lb) - p and a[la - 1 - q] == b[lb - 1 - q]:
        q += 1
    return max(la, lb) - p - q <= limit
