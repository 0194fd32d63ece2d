"""Small string builders that behave alike in every engine (white space as in Unicode, not only blanks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, for use within a character class.
SPACE = " \t\n\x0b\x0c\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The characters that make a word, for use within a character class: letters and numbers of every script (the JVM's \b and \w know ASCII only). The last one, a letter beyond 16 bits, is named so that a look-behind steps back over both halves of such letters.
WORD = "\\p{L}\\p{N}_\U00010000"


def alone(letters: str) -> str:
    """Pattern of one of the letters (of a class) that is no part of a word in any script."""
    return f"(?<![{WORD}])([{letters}])(?![{WORD}])"


def strip(c: Column, also: str = "") -> Column:
    """Without white space (and the characters `also`, escaped for a class) at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}{also}]+|[{SPACE}{also}]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+$", "")


def none_if_blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, stripped."""
    return F.coalesce(*[none_if_blank(c) for c in columns])


def last_of(hits: Column) -> Column:
    return F.try_element_at(hits, F.lit(-1))


def normal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def let(c: Column, body) -> Column:
    """body of c, with c computed once however often the body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))
