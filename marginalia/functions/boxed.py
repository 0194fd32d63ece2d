"""Brace-balanced boxes as Column builders.

A possessive regular expression of bounded depth keeps the work in the JVM; rows
nested deeper than DEPTH go to an Arrow UDF, so that the result holds at any depth.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 6


def balanced(depth: int = DEPTH, possessive: bool = True) -> str:
    """The pattern of a content whose braces are balanced, up to a depth."""
    plus, star = ("++", "*+") if possessive else ("+", "*")
    p = f"[^{{}}]{star}"
    for _ in range(depth):
        p = f"(?:[^{{}}]{plus}|\\{{{p}\\}}){star}"
    return p


def box_pattern(depth: int = DEPTH, possessive: bool = True) -> str:
    """Group 1 is the content and its closing brace; the second branch swallows the rest behind an unterminated box."""
    return f"\\\\boxed\\{{({balanced(depth, possessive)}\\}})|\\\\boxed\\{{[\\s\\S]*"


def strip_space(c: Column) -> Column:
    """Removes white space of any kind at both ends (SQL trim only removes blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def scan_boxes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, content) of each outermost complete box, left to right; an unterminated box ends the scan."""
    spans, i, opener = [], 0, "\\boxed{"
    while (start := text.find(opener, i)) >= 0:
        depth, j = 1, start + len(opener)
        while j < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[j], 0)
            j += 1
        if depth:
            break
        spans.append((start, j, text[start + len(opener) : j - 1]))
        i = j
    return spans


def extract_boxed_inner(c: Column) -> Column:
    """The unstripped contents, JVM-side, right up to DEPTH."""
    hits = F.filter(F.regexp_extract_all(c, F.lit(box_pattern()), F.lit(1)), lambda x: x != "")
    return F.transform(hits, lambda x: F.substring(x, F.lit(1), F.length(x) - 1))


def extract_all_boxed(c: Column) -> Column:
    return F.transform(extract_boxed_inner(c), strip_space)


def extract_boxed(c: Column) -> Column:
    """The last box, or the empty string."""
    return F.coalesce(F.try_element_at(extract_all_boxed(c), F.lit(-1)), F.lit(""))


def has_complete_boxed(c: Column) -> Column:
    return F.size(extract_boxed_inner(c)) > 0


def too_deep(c: Column) -> Column:
    """Whether the bounded pattern might not do: more than DEPTH opening braces without a closing one between."""
    return c.rlike("(?:\\{[^{}]*+){" + str(DEPTH + 2) + "}")


@F.pandas_udf(T.StringType())
def last_box_deep(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None or not (b := scan_boxes(t)) else b[-1][2])


def last_box(c: Column) -> Column:
    """The content of the last complete box, null where there is none. Right up to DEPTH; give rows that are too_deep to last_box_deep."""
    return F.try_element_at(extract_boxed_inner(c), F.lit(-1))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("inner", T.StringType())])


@F.pandas_udf(T.ArrayType(_SPAN))
def boxed_spans(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [] if t is None else [{"start": a, "end": b, "inner": x.strip()} for a, b, x in scan_boxes(t)])


# Fixed value: what may stand between two boxes of one group.
_BETWEEN = re.compile(r"^[\s,\$\.\;\:\-\&\\]*$")


@F.pandas_udf(T.ArrayType(T.StringType()))
def last_group(s: pd.Series) -> pd.Series:
    """The stripped contents of the last boxes that only punctuation separates, empty ones dropped."""

    def group(t: str | None) -> list[str]:
        spans = [x for x in scan_boxes(t or "") if x[2].strip()]
        k = len(spans) - 1
        while k > 0 and _BETWEEN.match(t[spans[k - 1][1] : spans[k][0]]):
            k -= 1
        return [x.strip() for _, _, x in spans[max(k, 0) :]]

    return s.map(group)


@F.pandas_udf(T.StringType())
def last_boxed_string(s: pd.Series) -> pd.Series:
    """The last boxed expression with its command (fbox if there is no box), braces balanced; null where it is not closed."""

    def last(t: str | None) -> str | None:
        t = t or ""
        at = max(t.rfind("\\boxed"), -1)
        at = at if at >= 0 else t.rfind("\\fbox")
        if at < 0:
            return None
        depth, opened = 0, False
        for i in range(at, len(t)):
            if t[i] == "{":
                depth, opened = depth + 1, True
            elif t[i] == "}":
                depth -= 1
                if opened and depth == 0:
                    return t[at : i + 1]
        return None

    return s.map(last)
