"""Thoughts and special tokens in generated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import strip

# The marks that open and close thoughts.
OPEN, CLOSE, REDACTED = "<think>", "</think>", "</redacted_reasoning>"


def visible_answer(c: Column) -> Column:
    """What follows the last closing mark, stripped; the text itself without one."""
    has = c.contains(CLOSE) | c.contains(REDACTED)
    return F.when(has, strip(F.regexp_replace(c, f"(?s)^.*(?:{CLOSE}|{REDACTED})", ""))).otherwise(c)


def clean_special_tokens(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"<\|[^|>]+\|>", ""), "</?think>", ""))


def strip_thinking_first(c: Column) -> Column:
    """Without thoughts: open and close marks give what follows the first close, a close alone what precedes it (or follows, if that is blank), an open one alone nothing."""
    o, e = c.contains(OPEN), c.contains(CLOSE)
    before, after = strip(F.split_part(c, F.lit(CLOSE), F.lit(1))), strip(F.regexp_replace(c, f"(?s)^.*?{CLOSE}", ""))
    return F.when(o & e, after).when(e, F.when(before != "", before).otherwise(after)).when(o, F.lit("")).otherwise(strip(c))


def strip_thinking_last(c: Column) -> Column:
    """What follows the last close mark; nothing where thoughts are only opened."""
    return F.when(c.contains(CLOSE), strip(F.substring_index(c, CLOSE, -1))).when(c.contains(OPEN), F.lit("")).otherwise(strip(c))


def clean_visible(c: Column) -> Column:
    return strip(F.regexp_replace(strip_thinking_first(c), r"<\|[^|]+\|>", ""))
