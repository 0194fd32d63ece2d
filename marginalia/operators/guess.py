"""Fallback cascades over generated texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import letters as L
from marginalia.functions.boxed import scan_boxes
from marginalia.functions.text import let, strip
from marginalia.functions.think import visible_answer
from marginalia.judge.methods import option_match
from marginalia.session import ship

BOX, PHRASE, OPTION, NO_TIER = "boxed_high", "answer_phrase_medium", "option_match_medium", "none"


def best_guess(primary: Column, before: Column, final: Column, valid: Column) -> Column:
    """struct(letter, path, tier): the first signal found, in the order below; texts that echo training lose all steps over the primary text.

    final: box, tail, option phrase, phrase; primary: the same; before (if it differs): box, option phrase, phrase;
    primary and final together: option phrase, phrase, tail; before and final together: phrase.
    """

    def step(letter: Column, path: str, tier: str) -> Column:
        return let(letter, lambda l: F.when(l != "", F.struct(l.alias("letter"), F.lit(path).alias("path"), F.lit(tier).alias("tier"))))

    def phrase(c: Column, path: str) -> list[Column]:
        each = lambda t: step(L.extract_valid_letter(t, valid), path, PHRASE)
        return [let(visible_answer(c), each), each(c)]

    def four(c: Column, box: str, stem: str, option: str) -> list[Column]:
        return [step(L.last_valid_letter(c, valid), box, BOX), step(L.tail_letter(c, valid), f"{stem}_tail_phrase", PHRASE), step(L.option_phrase_letter(c, valid), option, PHRASE), *phrase(c, f"{stem}_phrase_fulltext")]

    first = four(final, "mcq_finalizer_last_valid_letter", "mcq_finalizer", "mcq_finalizer_raw_option_phrase")
    second = four(primary, "mcq_last_valid_letter", "mcq_primary", "mcq_raw_option_phrase")
    changed = strip(before) != strip(primary)
    third = [step(L.last_valid_letter(before, valid), "mcq_pre_trunc_last_valid_letter", BOX), step(L.option_phrase_letter(before, valid), "mcq_pre_trunc_raw_option_phrase", PHRASE), *phrase(before, "mcq_pre_trunc_phrase_fulltext")]
    both, late = F.concat(primary, F.lit("\n\n"), final), F.concat(before, F.lit("\n\n"), final)
    fourth = [step(L.option_phrase_letter(both, valid), "mcq_combined_raw_option_phrase", PHRASE)]
    each = lambda t: F.coalesce(step(L.extract_valid_letter(t, valid), "mcq_combined_phrase_fulltext", PHRASE), step(L.tail_letter(t, valid), "mcq_combined_tail_phrase", PHRASE))
    fourth += [let(visible_answer(both), each), each(both)]
    fifth = phrase(late, "mcq_combined_pre_trunc_phrase")
    heard = ~L.has_training_echo(primary)
    rest = [F.when(heard, s) for s in second] + [F.when(heard & changed, s) for s in third] + [F.when(heard, s) for s in fourth] + [F.when(heard & changed, s) for s in fifth]
    return F.coalesce(*first, *rest, F.struct(F.lit("").alias("letter"), F.lit("mcq_abstain_no_signal").alias("path"), F.lit(NO_TIER).alias("tier")))


def guessed(df: DataFrame, primary: str, before: str, final: str, valid: str, options: str, name: str = "guess") -> DataFrame:
    """Adds the first signal found, with the last resort: the first option whose text equals, as the judge sees it, the answer that primary and final text together give. Only rows without any other signal meet Python."""
    ship(df.sparkSession)
    x = df.withColumn(name, best_guess(F.col(primary), F.col(before), F.col(final), F.col(valid)))
    open_ = (F.col(f"{name}.letter") == "") & ~L.has_training_echo(F.col(primary))
    y = x.withColumn("__option", option_match(F.when(open_, F.concat(primary, F.lit("\n\n"), final)), F.when(open_, F.col(options))))
    found = F.coalesce(F.col("__option"), F.lit("")) != ""
    matched = F.struct(F.col("__option").alias("letter"), F.lit("mcq_option_match_judger").alias("path"), F.lit(OPTION).alias("tier"))
    return y.withColumn(name, F.when(found, matched).otherwise(F.col(name))).drop("__option")


# Tokens that must precede a box that ends a text, the cue of a final answer and how far before the box it may stand.
LEAST_TOKENS, CUE_CHARS = 128, 600
CUE = re.compile(r"final\s+answer|therefore|thus|hence|the\s+answer\s+is|correct\s+(?:answer|option|choice)", re.I)
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_INNER = re.compile(r"\\(?:" + L.WRAPPERS + r")\s*\{\s*([A-Za-z])\s*\}", re.I)


def count_words(text: str) -> int:
    """A stand-in for a tokenizer: words, numbers and signs."""
    return len(_WORD.findall(text))


def _letter(inner: str, valid: set[str]) -> str:
    s = inner.strip().strip(".$)'\"")
    m = _INNER.search(s)
    one = s if len(s) == 1 else (m[1] if m else "")
    return one.upper() if one.upper() in valid else ""


def cut_text(text: str, valid: set[str] | None, least: int = LEAST_TOKENS, first: bool = False, count=count_words) -> str:
    """The text up to its final box. With labels: up to a box of a valid letter that `least` tokens precede, one with a cue first of all; the last such (the first, if so asked). Without: up to the last box (the first that isn't empty)."""
    spans = scan_boxes(text)
    if not spans:
        return text
    if valid is None:
        if first:
            return next((text[:e] for _, e, x in spans if x.strip()), text).rstrip()
        return text[: spans[-1][1]].rstrip()
    good = [(s, e) for s, e, x in spans if _letter(x, valid) and count(text[:e]) >= least]
    cued = [(s, e) for s, e in good if CUE.search(text[max(0, s - CUE_CHARS) : s])]
    pick = cued or good
    return text[: pick[0 if first else -1][1]].rstrip() if pick else text.rstrip()


def _cut(text: pd.Series, valid: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut_text(t, set(v) if v is not None else None) for t, v in zip(text, valid)])


smart_cut = F.pandas_udf(_cut, T.StringType())
