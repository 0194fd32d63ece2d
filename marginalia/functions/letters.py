"""Option letters in free text, as Column builders.

All scans run in the JVM. Labels are an array column of upper-case letters; the
empty string stands for "no letter".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.boxed import extract_boxed_inner
from marginalia.functions.text import SPACE, WORD, alone, last_of, let, strip
from marginalia.functions.think import visible_answer

# Wrappers around a letter in a box, and the phrases that name a letter (upper-case text), in order of priority.
WRAPPERS = "text|mathrm|mathbf|mathit|textbf|textit|emph|mbox"
PHRASES = [
    r"\\BOXED\{\s*([A-Z])\s*\}",
    r"OPTION\s+([A-Z])",
    r"CHOICE\s+([A-Z])",
    r"CORRECT\s+ANSWER\s+IS\s+([A-Z])",
    r"CORRECT\s+CHOICE\s+IS\s+([A-Z])",
    r"THE\s+ANSWER\s+IS\s+([A-Z])",
    r"ANSWER\s+IS\s+(?:OPTION\s+)?([A-Z])",
    r"CHOICE\s+IS\s+([A-Z])",
    r"OPTION\s+IS\s+([A-Z])",
    r"FINAL\s+ANSWER\s+IS\s+([A-Z])",
    r"CORRESPONDS\s+TO\s+OPTION\s+([A-Z])",
    r"MATCH(?:ES)?\s+OPTION\s+([A-Z])",
    r"(?:SELECT|PICK|CHOOSE)\s+(?:OPTION\s+)?([A-Z])\b",
    r"\bTHEREFORE[,:]?\s+(?:OPTION\s+)?([A-Z])\b",
    r"\bHENCE[,:]?\s+(?:OPTION\s+)?([A-Z])\b",
]
OPTION_PHRASES = [
    r"\bOPTION\s+([A-Z])\s+IS\b",
    r"\bOPTION\s+([A-Z])\s+MATCH(?:ES|ED|ING)?\b",
    r"\bOPTION\s*[:=-]?\s*([A-Z])\b",
    r"\bTHE\s+ANSWER\s+IS\s+([A-Z])\b",
    r"\bANSWER\s+IS\s+([A-Z])\b",
    r"\bFINAL\s+ANSWER\s*(?:IS|=|:)\s*([A-Z])\b",
    r"\bCHOICE\s+([A-Z])\b",
    r"\bCHOOSE\s+([A-Z])\b",
    r"\bPICK\s+([A-Z])\b",
    r"\b([A-Z])\s+IS\s+CORRECT\b",
    r"\b([A-Z])\s+IS\s+THE\s+CORRECT\s+(?:ANSWER|CHOICE|OPTION)\b",
]
TAIL_PHRASES = [
    r"(?:FINAL\s+ANSWER|ANSWER|ANS)\s*(?:IS|=|:)?\s*[\(\[]?\s*([A-Z])\s*[\)\]]?",
    r"(?:OPTION|CHOICE)\s*(?:IS|=|:)?\s*[\(\[]?\s*([A-Z])\s*[\)\]]?",
    r"(?:I\s+CHOOSE|MY\s+CHOICE\s+IS)\s*[\(\[]?\s*([A-Z])\s*[\)\]]?",
]
LETTER_LINE = r"(?m)^\s*[\(\[]?\s*([A-Z])\s*[\)\]]?\s*$"
TAIL = 2000

#: Words without any of which a phrase cannot match: looking for them costs a fraction of a pattern.
NEEDS = dict(zip(PHRASES, [["\\BOXED"], ["OPTION"], ["CHOICE"], ["CORRECT"], ["CORRECT"], ["ANSWER"], ["ANSWER"], ["CHOICE"], ["OPTION"], ["FINAL"], ["CORRESPONDS"], ["MATCH"], ["SELECT", "PICK", "CHOOSE"], ["THEREFORE"], ["HENCE"]]))
NEEDS |= dict(zip(OPTION_PHRASES, [["OPTION"], ["OPTION"], ["OPTION"], ["ANSWER"], ["ANSWER"], ["FINAL"], ["CHOICE"], ["CHOOSE"], ["PICK"], ["CORRECT"], ["CORRECT"]]))
NEEDS |= dict(zip(TAIL_PHRASES, [["ANS"], ["OPTION", "CHOICE"], ["CHOOSE", "CHOICE"]]))


def _may_match(up: Column, pattern: str) -> Column:
    return reduce(Column.__or__, [up.contains(w) for w in NEEDS[pattern]]) if pattern in NEEDS else F.lit(True)


def labels(options: Column) -> Column:
    """A, B, ... for each option; empty without options."""
    n = F.coalesce(F.size(options), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.char(i + 65))).otherwise(F.array().cast("array<string>"))


def letter_of_inner(inner: Column, valid: Column) -> Column:
    """The valid letter that a box's content stands for, or ''."""
    s = strip(inner, ".$)'\\\"")
    wrapped = F.upper(F.regexp_extract(s, r"(?i)\\(?:" + WRAPPERS + r")\s*\{\s*([A-Za-z])\s*\}", 1))
    one = F.when(F.length(s) == 1, F.upper(s)).otherwise(wrapped)
    return F.when((one != "") & F.array_contains(valid, one), one).otherwise("")


def _valid_hits(text: Column, pattern: str, valid: Column) -> Column:
    """The valid letters that a phrase names in an upper-case text; null where it cannot match."""
    return F.when(_may_match(text, pattern), F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.array_contains(valid, x)))


def boxed_letters(text: Column, valid: Column) -> Column:
    return F.filter(F.transform(extract_boxed_inner(text), lambda x: letter_of_inner(x, valid)), lambda x: x != "")


def last_valid_letter(text: Column, valid: Column) -> Column:
    """The last valid letter in a box, or ''."""
    return F.coalesce(last_of(boxed_letters(text, valid)), F.lit(""))


def extract_valid_letter(text: Column, valid: Column) -> Column:
    """The last valid letter in a box, else the last hit of the first phrase that names a valid one."""
    return let(F.upper(text), lambda up: F.coalesce(last_of(boxed_letters(text, valid)), *[last_of(_valid_hits(up, p, valid)) for p in PHRASES], F.lit("")))


def extract_first_valid_letter(text: Column, valid: Column) -> Column:
    up = F.upper(text)
    first = lambda a: F.try_element_at(a, F.lit(1))
    return F.coalesce(first(boxed_letters(text, valid)), *[first(_valid_hits(up, p, valid)) for p in PHRASES], F.lit(""))


def tail_letter(text: Column, valid: Column) -> Column:
    up = F.upper(F.right(text, F.lit(TAIL)))
    return F.coalesce(*[last_of(_valid_hits(up, p, valid)) for p in [*TAIL_PHRASES, LETTER_LINE]], F.lit(""))


def option_phrase_letter(text: Column, valid: Column) -> Column:
    """The valid letter of the phrase that starts last; of phrases with one start, the later in the list.

    The lengths of the hits of a phrase and of the gaps between them tell where each starts.
    """
    def latest(up: Column) -> Column:
        best = []
        for k, p in enumerate(OPTION_PHRASES):
            hit = let(_last_hit(up, p, valid), lambda s, k=k: F.when(s["letter"] != "", F.struct(s["best"].alias("at"), F.lit(k).alias("k"), s["letter"].alias("letter"))))
            best.append(F.when(_may_match(up, p), hit))
        return F.when(up.rlike("OPTION|ANSWER|CHOICE|CHOOSE|PICK|CORRECT"), F.coalesce(F.greatest(*best)["letter"], F.lit(""))).otherwise("")

    return let(F.upper(text), latest)


def _last_hit(up: Column, pattern: str, valid: Column) -> Column:
    """struct(best, letter): where the last hit of a pattern with a valid letter starts, and the letter."""
    bare = pattern.replace("([A-Z])", "[A-Z]")
    whole = F.regexp_extract_all(up, F.lit(f"({bare})"), F.lit(1))
    letter = F.regexp_extract_all(up, F.lit(pattern), F.lit(1))
    gaps = F.slice(F.split(up, bare, -1), F.lit(1), F.size(whole))
    zipped = F.zip_with(F.zip_with(gaps, whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("hit"))), letter, lambda x, l: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), l.alias("letter")))
    return F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.lit(-1).alias("best"), F.lit("").alias("letter")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["hit"]).alias("at"),
            F.when(F.array_contains(valid, x["letter"]), s["at"] + x["gap"]).otherwise(s["best"]).alias("best"),
            F.when(F.array_contains(valid, x["letter"]), x["letter"]).otherwise(s["letter"]).alias("letter"),
        ),
    )


def simple_letter(text: Column) -> Column:
    """A box of one letter, else the last letter that stands alone, or ''."""
    first = F.nullif(F.upper(F.regexp_extract(text, r"\\boxed\{([A-Za-z])\}", 1)), F.lit(""))
    return F.coalesce(first, last_of(F.regexp_extract_all(F.upper(text), F.lit(alone("A-Z")), F.lit(1))), F.lit(""))


def marked_letter(text: Column) -> Column:
    """A letter marked as final, else a box of one, else the first that stands alone, or ''."""
    marks = [rf"(?iu)FINAL[{SPACE}]*:[{SPACE}]*([A-J])(?![{WORD}])", rf"(?iu)\\boxed\{{[{SPACE}]*([A-J])[{SPACE}]*\}}"]
    return F.coalesce(*[F.nullif(F.upper(F.regexp_extract(text, p, 1)), F.lit("")) for p in marks], F.regexp_extract(F.upper(text), alone("A-J"), 1))


def primary_letter(raw: Column, before: Column, valid: Column) -> Column:
    """struct(letter, path): the first pass over a generated text (see PRIMARY_PATHS for the order)."""
    none = F.struct(F.lit("").alias("letter"), F.lit("mcq_last_valid_letter").alias("path"))

    def pick(letter: Column, path: str) -> Column:
        return let(letter, lambda l: F.when(l != "", F.struct(l.alias("letter"), F.lit(path).alias("path"))))

    def phrases(c: Column, option: str, phrase: str) -> list[Column]:
        each = lambda t: F.coalesce(pick(option_phrase_letter(t, valid), option), pick(extract_valid_letter(t, valid), phrase))
        return [let(visible_answer(c), each), each(c)]

    early = [pick(last_valid_letter(raw, valid), "mcq_last_valid_letter"), *phrases(raw, "mcq_raw_option_phrase", "mcq_primary_phrase_fulltext")]
    late = [pick(last_valid_letter(before, valid), "mcq_primary_pre_trunc_last_valid_letter"), *phrases(before, "mcq_primary_pre_trunc_raw_option_phrase", "mcq_primary_pre_trunc_phrase")]
    changed = strip(before) != strip(raw)
    return F.when(has_training_echo(raw), none).otherwise(F.coalesce(*early, F.when(changed, F.coalesce(*late)), none))


# Openings of a memorised training text, sought in the first ECHO_HEAD characters; phrases of doubt.
TRAINING_ECHO = ["Solve this problem concisely", "Solve the problem concisely", "report only one final boxed answer", "\\begin{solution}"]
ECHO_HEAD = 500
UNCERTAIN = r"(?i)\b(?:none\s+of\s+the\s+options|closest\s+option|might\s+be\s+a\s+mistake|not\s+sure|cannot\s+determine|unclear)\b"


def has_training_echo(text: Column) -> Column:
    head = F.left(text, F.lit(ECHO_HEAD))
    found = head.contains(TRAINING_ECHO[0])
    for p in TRAINING_ECHO[1:]:
        found = found | head.contains(p)
    return found


def risk_signal(raw: Column, valid: Column) -> Column:
    """struct(score, reasons): how far the boxes of a text are from one valid letter."""
    inner = extract_boxed_inner(raw)
    n = F.size(inner)
    letters = F.size(F.filter(inner, lambda x: letter_of_inner(x, valid) != ""))
    other = F.size(F.filter(inner, lambda x: (letter_of_inner(x, valid) == "") & (strip(x) != "")))
    signs = [(n != 1, 1, "multi_boxed"), (other > 0, 2, "nonletter_boxed"), (letters != 1, 2, "ambiguous_letter_spans"), (raw.rlike(UNCERTAIN), 1, "uncertainty_phrase")]
    score = sum((F.when(c, w).otherwise(0) for c, w, _ in signs), F.lit(0))
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, _, r in signs]), lambda x: x.isNotNull())
    return F.when(n == 0, F.struct(F.lit(4).alias("score"), F.array(F.lit("no_boxed_span")).alias("reasons"))).otherwise(F.struct(score.alias("score"), reasons.alias("reasons")))
