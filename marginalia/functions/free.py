"""Free answers: finding, boxing and canonicalising them, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.boxed import balanced, extract_all_boxed, extract_boxed_inner, has_complete_boxed
from marginalia.functions.text import last_of, let, normal_newlines, rstrip, strip
from marginalia.functions.think import CLOSE, visible_answer

# What encloses a formula, the phrases that introduce an answer, and the punctuation cut from its ends.
LATEX_BLOCKS = [r"(?s)\\\((.+?)\\\)", r"(?s)\\\[(.+?)\\\]", r"(?s)\$\$(.+?)\$\$", r"(?s)\$(.+?)\$"]
ANSWER_PHRASES = [r"(?im)(?:final\s+)?answer\s+is[:\s]+([^\n\.]+)", r"(?im)(?:therefore|thus|so|hence)[,]?\s+([^\n\.]+)", r"(?im)=\s*([^\n=]+?)\s*$"]
MULTI_PHRASES = [r"(?im)(?:final\s+)?answers?\s*(?:are|is)[:\s]+([^\n]+)", r"(?im)(?:therefore|thus|hence|so)[,]?\s+([^\n]+)"]
NUMBER = r"(-?\d+(?:\.\d+)?(?:/-?\d+(?:\.\d+)?)?)"
POINTS = ".,:; \\t"
CUE = r"(?i)(?:final\s+answer|therefore|thus|hence)\b"
CUE_WINDOW = 180
SLOT = "[ANS]"


def ans_slots(question: Column) -> Column:
    return F.coalesce(F.regexp_count(question, F.lit(r"\[ANS\]")), F.lit(0))


def last_latex_block(c: Column) -> Column:
    """The last block of the first kind that occurs, stripped; '' without one."""
    hits = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in LATEX_BLOCKS]
    return F.coalesce(*[strip(last_of(h)) for h in hits], F.lit(""))


def last_answer_phrase(c: Column) -> Column:
    """The last value of the first phrase that occurs and leaves one; else the last number; else ''."""
    values = [F.nullif(strip(last_of(F.regexp_extract_all(c, F.lit(p), F.lit(1))), POINTS), F.lit("")) for p in ANSWER_PHRASES]
    return F.coalesce(*values, last_of(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))), F.lit(""))


def ensure_boxed(c: Column) -> Column:
    """The text itself if it has a box; else with the best value it shows in a box at its end."""

    def shown_in(t: Column) -> Column:
        after = strip(F.substring_index(t, CLOSE, -1))
        return F.when(t.contains(CLOSE) & (after != ""), after).otherwise(t)

    value = let(shown_in(c), lambda t: F.when(last_latex_block(t) != "", last_latex_block(t)).otherwise(last_answer_phrase(t)))
    return F.when(has_complete_boxed(c), c).otherwise(F.concat(rstrip(c), F.lit("\n\n\\boxed{"), value, F.lit("}")))


def comma_values(c: Column) -> Column:
    """The parts between commas (of any depth), without blanks and points at their ends, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ",", -1), lambda x: strip(x, POINTS)), lambda x: x != "")


def multi_values(c: Column, slots: Column) -> Column:
    """The values that a phrase lists, if there are as many as slots; else an empty array."""
    hits = [last_of(F.regexp_extract_all(c, F.lit(p), F.lit(1))) for p in MULTI_PHRASES]
    s = strip(F.coalesce(*hits, F.lit("")), POINTS)
    s = F.regexp_replace(F.regexp_replace(s, r"^\\\[\s*", ""), r"\s*\\\]$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)^\$\$(.*)\$\$$", "$1"), r"(?s)^\$(.*)\$$", "$1")
    s = strip(s, POINTS)
    s = strip(F.coalesce(last_of(extract_all_boxed(s)), s), POINTS)
    values = comma_values(s)
    return F.when((slots >= 2) & (F.size(values) == slots), values).otherwise(F.array().cast("array<string>"))


def box(value: Column) -> Column:
    return F.concat(F.lit("\\boxed{"), value, F.lit("}"))


def boxes_with_context(c: Column) -> Column:
    """array of struct(before, inner): each box with up to CUE_WINDOW characters before it.

    The text is split at its boxes; a running suffix of what was passed gives the context without offsets.
    """
    whole = r"\\boxed\{" + balanced() + r"\}"
    inner = extract_boxed_inner(c)
    gaps = F.slice(F.split(c, whole, -1), F.lit(1), F.size(inner))
    pairs = F.zip_with(gaps, inner, lambda g, i: F.struct(g.alias("gap"), i.alias("inner")))
    empty = F.array().cast("array<struct<before:string,inner:string>>")
    step = lambda s, x: F.struct(
        F.right(F.concat(s["seen"], x["gap"], box(x["inner"])), F.lit(CUE_WINDOW)).alias("seen"),
        F.array_append(s["out"], F.struct(F.right(F.concat(s["seen"], x["gap"]), F.lit(CUE_WINDOW)).alias("before"), x["inner"].alias("inner"))).alias("out"),
    )
    return F.aggregate(pairs, F.struct(F.lit("").alias("seen"), empty.alias("out")), step)["out"]


def canonical_free(response: Column, question: Column) -> Column:
    """struct(response, path, slots, values, cue_matched): the one box that stands for a free answer."""
    slots = ans_slots(question)
    none = F.array().cast("array<string>")
    result = lambda value, path, values, cue: F.struct(value.alias("response"), F.lit(path).alias("path"), slots.alias("slots"), values.alias("values"), F.lit(cue).alias("cue_matched"))

    def choose(ensured: Column) -> Column:
        last = last_of(extract_all_boxed(ensured))
        listed = comma_values(last)
        cued = let(last_of(F.filter(boxes_with_context(ensured), lambda x: x["before"].rlike(CUE))), lambda x: F.when(x.isNotNull(), result(box(strip(x["inner"])), "free_cue_last", none, True)))
        return (
            F.when((slots >= 2) & (F.size(listed) == slots), result(box(F.array_join(listed, ", ")), "free_multi_ans_last_box", listed, False))
            .otherwise(F.coalesce(cued, result(box(F.coalesce(last, F.lit(""))), "free_last_boxed", none, False)))
        )

    def phrased(values: Column) -> Column:
        return F.when(F.size(values) > 0, result(box(F.array_join(values, ", ")), "free_multi_ans_phrase", values, False))

    return F.coalesce(let(multi_values(visible_answer(response), slots), phrased), let(ensure_boxed(response), choose))


def without_boxes(c: Column) -> Column:
    return F.regexp_replace(c, r"\\boxed\{" + balanced() + r"\}", "")


def canonical_mcq(response: Column, letter: Column) -> Column:
    """The text without its boxes, and one box with the letter at its end; unchanged without a letter."""
    body = rstrip(without_boxes(response))
    return F.when(strip(letter) == "", response).when(body == "", box(F.upper(strip(letter)))).otherwise(F.concat(body, F.lit("\n\n"), box(F.upper(strip(letter)))))


def after_first_box_cut(c: Column) -> Column:
    """The text up to the end of its first box."""
    head = F.regexp_extract(c, r"(?s)^(.*?\\boxed\{" + balanced() + r"\})", 1)
    return F.when(head == "", c).otherwise(head)


def after_last_box_cut(c: Column) -> Column:
    gaps = F.split(c, r"\\boxed\{" + balanced() + r"\}", -1)
    tail = F.length(last_of(gaps))
    return F.when(has_complete_boxed(c), F.left(c, F.length(c) - tail)).otherwise(c)


def single_final_box(response: Column, fallback: Column) -> Column:
    """One box at the end: the last one of the text, else the fallback, else what the text shows. Only flat boxes are taken out of the text."""
    flat = lambda c: strip(F.regexp_replace(c, r"\\boxed\s*\{[^{}]*\}", ""))
    given = strip(F.coalesce(fallback, F.lit("")))

    def put(body: Column, value: Column) -> Column:
        return F.when(body == "", box(value)).otherwise(F.concat(body, F.lit("\n\n"), box(value)))

    def ended(t: Column) -> Column:
        final = F.coalesce(F.nullif(last_of(extract_all_boxed(t)), F.lit("")), given)
        shown = let(ensure_boxed(t), lambda e: put(flat(e), F.coalesce(last_of(extract_all_boxed(e)), F.lit(""))))
        return let(final, lambda v: F.when(v != "", put(flat(t), v)).otherwise(shown))

    return let(strip(F.coalesce(response, F.lit(""))), ended)


def submission_format(raw: Column, response: Column) -> Column:
    """What is handed in: the raw text if it has a box, else it with the response as its final answer, else what there is."""
    r, a = normal_newlines(F.coalesce(raw, F.lit(""))), normal_newlines(F.coalesce(response, F.lit("")))
    return F.when(r.contains("\\boxed"), r).when((strip(r) != "") & (strip(a) != ""), F.concat(r, F.lit("\n\nFinal answer: "), a)).when(strip(a) != "", a).otherwise(r)


# Literal replacements of the answer normaliser, in this order, and the commands it unwraps.
NORMALISE = [("\\left", ""), ("\\right", ""), ("\u2236", ":"), ("\uff0c", ","), ("$", ""), ("\\approx", "="), ("\\simeq", "="), ("\\sim", "="), ("^\\prime", "'"), ("^{\\prime}", "'"), ("^\\circ", ""), ("%", ""), ("\\dfrac", "\\frac"), ("\\tfrac", "\\frac")]
UNWRAP = [(r"\\(?:mathrm|mathbf)\{~?([^}]*)\}", 1), (r"\\text\{(.*?)\}", 1), (r"\\textbf\{(.*?)\}", 1)]


def normalize_answer(c: Column) -> Column:
    for a, b in NORMALISE:
        c = F.replace(c, F.lit(a), F.lit(b))
    for p, g in UNWRAP:
        c = F.regexp_replace(c, p, f"${g}")
    c = F.regexp_replace(F.regexp_replace(c, r"frac([^{])(.)", "frac{$1}{$2}"), r"sqrt([^{])", "sqrt{$1}")
    return strip(F.regexp_replace(strip(c), r"^\$+|\$+$", ""))
