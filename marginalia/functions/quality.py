"""Signals of form and reasoning in an output, and the decisions that rest on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.boxed import extract_all_boxed, extract_boxed_inner
from marginalia.functions.free import after_first_box_cut
from marginalia.functions.letters import extract_first_valid_letter, extract_valid_letter, letter_of_inner
from marginalia.functions.text import last_of, let, strip

# Patterns of the signals.
STEP = r"(?i)\bstep\s+\d+\b"
MATH = r"[=+\-*/^\\]"
SURFACE = r"(?i)(?:can be solved using|we can use|it follows that|therefore we get)"
REPEAT = r"(?i)\bis\s+the\s+(?:correct|final|right)?\s*answer\b"
TOOL = r"(?i)(?:tool\s+available:|python\s+interpreter|wikipedia_search\(|\bpage:\s)"
GENERIC = r"(?i)(?:to solve this problem|we need to|let's solve this|we can start by)"


def _count(c: Column, p: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0))


def reasoning_signals(c: Column) -> Column:
    """struct(steps, math, surface_only) of booleans; all false for a blank text."""
    filled = strip(F.coalesce(c, F.lit(""))) != ""
    math, digits = _count(c, MATH), _count(c, r"\d")
    return F.struct(
        (filled & (_count(c, STEP) >= 2)).alias("steps"),
        (filled & ((math >= 2) | (digits >= 3))).alias("math"),
        (filled & F.coalesce(c.rlike(SURFACE), F.lit(False)) & (math < 2) & (digits < 3)).alias("surface_only"),
    )


def normalize_solution(c: Column) -> Column:
    """A solution without thought marks and fenced code, with at most one empty line in a row."""
    s = strip(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, "(?i)</?think>", ""), r"```[\s\S]*?```", "")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def quality_flag(problem: Column, solution: Column) -> Column:
    """The first reason against a solution as a training text, or null."""
    p = strip(F.coalesce(problem, F.lit("")))

    def flag(s: Column) -> Column:
        math = _count(s, MATH)
        return (
            F.when((p == "") | (s == ""), "missing_problem_or_solution")
            .when(s.rlike(TOOL), "tool_trace_or_environment_artifact")
            .when(F.length(s) < 80, "solution_too_short")
            .when((_count(s, STEP) >= 3) & (math < 2) & (_count(s, r"\d") < 3), "template_steps_without_math")
            .when((_count(s, GENERIC) >= 4) & (math < 3), "generic_surface_reasoning")
            .when(F.size(extract_boxed_inner(s)) > 1, "multiple_boxed_in_solution")
        )

    return let(strip(F.coalesce(solution, F.lit(""))), flag)


def diagnostics(raw: Column, response: Column, is_mcq: Column, valid: Column, hit_max: Column) -> Column:
    """How clean an output is: counts, flags, confidence (0-9) and the reasons that rule it out."""
    raw, response = F.coalesce(raw, F.lit("")), F.coalesce(response, F.lit(""))
    a, b = extract_all_boxed(raw), extract_all_boxed(response)
    n = F.size(b)
    mcq = is_mcq & (F.size(valid) > 0)
    one = (n == 1) & (F.coalesce(F.try_element_at(b, F.lit(1)), F.lit("")) != "")
    letter = mcq & (n > 0) & ((letter_of_inner(F.coalesce(last_of(b), F.lit("")), valid) != "") | ((raw != "") & (extract_valid_letter(raw, valid) != "")))
    empty = F.exists(a, lambda x: x == "") | F.exists(b, lambda x: x == "")
    filled = F.filter(a, lambda x: x != "")
    repeats = F.size(filled) - F.size(F.array_distinct(filled))
    head = after_first_box_cut(raw)
    phrases = F.when(F.size(a) > 0, _count(F.substring(raw, F.length(head) + 1, F.length(raw)), REPEAT)).otherwise(0)
    hit = F.coalesce(hit_max, F.lit(False))
    points = [(one, 2), (letter, 2), (~empty, 1), (repeats == 0, 1), (phrases == 0, 1), (~hit, 1), (n == 1, 1)]
    confidence = sum((F.when(c, w).otherwise(0) for c, w in points), F.lit(0))
    faults = [(empty, "empty_boxed"), (mcq & ~letter, "invalid_mcq_letter"), (hit & ~one, "hit_max_no_clean_box"), (~mcq & (n == 0), "final_box_malformed"), (repeats >= 3, "repeated_boxed_answers")]
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in faults]), lambda x: x.isNotNull())
    return F.struct(
        F.size(a).alias("boxes_raw"), n.alias("boxes_response"), one.alias("one_box"), letter.alias("letter_valid"), empty.alias("has_empty"),
        repeats.alias("repeats"), phrases.alias("phrases"), confidence.alias("confidence"), (F.size(reasons) == 0).alias("passes"), reasons.alias("reasons"),
    )


def deploy_decision(base: Column, other: Column, base_response: Column, other_response: Column, other_raw: Column, is_mcq: Column, valid: Column, strict: bool = False) -> Column:
    """struct(winner, response, reason): which run's output to keep, without looking at the gold answer."""
    more = (other["confidence"] - base["confidence"] >= 2) if strict else (other["confidence"] > base["confidence"])
    yes, no = ("strict_confidence_delta_ge_2", "strict_confidence_delta_lt_2") if strict else ("higher_lora_confidence", "tie_or_base_higher_confidence")
    reason = (
        F.when(other["passes"] & ~base["passes"], "base_failed_mandatory")
        .when(base["passes"] & ~other["passes"], "lora_failed_mandatory")
        .when(~base["passes"] & ~other["passes"], "both_failed_mandatory")
        .when(more, yes)
        .otherwise(no)
    )
    wins = reason.isin("base_failed_mandatory", yes)
    letter = extract_first_valid_letter(other_raw, valid)
    down = wins & is_mcq & (letter == "")
    return F.struct(
        F.when(wins & ~down, "lora").otherwise("base").alias("winner"),
        F.when(~wins | down, base_response).when(is_mcq, F.concat(F.lit("\\boxed{"), letter, F.lit("}"))).otherwise(other_response).alias("response"),
        F.when(down, "lora_no_valid_mcq_letter").otherwise(reason).alias("reason"),
    )
