"""Builders of DuckDB SQL for the oracles: written apart from the Column builders, in the other engine's terms."""

from __future__ import annotations

from marginalia.functions import letters, quality
from marginalia.functions.boxed import box_pattern, balanced

SPACE = " \t\n\x0b\x0c\r\x1c-\x1f\x85   -     　"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str, also: str = "") -> str:
    return f"regexp_replace({e}, {lit(f'^[{SPACE}{also}]+|[{SPACE}{also}]+$')}, '', 'g')"


def rstrip(e: str) -> str:
    return f"regexp_replace({e}, {lit(f'[{SPACE}]+$')}, '')"


BOX = lit(box_pattern(possessive=False))
ONE_BOX = "\\\\boxed\\{" + balanced(possessive=False) + "\\}"


def inners(e: str) -> str:
    """The unstripped contents of the boxes of a text."""
    return f"list_transform(list_filter(regexp_extract_all({e}, {BOX}, 1), lambda x: x <> ''), lambda x: x[:-2])"


def boxes(e: str) -> str:
    return f"list_transform({inners(e)}, lambda x: {strip('x')})"


def labels(options: str) -> str:
    return f"CASE WHEN len({options}) > 0 THEN list_transform(range(len({options})), lambda i: chr(65 + i::INT)) ELSE []::VARCHAR[] END"


def inner_letter(x: str, valid: str) -> str:
    s = strip(x, ".$)''\\\"".replace("''", "'"))
    w = lit(r"(?i)\\(?:" + letters.WRAPPERS + r")\s*\{\s*([A-Za-z])\s*\}")
    one = f"CASE WHEN length({s}) = 1 THEN upper({s}) ELSE upper(regexp_extract({s}, {w}, 1)) END"
    return f"CASE WHEN list_contains({valid}, {one}) THEN {one} ELSE '' END"


def box_letters(e: str, valid: str) -> str:
    return f"list_filter(list_transform({inners(e)}, lambda x: {inner_letter('x', valid)}), lambda y: y <> '')"


def hits(e: str, pattern: str, valid: str) -> str:
    return f"list_filter(regexp_extract_all({e}, {lit(pattern)}, 1), lambda x: list_contains({valid}, x))"


def valid_letter(e: str, valid: str, at: int = -1) -> str:
    parts = [f"({box_letters(e, valid)})[{at}]", *[f"({hits(f'upper({e})', p, valid)})[{at}]" for p in letters.PHRASES], "''"]
    return f"coalesce({', '.join(parts)})"


def tail_letter(e: str, valid: str) -> str:
    t = f"upper(right({e}, {letters.TAIL}))"
    return f"coalesce({', '.join(f'({hits(t, p, valid)})[-1]' for p in [*letters.TAIL_PHRASES, letters.LETTER_LINE])}, '')"


def count(e: str, pattern: str) -> str:
    return f"coalesce(len(regexp_extract_all({e}, {lit(pattern)})), 0)"


def quality_flag(p: str, s: str) -> str:
    p, s = strip(f"coalesce({p}, '')"), strip(f"coalesce({s}, '')")
    return (
        f"CASE WHEN {p} = '' OR {s} = '' THEN 'missing_problem_or_solution' WHEN regexp_matches({s}, {lit(quality.TOOL)}) THEN 'tool_trace_or_environment_artifact' "
        f"WHEN length({s}) < 80 THEN 'solution_too_short' WHEN {count(s, quality.STEP)} >= 3 AND {count(s, quality.MATH)} < 2 AND {count(s, '[0-9]')} < 3 THEN 'template_steps_without_math' "
        f"WHEN {count(s, quality.GENERIC)} >= 4 AND {count(s, quality.MATH)} < 3 THEN 'generic_surface_reasoning' WHEN len({inners(s)}) > 1 THEN 'multiple_boxed_in_solution' END"
    )


#: Both question tables; the last line of each id; the pair of both.
QUESTIONS = "(SELECT id, question, options, answer, split, source, 'public' AS origin FROM public_questions UNION ALL SELECT id, question, options, NULL, NULL, source, 'private' FROM private_questions)"
LAST = "(SELECT * FROM private_outputs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"


def option_phrase(e: str, valid: str) -> str:
    """The valid letter of the phrase that starts last."""
    up = f"upper({e})"
    all_ = []
    for k, p in enumerate(letters.OPTION_PHRASES):
        hit, letter, gap = (f"regexp_extract_all({up}, {lit(p)}, 0)", f"regexp_extract_all({up}, {lit(p)}, 1)", f"regexp_split_to_array({up}, {lit(p)})")
        total = lambda l, to: f"coalesce(list_sum(list_transform({l}[1:{to}], lambda x: length(x))), 0)::BIGINT"
        all_.append(f"list_transform(list_filter(range(1, len({hit}) + 1), lambda i: list_contains({valid}, ({letter})[i])), lambda i: {{'at': {total(gap, 'i')} + {total(hit, 'i - 1')}, 'k': {k}, 'l': ({letter})[i]}})")
    every = all_[0]
    for a in all_[1:]:
        every = f"list_concat({every}, {a})"
    return f"coalesce((list_max({every})).l, '')"


_THOUGHTS = lit("(?s)^.*(?:</think>|</redacted_reasoning>)")


def visible(e: str) -> str:
    after = strip(f"regexp_replace({e}, {_THOUGHTS}, '')")
    return f"CASE WHEN contains({e}, '</think>') OR contains({e}, '</redacted_reasoning>') THEN {after} ELSE {e} END"


def last_letter(e: str, valid: str) -> str:
    return f"coalesce(({box_letters(e, valid)})[-1], '')"


def echo(e: str) -> str:
    return "(" + " OR ".join(f"contains(left({e}, {letters.ECHO_HEAD}), {lit(p)})" for p in letters.TRAINING_ECHO) + ")"


def first_step(steps: list[tuple[str, ...]], none: tuple[str, ...]) -> list[str]:
    """CASE expressions over steps (condition, letter column, constants...): the letter and the constants of the first step with a letter."""
    out = [f"CASE {' '.join(f'WHEN {c} AND {x[0]} <> {lit(str())} THEN {x[0]}' for c, *x in steps)} ELSE {none[0]} END"]
    for k in range(1, len(none)):
        out.append(f"CASE {' '.join(f'WHEN {c} AND {x[0]} <> {lit(str())} THEN {lit(x[k])}' for c, *x in steps)} ELSE {none[k]} END")
    return out
