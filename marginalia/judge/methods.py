"""Whether a predicted answer equals the gold one, by kind of answer.

In automatic mode an answer is right if any kind says so, so the order of the kinds
only matters for cost. A text that cannot be read is unequal. Two points differ from
common practice on purpose: an identity is tried with all symbols set, and a row's
work is bounded by its size, not by a clock.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.boxed import scan_boxes
from marginalia.judge.latex import Unreadable, close, evaluate, read, same_value, steady_ratio, symbols
from marginalia.judge.normal import clean, normal, normal_of_kind, round_brackets, split_top

PRECISION = 1e-8
#: What a verdict may run into on texts that are no mathematics; such texts are unequal.
FAILURES = (Unreadable, ValueError, ZeroDivisionError, OverflowError, RecursionError, IndexError, TypeError, KeyError)


def normalize(s: str) -> str:
    """One answer in a plain form; an equation of two sides with symbols stays one."""
    return normal(s, keep=lambda right: bool(symbols_of(right)))


def symbols_of(s: str) -> set[str]:
    try:
        return symbols(read(s))
    except (Unreadable, ValueError, RecursionError):
        return set()


def text_equal(a: str, b: str) -> bool:
    return a.lower() == b.lower()


def truth_equal(a: str, b: str) -> bool:
    return b in ("True", "False") and a == b


def single_choice(a: str, b: str) -> bool:
    if text_equal(a, b):
        return True
    a = a.strip("[]") if a.startswith("[") and a.endswith("]") else a
    return text_equal(a, b) or len(a) > 1 and a[1] == ":" and "A" <= a[0] <= "Z" and a[0] == b


def multiple_choice(a: str, b: str) -> bool:
    """The capital letters of a are the signs of b, in any order."""
    return bool(b) and sorted(c.lower() for c in a if "A" <= c <= "Z") == sorted(c.lower() for c in b)


_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def number_equal(a: str, b: str, precision: float = PRECISION) -> bool:
    """Equal up to a relative error, a plain gold number rounded to six places too; of two numbers of which one is scientific, equal to three digits."""
    if a == b:
        return True
    if _FLOAT.fullmatch(a) and _FLOAT.fullmatch(b):
        gold = round(float(b), 6)
        if gold and abs((float(a) - gold) / gold) <= precision * 1.01:
            return True
    x, y = (Fraction(s) if _FLOAT.fullmatch(s) else read(s) for s in (a, b))
    if symbols(x) or symbols(y):
        return False
    u, v = evaluate(x), evaluate(y)
    if close(u, v, precision):
        return True
    p, q = scientific(x), scientific(y)
    if (p is None) != (q is None):
        p, q = p or rounded(u), q or rounded(v)
    return p is not None and q is not None and p[1] == q[1] and abs(p[0] - q[0]) <= 0.101


def scientific(e) -> tuple[float, int] | None:
    """(mantissa, exponent) of a product with a power of ten."""
    if isinstance(e, tuple) and e[0] == "*" and isinstance(e[2], tuple) and e[2][0] == "^" and e[2][1] == Fraction(10):
        n = evaluate(e[2][2])
        return (float(complex(evaluate(e[1])).real), int(n)) if isinstance(n, Fraction) and n.denominator == 1 else None
    return None


def rounded(v) -> tuple[float, int]:
    m, n = f"{complex(v).real:.2e}".split("e")
    return float(m), int(n)


def expression_equal(a: str, b: str, precision: float = PRECISION) -> bool:
    right = lambda s: s.split("=")[1].strip() if "=" in s else s
    return same_value(read(right(a)), read(right(b)), precision)


def equation_equal(a: str, b: str, precision: float = PRECISION) -> bool:
    """The differences of both sides are the same, or one is a whole multiple of the other."""
    if a.count("=") != 1 or b.count("=") != 1:
        return False
    f, g = (("-", read(x), read(y)) for x, y in (a.split("="), b.split("=")))
    if not symbols(f) or symbols(f) != symbols(g):
        return False
    ratio = steady_ratio(f, g)
    if ratio is None or abs(ratio) < 1e-9:
        return False
    r = ratio if abs(ratio) >= 1 else 1 / ratio
    return abs(r - round(r)) <= 1e-6 * max(1.0, abs(r))


def interval_equal(a: str, b: str, precision: float = PRECISION) -> bool:
    def parts(s: str) -> list[tuple[str, str, str, str]]:
        out = []
        for p in re.split(r"\\cup|∪", s):
            m = re.fullmatch(r"\s*([(\[])(.+?),(.+)([)\]])\s*", p)
            if not m:
                raise Unreadable(p)
            out.append((m[1], m[4], m[2], m[3]))
        return out

    left, right = parts(a), parts(b)
    if len(left) != len(right):
        return False
    for p in left:
        k = next((i for i, q in enumerate(right) if p[:2] == q[:2] and expression_equal(p[2], q[2], precision) and expression_equal(p[3], q[3], precision)), None)
        if k is None:
            return False
        right.pop(k)
    return True


def _members(s: str) -> list[str]:
    return split_top(s.strip("()<>"))


def ordered_list(a: str, b: str, precision: float = PRECISION) -> bool:
    x, y = _members(a), _members(b)
    return len(x) == len(y) > 1 and all(equal(p, q, precision, nested=True) for p, q in zip(x, y))


def unordered_list(a: str, b: str, precision: float = PRECISION) -> bool:
    x, y = _members(a), _members(b)
    if len(x) != len(y) or len(y) < 2:
        return False
    for q in y:
        k = next((i for i, p in enumerate(x) if equal(p, q, precision, nested=True)), None)
        if k is None:
            return False
        x.pop(k)
    return True


def _plain(f: Callable[[str, str], bool]) -> Callable[[str, str, float], bool]:
    return lambda a, b, precision=PRECISION: f(a, b)


#: Kinds of answers by code, cheap ones first. register() adds one.
JUDGES: dict[str, Callable[..., bool]] = {
    "OE": _plain(text_equal),
    "TF": _plain(truth_equal),
    "MCS": _plain(single_choice),
    "MCM": _plain(multiple_choice),
    "NV": number_equal,
    "INT": interval_equal,
    "EX": expression_equal,
    "EQ": equation_equal,
    "OL": ordered_list,
    "UOL": unordered_list,
}


def register(code: str, judge: Callable[..., bool]) -> None:
    JUDGES[code] = judge


def equal(a: str, b: str, precision: float = PRECISION, nested: bool = False) -> bool:
    if a == b or text_equal(a, b):
        return True
    for code, f in JUDGES.items():
        if nested and code in ("OL", "UOL"):
            continue
        try:
            if f(a, b, precision=precision):
                return True
        except FAILURES:
            continue
    return False


# What comes before an answer, and the phrases that name one.
AFTER = ("herefore", "#### ", "# Answer\n\n")
BEFORE_PHRASE, AFTER_PHRASE = ("is the ans", "is our ans"), ("answer is", "answer:", "answer :")
_JOINED = re.compile(r"^[\s,\$\.\;\:\-\&\\]*$")


def extract(text: str) -> str:
    """The answer that a text gives: its last boxes, else what the usual phrases name, else its last formula or number."""
    t = text.strip()
    for x in AFTER:
        t = t.rsplit(x, 1)[-1].strip()
    if "oxed{" in t:
        shown = t.rsplit("</think>", 1)[-1]
        spans = [x for x in scan_boxes(shown) if x[2].strip()]
        src = shown if spans else t
        spans = spans or [x for x in scan_boxes(t) if x[2].strip()]
        k = len(spans) - 1
        while k > 0 and _JOINED.match(src[spans[k - 1][1] : spans[k][0]]):
            k -= 1
        return ", ".join(x.strip() for _, _, x in spans[max(0, k) :])
    for x in BEFORE_PHRASE:
        if x in t:
            return re.split(r"[,.!]", t.split(x)[-2].strip())[-1].strip()
    for x in AFTER_PHRASE:
        if x in t:
            found = clean(t.split(x)[-1])
            return found[1:-1] if len(found) > 1 and found[0] == found[-1] == "$" else found
    if m := re.findall(r"(?:\$|\\\(|\\\[)([^\$]+?)(?:\$|\\\)|\\\])", t, re.S):
        return m[-1]
    m = re.findall(r"-?\d*\.?\d+", t.replace(",", ""))
    return m[-1] if m else ""


def judge(pred: str | None, gold: list[str] | None, kinds: list[str] | None = None, precision: float | list[float] = PRECISION) -> bool:
    """Whether a text answers a question of one or more slots, of given kinds or of any; precision: one, or one for each slot. Without a box nothing is right."""
    if not pred or not gold or "\\boxed" not in pred or any(g is None for g in gold):
        return False
    found = extract(pred)
    if not found:
        return False
    parts = split_top(found)
    gold = [round_brackets(g) for g in gold]
    if len(gold) == 1 and len(parts) > 1 and kinds is None:
        gold = split_top(gold[0])
    exact = precision if isinstance(precision, list) else [precision] * len(gold)
    if kinds is None:
        return len(parts) == len(gold) and all(equal(normalize(x), normalize(y), p) for x, y, p in zip(parts, gold, exact))
    keep = lambda right: bool(symbols_of(right))
    a, b = ([normal_of_kind(x, k, keep) for x, k in zip(xs, kinds)] for xs in (parts, gold))  # more predictions than kinds are not looked at
    if len(a) != len(b):
        return False
    try:
        return all(JUDGES[k](x, y, precision=p) for x, y, k, p in zip(a, b, kinds, exact))
    except FAILURES:
        return False


def verdicts(code: str):
    """The judge of one kind as a column function of two texts; null where either is."""

    @F.pandas_udf(T.BooleanType())
    def of_kind(pred: pd.Series, gold: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None:
                return None
            try:
                return JUDGES[code](a, b)
            except FAILURES:
                return False

        return pd.Series([one(a, b) for a, b in zip(pred, gold)], dtype=object)

    return of_kind


@F.pandas_udf(T.BooleanType())
def judge_udf(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([judge(p, None if g is None else list(g)) for p, g in zip(pred, gold)])


def _match_option(text: str | None, options) -> str:
    if not text or options is None:
        return ""
    found = extract(text)
    if not found:
        return ""
    a = normalize(found)
    return next((chr(65 + i) for i, o in enumerate(options) if o and equal(a, normalize(o))), "")


@F.pandas_udf(T.StringType())
def option_match(text: pd.Series, options: pd.Series) -> pd.Series:
    """The first option whose text equals the answer that a text gives, or ''."""
    return pd.Series([_match_option(t, o) for t, o in zip(text, options)])
