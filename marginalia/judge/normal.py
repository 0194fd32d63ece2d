"""Answers in one plain form, step by step. Each step takes and gives a text."""

from __future__ import annotations

import re

# Punctuation cut from the ends, layout that goes, signs in plain form, commands and environments whose content stays.
PRECEDING, TRAILING = ",.:;!?=+-×÷*/\\|", ",.:;!?=\\。，、；：！？"
LAYOUT = "\\! \\, \\; \\: \\quad \\qquad \\displaystyle \\textstyle \\scriptstyle \\scriptscriptstyle \\normalsize \\hspace{0.1in} \\hspace{0.2in} \\hspace{1em} \\medspace \\thinspace \\thickspace \\enspace \\negthinspace ~ \\left \\right $ \\uparrow \\downarrow \\nearrow \\searrow \\dagger \\ddagger".split()
SIGNS = {
    "\\times": "*", "\\cdot": "*", "\\div": "/", "\\leq": "<=", "\\geq": ">=", "\\neq": "!=", "×": "*", "÷": "/", "·": "*", "π": "\\pi ", "&#960;": "\\pi ", "…": "...", "−": "-", "–": "-", "∶": ":", "，": ",",
    "\\longrightarrow": "->", "\\longleftarrow": "<-", "\\rightarrow": "->", "\\leftarrow": "<-", "\\Rightarrow": "=>", "\\Leftarrow": "<=", "\\iff": "<=>", "\\mapsto": "->", "\\gets": "<-", "\\to": "->", "\\star": "*",
    "\\approx": "=", "\\simeq": "=", "\\sim": "=", "^{\\prime}": "'", "^\\prime": "'", "\\dfrac": "\\frac", "\\tfrac": "\\frac",
}
COMMANDS = "rm bf it sl tt sf small large Large LARGE huge Huge normalsize tiny footnotesize scriptsize underline overline hat bar tilde vec widetilde widehat overrightarrow overleftarrow not cancel boldsymbol bm mathrm mathbf textbf text color{red} color{blue} color{green}".split()
ENVIRONMENTS = "align aligned equation gather gathered multline split cases eqnarray flalign itemize enumerate description list".split()
FUNCTION_NAMES = "arcsin arccos arctan arccot arcsec arccsc sinh cosh tanh coth sech csch sin cos tan cot sec csc log ln exp max min sup lim det gcd lcm sgn pi".split()
UNITS = "seconds second sec s minutes minute min hours hour hr h days day weeks week years year m cm mm km ft in yd kg g mg lb grams gram litres litre liters metres metre coins".split()
WEEKDAYS = {a: d for d, names in {"Monday": "monday mon", "Tuesday": "tuesday tue tues", "Wednesday": "wednesday wed", "Thursday": "thursday thu thur thurs", "Friday": "friday fri", "Saturday": "saturday sat", "Sunday": "sunday sun"}.items() for a in names.split()}
NUMBERS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {w: str(10 * i) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"hundred": "100", "thousand": "1000", "million": "1000000", "half": "1/2", "third": "1/3", "quarter": "1/4", "fourth": "1/4", "true": "True", "yes": "True", "false": "False", "no": "False"}
TRUE, FALSE = frozenset("true yes t y 1 correct right".split()), frozenset("false no f n 0 incorrect wrong".split())
# Both sides of a plus-minus sign.
PLUS_MINUS = re.compile(r"([\w.\\{}+\-*^]+?)(?:\\pm|\\mp)\s*([\w.\\{}+\-*^]+)", re.A)

PAIRS = {"(": ")", "[": "]", "{": "}", "\\{": "\\}", "\\langle": "\\rangle"}
_LAYOUT = re.compile("|".join(re.escape(x) + ("(?![a-zA-Z])" if x[-1].isalpha() and x[0] == "\\" else "") for x in sorted(LAYOUT, key=len, reverse=True)))
_SIGNS = re.compile("|".join(re.escape(x) + ("(?![a-zA-Z])" if x[-1].isalpha() and not x.endswith("frac") else "") for x in sorted(SIGNS, key=len, reverse=True)))
_COMMANDS = re.compile(r"\\(?:" + "|".join(re.escape(c) for c in sorted(COMMANDS, key=len, reverse=True)) + r")(?![a-zA-Z])\s*")
_ENVIRONMENTS = re.compile(r"\\(?:begin|end)\{(?:" + "|".join(ENVIRONMENTS) + r")\*?\}")
_UNIT = re.compile(r"(?<=[\d})])\s*(?:\\text\{\s*|\\mathrm\{\s*)?(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?:\s*\})?(?:\^\{?\d\}?|[²³])?$")
_BARE = re.compile(r"(?<![\\a-zA-Z])(" + "|".join(sorted(FUNCTION_NAMES, key=len, reverse=True)) + ")")
_NAME = re.compile(r"(?:[a-zA-Z]|[A-Z]{2}|\\[a-zA-Z]+)(?:'|\^\{?-?\d\}?|_\{?\w\}?|\u0304)*(?:\([^()=]{1,6}\))?")
_OR = re.compile(r",|(?<![a-zA-Z])or(?![a-zA-Z])")


def partner(s: str, at: int = 0) -> int | None:
    """Where the bracket that opens at a place closes: the place of its closing mark."""
    left = next((p for p in sorted(PAIRS, key=len, reverse=True) if s.startswith(p, at)), None)
    if left is None:
        return None
    right, depth, i = PAIRS[left], 0, at
    while i < len(s):
        if s.startswith(left, i) and not (len(left) == 1 and i and s[i - 1] == "\\" and left == "{"):
            depth, i = depth + 1, i + len(left)
        elif s.startswith(right, i) and not (right == "}" and i and s[i - 1] == "\\"):
            depth -= 1
            if depth == 0:
                return i
            i += len(right)
        else:
            i += 1
    return None


def clean(s: str) -> str:
    """Without punctuation at the ends; a backslash that opens a command and the sign of a number stay."""
    s = s.strip()
    while s and s[0] in PRECEDING and not (s[0] == "\\" and s[1:2].isalpha() or s[:2] == "\\{") and not (s[0] in "+-" and len(s) > 1):
        s = s[1:].strip()
    while s and s[-1] in TRAILING:
        s = s[:-1].strip()
    return s


def round_brackets(s: str) -> str:
    """Braces of sets and angles as round brackets."""
    s = re.sub(r"\\\{|\\langle(?![a-zA-Z])", "(", s)
    return re.sub(r"\\\}|\\rangle(?![a-zA-Z])", ")", s)


def split_top(s: str) -> list[str]:
    """Parts between commas outside brackets, sets and angles counting as brackets; a thousands comma doesn't part."""
    s = round_brackets(s)
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth <= 0:
            if re.match(r"\d{3}(?!\d)", s[i + 1 :]) and i and s[i - 1].isdigit() and len(re.search(r"\d+$", s[:i])[0]) <= 3:
                continue
            out.append(s[last:i])
            last = i + 1
    return [x for x in (x.strip().strip("$").strip() for x in [*out, s[last:]]) if x]


def drop_commands(s: str) -> str:
    """Without commands of style; what stands in their braces stays, and what a declaration in braces rules."""
    while m := _COMMANDS.search(s):
        head, rest = s[: m.start()], s[m.end() :]
        if rest[:1] == "{" and (j := partner(rest)) is not None:
            rest = rest[1:j] + rest[j + 1 :]
        elif head[-1:] == "{" and (j := partner(head[-1:] + rest)) is not None:
            head, rest = head[:-1], rest[: j - 1] + rest[j:]
        s = head + rest
    return s


def drop_environments(s: str) -> str:
    return _ENVIRONMENTS.sub("", s)


def drop_degrees(s: str) -> str:
    return re.sub(r"(?<=\d)\s*(?:°|\^?\s*\{?\\circ\}?)", "", s)


def drop_unit(s: str) -> str:
    return _UNIT.sub("", s.replace("\\%", "").replace("%", "").strip()).strip()


def name_functions(s: str) -> str:
    """Functions as commands, and inverse ones by one name."""
    s = re.sub(r"(?<![a-zA-Z])\\?a(sin|cos|tan)(?![a-z])", r"arc\1", s)
    s = re.sub(r"\\?(?<![a-z])(sin|cos|tan)\s*\^\s*(?:\{\s*\(?-1\)?\s*\}|\(-1\))", r"arc\1", s)
    return _BARE.sub(r"\\\1 ", s)


def plain_arrays(s: str) -> str:
    """Matrices as arrays without columns; no line breaks elsewhere."""
    s = re.sub(r"\{[a-zA-Z]?matrix\}", "{array}", s)
    s = re.sub(r"\\begin\{array\}\{[lcr|]*\}", r"\\begin{array}", s)
    return s if "\\begin{array}" in s else s.replace("\\\\", "")


def outer_brackets(s: str) -> str:
    """Without brackets around the whole."""
    while s and (j := partner(s)) is not None:
        left = next(p for p in sorted(PAIRS, key=len, reverse=True) if s.startswith(p))
        if j + len(PAIRS[left]) != len(s):
            break
        s = s[len(left) : j].strip()
    return s


def is_set(s: str) -> bool:
    return s[:1] == "{" and partner(s) == len(s) - 1


def set_members(s: str) -> list[str]:
    """The members of a set in order, each once; "or" parts them too."""
    return list(dict.fromkeys(x.strip() for x in _OR.split(outer_brackets(s)) if x.strip()))


def fractions(s: str) -> str:
    """Short fractions and roots with their braces."""
    s = re.sub(r"(?<!\\)\bsqrt\s*\(([^()]*)\)", r"\\sqrt{\1}", s)
    s = re.sub(r"\\?\bsqrt\s*([^\s{\[(\\])", r"\\sqrt{\1}", s)
    s = re.sub(r"\\frac\s*(\d)\s*(\d)", r"\\frac{\1}{\2}", s)
    return re.sub(r"(\\frac\{[^{}]*\})\s*([^\s{])", r"\1{\2}", s)


def right_side(s: str, keep) -> str:
    """What a named value equals: of a chain its end; of two sides the right one if the left is a name or holds no letter. keep: whether the left side must stay before a right one."""
    parts = s.split("=")
    if any(p[-1:] in "<>!" for p in parts[:-1]) or "\\begin" in s:
        return s
    if len(parts) > 2:
        return parts[-1].strip()
    if len(parts) == 2:
        left = parts[0].strip()
        if _NAME.fullmatch(left) and not keep(parts[1]) or left and not re.search("[a-zA-Z]", left):
            return parts[1].strip()
    return s


def plus_minus(s: str) -> str:
    """Both values of a sum with a plus-minus sign."""
    t = outer_brackets(s)
    return PLUS_MINUS.sub(r"\1-\2,\1+\2", t) if PLUS_MINUS.search(t) else s


def bounds(s: str) -> str:
    """A chain of inequalities of one sign as the list of its parts."""
    for sign in "<>":
        if len(re.findall(sign, s)) > 1 and not re.search(r",|and|or|[-=]>|<[-=]", s):
            s = s.replace(sign, ",")
    return s


def drop_spaces(s: str) -> str:
    """Without white space, but for one blank behind a command."""
    return re.sub(r"(\\[a-zA-Z]+)?\s+", lambda m: m[1] + " " if m[1] else "", s).strip()


def plain_number(s: str) -> str:
    s = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", s)
    s = re.sub(r"(\d)\.0+(?!\d)", r"\1", s)
    return re.sub(r"^0+(?=[1-9])", "", "0" + s if s[:1] == "." else s)


def truth(s: str) -> str | None:
    w = s.strip().lower()
    return "True" if w in TRUE else "False" if w in FALSE else None


def normal(s: str, keep=lambda right: False) -> str:
    """One answer in its plain form."""
    s = clean(s.replace("\n", " "))
    for words in (WEEKDAYS, NUMBERS):
        if s.lower() in words:
            return words[s.lower()]
    s = _SIGNS.sub(lambda m: SIGNS[m[0]], _LAYOUT.sub("", s))
    if "\\infty" not in s:
        s = re.sub(r"(?<![a-zA-Z\\])inf(?![a-zA-Z])", r"\\infty", s)
    s = drop_spaces(plain_arrays(drop_environments(drop_commands(drop_unit(s)))))
    s = name_functions(drop_degrees(s))
    if "j" in s and "i" not in s:
        s = s.replace("j", "i")
    parts = set_members(s) if is_set(s) else [s]
    out = []
    for p in parts:
        p = re.sub(r"^[a-zA-Z]\s*\\in(?![a-zA-Z])\s*", "", fractions(plain_number(p.strip())))
        if "," not in p:
            p = outer_brackets(p)
        out.append(plain_number(plus_minus(right_side(p, keep))))
    s = ",".join(sorted(out)) if is_set(s) else out[0] if out else ""
    if "," not in s:
        s = outer_brackets(s)
    return bounds(clean(WEEKDAYS.get(s.lower()) or NUMBERS.get(s.lower(), s)))


def normal_of_kind(s: str, kind: str, keep=lambda right: False) -> str:
    """The plain form for a kind of answer: letters and open texts stay, truths become words."""
    if kind in ("MCS", "MCM", "OE"):
        return s
    if kind == "TF" and (t := truth(clean(s))):
        return t
    return normal(s, keep)
