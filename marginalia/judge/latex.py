"""A small LaTeX mathematics reader: to an expression tree, then to values.

Numbers stay exact fractions while they can; functions, roots and constants go to
complex floats. Expressions with symbols are compared at random points, seeded by
their text, so a verdict does not depend on the task that gives it. What cannot be
read raises Unreadable.
"""

from __future__ import annotations

import cmath
import math
import random
import re
import zlib
from fractions import Fraction

# Names that are read as functions, constants and signs.
FUNCTIONS = "arcsin arccos arctan arccot arcsec arccsc sinh cosh tanh coth sech csch sin cos tan cot sec csc log ln exp lg".split()
GREEK = "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi rho sigma tau upsilon phi varphi chi psi omega".split()
_DROP = re.compile(r"\\(?:left|right|displaystyle|textstyle|limits|quad|qquad|[,;:! ])")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|\.\d+|\\[a-zA-Z]+|[a-zA-Z]|\*\*|[-+*/^_(){}\[\]|!,=<>%°]")


class Unreadable(ValueError):
    pass


class _Reader:
    def __init__(self, text: str):
        text = _DROP.sub(" ", text).replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").replace("\\cdot", "*").replace("\\times", "*").replace("\\div", "/").replace("π", "\\pi ").replace("∞", "\\infty ").replace("−", "-").replace("θ", "\\theta ")
        self.t = _TOKEN.findall(text)
        if re.sub(r"\s", "", text) != "".join(self.t):
            raise Unreadable(text)
        self.i = 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def next(self) -> str:
        x = self.peek()
        self.i += 1
        return x

    def expect(self, x: str) -> None:
        if self.next() != x:
            raise Unreadable(x)

    def all(self):
        e = self.sum()
        if self.peek():
            raise Unreadable(self.peek())
        return e

    def sum(self):
        terms = [self.product()]
        while self.peek() in ("+", "-"):
            op = self.next()
            e = self.product()
            terms.append(e if op == "+" else ("neg", e))
        if len(terms) == 2 and isinstance(terms[1], tuple) and terms[1][0] == "neg":
            return ("-", terms[0], terms[1][1])
        return _balanced("+", terms)

    def product(self):
        over, under = [self.signed()], []
        while True:
            p = self.peek()
            if p in ("*", "/"):
                self.next()
                (over if p == "*" else under).append(self.signed())
            elif p and (p[0].isalnum() or p[0] == "." or p in ("(", "{", "[") or p[0] == "\\" and p[1:] not in ("cup", "cap", "pm", "mp", "le", "leq", "ge", "geq", "ne", "neq", "in", "to", "text", "end")):
                over.append(self.power())
            else:
                break
        e = _balanced("*", over)
        return ("/", e, _balanced("*", under)) if under else e

    def signed(self):
        if self.peek() in ("+", "-"):
            return ("neg", self.signed()) if self.next() == "-" else self.signed()
        return self.power()

    def power(self):
        e = self.atom()
        while True:
            if self.peek() == "!":
                self.next()
                e = ("!", e)
            elif self.peek() in ("%",):
                self.next()
                e = ("/", e, Fraction(100))
            elif self.peek() == "°":
                self.next()
            elif self.peek() in ("^", "**"):
                self.next()
                if self.peek() == "\\circ":
                    self.next()
                    continue
                if self.peek() == "{" and self.t[self.i + 1 : self.i + 3] == ["\\circ", "}"]:
                    self.i += 3
                    continue
                return ("^", e, ("neg", self.power()) if self.peek() == "-" and self.next() else self.argument(power=True))
            else:
                return e

    def argument(self, power: bool = False):
        """A group in braces, or one sign (one digit of a number)."""
        if self.peek() == "{":
            self.next()
            e = self.sum()
            self.expect("}")
            return e
        p = self.peek()
        if p[:1].isdigit() and len(p) > 1 and not power:
            self.t[self.i : self.i + 1] = [p[0], p[1:]]
        return self.power() if power else self.atom()

    def atom(self):
        p = self.next()
        if not p:
            raise Unreadable("end")
        if p[0].isdigit() or p[0] == ".":
            return Fraction(p)
        if p in ("(", "[", "{"):
            e = self.sum()
            self.expect({"(": ")", "[": "]", "{": "}"}[p])
            return e
        if p == "|":
            e = self.sum()
            self.expect("|")
            return ("abs", e)
        if p == "\\frac":
            a = self.argument()
            return ("/", a, self.argument())
        if p == "\\sqrt":
            n = None
            if self.peek() == "[":
                self.next()
                n = self.sum()
                self.expect("]")
            return ("root", self.argument(), n or Fraction(2))
        name = p.lstrip("\\")
        if name in FUNCTIONS:
            base = power = None
            if self.peek() == "_":
                self.next()
                base = self.argument()
            if self.peek() == "^":
                self.next()
                power = self.argument()
            arg = self.argument() if self.peek() == "{" else self.power() if self.peek() == "(" else self.tight()
            if power == ("neg", Fraction(1)):
                name, power = "arc" + name, None
            e = ("fn", name, arg, base)
            return ("^", e, power) if power is not None else e
        if p == "\\pi":
            return ("const", "pi")
        if p == "\\infty":
            return ("const", "inf")
        if p in ("\\mathrm", "\\mathbf", "\\text"):
            return self.argument()
        if p[0] == "\\" and name in GREEK or len(p) == 1 and p.isalpha():
            sub = ""
            if self.peek() == "_":
                self.next()
                sub = str(self.argument())
            return ("const", "e") if p == "e" and not sub else ("const", "i") if p == "i" and not sub else ("sym", name + sub)
        raise Unreadable(p)

    def tight(self):
        """The argument of a function without brackets: factors up to a sign."""
        e = self.power()
        while self.peek() and (self.peek()[0].isalnum() or self.peek() == "\\pi"):
            e = ("*", e, self.power())
        return e


def _balanced(op: str, parts: list):
    """One tree of many terms, of a depth that grows with the logarithm of their number."""
    while len(parts) > 1:
        parts = [(op, a, b) for a, b in zip(parts[::2], parts[1::2])] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def read(text: str):
    return _Reader(text).all()


def symbols(e) -> set[str]:
    if not isinstance(e, tuple):
        return set()
    if e[0] == "sym":
        return {e[1]}
    return set().union(*[symbols(x) for x in e[1:]]) if len(e) > 1 else set()


def evaluate(e, at: dict[str, complex] | None = None):
    """A Fraction where exact, else a complex or infinite float."""
    if isinstance(e, Fraction):
        return e
    if isinstance(e, str) or e is None:
        raise Unreadable(str(e))
    op = e[0]
    if op == "sym":
        if at is None or e[1] not in at:
            raise Unreadable(e[1])
        return at[e[1]]
    if op == "const":
        return {"pi": math.pi, "e": math.e, "i": 1j, "inf": math.inf}[e[1]]
    if op == "neg":
        return -evaluate(e[1], at)
    if op == "abs":
        return abs(evaluate(e[1], at))
    if op == "!":
        n = evaluate(e[1], at)
        if not isinstance(n, Fraction) or n.denominator != 1 or not 0 <= n <= 300:
            raise Unreadable("!")
        return Fraction(math.factorial(int(n)))
    if op == "fn":
        return _function(e[1], evaluate(e[2], at), None if e[3] is None else evaluate(e[3], at))
    a, b = evaluate(e[1], at), evaluate(e[2], at)
    if op == "root":
        if isinstance(a, Fraction) and b == 2 and a >= 0 and math.isqrt(a.numerator) ** 2 == a.numerator and math.isqrt(a.denominator) ** 2 == a.denominator:
            return Fraction(math.isqrt(a.numerator), math.isqrt(a.denominator))
        return complex(a) ** (1 / complex(b))
    if op == "^":
        if isinstance(a, Fraction) and isinstance(b, Fraction) and b.denominator == 1 and abs(b) <= 400 and max(a.numerator.bit_length(), a.denominator.bit_length()) * abs(b) < 60_000:
            return a ** int(b)
        return complex(a) ** complex(b)
    if not (isinstance(a, Fraction) and isinstance(b, Fraction)):
        a, b = (float(x) if isinstance(x, Fraction) else x for x in (a, b))
    return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b


def _function(name: str, x, base):
    x = complex(x)
    if name in ("log", "ln", "lg"):
        return cmath.log(x) / cmath.log(complex(base)) if base is not None else cmath.log(x) / (cmath.log(10) if name == "lg" else 1)
    if name == "exp":
        return cmath.exp(x)
    inverse = name.startswith("arc")
    core = name.removeprefix("arc")
    flip = {"cot": "tan", "sec": "cos", "csc": "sin", "coth": "tanh", "sech": "cosh", "csch": "sinh"}
    if inverse:
        f = getattr(cmath, "a" + flip.get(core, core))
        return f(1 / x) if core in flip else f(x)
    f = getattr(cmath, flip.get(core, core))
    return 1 / f(x) if core in flip else f(x)


def close(a, b, precision: float) -> bool:
    if isinstance(a, Fraction) and isinstance(b, Fraction) and a == b:
        return True
    a, b = complex(a), complex(b)
    if math.isinf(abs(a)) or math.isinf(abs(b)):
        return a == b
    return b != 0 and abs((a - b) / b) <= precision * 1.01 or abs(a - b) <= 1e-12


POINTS = 12


def _values(a, b):
    """Values of both at random points of either sign where both are real; at points where one is not, the other's domain ends."""
    names = sorted(symbols(a) | symbols(b))
    rng = random.Random(zlib.crc32(repr((a, b)).encode()))
    seen = 0
    for k in range(8 * POINTS):
        low = 0.3 if k % 2 else -4.0
        at = {n: complex(rng.uniform(low, 4.0)) for n in names}
        try:
            x, y = complex(evaluate(a, at)), complex(evaluate(b, at))
        except (ZeroDivisionError, OverflowError):
            continue
        if max(abs(x.imag), abs(y.imag)) > 1e-9 * max(1.0, abs(x), abs(y)) or x != x or y != y:
            continue
        yield x.real, y.real
        seen += 1
        if seen == POINTS:
            return


def same_value(a, b, precision: float) -> bool:
    """Equal as numbers, or as functions of their symbols where both are defined."""
    if not symbols(a) and not symbols(b):
        return close(evaluate(a), evaluate(b), precision)
    if not symbols(a) or not symbols(b):
        return False
    seen = 0
    for x, y in _values(a, b):
        if abs(x - y) > 1e-7 * max(1.0, abs(x), abs(y)):
            return False
        seen += 1
    return seen > 0


def steady_ratio(a, b) -> float | None:
    """a / b if it is the same at all points, else None."""
    ratio = None
    for x, y in _values(a, b):
        if abs(x) < 1e-9 and abs(y) < 1e-9:
            continue
        if abs(y) < 1e-12:
            return None
        if ratio is None:
            ratio = x / y
        elif abs(x - ratio * y) > 1e-7 * max(1.0, abs(x), abs(ratio * y)):
            return None
    return ratio
