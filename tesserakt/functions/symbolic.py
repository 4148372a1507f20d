"""Equality of mathematical answers beyond their spelling.

Answers that are alike once normalised, or alike as numbers, are decided by column expressions. Only what is left is parsed: two expressions
are taken as equal if they agree at seeded points, modulo two primes where they are rational, as complex numbers where roots,
functions or constants occur. Tuples, intervals and matrices are compared element by element.
"""

from __future__ import annotations

import cmath
import hashlib
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserakt.functions import grading

# Units that an answer may name, and words for powers of ten.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]
POWERS = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
#: Relative difference at which two numbers count as the same answer.
TOLERANCE = 1e-4
#: Pairs of answers that a worker remembers, as many rollouts give the same answer to the same question.
REMEMBERED = 20_000
PRIMES = (2**61 - 1, 2**31 - 1)
POINTS = 4
#: Greatest exponent that is taken modulo a prime (others are compared as numbers), and the longest expression and deepest nesting that is parsed.
MOST_POWER, LONGEST, DEEPEST = 10_000, 2_000, 60

_TOKEN = re.compile(r"\s*(\d+(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+\.?\d*|\.\d+|\\[A-Za-z]+|\*\*|[A-Za-z]+|[-+*/^(){}\[\]|!=_%])")
_FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "asin": cmath.asin, "acos": cmath.acos, "atan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "abs": lambda z: complex(abs(z))}
_CONSTANTS = {"pi": math.pi, "e": math.e, "i": 1j, "I": 1j, "E": math.e}


class Unreadable(ValueError):
    """Not an expression that can be compared."""


def tokens(text: str) -> list[str]:
    text = re.sub(r"\\(?:left|right|displaystyle|,|;|!|:|quad|\s)", " ", text)
    text = text.replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").replace("π", "\\pi ").replace("√", "\\sqrt ").replace("·", "*").replace("×", "*").replace("−", "-").replace("$", "")
    text = re.sub(r"\^\s*(?:\\circ|\{\s*\\circ\s*\})|°", "", text)
    out, at, text = [], 0, text.strip()
    if len(text) > LONGEST:
        raise Unreadable(text[:20])
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(text)
        out.append(m[1])
        at = m.end()
    return out


class Reader:
    """Recursive descent over tokens; trees are tuples of an operation and its operands."""

    def __init__(self, text: str) -> None:
        self.left, self.depth = tokens(text)[::-1], 0

    def next(self) -> str:
        return self.left[-1] if self.left else ""

    def take(self, *wanted: str) -> bool:
        if self.next() in wanted and self.left:
            self.left.pop()
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise Unreadable(wanted)

    def whole(self) -> tuple:
        out = self.sum()
        if self.left:
            raise Unreadable(self.next())
        return out

    def sum(self) -> tuple:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unreadable("depth")
        out = self.product()
        while self.next() in ("+", "-") and self.left:
            sign = self.left.pop()
            right = self.product()
            out = ("+", out, right if sign == "+" else ("neg", right))
        self.depth -= 1
        return out

    def product(self) -> tuple:
        out = self.signed()
        while self.left:
            if self.take("*", "**", "\\cdot", "\\times"):
                out = ("*", out, self.signed())
            elif self.take("/", "\\div"):
                out = ("/", out, self.signed())
            elif self.next() in ("\\frac",) and out[0] == "number":  # a mixed number
                out = ("+", out, self.power())
            elif self.next()[0] in "({|\\" or self.next()[0].isalnum() or self.next()[0] == ".":
                if self.next() in ("|", "\\begin", "\\end", "\\text", "\\%"):
                    break
                mixed = out[0] == "number" and self.next()[0].isdigit()
                right = self.power()
                if mixed and self.take("/"):  # as in 7 3/4
                    out = ("+", out, ("/", right, self.power()))
                elif mixed:
                    raise Unreadable("two numbers")
                else:
                    out = ("*", out, right)
            else:
                break
        return out

    def signed(self) -> tuple:
        if self.take("-"):
            return ("neg", self.signed())
        return self.signed() if self.take("+") else self.power()

    def power(self) -> tuple:
        base = self.atom()
        if self.take("^", "**"):
            return ("^", base, self.signed() if self.next() == "-" else self.power())
        return base

    def group(self) -> tuple:
        """What a command takes: braces or a single token; digits that stand together are split, as in \\frac12."""
        if self.take("{"):
            out = self.sum()
            self.need("}")
            return out
        word = self.next()
        if len(word) > 1 and word[0].isalnum():
            self.left[-1:] = [word[1:], word[0]]
        return self.atom()

    def atom(self) -> tuple:
        if not self.left:
            raise Unreadable("end")
        word = self.left.pop()
        for a, b in (("(", ")"), ("{", "}"), ("[", "]"), ("|", "|")):
            if word == a:
                out = self.sum()
                self.need(b)
                return ("abs", out) if a == "|" else out
        if word[0].isdigit() or word[0] == ".":
            return ("number", word.replace(",", ""))
        name = word.lstrip("\\")
        if name == "frac":
            return ("/", self.group(), self.group())
        if name == "sqrt":
            if self.take("["):
                root = self.sum()
                self.need("]")
                return ("^", self.group(), ("/", ("number", "1"), root))
            return ("^", self.group() if word[0] == "\\" else self.atom(), ("/", ("number", "1"), ("number", "2")))
        if name in _FUNCTIONS:
            power = self.atom() if self.take("^") else None
            of = ("call", name, self.atom() if self.next() in ("(", "{") else self.power())
            return ("^", of, power) if power else of
        if word[0] == "\\" or name in _CONSTANTS or len(name) == 1:
            return ("constant", name) if name in _CONSTANTS else self.letter(name)
        out = None  # letters that stand together are factors
        for c in name:
            one = ("constant", c) if c in _CONSTANTS and c != "E" and c != "I" else self.letter(c)
            out = one if out is None else ("*", out, one)
        return out

    def letter(self, name: str) -> tuple:
        if not name[0].isalpha() or name in ("begin", "end", "text", "cup", "cap", "infty", "in", "le", "ge", "leq", "geq", "neq"):
            raise Unreadable(name)
        if self.take("_"):
            return ("letter", f"{name}_{self.group()}")
        return ("letter", name)


def draw(name: str, point: int) -> float:
    """A number from 0 to 1 for a letter at a point."""
    return int.from_bytes(hashlib.md5(f"{name}:{point}".encode()).digest()[:8], "big") / 2**64


def modulo(tree: tuple, point: int, p: int) -> int:
    """Value modulo a prime; raises for what isn't rational, and ZeroDivisionError where a denominator vanishes."""
    kind, *of = tree
    if kind == "number":
        whole, _, part = of[0].partition(".")
        return int(whole + part or "0") * pow(pow(10, len(part), p), -1, p) % p if part else int(whole or "0") % p
    if kind == "letter":
        return int(draw(of[0], point) * 2**64) % p
    if kind == "^":
        exponent = whole_number(of[1])
        if exponent is None or abs(exponent) > MOST_POWER:
            raise Unreadable("power")
        base = modulo(of[0], point, p)
        if exponent < 0 and not base:
            raise ZeroDivisionError
        return pow(base, exponent, p)
    if kind in ("constant", "call", "abs"):
        raise Unreadable(kind)
    values = [modulo(x, point, p) for x in of]
    if kind == "neg":
        return -values[0] % p
    if kind == "/":
        if not values[1]:
            raise ZeroDivisionError
        return values[0] * pow(values[1], -1, p) % p
    return (values[0] + values[1] if kind == "+" else values[0] * values[1]) % p


def whole_number(tree: tuple) -> int | None:
    if tree[0] == "neg":
        n = whole_number(tree[1])
        return None if n is None else -n
    return int(tree[1]) if tree[0] == "number" and tree[1].isdigit() and len(tree[1]) < 9 else None


def number(tree: tuple, point: int) -> complex:
    """Value as a complex number; letters lie on both sides of zero, so that a root of a square isn't taken for its base."""
    kind, *of = tree
    if kind == "number":
        return complex(float(of[0]))
    if kind == "constant":
        return complex(_CONSTANTS[of[0]])
    if kind == "letter":
        return complex(4 * draw(of[0], point) - 2, 3 * draw(of[0], point + 1000) - 1.5)
    if kind == "call":
        return complex(_FUNCTIONS[of[0]](number(of[1], point)))
    values = [number(x, point) for x in of]
    if kind == "neg":
        return -values[0]
    if kind == "abs":
        return complex(abs(values[0]))
    if kind == "^":
        return values[0] ** values[1]
    if kind == "/":
        return values[0] / values[1]
    return values[0] + values[1] if kind == "+" else values[0] * values[1]


def letters(tree: tuple) -> set[str]:
    return {tree[1]} if tree[0] == "letter" else set().union(*(letters(x) for x in tree[1:] if isinstance(x, tuple)))


def identical(a: tuple, b: tuple) -> bool:
    """Whether two trees have the same value at all points."""
    try:
        tried = [(modulo(a, k, p), modulo(b, k, p)) for p in PRIMES for k in range(POINTS)]
        return all(x == y for x, y in tried)
    except (Unreadable, ZeroDivisionError):
        pass
    pairs = []
    for k in range(2 * POINTS):
        try:
            pairs.append((number(a, k), number(b, k)))
        except (ZeroDivisionError, OverflowError, ValueError):
            continue
    return len(pairs) >= POINTS and all(cmath.isclose(x, y, rel_tol=1e-8, abs_tol=1e-12) for x, y in pairs)


def same_value(a: str, b: str) -> bool:
    """Whether two expressions are identical, or constants within the tolerance."""
    try:
        one, two = Reader(a).whole(), Reader(b).whole()
        if identical(one, two):
            return True
        if letters(one) | letters(two):
            return False
        return cmath.isclose(number(one, 0), number(two, 0), rel_tol=TOLERANCE)
    except (Unreadable, ZeroDivisionError, OverflowError, ValueError, RecursionError):
        return False


def digits(text: str) -> float | None:
    try:
        return float(text.replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


def elements(text: str) -> tuple[str, list[str]]:
    """Kind and elements: cells of a matrix by row, parts of a bracketed or bare list at its outer commas."""
    matrix = re.fullmatch(r"\s*\\begin\{([bpv]?matrix)\}(.*)\\end\{\1\}\s*", text, re.DOTALL)
    if matrix:
        rows = [r.split("&") for r in re.split(r"\\\\|\\(?=[\s\d-])", matrix[2]) if r.strip()]
        return f"matrix{[len(r) for r in rows]}", [c.strip() for r in rows for c in r]
    listed = re.fullmatch(r"\s*(?:Matrix\()?\[\s*(\[.*\])\s*\]\)?\s*", text, re.DOTALL)
    if listed:
        rows = [r.split(",") for r in re.findall(r"\[([^\[\]]*)\]", listed[1])]
        return f"matrix{[len(r) for r in rows]}", [c.strip() for r in rows for c in r]
    for name, pattern in (("[{}]", "Interval"), ("[{})", "Interval.Ropen"), ("({}]", "Interval.Lopen"), ("({})", "Interval.open"), ("({})", "Point")):
        found = re.fullmatch(re.escape(pattern) + r"\((.*)\)", text.strip())
        text = name.format(found[1]) if found else text
    text = re.sub(r"\\left|\\right", "", text).strip()
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text) if not re.match(r"[\[(]", text) else text
    depth, parts, here = 0, [], ""
    inside = text[1:-1] if len(text) > 2 and text[0] in "([" and text[-1] in ")]" else text
    for c in inside:
        depth += (c in "([{") - (c in ")]}")
        if depth < 0:
            return "", [text]
        if c == "," and not depth:
            parts.append(here.strip())
            here = ""
        else:
            here += c
    parts.append(here.strip())
    if len(parts) == 1:
        return "", [text]
    return (text[0] + text[-1] if inside is not text else ""), parts


@lru_cache(maxsize=REMEMBERED)
def alike(a: str, b: str) -> bool:
    """Whether an answer matches: as text, as a number (percentages too), element by element, or as an expression."""
    if a.strip().lower() == b.strip().lower() or a.replace(" ", "") == b.replace(" ", ""):
        return True
    a, b = (re.sub(r"^(\d+(?:\.\d+)?)\\?%$", r"\1", x.strip().removeprefix("$") if re.match(r"\$\d", x.strip()) else x.strip()) for x in (a, b))
    x, y = digits(a), digits(b)
    if x is not None and y is not None:
        return any(math.isclose(z, x, rel_tol=TOLERANCE) for z in (y / 100, y, y * 100))
    if not a or not b:
        return False
    (kind, left), (other, right) = elements(a), elements(b)
    if len(left) > 1 or len(right) > 1:
        return len(left) == len(right) and (kind == other or not kind or not other) and all(alike(p, q) for p, q in zip(left, right, strict=True))
    return same_value(a, b)


def normalised(answer: Column) -> Column:
    """An answer without units, currency, outer braces and spaces after signs, in lower case; words for powers of ten written out."""
    x = F.regexp_replace(answer, r"^\\text\{(.+?)\}$", "$1")
    x = F.regexp_replace(x, r"\\?[%$]", "")
    x = F.regexp_replace(x, r" (?:or|and) ", " , ")
    for word, power in POWERS:
        x = F.replace(x, F.lit(word), F.lit(power))
    x = F.regexp_replace(x, rf"(?:{'|'.join(UNITS)})(es)?(s)? *(\^[0-9]+)?", "")
    x = F.regexp_replace(x, r"\^ *\\circ", "")
    x = F.regexp_replace(x, r"^\{(.*)\}$", "$1")
    x = F.regexp_replace(x, r",\\! *", "")
    x = F.regexp_replace(F.regexp_replace(x, r"- *", "-"), r"([0-9]) +([0-9])", "$1+$2")
    x = F.regexp_replace(F.lower(F.trim(x)), r"(?<=\d),(?=\d{3}(?:$|\D))", "")
    return F.regexp_replace(x, r"^(-?\d+)\.0*$", "$1")


def _number(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\{,\}|,", "").try_cast("double")


def answers_equal(given: Column, truth: Column) -> Column:
    """Whether a given answer is the true one; false if either is null.

    Only what spelling and numbers don't decide is parsed.
    """
    close = lambda x, y: F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y))
    x, y = _number(given), _number(truth)
    plain = normalised(given), normalised(truth)
    spelt = F.coalesce((plain[0] == plain[1]) | grading.same_latex(F.trim(given), F.trim(truth)), F.lit(False))
    numeric = F.coalesce(close(x, y / 100) | close(x, y) | close(x, y * 100), F.lit(False))
    missing = given.isNull() | truth.isNull()
    decided = missing | (x.isNotNull() & y.isNotNull())

    @F.pandas_udf("boolean")
    def run(spelt: pd.Series, given: pd.Series, truth: pd.Series, plain_given: pd.Series, plain_truth: pd.Series) -> pd.Series:
        rows = zip(spelt, given, truth, plain_given, plain_truth, strict=True)
        return pd.Series([bool(s) or (isinstance(a, str) and isinstance(b, str) and (alike(a, b) or alike(c, d))) for s, a, b, c, d in rows], dtype=bool)

    return ~missing & (numeric | run(spelt, F.when(~decided, given), truth, *plain))
