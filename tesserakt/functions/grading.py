"""Grading of mathematical answers and tool calls, as column expressions."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserakt.functions import text as tx

# What canonical LaTeX leaves out or writes in another way.
DROPPED = ["\n", "\\!", "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$"]
REWRITTEN = [("tfrac", "frac"), ("dfrac", "frac")]
# Substitutions and words that a final answer loses, in this order.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Fixed value: how an answer line is announced.
ANSWER_LINE = r"(?i)Answer\s*:\s*([^\n]+)"


def _without(x: Column, word: str, by: str = "") -> Column:
    return F.replace(x, F.lit(word), F.lit(by))


def canonical_latex(answer: Column) -> Column:
    """One spelling for answers that differ in spacing, fraction and root shorthand, units or a short left side of an equation."""
    x = answer
    for word in DROPPED[:2]:
        x = _without(x, word)
    x = _without(x, "\\\\", "\\")
    for a, b in REWRITTEN:
        x = _without(x, a, b)
    for word in DROPPED[2:]:
        x = _without(x, word)
    x = F.substring_index(x, "\\text{ ", 1)
    x = _without(x, "\\%")
    x = F.regexp_replace(F.regexp_replace(x, r" \.", " 0."), r"\{\.", "{0.")
    x = F.regexp_replace(x, r"^\.", "0.")
    x = F.regexp_replace(x, r"^[^=]{0,2}=([^=]*)$", "$1")
    x = F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}")
    x = _without(x, " ")
    x = F.regexp_replace(x, r"\\frac([^{\\])([^{\\])", r"\\frac{$1}{$2}")
    x = F.regexp_replace(x, r"\\frac([^{\\])\{", r"\\frac{$1}{")
    x = F.regexp_replace(x, r"^0\.5$", r"\\frac{1}{2}")
    return F.regexp_replace(x, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def same_latex(a: Column, b: Column) -> Column:
    """Whether both are the same once canonical; two nulls are, one isn't."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(canonical_latex(a) == canonical_latex(b))


def math_score(solution: Column, gold: Column) -> Column:
    """1 if the last boxed answer is the gold one."""
    return F.when(F.coalesce(canonical_latex(tx.last_boxed(solution)) == canonical_latex(gold), F.lit(False)), 1.0).otherwise(0.0)


def final_answer(answer: Column) -> Column:
    """What follows the last equals sign, without units, fillers, markup of text and thousands separators."""
    x = F.substring_index(answer, "=", -1)
    for a, b in SUBSTITUTIONS:
        x = _without(x, a, b)
    for word in REMOVED:
        x = _without(x, word)
    x = F.regexp_replace(x, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for command in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, r"\\" + command + r"\{(.*?)\}", "$1")
    x = F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(x, "frac([^{])(.)", "frac{$1}{$2}")
    x = F.regexp_replace(x, "sqrt([^{])", "sqrt{$1}")
    x = _without(x, "$")
    return F.trim(F.when(_without(x, ",").rlike("^[0-9]+$"), _without(x, ",")).otherwise(x))


def answer_line(solution: Column) -> Column:
    """The last announced answer, or a mark that there is none."""
    found = F.regexp_extract_all(solution, F.lit(ANSWER_LINE), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit("[INVALID]"))


def announced_score(solution: Column, gold: Column, longest: int = 300) -> Column:
    """1 if the answer announced in the last characters is the gold one, else -1."""
    end = F.when(F.length(solution) > longest, F.substring(solution, -longest, longest)).otherwise(solution)
    return F.when(final_answer(answer_line(end)) == final_answer(gold), 1.0).otherwise(-1.0)


def strictly_boxed_score(solution: Column, gold: Column, longest: int = 100) -> Column:
    """1 if the last boxed answer among the last characters is the gold one to the letter, else -1."""
    end = F.when(F.length(solution) > longest, F.substring(solution, -longest, longest)).otherwise(solution)
    return F.when(F.coalesce(tx.last_boxed(end) == gold, F.lit(False)), 1.0).otherwise(-1.0)


def thought_and_boxed(solution: Column) -> Column:
    """1 if a thought comes before a boxed answer."""
    return F.when(solution.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def geometry_score(solution: Column, gold: Column, share: float = 0.1) -> Column:
    """Mostly the answer, a little the form."""
    return (1 - share) * math_score(solution, gold) + share * thought_and_boxed(solution)


def tagged_integer_score(solution: Column, gold: Column, wrong: float = 0.1) -> Column:
    """1 for the right integer in the last answer tag after the speaker's mark, a little for another integer, else 0."""
    said = F.when(F.contains(solution, F.lit("Assistant:")), F.regexp_replace(solution, r"(?s)^.*?Assistant:", ""))
    tags = F.regexp_extract_all(said, F.lit(r"<answer>(.*?)</answer>"), F.lit(1))
    number = F.trim(F.get(tags, F.size(tags) - 1)).try_cast("long")
    return F.when(number.isNull(), 0.0).when(number == gold.cast("long"), 1.0).otherwise(wrong)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Pow: operator.pow, ast.UAdd: operator.pos, ast.USub: operator.neg}


def arithmetic(equation: str) -> float | None:
    """The value of numbers, + - * / and brackets; None if it is anything else or has none."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS and not isinstance(node.op, ast.Pow):
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        raise ValueError("no arithmetic")

    try:
        return float(value(ast.parse(equation.strip(), mode="eval")))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def evaluated(equation: Column) -> Column:
    """arithmetic() of a column: the one step that has no form in SQL."""

    def run(equations: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else arithmetic(e) for e in equations], dtype="float64")

    run.__annotations__ = {"equations": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(equation)


def same_numbers(equation: Column, numbers: Column) -> Column:
    """Whether the integers of an equation are the given ones, each used once."""
    found = F.transform(F.regexp_extract_all(equation, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    return F.array_sort(found) == F.array_sort(F.transform(numbers, lambda x: x.cast("long")))


def countdown_score(equation: Column, numbers: Column, target: Column, form: float = 0.1) -> Column:
    """1 if the equation uses the numbers once each and comes to the target, a little for any equation, else 0."""
    right = same_numbers(equation, numbers) & equation.rlike(r"^[0-9+\-*/().\s]+$") & (F.abs(evaluated(equation) - target) < 1e-5)
    return F.when(equation.isNull(), 0.0).when(F.coalesce(right, F.lit(False)), 1.0).otherwise(form)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Common elements over all elements, as often as they occur; 1 for equal lists, 0 if one is empty."""
    both = tx.overlap(a, b)
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def call_form(response: Column, gold: Column, right: float = 1.0, wrong: float = 0.0) -> Column:
    """Whether the response has the parts that the gold one has, in order and once: a thought, tool calls, an answer."""
    # The tags of the parts and how they are laid out.
    once = lambda tag: (F.size(F.split(response, f"<{tag}>")) == 2) & (F.size(F.split(response, f"</{tag}>")) == 2)
    asks, calls = F.contains(gold, F.lit("<response>")), F.contains(gold, F.lit("<tool_call>"))
    both = response.rlike(r"(?s)^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>$") & once("tool_call") & once("response")
    call = response.rlike(r"(?s)^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>$") & once("tool_call")
    answer = response.rlike(r"(?s)^<think>.*?</think>\n<response>.*?</response>$") & once("response")
    good = F.when(asks & calls, both).when(calls, call).when(asks, answer).otherwise(response.rlike(r"(?s)^<think>.*?</think>$"))
    return F.when(good, right).otherwise(wrong)


def within_relative(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Whether two numbers agree within a share of the second."""
    return F.abs(a - b) <= tolerance * F.abs(b)


# The names of sources. Scorers by what a name begins with; each takes the solution and the gold answer.
ROUTES = {
    "openai/gsm8k": lambda s, g: F.when(F.coalesce(tx.final_number(s) == g, F.lit(False)), 1.0).otherwise(0.0),
    "lighteval/MATH": math_score,
    "DigitalLearningGmbH/MATH-lighteval": math_score,
    "HuggingFaceH4/MATH-500": math_score,
    "math_dapo": announced_score,
    "aime": announced_score,
    "hiyouga/geometry3k": geometry_score,
    "multiply": tagged_integer_score,
}


def routed_score(source: Column, solution: Column, gold: Column) -> Column:
    """The score by the scorer of the row's source; a source that nobody scores is an error of the whole query, so filter such rows before."""
    out = None
    for name, scorer in ROUTES.items():
        test = F.startswith(source, F.lit(name))
        out = F.when(test, scorer(solution, gold)) if out is None else out.when(test, scorer(solution, gold))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double"))


def first_json_array(text: Column) -> Column:
    """Strings of the first JSON array in a text, null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), "array<string>")


def retrieved_right(text: Column, golds: Column) -> Column:
    """Whether a retrieved block holds a gold answer, both normalised."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<information>(.*?)</information>"), F.lit(1))
    return F.exists(blocks, lambda b: F.exists(golds, lambda g: F.contains(tx.normalise_answer(b), tx.normalise_answer(g))))


def generic_code_metrics(code: Column) -> Column:
    """Lines, and a complexity from their number: log2 / 10, 1 at most."""
    lines = F.size(F.filter(F.split(code, "\n"), lambda x: F.trim(x) != ""))
    return F.struct(F.size(F.split(code, "\n")).alias("loc"), lines.alias("lloc"), F.round(F.least(F.log2(lines + 1) / 10, F.lit(1.0)), 3).alias("complexity"))


def search_score(text: Column, golds: Column, at_least: int = 2, right: float = 1.0, form: float = 0.0, most_tags: int = 10) -> Column:
    """Exact match of the last answer tag; a quarter where answer tags are piled up; `form` for a wrong answer, 0 for none."""
    answer = tx.last_answer(text, at_least)
    many = (tx.count_of(text, "<answer>") > most_tags) | (tx.count_of(text, "</answer>") > most_tags)
    return F.when(answer.isNull(), 0.0).when(tx.exact_match(answer, golds) == 1, F.when(many, right / 4).otherwise(right)).otherwise(form)


def substring_score(text: Column, golds: Column, at_least: int = 2, right: float = 1.0, form: float = 0.0) -> Column:
    """The same where a gold answer may stand anywhere in the answer."""
    answer = tx.last_answer(text, at_least)
    return F.when(answer.isNull(), 0.0).when(tx.contains_match(answer, golds) == 1, right).otherwise(form)


def goal_value(value: Column) -> Column:
    """An evaluated goal as a number from 0 to 1; what has no finite value is 0."""
    x = value.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
