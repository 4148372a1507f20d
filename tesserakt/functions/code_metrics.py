"""Complexity of programs: lines, decisions, nesting, volume, maintainability.

C-like and unknown languages are measured by column expressions. Python is parsed in a small Arrow function; what doesn't parse is measured like C.
"""

from __future__ import annotations

import ast
import io
import math
import tokenize
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision points of C-like code, and the languages measured so.
DECISIONS = [r"\bif\b", r"\belse\b", r"\bwhile\b", r"\bfor\b", r"\bswitch\b", r"\bcase\b", r"\bcatch\b", r"\b\?\b"]
C_LIKE = ["cpp", "c", "cuda", "c++", "rust"]
FIELDS = "cyclomatic_complexity int, average_cyclomatic_complexity double, halstead_volume double, halstead_difficulty double, halstead_effort double, lines_of_code int, logical_lines_of_code int, comments int, maintainability_index double, max_nesting_depth int, complexity_score double"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]
KINDS = [x.split()[1] for x in FIELDS.split(", ")]

_NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.FunctionDef, ast.AsyncFunctionDef)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _own(node: ast.AST) -> int:
    """Decisions that a node adds by itself."""
    if isinstance(node, ast.Try):
        return len(node.handlers) + bool(node.orelse)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, (ast.For, ast.While, ast.AsyncFor)):
        return 1 + bool(node.orelse)
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    return int(isinstance(node, (ast.If, ast.IfExp, ast.Assert)))


def _decisions(node: ast.AST, blocks: list[int]) -> int:
    """Decisions in a node outside functions and classes; of these each gives a block of its own."""
    if isinstance(node, _FUNCTIONS):
        blocks.append(1 + sum(_decisions(x, []) for x in node.body))
        return 0
    if isinstance(node, ast.ClassDef):
        methods: list[int] = []
        body = 1 + sum(_decisions(x, methods) for x in node.body) + sum(methods)
        blocks += [int(body / len(methods)) + (len(methods) > 1) if methods else body, *methods]
        return 0
    return _own(node) + sum(_decisions(x, blocks) for x in ast.iter_child_nodes(node))


def _operands(node: ast.AST) -> tuple[list[str], list[ast.AST]]:
    kind = lambda *ops: [type(o).__name__ for o in ops]
    if isinstance(node, ast.BinOp):
        return kind(node.op), [node.left, node.right]
    if isinstance(node, ast.UnaryOp):
        return kind(node.op), [node.operand]
    if isinstance(node, ast.BoolOp):
        return kind(node.op), node.values
    if isinstance(node, ast.AugAssign):
        return kind(node.op), [node.target, node.value]
    if isinstance(node, ast.Compare):
        return kind(*node.ops), [*node.comparators, node.left]
    return [], []


def _volume(tree: ast.AST) -> tuple[float, float, float]:
    """Volume, difficulty and effort from operators and operands; a name counts anew in every function."""
    operators, operands, seen = [], 0, set()
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, where = todo.pop()
        ops, of = _operands(node)
        operators += ops
        operands += len(of)
        for x in of:
            name = x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else x.value if isinstance(x, ast.Constant) else id(x)
            seen.add((where, type(name).__name__, name))
        todo += [(x, node.name if isinstance(node, _FUNCTIONS) else where) for x in (node.body if isinstance(node, _FUNCTIONS) else ast.iter_child_nodes(node))]
    h1, h2, n = len(set(operators)), len(seen), len(operators) + operands
    volume = n * math.log2(h1 + h2) if h1 + h2 else 0.0
    difficulty = h1 * operands / (2 * h2) if h2 else 0.0
    return volume, difficulty, difficulty * volume


def _depth(node: ast.AST, at: int = 0) -> int:
    here = at + isinstance(node, _NESTING)
    return max([here, *(_depth(x, here) for x in ast.iter_child_nodes(node))])


def measured(code: str) -> tuple | None:
    """The fields for Python code; None if it can't be parsed."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
        blocks: list[int] = []
        for x in ast.iter_child_nodes(tree):
            _decisions(x, blocks)
        total = sum(blocks)
        volume, difficulty, effort = _volume(tree)
        loc = len(code.splitlines())
        comments = sum(t.type == tokenize.COMMENT for t in tokenize.generate_tokens(io.StringIO(code).readline))
        depth = _depth(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    size = lambda x: math.log2(x) if x > 0 else 0.0
    index = 171 - 5.2 * size(volume) - 0.23 * total - 16.2 * size(loc)
    score = 0.4 * total / 10 + 0.4 * math.log2(volume + 1) / 10 + 0.1 * math.log2(loc + 1) / 10 + 0.1 * depth / 5
    return total, total / len(blocks) if blocks else 0.0, volume, difficulty, effort, loc, sum(isinstance(x, ast.stmt) for x in ast.walk(tree)), comments, index, depth, round(min(score, 1.0), 3)


def c_like(code: Column) -> dict[str, Column]:
    """The fields from lines, decision words and braces."""
    lines = F.transform(F.split(code, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    comment = lambda x: F.startswith(x, F.lit("//")) | F.startswith(x, F.lit("/*")) | F.endswith(x, F.lit("*/"))
    loc, comments = F.size(lines), F.size(F.filter(lines, comment))
    logical = F.size(F.filter(lines, lambda x: (x != "") & ~comment(x)))
    total = F.lit(1)
    for word in DECISIONS:
        total = total + F.regexp_count(code, F.lit("(?i)" + word))
    zero = F.struct(F.lit(0).alias("here"), F.lit(0).alias("most"))

    def step(at: Column, brace: Column) -> Column:
        here = F.greatest(at["here"] + F.when(brace == "{", 1).otherwise(-1), F.lit(0))
        return F.struct(here.alias("here"), F.greatest(at["most"], here).alias("most"))

    depth = F.aggregate(F.regexp_extract_all(code, F.lit("[{}]"), F.lit(0)), zero, step, lambda at: at["most"])
    return {"total": total, "loc": loc, "logical": logical, "comments": comments, "depth": depth}


def code_metrics(df: DataFrame, code: str, language: str, out: str = "metrics") -> DataFrame:
    """df with a struct of the fields; a null program has null."""
    lang = F.lower(F.coalesce(F.col(language), F.lit("")))

    @F.pandas_udf(FIELDS)
    def python(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(measured(c) if isinstance(c, str) else None) or (None,) * len(NAMES) for c in code], columns=NAMES)

    parts = F.struct(*(c.alias(n) for n, c in c_like(F.col(code)).items()))
    df = df.withColumn("_python", python(F.when(lang == "python", F.col(code)))).withColumn("_c", parts)
    total, loc, logical = (F.col(f"_c.{n}").cast("double") for n in ("total", "loc", "logical"))
    least = lambda x: F.greatest(x, F.lit(1.0))
    volume = least(logical * F.log2(least(total)))
    index = F.greatest(F.lit(0.0), 171 - 5.2 * F.log2(volume) - 0.23 * total - 16.2 * F.log2(least(loc)))
    share = lambda x: F.least(x, F.lit(1.0))
    score = 0.4 * share(total / 10) + 0.4 * share(F.log2(volume + 1) / 10) + 0.1 * share(F.log2(loc + 1) / 10) + 0.1 * share(F.col("_c.depth") / 5)
    c = [total, total, volume, F.lit(1.0), volume, loc, logical, F.col("_c.comments"), index, F.col("_c.depth"), F.round(share(score), 3)]
    filled = least(F.size(F.filter(F.split(F.col(code), "\n", -1), lambda x: F.regexp_replace(x, r"\s+", "") != "")).cast("double"))
    real = F.when(F.regexp_replace(F.col(code), r"\s+", "") == "", 0).otherwise(filled)
    generic = [F.lit(1), F.lit(1.0), filled, F.lit(1.0), filled, real, real, F.lit(0), F.lit(100.0), F.lit(1), F.round(share(F.log2(filled) / 10), 3)]
    fields = lambda values: F.struct(*(v.cast(k).alias(n) for v, k, n in zip(values, KINDS, NAMES, strict=True)))
    parsed = F.col("_python.lines_of_code").isNotNull()
    metrics = F.when(F.col(code).isNull(), None).when(parsed, F.col("_python")).when(lang.isin("python", *C_LIKE), fields(c)).otherwise(fields(generic))
    return df.withColumn(out, metrics).drop("_python", "_c")
