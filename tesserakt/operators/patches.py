"""Edits of programs: SEARCH/REPLACE blocks and whole rewrites, both only inside the regions that may change.

A table of patches meets the table of their parent programs by key; each patch then gives its child program, the number of blocks applied and, if
it is refused, the reason. A refused patch leaves the parent's text and applies nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of a region that may change, the comment signs around a line of its own, and the form of a block.
SIDE = re.compile(r"EVOLVE-BLOCK-(START|END)")
COMMENTS = [("#", ""), ("//", ""), ("<!--", r"\s*-->"), ("", "")]
BLOCK = re.compile(r"<{7}\s*SEARCH\s*\n(.*?)\n\s*={7}\s*\n(.*?)\n\s*>{7}\s*REPLACE\s*", re.DOTALL)
# Names that a code fence may have for a language.
FENCES = {"cuda": ["cuda", "cu"], "cpp": ["cpp", "c++", "cc", "cxx"], "python": ["python", "py"], "rust": ["rust", "rs"], "swift": ["swift"], "json": ["json"], "json5": ["json5", "json"], "julia": ["julia", "jl"], "markdown": ["markdown", "md"]}
# What stands for code that may not change.
GAP, TAIL = "<… non-evolvable code omitted …>", "<… non-evolvable tail omitted …>"

NO_REGION, OUTSIDE, NOT_FOUND, NO_CODE, UNCLEAR = "no region may change", "outside the regions", "search text not found", "no code in the patch", "several regions and no mark"


class Refused(Exception):
    """Why a patch can't be applied."""


def marks(text: str) -> list[tuple[int, int, str]]:
    """Start, end and side of each mark, with the white space before it and then a comment sign; its fixed letters are searched first, as a search that begins with optional parts is slow."""
    out, done = [], 0
    for m in SIDE.finditer(text):
        at = done + len(text[done : m.start()].rstrip())
        sign = next((x for x in ("//", "#") if text.endswith(x, done, at)), "")
        out.append((at - len(sign), m.end(), m[1]))
        done = m.end()
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Where a text may change, as pairs of positions, in the order in which regions end; regions may be nested."""
    opened, out = [], []
    for start, end, side in marks(text):
        if side == "START":
            opened.append(end)
        elif opened:
            out.append((opened.pop(), start))
    return out


def tidy(text: str) -> str:
    return "\n".join(line.rstrip() for line in text.splitlines())


def without_marks(text: str) -> str:
    """Lines that are nothing but a mark lose it."""
    if "EVOLVE-BLOCK-" not in text:
        return text
    for side in ("START", "END"):
        for before, after in COMMENTS:
            text = re.sub(rf"^\s*{before}\s*EVOLVE-BLOCK-{side}{after}\s*$", "", text, flags=re.MULTILINE)
    return text


def shifted(lines: list[str], indent: str) -> list[str]:
    """Lines moved in by an indent, keeping what they have themselves; blank lines become empty."""
    return [indent + " " * (len(x) - len(x.lstrip())) + x.strip() if x.strip() else "" for x in lines]


def located(search: str, text: str) -> tuple[int, int, str | None]:
    """Start and end of a search text, and the indent that it had to be given; the first line's own indent doesn't count then."""
    at = text.find(search)
    if at >= 0:
        return at, at + len(search), None
    first, *rest = search.splitlines()
    if first.strip():
        indents = [x[: len(x) - len(x.lstrip())] for x in text.splitlines() if x.strip() == first.strip()]
        for indent in dict.fromkeys(indents):
            moved = "\n".join([indent + first.strip(), *shifted(rest, indent)])
            at = text.find(moved)
            if at >= 0:
                return at, at + len(moved), indent
    raise Refused(NOT_FOUND)


def replaced(text: str, search: str, replace: str) -> str:
    """The text after one block; a blank search adds at the end of the region that ends last."""
    allowed = regions(text)
    if not search.strip():
        if not allowed:
            raise Refused(NO_REGION)
        at = allowed[-1][1]
        return text[:at] + replace + text[at:]
    start, end, indent = located(search, text)
    if not any(a <= start and end <= b for a, b in allowed):
        raise Refused(OUTSIDE)
    if indent is not None and replace.strip():
        replace = "\n".join(shifted(replace.splitlines(), indent))
    return text[:start] + replace + text[end:]


def with_blocks(program: str, patch: str, strict: bool = True) -> tuple[str, int]:
    """The program after all blocks of a patch, each on what the one before left, and how many were applied."""
    text, n = tidy(program), 0
    for search, replace in BLOCK.findall(without_marks(tidy(patch))):
        try:
            text = replaced(text, tidy(without_marks(search)), tidy(without_marks(replace)))
            n += 1
        except Refused as why:
            if strict or str(why) != NOT_FOUND:
                raise
    return text, n


def fenced(patch: str, language: str) -> str:
    """The first code block under one of the language's names."""
    for name in dict.fromkeys([language, *FENCES[language]]):
        found = re.search(rf"```{re.escape(name)}\s*(.*?)\s*```", patch, re.DOTALL)
        if found and found[1].strip() != "none":
            return found[1].strip()
    raise Refused(NO_CODE)


def rewritten(program: str, code: str) -> str:
    """The program with its regions taken from a whole rewrite.

    A rewrite with both marks gives its regions one by one (missing ones stay). With one mark or none it must be meant for the only
    region; what it repeats of the program outside the marks is left out, and the marks keep lines of their own.
    """
    own = regions(program)
    if not own:
        raise Refused(NO_REGION)
    given = {side: (a, b) for a, b, side in reversed(marks(code))}  # the first of each
    if len(given) == 2:
        new, out, done = regions(code), [], 0
        for i, (a, b) in enumerate(own):
            out += [program[done:a], code[slice(*new[i])] if i < len(new) else program[a:b]]
            done = b
        return "".join([*out, program[done:]])
    if len(own) > 1:
        raise Refused(UNCLEAR)
    (start, end), = own
    head = next(program[:a] for a, b, _ in marks(program) if b == start)
    foot = next(program[b:] for a, b, _ in marks(program) if a == end)
    feet = [foot, foot.rstrip("\r\n")]
    if "START" in given:
        code = code[given["START"][1] :]
        code = next((code[: len(code) - len(x)] for x in feet if x and code.endswith(x)), code)
    elif "END" in given:
        code = code[: given["END"][0]]
        code = next((code[len(x) :] for x in (head, head.rstrip("\r\n")) if x and code.startswith(x)), code)
    elif code.startswith(head) and any(code.endswith(x) for x in feet):
        code = code[len(head) : len(code) - len(next(x for x in feet if code.endswith(x)))]
    if code:
        code = ("" if code.startswith("\n") else "\n") + code + ("" if code.endswith("\n") else "\n")
    return program[:start] + code + program[end:]


def _child(kind: str | None, program: str | None, patch: str | None, language: str | None, strict: bool) -> tuple[str | None, int, str | None]:
    if program is None or patch is None:
        return program, 0, None
    try:
        if kind == "full":
            return rewritten(program, fenced(patch, language if language in FENCES else "python")), 1, None
        return *with_blocks(program, patch, strict), None
    except Refused as why:
        return program if kind == "full" else tidy(program), 0, str(why)


def child(kind: Column, program: Column, patch: Column, language: Column, strict: bool = True) -> Column:
    """Struct of text, applied and reason; kind is 'diff' for blocks or 'full' for a rewrite. A null program or patch applies nothing."""

    @F.pandas_udf("text string, applied int, reason string")
    def run(kind: pd.Series, program: pd.Series, patch: pd.Series, language: pd.Series) -> pd.DataFrame:
        rows = [_child(*row, strict) for row in zip(kind, program, patch, language, strict=True)]
        return pd.DataFrame(rows, columns=["text", "applied", "reason"])

    return run(kind, program, patch, language)


def children(programs: DataFrame, patches: DataFrame, strict: bool = True) -> DataFrame:
    """Of programs (program_id, text, language) and patches (patch_id, program_id, kind, patch): patch_id, program_id, text, applied, reason.

    A join on the parent's key, so that a parent with many patches is split as any skewed key is; patches of unknown parents are left out.
    """
    rows = patches.join(programs.select("program_id", F.col("text").alias("program"), "language"), "program_id")
    made = child(F.col("kind"), F.col("program"), F.col("patch"), F.col("language"), strict)
    return rows.select("patch_id", "program_id", made.alias("made")).select("patch_id", "program_id", "made.text", "made.applied", "made.reason")


def redacted(program: Column, with_gaps: bool = True) -> Column:
    """What may change, with a line for each stretch that may not."""

    @F.pandas_udf("string")
    def run(program: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            parts = [text[a:b] for a, b in regions(text)]
            return "".join([x for p in parts for x in (GAP, p)] + [TAIL]) if with_gaps else "".join(parts)

        return program.map(one, na_action="ignore")

    return run(program)


def diff_summary(diff: Column) -> Column:
    """Of a unified diff: an array of path, added, deleted, modified, a file each; a hunk's additions and deletions pair up as modifications."""
    files = F.filter(F.split(F.concat(F.lit("\n"), diff), r"\n--- "), lambda x: F.contains(x, F.lit("\n+++ ")))

    def of_file(x: Column) -> Column:
        path = F.regexp_replace(F.regexp_extract(x, r"\n\+\+\+ ([^\t\n]*)", 1), "^b/", "")
        hunks = F.split(x, r"\n@@ [^\n]*")
        counts = F.transform(F.slice(hunks, F.lit(2), F.greatest(F.size(hunks) - 1, F.lit(0))), lambda h: F.struct(F.regexp_count(h, F.lit(r"\n\+")).alias("a"), F.regexp_count(h, F.lit(r"\n-")).alias("d")))
        total = lambda f: F.aggregate(counts, F.lit(0), lambda n, c: n + f(c))
        both = lambda c: F.least(c["a"], c["d"])
        return F.struct(path.alias("path"), total(lambda c: c["a"] - both(c)).alias("added"), total(lambda c: c["d"] - both(c)).alias("deleted"), total(both).alias("modified"))

    return F.transform(files, of_file)
