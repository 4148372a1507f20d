"""Claims about who tells the truth: puzzles in which every person says one thing, and texts that reason about them.

A statement is a nested list, as JSON or with brackets of tuples: ["telling-truth", i], ["lying", i], ["not", s], ["and", s, ...], ["or", s, ...],
["->", s, t], ["<=>", s, t]; i is a person's number. Formulas are rows; each is solved by branching over the persons it names, cut short where a
part-way assignment already decides it. Paragraphs, claims and goals are rows too, made and counted by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a text says where it finds an assumption possible or impossible, and the openings of paragraphs that claim nothing.
POSSIBLE = ["No contradiction", "consistent", "No issues", "holds without", "does not contradict"]
IMPOSSIBLE = [r"(\w+)\s+cannot\s+be\s+(?:a\s+)?(knight|knave)", r"(\w+)\s+being\s+(?:a\s+)?(knight|knave)\s+is\s+impossible", r"If\s+(\w+)\s+were\s+(?:a\s+)?(knight|knave)"]
ROLE = r"(\w+)\s+is\s+(?:a\s+)?(knight|knave)"
ASSUMED = r"^Assume\s+(.+?)\."
OPENINGS = ["Let", "I ", "To "]
FINAL = "### Final Answer"
# What confirms a goal.
CONFIRMED = r"(?:No contradiction|No issues|consistent|holds without)"

#: Puzzles with assumptions that a worker remembers.
REMEMBERED = 20_000

Known = dict[int, bool]


def value(statement: list, known: Known) -> bool | None:
    """A statement's truth under what is known of the persons; None if that doesn't decide it."""
    kind, *of = statement
    if kind in ("telling-truth", "lying"):
        said = known.get(of[0])
        return said if said is None or kind == "telling-truth" else not said
    values = [value(s, known) for s in of]
    if kind == "not":
        return None if values[0] is None else not values[0]
    if kind in ("and", "or", "->"):
        if kind == "->" and values[0] is not None:
            values[0] = not values[0]
        decides = kind != "and"
        return decides if decides in values else None if None in values else not decides
    if kind == "<=>":
        return None if None in values else values[0] == values[1]
    raise ValueError(f"not a statement: {statement}")


def named(statement: list) -> set[int]:
    return {statement[1]} if statement[0] in ("telling-truth", "lying") else set().union(*map(named, statement[1:]))


def models(constraints: list[list], free: list[int], known: Known) -> Iterator[Known]:
    """The assignments of the free persons under which all constraints hold, truth first."""
    values = [value(c, known) for c in constraints]
    if False in values:
        return
    if not free:
        yield dict(known)
        return
    for truth in (True, False):
        yield from models([c for c, v in zip(constraints, values, strict=True) if v is None], free[1:], known | {free[0]: truth})


def _statements(text: str) -> list[list]:
    return json.loads(text.replace("'", '"').replace("(", "[").replace(")", "]").replace(",]", "]"))


def solutions(statements: Column) -> Column:
    """Struct of n, the assignments under which every person is truthful exactly if their statement holds, and first, one of them; null for null."""

    @F.pandas_udf("n long, first array<boolean>")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for text in column:
            if text is None:
                rows.append((None, None))
                continue
            said = _statements(text)
            n, first = 0, None
            for m in models([["<=>", ["telling-truth", i], s] for i, s in enumerate(said)], list(range(len(said))), {}):
                n, first = n + 1, first or [m[i] for i in range(len(said))]
            rows.append((n, first))
        return pd.DataFrame(rows, columns=["n", "first"])

    return run(statements)


def _consistent(text: str | None, roles: list | None) -> bool | None:
    if text is None or roles is None:
        return None
    return _can_all(text, tuple(None if r is None else bool(r) for r in roles))


@lru_cache(maxsize=REMEMBERED)
def _can_all(text: str, roles: tuple[bool | None, ...]) -> bool:
    """Many texts reason about the same puzzle: what a worker has solved it remembers."""
    said, known = _statements(text), {i: r for i, r in enumerate(roles) if r is not None}
    demands = [said[i] if truth else ["not", said[i]] for i, truth in known.items() if i < len(said)]
    return all(next(models([d], sorted(named(d) - known.keys()), known), None) is not None for d in demands)


def consistent(statements: Column, assumed: Column) -> Column:
    """Whether the statement of every person whose role is assumed (true: truthful, false: not, null: open) can come out as that role demands, each by itself."""

    @F.pandas_udf("boolean")
    def run(column: pd.Series, assumed: pd.Series) -> pd.Series:
        return pd.Series([_consistent(t, r) for t, r in zip(column, assumed, strict=True)], dtype=object)

    return run(statements, assumed)


def claims(texts: DataFrame) -> DataFrame:
    """Of texts (text_id, text, names, statements): a row for each claim, with paragraph, possible (whether the text says so) and assumed."""
    parts = texts.select("text_id", "names", "statements", F.posexplode(F.split("text", "\n\n")).alias("paragraph", "part")).withColumn("part", F.trim(F.regexp_replace("part", r"^\s+|\s+$", "")))
    opening = F.lit(False)
    for x in OPENINGS:
        opening |= F.startswith("part", F.lit(x))
    parts = parts.filter((F.col("part") != "") & ~opening & ~F.contains("part", F.lit(FINAL)))
    possible = F.col("part").rlike("(?i)" + "|".join(POSSIBLE))
    refused = [F.col("part").rlike("(?i)" + p) for p in IMPOSSIBLE]
    where = F.when(possible, F.lit(None))
    who, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p, hit in reversed(list(zip(IMPOSSIBLE, refused, strict=True))):
        who = F.when(hit, F.regexp_extract("part", "(?i)" + p, 1)).otherwise(who)
        role = F.when(hit, F.regexp_extract("part", "(?i)" + p, 2)).otherwise(role)
    given = F.regexp_extract("part", "(?d)" + ASSUMED, 1)
    pair = lambda g: F.regexp_extract_all(given, F.lit("(?i)" + ROLE), F.lit(g))
    rows = parts.select(
        "text_id", "paragraph", "names", "statements", possible.alias("possible"), F.col("part").rlike("(?d)" + ASSUMED).alias("assumes"),
        F.arrays_zip(pair(1).alias("who"), pair(2).alias("role")).alias("roles"), F.when(possible, where).otherwise(who).alias("who"), role.alias("role"),
    )
    rows = rows.filter((F.col("possible") & F.col("assumes")) | F.exists("names", lambda n: F.lower(n) == F.lower(F.col("who"))))
    same = lambda n: F.filter("roles", lambda r: F.lower(r["who"]) == F.lower(n))

    def assumed(n: Column) -> Column:
        said = F.when(F.size(same(n)) > 0, F.lower(F.element_at(same(n), -1)["role"]) == "knight")
        return F.when(F.lower(F.col("who")) == F.lower(n), F.lower(F.col("role")) == "knight").otherwise(said)

    return rows.select("text_id", "paragraph", "possible", F.transform("names", assumed).alias("assumed"), "statements")


def claim_counts(texts: DataFrame) -> DataFrame:
    """text_id, n_correct, n_wrong: how many claims of each text hold; a text without claims has 0 and 0."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [_consistent(t, r) for t, r in zip(rows["statements"], rows["assumed"], strict=True)]
            yield pd.DataFrame({"text_id": rows["text_id"], "right": [f == p for f, p in zip(found, rows["possible"], strict=True)]})

    kind = dict(texts.dtypes)["text_id"]
    checked = claims(texts).select("text_id", "possible", "assumed", "statements").mapInPandas(check, f"text_id {kind}, right boolean")
    counts = checked.groupBy("text_id").agg(F.count_if("right").alias("n_correct"), F.count_if(~F.col("right")).alias("n_wrong"))
    return texts.select("text_id").join(counts, "text_id", "left").fillna(0, ["n_correct", "n_wrong"])


def goals(puzzles: DataFrame) -> DataFrame:
    """Of puzzles (puzzle_id, names, solution): the goals of solving them, as rows (puzzle_id, goal, parent, level, kind, persons: array of name and role)."""
    role = lambda truth: F.when(truth, "knight").otherwise("knave")
    one = F.explode(F.transform(F.arrays_zip("names", "solution"), lambda p: F.struct(p["names"].alias("name"), role(p["solution"]).alias("role"), role(~p["solution"]).alias("other")))).alias("p")
    people = puzzles.select("puzzle_id", "names", "solution", one)
    name, own, other = F.col("p.name"), F.col("p.role"), F.col("p.other")
    person = lambda n, r: F.struct(n.alias("name"), r.alias("role"))
    goal = lambda kind, tag, *persons: F.struct(F.concat(F.lit("L3_"), name, tag).alias("goal"), F.lit(kind).alias("kind"), F.array(*persons).alias("persons"))
    steps = F.array(
        goal("assumed", F.concat(F.lit("_try_"), other), person(name, other)), goal("refuted", F.concat(F.lit("_contra_"), other), person(name, other)),
        goal("assumed", F.concat(F.lit("_try_"), own), person(name, own)), goal("confirmed", F.concat(F.lit("_confirm_"), own), person(name, own)),
    )
    others = F.filter(F.arrays_zip("names", "solution"), lambda q: q["names"] != name)
    both = F.transform(others, lambda q: F.struct(F.concat(F.lit("L3_"), name, F.lit("+"), q["names"]).alias("goal"), F.lit("assumed").alias("kind"), F.array(person(name, own), person(q["names"], role(q["solution"]))).alias("persons")))
    above = F.concat(F.lit("L2_"), name)
    third = people.select("puzzle_id", F.explode(F.concat(steps, both)).alias("g"), above.alias("parent")).select("puzzle_id", "g.goal", "parent", F.lit(3).alias("level"), "g.kind", "g.persons")
    second = people.select("puzzle_id", above.alias("goal"), F.lit("L1").alias("parent"), F.lit(2).alias("level"), F.lit("identity").alias("kind"), F.array(person(name, own)).alias("persons"))
    first = puzzles.select("puzzle_id", F.lit("L1").alias("goal"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"), F.lit("solved").alias("kind"), F.expr("array()").cast("array<struct<name:string,role:string>>").alias("persons"))
    return first.union(second).union(third)


def met(texts: DataFrame, tree: DataFrame) -> DataFrame:
    """Of texts (text_id, puzzle_id, text, solved) and goals: text_id, puzzle_id, goal, parent, level, satisfied."""
    rows = texts.join(tree, "puzzle_id")
    quoted = lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))
    is_role = lambda p: F.concat(quoted(p["name"]), F.lit(r"\s+is\s+(?:a\s+)?"), quoted(p["role"]))
    matches = lambda *parts: F.regexp(F.col("text"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    p = F.get("persons", F.lit(0))
    assumed = F.forall("persons", lambda q: matches(r"(?id)Assume\s+.*?", is_role(q)))
    confirmed = matches(r"(?is)Assume\s+.*?", is_role(p), ".*?" + CONFIRMED)
    name, role = quoted(p["name"]), quoted(p["role"])
    refuted = matches("(?id)", name, r"\s+cannot\s+be\s+(?:a\s+)?", role) | matches("(?id)", name, r"\s+being\s+(?:a\s+)?", role, r"\s+is\s+impossible") | matches(r"(?id)If\s+", name, r"\s+were\s+(?:a\s+)?", role, ".*?contradict")
    identity = confirmed | (F.contains("text", F.lit(FINAL)) & matches("(?id)", is_role(p)))
    kinds = {"solved": F.col("solved"), "identity": identity, "assumed": assumed, "refuted": refuted, "confirmed": confirmed}
    satisfied = F.lit(False)
    for kind, holds in kinds.items():
        satisfied = F.when(F.col("kind") == kind, holds).otherwise(satisfied)
    return rows.select("text_id", "puzzle_id", "goal", "parent", "level", F.coalesce(satisfied, F.lit(False)).alias("satisfied"))
