"""Changes to search trajectories, as expressions on arrays of turns (structs with role and kind).

Where several places would do, `pick` names one (a number of any size, taken
modulo their count), so a seeded hash of the row makes the draw repeatable.
A change that isn't legal gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use) -> Column:
    """Evaluate `value` once and use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(F.transform(a, lambda x, i: F.when((i < shorter) & ~x.eqNullSafe(F.get(b, i)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(differ), shorter)


def _is(turn: Column, role: str, kind: str | None = None) -> Column:
    out = F.coalesce(turn["role"] == role, F.lit(False))
    return out if kind is None else out & F.coalesce(turn["kind"] == kind, F.lit(False))


def think_starts(a: Column, least: Column | int = 0) -> Column:
    """Places of thinking turns, from `least` on."""
    least = least if isinstance(least, Column) else F.lit(least)
    places = F.transform(a, lambda x, i: F.when(_is(x, "agent", "think") & (i >= least), i))
    return F.filter(places, lambda i: i.isNotNull())


def triples(a: Column, least: Column | int = 0) -> Column:
    """Starts of think, search, observation followed by another think, from `least` on."""

    def whole(i: Column) -> Column:
        return _is(F.get(a, i + 1), "agent", "search") & _is(F.get(a, i + 2), "obs") & _is(F.get(a, i + 3), "agent", "think")

    return F.filter(think_starts(a, least), lambda i: F.coalesce(whole(i), F.lit(False)))


def _head(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), n)


def _tail(a: Column, start: Column) -> Column:
    return F.slice(a, start + 1, F.greatest(F.size(a) - start, F.lit(0)))


def _chosen(places: Column, pick: Column) -> Column:
    return F.when(F.size(places) > 0, F.get(places, F.pmod(pick, F.greatest(F.size(places), F.lit(1))).cast("int")))


def combine(a: Column, b: Column) -> Column:
    """a, and what follows their common beginning in b; neither may be the beginning of the other, nor may they share none."""
    return _let(common_prefix(a, b), lambda s: F.when((s > 0) & (s < F.size(a)) & (s < F.size(b)), F.concat(a, _tail(b, s))))


def delete(a: Column, pick: Column) -> Column:
    """a without one of its triples that is neither the first nor the last; three are needed at least."""

    def cut(t: Column) -> Column:
        i = F.get(t, 1 + F.pmod(pick, F.greatest(F.size(t) - 2, F.lit(1))).cast("int"))
        return F.when(F.size(t) >= 3, F.concat(_head(a, i), _tail(a, i + 3)))

    return _let(triples(a), cut)


def translocate(a: Column, b: Column, pick_a: Column, pick_b: Column) -> Column:
    """a with one triple behind the common beginning replaced by one of b."""

    def swap(s: Column) -> Column:
        i, j = _chosen(triples(a, s), pick_a), _chosen(triples(b, s), pick_b)
        return F.when(i.isNotNull() & j.isNotNull(), F.concat(_head(a, i), F.slice(b, j + 1, F.lit(3)), _tail(a, i + 3)))

    return _let(common_prefix(a, b), swap)


def crossover(a: Column, b: Column, pick_a: Column, pick_b: Column) -> Column:
    """a up to a thinking turn behind the common beginning (or all of it), then b from one of its own."""

    def join(s: Column) -> Column:
        i = _chosen(F.concat(think_starts(a, s), F.array(F.size(a))), pick_a)
        j = _chosen(think_starts(b, s), pick_b)
        return F.when(j.isNotNull(), F.concat(_head(a, i), _tail(b, j)))

    return _let(common_prefix(a, b), join)


def capped_searches(turns: Column, most: int) -> Column:
    """The trajectory up to its `most`-th search, without the thought that would lead to the next."""
    places = F.filter(F.transform(turns, lambda x, i: F.when(_is(x, "agent", "search"), i)), lambda i: i.isNotNull())

    def cut(p: Column) -> Column:
        at = F.get(p, F.lit(most))
        before = F.when(_is(F.get(turns, at - 1), "agent", "think"), at - 1).otherwise(at)
        return F.when(F.size(p) > most, _head(turns, before)).otherwise(turns)

    return _let(places, cut)
