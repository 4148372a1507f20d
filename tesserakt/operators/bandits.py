"""Bandits whose memory decays at every event, as a scan over ordered events in ranges.

An arm's sum in log space is kept as S = exp(s). An event adds to its arm's S, and then every arm decays, S -> f S / ((1 - f) S + 1). Both are
fractions of linear terms, so any stretch of events acts on an arm as one 2 x 2 matrix. Ranges of events give their matrices on their own, these are composed
over the ranges, and each range then runs through its events from the state it begins with. The greatest contribution seen decays too: in
u = log(1 + 1 / S) a decay adds -log f, so it is a running least of u shifted by the step. No task sees more than a range; arms are few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.operators.stages import staged

#: Events in a range.
RANGE = 4096


@dataclass(frozen=True)
class Bandit:
    """factor: what an event leaves of the past; base: scale of rewards in the exponent; prior: of both Beta parameters."""

    factor: float = 0.95
    base: float = 1.0
    prior: float = 1.0
    exploration: float = 1.0
    epsilon: float = 0.2


DECAYING = Bandit()


def contribution(reward: Column, baseline: Column, base: float = 1.0) -> Column:
    """What a reward adds to S: exp(base * gain) - 1, the gain over the baseline being 0 at least; a missing reward adds nothing."""
    gain = F.greatest(reward - baseline, F.lit(0.0))
    return F.coalesce(F.expm1(F.least(base * gain, F.lit(700.0))), F.lit(0.0))


def _events(df: DataFrame, step: str, arm: str, reward: str, baseline: str, how: Bandit) -> DataFrame:
    add = contribution(F.col(reward).cast("double"), F.col(baseline).cast("double"), how.base)
    return df.select(F.col(step).alias("step"), F.floor(F.col(step) / RANGE).alias("range"), F.col(arm).alias("arm"), add.alias("add"), F.col(reward).isNotNull().alias("real"))


def _matrices(rows: pd.DataFrame, f: float) -> pd.DataFrame:
    """A range's action on each arm that it has: matrix a b / c d of S, number of events, decayed sum of ones, events in the range."""
    rows, out = rows.sort_values("step"), []
    n = len(rows)
    at = np.arange(n)
    for arm, own in rows.assign(at=at).groupby("arm", sort=True):
        m, last = np.eye(2), -1
        for k, add in zip(own["at"], own["add"], strict=True):
            g = f ** (k - last - 1)
            m = np.array([[1.0, add], [0.0, 1.0]]) @ np.array([[g, 0.0], [1.0 - g, 1.0]]) @ m
            m = np.array([[f, 0.0], [1.0 - f, 1.0]]) @ m
            m, last = m / np.abs(m).max(), k
        g = f ** (n - 1 - last)
        m = np.array([[g, 0.0], [1.0 - g, 1.0]]) @ m
        out.append((arm, *m.ravel(), len(own), float((f ** (n - own["at"].to_numpy(float))).sum()), n))
    return pd.DataFrame(out, columns=["arm", "a", "b", "c", "d", "n", "ones", "events"])


def _composed(acts: DataFrame, kind: str, f: float) -> DataFrame:
    """range, arm, total, weight, n, won, lost: every arm's state at the start of each range."""
    sizes = acts.groupBy("range").agg(F.max("events").alias("events"))
    grid = sizes.join(acts.select("arm").distinct()).join(acts.drop("events"), ["range", "arm"], "left")  # arms are few: a row each

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = w = 0.0
        n, out = 0, []
        for r in rows.sort_values("range").itertuples():
            out.append((r.range, r.arm, s, w, n))
            g = f**r.events
            if np.isnan(r.a):
                s, w = g * s / ((1 - g) * s + 1), w * g
            else:
                s, w, n = (r.a * s + r.b) / (r.c * s + r.d), w * g + r.ones, n + int(r.n)
        return pd.DataFrame(out, columns=["range", "arm", "total", "weight", "n"])

    return grid.groupBy("arm").applyInPandas(run, f"range long, arm {kind}, total double, weight double, n long")


def states(df: DataFrame, step: str, arm: str, reward: str, baseline: str, how: Bandit = DECAYING) -> DataFrame:
    """step, arm, n, total, weight, greatest, gain: after each event, its arm's events, decayed S and weight, and of all arms the greatest contribution.

    `step` counts events from 0 without gaps. gain is the event's share of the greatest contribution before the decay, what a Beta arm wins.
    """
    f, kind, shift = how.factor, dict(df.dtypes)[arm], float(np.log(how.factor))
    rows = staged(_events(df, step, arm, reward, baseline, how))
    acts = rows.groupBy("range").applyInPandas(lambda key, x: _matrices(x, f).assign(range=key[0])[["range", "arm", "a", "b", "c", "d", "n", "ones", "events"]], f"range long, arm {kind}, a double, b double, c double, d double, n long, ones double, events long")
    begun = staged(_composed(staged(acts), kind, f))

    def run(key: tuple, events: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        """The events of a range in order; own and seen: u of the event's contribution and of the best mean, less the decays up to there."""
        names = {a: i for i, a in enumerate(begin["arm"])}
        s, w, n = (begin[c].to_numpy(float).copy() for c in ("total", "weight", "n"))
        out = []
        for r in events.sort_values("step").itertuples():
            i = names[r.arm]
            s[i], w[i], n[i] = s[i] + r.add, w[i] + 1, n[i] + 1
            s, w = f * s / ((1 - f) * s + 1), w * f
            mean = (s / np.maximum(w, 1e-7)).max()
            own = np.log1p(1 / r.add) + r.step * shift if r.real and r.add > 0 else np.inf
            seen = np.log1p(1 / mean) + (r.step + 1) * shift if mean > 0 else np.inf
            out.append((r.step, r.range, r.arm, r.add, r.real, int(n[i]), s[i], w[i], own, seen))
        return pd.DataFrame(out, columns=["step", "range", "arm", "add", "real", "n", "total", "weight", "own", "seen"])

    schema = f"step long, range long, arm {kind}, add double, real boolean, n long, total double, weight double, own double, seen double"
    got = staged(rows.groupBy("range").cogroup(begun.groupBy("range")).applyInPandas(run, schema))
    never = F.lit(float("inf"))
    first = got.agg(F.min(F.when(F.col("own") < never, F.col("step"))).alias("first"))  # a mean counts only once a contribution was seen
    got = got.join(first).withColumn("low", F.least("own", F.when(F.col("step") >= F.col("first"), F.col("seen")).otherwise(never)))
    lows = got.groupBy("range").agg(F.min("low").alias("low"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    lows = lows.select("range", F.coalesce(F.min("low").over(order), never).alias("before"))
    inside = Window.partitionBy("range").orderBy("step")
    upto = F.least("before", F.min("low").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    past = F.least("before", F.coalesce(F.min("low").over(inside.rowsBetween(Window.unboundedPreceding, -1)), never))
    got = got.join(lows, "range").withColumn("upto", upto).withColumn("past", past)
    back = lambda low, k: F.when(low < never, 1 / F.expm1(low - k * shift)).otherwise(0.0)
    at_event = F.greatest("add", back(F.col("past"), F.col("step")))
    gain = F.when(F.col("real"), F.when(at_event > 0, F.col("add") / at_event).otherwise(0.5)).otherwise(0.0)
    return got.select("step", "range", "arm", "n", "total", "weight", back(F.col("upto"), F.col("step") + 1).alias("greatest"), gain.alias("gain"))


def betas(found: DataFrame, how: Bandit = DECAYING) -> DataFrame:
    """step, arm, alpha, beta: the Beta parameters of each event's arm after it, from `states`; both fall back to the prior with every event of any arm."""
    f, kind = how.factor, dict(found.dtypes)["arm"]
    end = F.max("step").over(Window.partitionBy("range"))
    sized = found.withColumn("end", end)
    sums = sized.groupBy("range", "arm").agg(*(F.sum(x * F.pow(F.lit(f), F.col("end") - F.col("step") + 1)).alias(c) for c, x in (("won", F.col("gain")), ("lost", 1 - F.col("gain")))), F.max("end").alias("end"))

    def carried(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """An arm's decayed sums at the start of each range that it has."""
        won = lost = 0.0
        last, out = -1, []
        for r in rows.sort_values("range").itertuples():
            begin = r.range * RANGE - 1
            g = f ** (begin - last)
            out.append((r.range, r.arm, won * g, lost * g))
            h = f ** (r.end - last)
            won, lost, last = won * h + r.won, lost * h + r.lost, r.end
        return pd.DataFrame(out, columns=["range", "arm", "won", "lost"])

    begun = sums.groupBy("arm").applyInPandas(carried, f"range long, arm {kind}, won double, lost double")

    def run(key: tuple, events: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        out, last = [], int(key[0]) * RANGE - 1
        won, lost = (float(begin[c].iloc[0]) for c in ("won", "lost"))
        for r in events.sort_values("step").itertuples():
            g = f ** (r.step - last)  # the decays of the events since, this one's too
            won, lost, last = won * g + f * r.gain, lost * g + f * (1 - r.gain), r.step
            out.append((r.step, r.arm, how.prior + won, how.prior + lost))
        return pd.DataFrame(out, columns=["step", "arm", "alpha", "beta"])

    return found.groupBy("range", "arm").cogroup(begun.groupBy("range", "arm")).applyInPandas(run, f"step long, arm {kind}, alpha double, beta double")


def _shared(scored: DataFrame, epsilon: float) -> DataFrame:
    """arm, score, probability: the arms of greatest score share 1 - epsilon, the others epsilon; all alike share evenly."""
    top = scored.agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("arms"))
    best = scored.join(top).withColumn("won", F.col("score") == F.col("top"))
    many = best.agg(F.count_if("won").alias("winners"))
    chance = F.when(F.col("winners") == F.col("arms"), 1 / F.col("arms")).when(F.col("won"), (1 - epsilon) / F.col("winners")).otherwise(epsilon / (F.col("arms") - F.col("winners")))
    return best.join(many).select("arm", "score", chance.alias("probability"))


def bounds(found: DataFrame, how: Bandit = DECAYING) -> DataFrame:
    """arm, score, probability after the last event: mean over the greatest contribution plus an upper bound's bonus."""
    f = how.factor
    last = found.agg(F.max("step").alias("end"), F.max_by("greatest", "step").alias("o"), F.count(F.lit(1)).alias("t"))
    own = found.groupBy("arm").agg(F.max_by(F.struct("step", "n", "total", "weight"), "step").alias("x")).select("arm", "x.*")
    g = F.pow(F.lit(f), F.col("end") - F.col("step"))
    total, weight = g * F.col("total") / ((1 - g) * F.col("total") + 1), g * F.col("weight")
    mean = total / F.greatest(weight, F.lit(1e-7))
    bonus = how.exploration * F.sqrt(2 * F.log(F.greatest(F.col("t").cast("double"), F.lit(2.0))) / F.col("n"))
    scored = own.join(last).select("arm", (F.when(F.col("o") > 0, mean / F.col("o")).otherwise(mean) + bonus).alias("score"))
    return _shared(scored, how.epsilon)


def thompson(found: DataFrame, last: int, draw: int, how: Bandit = DECAYING, seed: int = 0) -> DataFrame:
    """arm, score, probability: a seeded Beta draw of every arm at the end (`last`: the last step); found: from `betas`."""
    f = how.factor
    own = found.groupBy("arm").agg(F.max_by(F.struct("step", "alpha", "beta"), "step").alias("x")).select("arm", "x.*")
    later = lambda c: (how.prior + (F.col(c) - how.prior) * F.pow(F.lit(f), F.lit(last) - F.col("step"))).alias(c)

    @F.pandas_udf("double")
    def drawn(arm: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, draw, *str(a).encode()]).beta(x, y) for a, x, y in zip(arm, alpha, beta, strict=True)])

    scored = own.select("arm", later("alpha"), later("beta")).select("arm", drawn("arm", "alpha", "beta").alias("score"))
    return _shared(scored, how.epsilon)
