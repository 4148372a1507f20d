"""Decaying bandits against a plain loop over the events."""

import math
import random

import pytest

from tesserakt.operators import bandits
from tesserakt.operators.bandits import Bandit


def plain(events, how):
    arms = sorted({a for _, a, _, _ in events})
    s, w, n, alpha, beta = ({a: x for a in arms} for x in (0.0, 0.0, 0, how.prior, how.prior))
    top, out, f = 0.0, [], how.factor
    for step, a, reward, baseline in events:
        add = math.expm1(how.base * max(reward - baseline, 0.0)) if reward is not None else 0.0
        s[a], w[a], n[a] = s[a] + add, w[a] + 1, n[a] + 1
        top = max(top, add)
        gain = 0.0 if reward is None else add / top if top > 0 else 0.5
        alpha[a], beta[a] = alpha[a] + gain, beta[a] + 1 - gain
        for b in arms:
            s[b], w[b] = f * s[b] / ((1 - f) * s[b] + 1), w[b] * f
            alpha[b], beta[b] = how.prior + f * (alpha[b] - how.prior), how.prior + f * (beta[b] - how.prior)
        if top > 0:
            top = max(f * top / ((1 - f) * top + 1), max(s[b] / max(w[b], 1e-7) for b in arms))
        out.append((step, a, n[a], s[a], w[a], top, gain, alpha[a], beta[a]))
    score = {a: s[a] / max(w[a], 1e-7) / (top or 1) + how.exploration * math.sqrt(2 * math.log(max(len(events), 2)) / n[a]) for a in arms}
    return out, score


@pytest.mark.parametrize("how", [Bandit(), Bandit(factor=0.5, base=3.0, prior=2.0), Bandit(factor=1 - 1e-6)])
def test_every_state_equals_a_plain_loop(spark, monkeypatch, how):
    monkeypatch.setattr(bandits, "RANGE", 16)
    rng = random.Random(4)
    events = [(i, rng.choice("abbbc") if i > 20 else "a", None if rng.random() < 0.2 else rng.uniform(-1, 2), rng.choice([0.0, 0.5])) for i in range(150)]
    events[0] = (0, "a", None, 0.0)
    df = spark.createDataFrame(events, "step long, arm string, reward double, baseline double").repartition(5)
    found = bandits.states(df, "step", "arm", "reward", "baseline", how)
    got = {r["step"]: r for r in found.collect()}
    beta = {r["step"]: r for r in bandits.betas(found, how).collect()}
    want, scores = plain(events, how)
    for step, arm, n, total, weight, top, gain, alpha, b in want:
        r, x = got[step], beta[step]
        assert (r["arm"], r["n"]) == (arm, n)
        assert [r["total"], r["weight"], r["greatest"], r["gain"], x["alpha"], x["beta"]] == pytest.approx([total, weight, top, gain, alpha, b], rel=1e-6, abs=1e-9)
    bounds = {r["arm"]: r for r in bandits.bounds(found, how).collect()}
    assert {a: r["score"] for a, r in bounds.items()} == pytest.approx(scores, rel=1e-6)
    best = max(scores, key=scores.get)
    assert {a: r["probability"] for a, r in bounds.items()} == pytest.approx({a: 0.8 if a == best else 0.1 for a in scores})
    drawn = [{r["arm"]: r["probability"] for r in bandits.thompson(bandits.betas(found, how), 149, k, how).collect()} for k in (0, 0, 1)]
    assert drawn[0] == drawn[1] and sorted(drawn[2].values()) == pytest.approx([0.1, 0.1, 0.8])
