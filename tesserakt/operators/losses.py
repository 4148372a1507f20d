"""KL estimates and policy losses of single tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    held = F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), held)  # greatest and least pass nulls over


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    """k1 or kl; abs; k2 or mse; k3 or low_var_kl (differences held within 20, the result within 10).

    A + behind a kind only changes its gradient, which a table doesn't have: the value is the same.
    """
    kind = kind.removesuffix("+")
    d = logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        x = clip(ref - logp, -20.0, 20.0)
        return clip(F.exp(x) - x - 1, -10.0, 10.0)
    raise NotImplementedError(kind)


def penalised_reward(score: Column, old: Column, ref: Column, ratio: float) -> Column:
    return score - (old - ref) * ratio


def next_kl_coefficient(beta: float, kl: float, target: float, n: int, horizon: int) -> float:
    """Adaptive control: the error is held within 20 %."""
    return beta * (1 + min(max(kl / target - 1, -0.2), 0.2) * n / horizon)


def ratio(logp: Column, old: Column) -> Column:
    return F.exp(clip(logp - old, -20.0, 20.0))


def clipped_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> Column:
    """Dual-clip: the clipped ratio's loss, and for negative advantages no more than -c times them."""
    r = ratio(logp, old)
    worst = F.greatest(-adv * r, -adv * clip(r, 1 - low, 1 + high))
    return F.when(adv < 0, F.least(-adv * c, worst)).otherwise(worst)


def was_clipped(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    r = ratio(logp, old)
    return F.when(-adv * clip(r, 1 - low, 1 + high) > -adv * r, 1.0).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    """Safe for any size of x."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def soft_gate_loss(logp: Column, old: Column, adv: Column, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """Sigmoid gate around ratio 1, steeper or flatter by the advantage's sign."""
    tau = F.when(adv > 0, tau_pos).otherwise(tau_neg)
    return -sigmoid(tau * (ratio(logp, old) - 1)) * (4 / tau) * adv


def clipped_weight_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """The clipped importance weight is a factor of advantage times log-probability."""
    return -clip(ratio(logp, old), 1 - low, 1 + high) * adv * logp


def log_likelihood_loss(logp: Column, adv: Column) -> Column:
    return -logp * adv


def weighted_reinforce_loss(logp: Column, adv: Column, weight: Column) -> Column:
    return -logp * adv * weight


def value_loss(value: Column, old: Column, returns: Column, reach: float = 0.5) -> Column:
    """Half of the greater squared error, the value moved by `reach` at most in one of them."""
    near = clip(value, old - reach, old + reach)
    return 0.5 * F.greatest((value - returns) * (value - returns), (near - returns) * (near - returns))


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    """0 up to the buffer before the greatest length, then falling in proportion."""
    return F.least(-(length - (longest - buffer)) / buffer * factor, F.lit(0.0))


def log_softmax(logits: Column) -> Column:
    """Log-probabilities of an array of logits, shifted by the greatest."""
    top = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(logits, lambda x: x - top - total)


def entropy(logits: Column) -> Column:
    return F.aggregate(log_softmax(logits), F.lit(0.0), lambda a, x: a - x * F.exp(x))


def sum_of_squares(logits: Column) -> Column:
    """Sum of squared probabilities."""
    return F.aggregate(log_softmax(logits), F.lit(0.0), lambda a, x: a + F.exp(2 * x))


def reward_with_kl(score: Column, logp: Column, ref: Column, mask: Column, beta: float, kind: str = "kl") -> Column:
    """A token's reward: its score less a fixed share of the masked KL estimate."""
    return score - beta * kl_penalty(logp, ref, kind) * mask
