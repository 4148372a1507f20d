"""Policy losses of token tables, by name: every one adds a column `loss`.

A token is a row with its sequence, log-probabilities under the current and the old
policy, advantage and mask. Losses that need more than the token itself take their
sums over the sequence in one window, or over the whole batch in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.operators import correction, losses
from tesserakt.operators.losses import clip
from tesserakt.operators.stages import first_of

_LOSSES: dict[str, Callable[..., DataFrame]] = {}


@dataclass(frozen=True)
class Tokens:
    """Names of the columns of a token table."""

    seq: str = "seq"
    pos: str = "pos"
    logp: str = "logp"
    old: str = "old"
    adv: str = "adv"
    mask: str = "mask"

    def values(self) -> tuple[Column, Column, Column, Column]:
        return F.col(self.logp), F.col(self.old), F.col(self.adv), F.col(self.mask) == 1


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Name a loss; another function under a name that is taken is an error."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if _LOSSES.setdefault(name, f) is not f:
            raise ValueError(f"{name} names another loss already")
        return f

    return put


def policy_loss(name: str) -> Callable[..., DataFrame]:
    if name not in _LOSSES:
        raise ValueError(f"no loss {name}: {sorted(_LOSSES)}")
    return _LOSSES[name]


@register("vanilla")
def vanilla(df: DataFrame, t: Tokens, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> DataFrame:
    logp, old, adv, _ = t.values()
    return df.withColumn("loss", losses.clipped_loss(logp, old, adv, low, high, c))


@register("sapo")
def soft_gate(df: DataFrame, t: Tokens, tau_pos: float = 1.0, tau_neg: float = 1.05) -> DataFrame:
    logp, old, adv, _ = t.values()
    return df.withColumn("loss", losses.soft_gate_loss(logp, old, adv, tau_pos, tau_neg))


@register("cispo")
def clipped_weight(df: DataFrame, t: Tokens, low: float = 0.2, high: float = 0.2) -> DataFrame:
    logp, old, adv, _ = t.values()
    return df.withColumn("loss", losses.clipped_weight_loss(logp, old, adv, low, high))


@register("gpg")
def log_likelihood(df: DataFrame, t: Tokens) -> DataFrame:
    logp, _, adv, _ = t.values()
    return df.withColumn("loss", losses.log_likelihood_loss(logp, adv))


def _truncated(logp: Column, old: Column, adv: Column, allowed: Column, c: float) -> Column:
    return F.when(allowed, -adv * F.least(losses.ratio(logp, old), F.lit(c)) * logp).otherwise(0.0)


@register("dppo_tv")
def within_variation(df: DataFrame, t: Tokens, low: float = 0.2, high: float = 0.2, c: float = 20.0) -> DataFrame:
    """Truncated ratio times log-probability; 0 where the token's probability has moved too far the way the advantage pushes it."""
    logp, old, adv, _ = t.values()
    moved = F.exp(logp) - F.exp(old)
    allowed = F.when(adv > 0, moved <= high).otherwise(moved >= -low)
    return df.withColumn("loss", _truncated(logp, old, adv, allowed, c))


@register("dppo_kl")
def within_divergence(df: DataFrame, t: Tokens, low: float = 0.2, high: float = 0.2, c: float = 20.0) -> DataFrame:
    """The same with the divergence of the two-outcome distributions token or not."""
    logp, old, adv, _ = t.values()
    p, q = F.exp(logp), F.exp(old)
    far = q * (old - logp) + (1 - q) * F.log((1 - q + 1e-8) / (1 - p + 1e-8))
    allowed = F.when(adv > 0, (far <= high) | (p <= q)).otherwise((far <= low) | (p >= q))
    return df.withColumn("loss", _truncated(logp, old, adv, allowed, c))


@register("gspo")
def sequence_ratio(df: DataFrame, t: Tokens, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """All tokens of a sequence share its mean ratio, exp of the mean masked log-ratio (10 at most)."""
    logp, old, adv, on = t.values()
    w = Window.partitionBy(t.seq)
    mean = F.sum(F.when(on, logp - old).otherwise(0.0)).over(w) / F.greatest(F.sum(F.when(on, 1).otherwise(0)).over(w), F.lit(1))
    ratio = F.exp(F.least(mean, F.lit(10.0)))
    return df.withColumn("loss", F.greatest(-adv * ratio, -adv * clip(ratio, 1 - low, 1 + high)))


@register("geo_mean")
def geometric_mean(df: DataFrame, t: Tokens, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """One row a sequence: minus its mean advantage times the geometric mean of its clipped ratios."""
    logp, old, adv, on = t.values()
    move, sign = logp - old, F.signum(adv)
    held = sign * F.least(sign * move, sign * clip(move, -low, high))
    n = F.sum(F.when(on, 1).otherwise(0)) + 1e-8
    total = lambda x: F.sum(F.when(on, x).otherwise(0.0))
    return df.groupBy(t.seq).agg((-(total(adv) / n) * F.exp(total(held) / n)).alias("loss"))


def _covariance(df: DataFrame, t: Tokens) -> DataFrame:
    """Adds `cov`: advantage and log-probability of kept tokens, each less its mean over the batch, multiplied."""
    logp, _, adv, on = t.values()
    means = df.agg(F.avg(F.when(on, adv)).alias("_a"), F.avg(F.when(on, logp)).alias("_l"), F.sum(F.when(on, 1).otherwise(0)).alias("_n"))  # one row
    return df.join(F.broadcast(means)).withColumn("cov", F.when(on, (adv - F.col("_a")) * (logp - F.col("_l"))))


def _named(df: DataFrame, t: Tokens, order: list[Column], number: int, down: bool = False) -> DataFrame:
    """Keys of the first `number` rows in an order (down: the greatest first), then by sequence and position."""
    keys = df.select(F.col(t.seq).alias("_s"), F.col(t.pos).alias("_p"), *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    ranks = [F.col(f"_o{i}").desc() if down else F.col(f"_o{i}").asc() for i in range(len(order))]
    return first_of(keys, [*ranks, F.col("_s"), F.col("_p")], number).select("_s", "_p", F.lit(True).alias("_hit"))


@register("clip_cov")
def without_some_covariance(df: DataFrame, t: Tokens, low: float = 0.2, high: float = 0.2, share: float = 0.0002, least: float = 1.0, most: float = 5.0, seed: int = 0) -> DataFrame:
    """The clipped loss, 0 for a share of the unclipped tokens (one at least) whose covariance lies between the bounds.

    Which of them is decided by a hash of sequence, position and seed.
    """
    logp, old, adv, on = t.values()
    ratio = F.exp(logp - old)
    plain, held = -adv * ratio, -adv * clip(ratio, 1 - low, 1 + high)
    df = _covariance(df, t)
    number = max(int(share * (df.agg(F.max("_n")).first()[0] or 0)), 1)
    can = df.filter(on & ~(held > plain) & (F.col("cov") > least) & (F.col("cov") < most))
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(t.seq).cast("string"), F.col(t.pos).cast("string")))
    hit = _named(can, t, [draw], number)
    out = df.join(hit, (F.col(t.seq) == F.col("_s")) & (F.col(t.pos) == F.col("_p")), "left")
    return out.withColumn("loss", F.when(F.col("_hit"), 0.0).otherwise(F.greatest(plain, held))).drop("_a", "_l", "_n", "_s", "_p", "_hit", "cov")


@register("kl_cov")
def penalised_covariance(df: DataFrame, t: Tokens, share: float = 0.0002, coefficient: float = 1.0) -> DataFrame:
    """Minus advantage times ratio; the share of kept tokens (one at least) with the greatest covariance pays |log-ratio| times the coefficient too."""
    logp, old, adv, on = t.values()
    df = _covariance(df, t)
    number = max(1, int((df.agg(F.max("_n")).first()[0] or 0) * share))
    hit = _named(df.filter(on), t, [F.col("cov")], number, down=True)
    out = df.join(hit, (F.col(t.seq) == F.col("_s")) & (F.col(t.pos) == F.col("_p")), "left")
    loss = -adv * F.exp(logp - old) + F.when(F.col("_hit"), coefficient * F.abs(logp - old)).otherwise(0.0)
    return out.withColumn("loss", loss).drop("_a", "_l", "_n", "_s", "_p", "_hit", "cov")


@register("bypass_mode")
def bypass(df: DataFrame, t: Tokens, kind: str = "ppo_clip", level: str | None = None, threshold: float | str = 2.0, normalise: bool = False, options: dict[str, str | float] | None = None) -> DataFrame:
    """The rollout's policy serves as the old one: rejection by its log-ratio, then the clipped loss, or log-likelihood with importance weights.

    Adds `kept`, the mask less what is rejected.
    """
    logp, old, adv, _ = t.values()
    df = df.withColumn("_x", logp - old)
    df = correction.rejection_mask(df, t.seq, "_x", t.mask, options or {})
    if kind == "ppo_clip":  # its ratio weighs the tokens already
        return vanilla(df, t).drop("_x")
    if kind != "reinforce":
        raise ValueError("the kind is ppo_clip or reinforce")
    if level is None:
        return df.withColumn("loss", losses.log_likelihood_loss(logp, adv)).drop("_x")
    df = correction.importance_weights(df, t.seq, "_x", t.mask, level, threshold, normalise)
    return df.withColumn("loss", losses.weighted_reinforce_loss(logp, adv, F.col("weight"))).drop("_x", "weight")


def forward_kl_top_k(teacher: Column, student: Column) -> Column:
    """Divergence of the student from the teacher over the teacher's k best tokens (arrays of log-probabilities), 0 at least."""
    terms = F.zip_with(teacher, student, lambda p, q: F.exp(p) * (p - q))
    return F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
