"""Weights, scores and lifecycle formulas as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.constants import BOOSTED, DIMENSIONS, DISPOSITIONS, FALLBACK_WEIGHTS, GATE_WEIGHTS, PROMOTE_THRESHOLD, R_BASE, SCORE_TERMS, SCORE_WEIGHTS


def lit(x: float) -> Column:
    return F.lit(float(x))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(lit(low), F.least(lit(high), c)))


def recency(days: Column, strength: Column, half_life: float = 365.0) -> Column:
    """1 / (1 + ln(1 + d / (half life * (1 + strength)))); 0.5 without a date."""
    d = F.greatest(lit(0), days)
    return F.when(days.isNull(), lit(0.5)).otherwise(1 / (1 + F.log1p(d / (lit(half_life) * (1 + strength)))))


def thalamus_weight(mode: str | None, novelty: Column, surprise: Column, task_relevance: Column, emotional_valence: Column) -> Column:
    """The mode's boosted dimension times 1.5, at most 1; else the mean; 0.5 without any score."""
    by_name = dict(zip(DIMENSIONS, (novelty, surprise, task_relevance, emotional_valence), strict=True))
    none = reduce(lambda a, b: a & b, (c.isNull() for c in by_name.values()))
    mean = reduce(lambda a, b: a + b, (F.coalesce(c, lit(0)) for c in by_name.values())) / 4
    boosted = BOOSTED.get(mode) if mode else None
    value = mean if boosted is None else F.when(by_name[boosted].isNull(), mean).otherwise(F.least(lit(1), by_name[boosted] * 1.5))
    return F.when(none, lit(0.5)).otherwise(value)


def strength_weight(strength: Column) -> Column:
    return F.log1p(strength) / F.log1p(lit(1))


def combined(mode: str | None, **terms: Column) -> Column:
    """Weighted sum of the score terms by mode; without a mode the four basic terms."""
    weights = dict(zip(SCORE_TERMS, SCORE_WEIGHTS[mode], strict=True)) if mode else FALLBACK_WEIGHTS
    return reduce(lambda a, b: a + b, (terms[t] * w for t, w in weights.items() if t in terms))


def frequency(access: Column, most: float = 2.0) -> Column:
    return F.when(access <= 0, lit(1)).otherwise(1 + F.least(F.log10(access + 1), lit(most - 1)))


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def anchor(start: Column, end: Column) -> Column:
    """Seconds of a range's midpoint."""
    return (seconds(start) + seconds(end)) / 2


def day_proximity(a: Column, b: Column, half_life: float = 30.0) -> Column:
    """1 / (1 + ln(1 + whole days / half life)) of two anchors in seconds."""
    return 1 / (1 + F.log1p(F.floor(F.abs(a - b) / 86400) / half_life))


def window_proximity(best: Column, start: Column, end: Column, missing: float = 0.5) -> Column:
    """1 at a window's middle, 0 at its edges and beyond; all in seconds."""
    half = (end - start) / 2
    return F.when(best.isNull(), lit(missing)).when(half <= 0, lit(1)).otherwise(1 - F.least(F.abs(best - (start + end) / 2) / half, lit(1)))


def overall(mode: str, novelty: Column, surprise: Column, task_relevance: Column, emotional_valence: Column) -> Column:
    """Gate score: the mode's weighted sum of the four dimensions, 0 to 1."""
    return clamp(reduce(lambda a, b: a + b, (c * w for c, w in zip((novelty, surprise, task_relevance, emotional_valence), GATE_WEIGHTS[mode], strict=True))))


def novelty(nearest: Column) -> Column:
    """1 - the greatest similarity to what is stored; 1 if nothing is."""
    return clamp(1 - F.coalesce(nearest, lit(0)))


def surprise(similarity: Column) -> Column:
    return F.when(similarity.isNull(), lit(0.5)).otherwise(clamp(1 - similarity))


def task_relevance(similarity: Column) -> Column:
    return F.when(similarity.isNull(), lit(0.5)).otherwise(clamp(similarity))


def valence(similarity: Column, gain: float = 1.5) -> Column:
    return F.when(similarity.isNull(), lit(0.3)).otherwise(F.least(lit(1), clamp(1 - similarity) * gain))


def bank_factor(n: Column) -> Column:
    """ln(1001) / ln(1 + n); 1.5 below one item and at most 1.5 below 100."""
    f = F.log(lit(1001)) / F.log(1 + n.cast("double"))
    return F.when(n < 1, lit(1.5)).when(n < 100, F.least(lit(1.5), f)).otherwise(f)


def equilibrium_rate(mode: str | None, novelty: Column, surprise: Column, task_relevance: Column, emotional_valence: Column, factor: Column) -> Column:
    base = R_BASE.get(mode, 0.5) if mode else 0.5
    return F.greatest(lit(0.001), base * (1 + 0.5 * task_relevance) / (1 + 0.5 * (novelty + surprise + emotional_valence) / 3) * factor)


def decay(access: Column, sessions: Column, rate: Column) -> Column:
    """ln(1 + a) / ln(1 + s r); 1 for no sessions or rate, else 0 for no access."""
    return F.when((sessions <= 0) | (rate <= 0), lit(1)).when(access <= 0, lit(0)).otherwise(F.log1p(access.cast("double")) / F.log1p(sessions * rate))


def composite(overall_score: Column, decayed: Column) -> Column:
    return clamp(overall_score * decayed, 0, 10)


def promote_threshold(tags: Column) -> Column:
    """The lowest threshold among known tags; 0.7 if none is known."""
    known = F.create_map(*(x for k, v in PROMOTE_THRESHOLD.items() for x in (F.lit(k), lit(v))))
    return F.coalesce(F.array_min(F.transform(F.filter(tags, lambda t: F.map_contains_key(known, t)), lambda t: F.element_at(known, t))), lit(0.7))


def access_gate(factor: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(5 * factor).cast("int"))


def disposition(skepticism: Column, literalism: Column, empathy: Column) -> Column:
    """The profile of a bank's traits; neutral where they are missing."""
    return F.when(skepticism >= 4, "analytical").when(empathy >= 4, "optimistic").when(literalism >= 4, "conservative").otherwise("neutral")


def modulated_strength(strength: Column, delta: Column, confirmed: Column, similarity: Column, profile: Column) -> Column:
    """A strength after a delta: weighed by the profile, biased if confirmed, skipped if tolerated."""
    weight, bias, tolerance = (F.element_at(F.create_map(*(x for k, v in DISPOSITIONS.items() for x in (F.lit(k), lit(v[i])))), profile) for i in range(3))
    moved = clamp(strength + delta * weight + F.when((delta > 0) | confirmed, bias).otherwise(lit(0)))
    return F.when((delta < 0) & (similarity < tolerance), strength).otherwise(moved)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def resolution(name: Column, shared: Column, days: Column) -> Column:
    """0.5 name similarity + 0.3 share of co-occurring names + 0.2 nearness within 7 days."""
    near = F.when(days < 7, 1 - days / 7).otherwise(lit(0))
    return 0.5 * name + 0.3 * F.coalesce(shared, lit(0)) + 0.2 * F.coalesce(near, lit(0))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0 to 1 over a set; 0.5 where all are equal."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(lit(0.5))


def error_level(error: Column) -> Column:
    return F.when(error < 0.3, "low").when(error < 0.7, "medium").otherwise("high")


def maturity(dominance: Column, members: Column) -> Column:
    return F.when((dominance >= 0.6) & (members >= 5), "dominant").when(dominance >= 0.3, "stable").otherwise("emerging")


def cycles(days: Column, per: int = 7) -> Column:
    return F.floor(F.floor(days) / per).cast("int")
