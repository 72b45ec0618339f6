"""Scalar expressions shared by the operators. All stay on the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | int | Column, high: float | int | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def even(x: Column) -> Column:
    """The even number at or below, at least 2."""
    return F.greatest(x.bitwiseAND(F.lit(~1)), F.lit(2))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def gaussian(x: Column, mean: Column, sigma: Column) -> Column:
    """exp(-(x - mean)^2 / (2 sigma^2)): the preference for a length."""
    d = (x - mean).cast("double")
    s = sigma.cast("double")
    return F.exp(-(d * d) / (F.lit(2.0) * s * s))


def apply_range(x: Column, low: Column, high: Column) -> Column:
    """Into 0..1 by a fitted range; a range without width gives 0.5."""
    return F.when(high <= low, F.lit(0.5)).otherwise(clamp((x - low) / (high - low), 0.0, 1.0))


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Cosine of two feature lists in 0..1; 0 if either is all zeros."""
    total = lambda xs: sum(xs[1:], xs[0])
    dot = total([x * y for x, y in zip(a, b, strict=True)])
    na, nb = total([x * x for x in a]), total([y * y for y in b])
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(clamp(dot / (F.sqrt(na) * F.sqrt(nb)), 0.0, 1.0))


def similarity(cos: Column, same_shot: Column) -> Column:
    return clamp(F.lit(0.6) * cos + F.lit(0.4) * F.when(same_shot, 1.0).otherwise(0.0), 0.0, 1.0)


def timeline_bucket(start: Column, end: Column, total: Column, buckets: int = 8) -> Column:
    """Which eighth of the timeline the centre lies in."""
    centre = F.call_function("div", start + end, F.lit(2))
    return clamp(F.call_function("div", centre * F.lit(buckets), total), 0, buckets - 1)


def composite(features: list[Column], weights: list[Column]) -> Column:
    """0.7 of the weighted sum and 0.3 of the largest weighted term."""
    terms = [w * f for w, f in zip(weights, features, strict=True)]
    return F.lit(0.7) * sum(terms[1:], terms[0]) + F.lit(0.3) * F.greatest(F.lit(0.0), *terms)


def clock(ms: Column, separator: str) -> Column:
    """HH:MM:SS, separator, milliseconds."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    return F.format_string("%02d:%02d:%02d" + separator + "%03d", div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000)
