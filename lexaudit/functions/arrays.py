"""Scores of one record from arrays of token statistics. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used and in whatever loop."""
    return F.transform(F.array(value), use)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def bottom_mean(a: Column, ratio: float) -> Column:
    """Mean of the ``ratio`` smallest, at least one; null if empty."""
    k = F.greatest(F.lit(1), F.floor(F.size(a) * ratio).cast("int"))
    return F.when(F.size(a) > 0, mean(F.slice(F.array_sort(a), F.lit(1), k)))


def min_k(lp: Column, ratio: float = 0.2) -> Column:
    return bottom_mean(lp, ratio)


def standardised(lp: Column, mu: Column, var: Column) -> Column:
    """Log-probabilities by mean and variance of the distribution at each token."""
    return F.zip_with(F.zip_with(lp, mu, lambda x, m: x - m), var, lambda x, v: x / (F.sqrt(F.greatest(v, F.lit(1e-9))) + F.lit(1e-9)))


def min_k_plus(lp: Column, mu: Column, var: Column, ratio: float = 0.2) -> Column:
    """Bottom mean of standardised log-probabilities; mu and var (a variance) of the distribution at each token."""
    return bottom_mean(standardised(lp, mu, var), ratio)


def polarised(lp: Column, far: float = 0.05, near: float = 0.10) -> Column:
    """Mean of the largest ``far`` less mean of the smallest ``near``, at least one each; 0 if empty."""
    s = F.array_sort(lp)
    n = F.size(lp)
    top, low = (F.greatest(F.lit(1), F.floor(n * r).cast("int")) for r in (far, near))
    return F.when(n > 0, mean(F.slice(s, n - top + 1, top)) - mean(F.slice(s, F.lit(1), low))).otherwise(F.lit(0.0))


def penalised_cosine(a: Column, b: Column) -> Column:
    """Cosine of the zero-padded arrays times shorter length over longer; 0 if one is empty."""
    dot = total(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(shorter > 0, F.coalesce(F.try_divide(dot, norm), F.lit(0.0)) * shorter / longer).otherwise(F.lit(0.0))


def neighbour_scores(target: Column, others: Column) -> tuple[Column, Column]:
    """Target less mean of others, and that over their population deviation (1 if there is one value or no spread)."""
    sd = once(mean(others), lambda m: F.sqrt(total(F.transform(others, lambda x: (x - m) * (x - m))) / F.size(others)))
    d = target - mean(others)
    return d, d / once(sd, lambda s: F.when((F.size(others) <= 1) | (s == 0), F.lit(1.0)).otherwise(s))


def kappa(p: Column, pe: Column, floor: float = 1e-3) -> Column:
    return (p - pe) / F.greatest(F.lit(floor), 1 - pe)


def count_above_mean(a: Column) -> Column:
    return once(mean(a), lambda m: F.size(F.filter(a, lambda x: x > m)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_mean(a: Column) -> Column:
    """Mean of the finite elements; null if there are none."""
    return mean(F.filter(a, finite))


def diversity(tokens: Column) -> Column:
    return F.try_divide(F.size(F.array_distinct(tokens)).cast("double"), F.size(tokens).cast("double"))


def cut_at(a: Column, stop: Column) -> Column:
    """The array up to the first stop element."""
    at = F.array_position(a, stop)
    return F.when(at > 0, F.slice(a, F.lit(1), at.cast("int") - 1)).otherwise(a)


def prefix_ratio(conditional: Column, plain: Column) -> Column:
    """Conditional over plain mean log-probability; null if not finite."""
    r = F.try_divide(conditional, plain)
    return F.when(F.isnan(r) | (F.abs(r) == float("inf")), None).otherwise(r)
