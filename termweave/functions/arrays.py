"""Numeric and array column functions (PF11, PF13, PF14, PF16, PF18, losses AG20-AG22)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    """PF11: NaN and infinities become 0."""
    value = col.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


def finite_array(col: Column) -> Column:
    """PF11 for every element of an array."""
    return F.transform(col, finite)


def entropy_confidence(col: Column) -> Column:
    """PF13: ``1 - H(p) / ln 20`` with every probability floored at 1e-9."""
    floored = F.transform(col, lambda p: F.greatest(p.cast("double"), F.lit(1e-9)))
    entropy = F.aggregate(floored, F.lit(0.0), lambda acc, p: acc - p * F.ln(p))
    return F.lit(1.0) - entropy / F.lit(math.log(20.0))


def sigmoid(col: Column) -> Column:
    """PF14: logit to probability."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def take(col: Column, indices: Sequence[int], expected: int | None = None) -> Column:
    """PF16: elements at the given zero-based positions; ``expected`` pins how many."""
    if expected is not None and len(indices) != expected:
        raise ValueError(f"expected {expected} positions, got {len(indices)}")
    return F.transform(F.array(*[F.lit(int(i) + 1) for i in indices]), lambda i: F.element_at(col, i))


def fit_length(col: Column, n: Column | int, pad: float = 0.0) -> Column:
    """PF18: cut or zero-pad an array to length ``n``."""
    length = F.lit(n) if isinstance(n, int) else n
    missing = F.greatest(length - F.size(col), F.lit(0)).cast("int")
    return F.concat(F.slice(col, F.lit(1), length), F.array_repeat(F.lit(pad), missing))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def bce(logit: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """AG20: binary cross entropy of a logit, stable form, optional positive weight."""
    weight = F.lit(pos_weight) if isinstance(pos_weight, (int, float)) else pos_weight
    log_term = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (F.lit(1.0) - y) * logit + (F.lit(1.0) + (weight - 1.0) * y) * log_term


def _softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def focal(logit: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25, eps: float = 1e-8) -> Column:
    """AG21: focal loss ``a_t (1 - p_t)^gamma (-log p_t)``.

    For a label y the log odds of the true class are ``(2y - 1) logit``, so ``-log p_t`` is the softplus of
    their negative; it mixes linearly for labels between 0 and 1. ``p_t`` is clamped by ``eps``.
    """
    surprise = y * _softplus(-logit) + (1 - y) * _softplus(logit)
    missed = F.least(F.greatest(1 - F.exp(-surprise), F.lit(eps)), F.lit(1 - eps))
    return ((1 - alpha) + (2 * alpha - 1) * y) * F.exp(gamma * F.ln(missed)) * surprise


def asymmetric(
    logit: Column, y: Column, gp: float = 0.0, gn: float = 4.0, clip: float = 0.025, eps: float = 1e-8
) -> Column:
    """AG22: asymmetric loss ``-y (1 - p)^gp log p - (1 - y) p^gn log(1 - min(p + clip, 1))``.

    Both powers are of clamped probabilities, written through logarithms; the shift by ``clip`` enters
    only the logarithm of the negative term.
    """
    low, high = math.log(eps), math.log1p(-eps)

    def bounded(log_p: Column) -> Column:
        return F.least(F.greatest(log_p, F.lit(low)), F.lit(high))

    log_yes, log_no = bounded(-_softplus(-logit)), bounded(-_softplus(logit))
    rest = F.greatest(1 - F.exp(log_yes) - max(clip, 0.0), F.lit(eps))
    hit = -y * F.exp(max(gp, 0.0) * log_no) * log_yes
    miss = -(1 - y) * F.exp(max(gn, 0.0) * log_yes) * F.ln(rest)
    return hit + miss
