"""Intervals and differences as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V

Z = V.Z95


def _d(c: Column) -> Column:
    return c.cast("double")


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """AGG-09: bounds of Wilson's score interval; null where n is 0 or k above n."""
    k, n = _d(k), _d(n)
    below = n + Z * Z
    centre = (k + Z * Z / 2) / below
    half = F.lit(Z) / below * F.sqrt(k * (n - k) / n + Z * Z / 4)
    good = (n > 0) & (k <= n)
    lo = F.when(good, F.when(k == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half)))
    hi = F.when(good, F.when(k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half)))
    return lo, hi


def _root(c: Column) -> Column:
    return F.sqrt(F.greatest(c, F.lit(0.0)))


def newcombe(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """AGG-10: theta and bounds of the paired difference of a 2 x 2 table, not clamped."""
    a, b, c, d = map(_d, (a, b, c, d))
    n, one, two = a + b + c + d, a + b, a + c
    p1, p2 = one / n, two / n
    (l1, u1), (l2, u2) = wilson(one, n), wilson(two, n)
    margins = one * (c + d) * two * (b + d)
    cross = a * d - b * c
    damped = F.when(cross > 0, F.greatest(cross - n / 2, F.lit(0.0))).otherwise(cross)
    phi = F.when(margins == 0, F.lit(0.0)).otherwise(damped / F.sqrt(F.when(margins != 0, margins)))
    spread = lambda x, y: _root(x * x - 2 * phi * x * y + y * y)
    theta = (b - c) / n
    return theta, theta - spread(p1 - l1, u2 - p2), theta + spread(u1 - p1, p2 - l2)


def unpaired(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """AGG-11, a diagnostic: bounds as if the two conditions were independent."""
    a, b, c, d = map(_d, (a, b, c, d))
    n, one, two = a + b + c + d, a + b, a + c
    (l1, u1), (l2, u2) = wilson(one, n), wilson(two, n)
    theta = (b - c) / n
    return theta - F.hypot(one / n - l1, u2 - two / n), theta + F.hypot(u1 - one / n, two / n - l2)


def mover(x: Column, x_lo: Column, x_hi: Column, y: Column, y_lo: Column, y_hi: Column) -> tuple[Column, Column, Column]:
    """AGG-11: the difference of two independent estimates, from their intervals."""
    return x - y, x - y - F.hypot(x - x_lo, y_hi - y), x - y + F.hypot(x_hi - x, y - y_lo)


def hanley_mcneil(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """AGG-11, a diagnostic that nothing published uses: the closed-form variance of an AUC."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return (auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)) / (n_pos * n_neg)


def softmax(logits: Column) -> Column:
    """MDL-01: stable softmax of an array; null if a logit isn't finite."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    finite = F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite & (F.size(logits) > 0), F.transform(e, lambda x: x / total))


def windows(tokens: Column, size: int) -> Column:
    """MDL-03: consecutive windows of at most ``size`` tokens; one, empty, for no tokens."""
    n = F.greatest(F.ceil(F.size(tokens) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * size + 1, size))


def nearest_rank(q_num: int, q_den: int, n: Column) -> Column:
    """AGG-14: the rank, from 1, of the q-quantile among n: ceil(q n) in whole numbers."""
    return F.floor((F.lit(q_num) * n + (q_den - 1)) / q_den).cast("long")
