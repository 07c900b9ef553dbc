"""Tail probabilities of the normal, t, F and chi-square distributions, in plain Python."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by a continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def gamma_sf(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_sf2(z: float) -> float:
    """Both tails of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_sf2(t: float, df: float) -> float:
    """Both tails of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def _bisect(tail, p: float) -> float:
    low, high = 0.0, 1.0
    while tail(high) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > p else (low, mid)
    return (low + high) / 2


def t_crit(df: float, alpha: float = 0.05) -> float:
    return _bisect(lambda t: t_sf2(t, df), alpha)


def z_crit(alpha: float = 0.05) -> float:
    return _bisect(normal_sf2, alpha)
