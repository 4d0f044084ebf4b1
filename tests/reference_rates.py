"""The exact rate test in plain Python: brute force for the Spark expressions."""

from __future__ import annotations

import math

LEVEL = 0.95


def _log_pmf(k: float, n: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def _beta_part(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_part(1 - x, b, a)
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * h / a


def _at_most(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else _beta_part(1 - p, n - k, k + 1)


def two_sided(a: int, n: int, p: float) -> float:
    """Exact test: the sum of all counts no likelier than a. The far tail's edge is found by bisection."""
    limit, mode = _log_pmf(a, n, p) + math.log1p(1e-7), min(n, math.floor((n + 1) * p))
    if _log_pmf(mode, n, p) <= limit:
        return 1.0
    if a < mode:
        low, high = mode, n + 1  # smallest k above the mode that counts
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if _log_pmf(mid, n, p) <= limit else (mid, high)
        return min(1.0, _at_most(a, n, p) + 1.0 - _at_most(high - 1, n, p) if high <= n else _at_most(a, n, p))
    low, high = -1, mode
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if _log_pmf(mid, n, p) <= limit else (low, mid)
    upper = _beta_part(p, a, n - a + 1) if a > 0 else 1.0
    return min(1.0, upper + _at_most(low, n, p))


def interval(a: int, n: int, level: float = LEVEL) -> tuple[float, float]:
    """Clopper-Pearson bounds of a share."""
    tail = (1 - level) / 2

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    return (0.0 if a == 0 else solve(lambda q: _beta_part(q, a, n - a + 1) < tail)), (1.0 if a == n else solve(lambda q: _beta_part(1 - q, n - a, a + 1) > tail))


def compare(a: int, b: int, f: float) -> tuple[float, float, float, float]:
    """(ratio, low, high, p) of count a against b, where a/b = f is expected."""
    if f is None or not math.isfinite(f) or f <= 0:
        return math.nan, math.nan, math.nan, 1.0
    ratio, n = ((a + 0.5) / (b + 0.5)) / f, a + b
    if n == 0:
        return ratio, 0.0, math.inf, 1.0
    low, high = interval(a, n)
    odds = lambda q: math.inf if q >= 1 else q / (1 - q) / f
    return ratio, odds(low), odds(high), two_sided(a, n, f / (1 + f))
