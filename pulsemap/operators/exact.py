"""Exact binomial tests and intervals as Spark expressions.

Probabilities come from the saddle-point form of the binomial, which keeps its digits at any count; tails from
the continued fraction of the incomplete beta function, in a number of steps that grows with the root of the
count; the far tail's edge from bisection over counts; interval bounds from Newton steps kept within a bracket.
All loops are ``aggregate`` over a sequence, so nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound as let

#: Errors of Stirling's formula for 0 to 15, and Newton steps of a bound.
SMALL = [0.0, *(math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16))]
STEPS, TINY = 16, 1e-300


def _stirling_error(n: Column) -> Column:
    """log n! minus Stirling's formula."""
    i = 1 / (n * n)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - i / 1188) * i) * i) * i) / n
    return F.when(n <= 15, F.element_at(F.array(*map(F.lit, SMALL)), n.cast("int") + 1)).otherwise(series)


def _deviance(x: Column, m: Column) -> Column:
    """x log(x / m) + m - x, without cancellation where the two are close."""

    def near(v: Column) -> Column:
        square, h = v * v, F.lit(0.0)
        for j in range(9, 0, -1):
            h = square * (1 / (2 * j + 1) + h)
        return (x - m) * v + 2 * x * v * h

    return F.when(F.abs(x - m) < 0.1 * (x + m), let((x - m) / (x + m), near)).otherwise(x * F.ln(x / m) + m - x)


def _each(values: list[Column], use) -> Column:
    """use of each value; one copy of the expression serves all, which keeps plans small."""
    return F.transform(F.array(*values), use)


def log_pmf(k: Column, n: Column, p: Column) -> Column:
    """log of the binomial probability of k in n, 0 < p < 1."""
    errors = _each([n, k, n - k], _stirling_error)
    parts = _each([F.struct(k.alias("x"), (n * p).alias("m")), F.struct((n - k).alias("x"), (n * (1 - p)).alias("m"))], lambda s: _deviance(s["x"], s["m"]))
    sums = lambda e, d: F.get(e, F.lit(0)) - F.get(e, F.lit(1)) - F.get(e, F.lit(2)) - F.get(d, F.lit(0)) - F.get(d, F.lit(1))
    inner = let(errors, lambda e: let(parts, lambda d: sums(e, d))) + 0.5 * F.ln(n / (2 * math.pi * k * (n - k)))
    return F.when(k == 0, n * F.log1p(-p)).when(k == n, n * F.ln(p)).otherwise(inner)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, for x not beyond its mean."""
    away = lambda v: F.when(F.abs(v) > TINY, v).otherwise(F.lit(TINY))
    first = let(1 / away(1 - (a + b) * x / (a + 1)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), F.lit(False).alias("done")))

    def half(s: Column, by: Column) -> Column:
        return let(F.struct(away(1 + by / s["c"]).alias("c"), (1 / away(1 + by * s["d"])).alias("d")), lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (s["h"] * t["c"] * t["d"]).alias("h"), (F.abs(t["c"] * t["d"] - 1) < 3e-16).alias("done")))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(s["done"], s).otherwise(let(half(s, even), lambda t: half(t, odd)))

    steps = (F.lit(20) + 3 * F.sqrt(a + b)).cast("int")
    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double")), first, step)["h"]


def at_least(k: Column, n: Column, p: Column) -> Column:
    """struct<upper, lower>: the probabilities of k or more and of fewer than k, 1 <= k <= n; the smaller one has all its digits."""
    direct = p <= (k + 1) / (n + 3)
    side = F.when(direct, F.struct(p.alias("x"), k.alias("a"), (n - k + 1).alias("b"), k.alias("k"))).otherwise(F.struct((1 - p).alias("x"), (n - k + 1).alias("a"), k.alias("b"), (k - 1).alias("k")))
    small = let(side, lambda s: F.exp(log_pmf(s["k"], n, p)) * (1 - s["x"]) * _fraction(s["x"], s["a"], s["b"]))
    return let(small, lambda v: F.struct(F.when(direct, v).otherwise(1 - v).alias("upper"), F.when(direct, 1 - v).otherwise(v).alias("lower")))


def two_sided(a: Column, n: Column, p: Column) -> Column:
    """Exact test: the sum of all counts no likelier than a, n >= 1."""
    mode = F.least(n, F.floor((n + 1) * p).cast("double"))
    rounds = F.sequence(F.lit(1), (F.log2(n + 2) + 2).cast("int"))

    def edge(m: Column, likely: Column) -> Column:
        """On the other side of the mode, the count nearest to it that is no likelier than a; n + 1 or -1 if there is none."""
        below = a < m

        def halved(s: Column, _: Column) -> Column:
            def cut(mid: Column) -> Column:
                hit = log_pmf(mid, n, p) <= likely
                return F.when(hit != below, F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

            return F.when(s["high"] - s["low"] > 1, let(F.floor((s["low"] + s["high"]) / 2).cast("double"), cut)).otherwise(s)

        ends = F.struct(F.when(below, m).otherwise(-1.0).alias("low"), F.when(below, n + 1).otherwise(m).alias("high"))
        return let(F.aggregate(rounds, ends, halved), lambda s: F.when(below, s["high"]).otherwise(s["low"]))

    def tails(m: Column, far: Column) -> Column:
        below = a < m
        near, other = F.when(below, a + 1).otherwise(a), F.when(below, far).otherwise(far + 1)
        sure = F.struct(F.lit(1.0).alias("upper"), F.lit(0.0).alias("lower"))
        never = F.struct(F.lit(0.0).alias("upper"), F.lit(1.0).alias("lower"))
        both = _each([near, other], lambda k: F.when(k <= 0, sure).when(k > n, never).otherwise(at_least(k, n, p)))
        return let(both, lambda t: F.when(below, F.get(t, F.lit(0))["lower"] + F.get(t, F.lit(1))["upper"]).otherwise(F.get(t, F.lit(0))["upper"] + F.get(t, F.lit(1))["lower"]))

    def tested(m: Column) -> Column:
        return let(_each([a, m], lambda k: log_pmf(k, n, p)), lambda l: let(F.get(l, F.lit(0)) + math.log1p(1e-7), lambda v: F.when(F.get(l, F.lit(1)) <= v, 1.0).otherwise(let(edge(m, v), lambda far: tails(m, far)))))

    return F.least(F.lit(1.0), let(mode, tested))


def lower_bound(a: Column, n: Column, level: float) -> Column:
    """The share at which a or more of n has half the probability left by the level, a >= 1: Newton steps on its logarithm, kept within a bracket."""
    tail, z = math.log((1 - level) / 2), 1.96
    share = a / n
    middle = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    start = F.greatest(F.least(middle, F.lit(1 - 1e-12)), F.lit(1e-12))

    def step(s: Column, _: Column) -> Column:
        q = s["q"]

        def moved(u: Column) -> Column:
            slope = a * F.exp(log_pmf(a, n, q)) / q / u
            over = F.ln(u) > tail
            low, high = F.when(over, s["low"]).otherwise(q), F.when(over, q).otherwise(s["high"])
            return let(q - (F.ln(u) - tail) / slope, lambda new: chosen(new, low, high))

        def chosen(new: Column, low: Column, high: Column) -> Column:
            stay = F.abs(new - q) <= 1e-15 * q
            return F.struct(low.alias("low"), high.alias("high"), F.when(stay, q).when((new > low) & (new < high), new).otherwise((low + high) / 2).alias("q"), stay.alias("done"))

        return F.when(s["done"], s).otherwise(let(F.greatest(at_least(a, n, q)["upper"], F.lit(TINY)), moved))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), start.alias("q"), F.lit(False).alias("done")), step)["q"]


def interval(a: Column, n: Column, level: float) -> tuple[Column, Column]:
    """Clopper-Pearson bounds of a share, n >= 1: the upper one is the lower one of the other share."""
    ends = _each([a, n - a], lambda k: F.when(k == 0, 0.0).otherwise(lower_bound(k, n, level)))
    return F.get(ends, F.lit(0)), 1 - F.get(ends, F.lit(1))
