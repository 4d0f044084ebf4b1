"""Exact tests and intervals as expressions, against plain Python and against sums of all probabilities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsemap.operators import stats
from pulsemap.plans import queries as Q

from . import reference_rates as rates
from .conftest import DATA, same

COUNTS = [(0, 0), (0, 1), (1, 0), (3, 0), (0, 7), (5, 5), (18, 4), (2, 4), (15, 125), (136, 28), (86, 84), (12, 27), (1, 300), (400, 3), (1000, 900), (5000, 5400), (40_000, 39_000)]


def told(spark, rows):
    df = spark.createDataFrame(rows, "a long, b long, f double").repartition(8)
    return {(r["a"], r["b"], r["f"]): tuple(r["r"]) for r in df.select("a", "b", "f", stats.compare_rates(F.col("a"), F.col("b"), F.col("f")).alias("r")).collect()}


def test_expressions_equal_plain_python(spark):
    rng = random.Random(0)
    rows = [(a, b, f) for a, b in COUNTS for f in (0.3, 1.0, 2.7)] + [(rng.randint(0, 80), rng.randint(0, 80), math.exp(rng.gauss(0, 1))) for _ in range(150)]
    for (a, b, f), got in told(spark, rows).items():
        want = rates.compare(a, b, f)
        for x, y in zip(got, want, strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-10), (a, b, f, got, want)


def test_without_a_usable_expectation(spark):
    df = spark.createDataFrame([(3, 4, None), (3, 4, math.nan), (3, 4, 0.0), (3, 4, -1.0), (3, 4, math.inf)], "a long, b long, f double")
    for r in df.select(stats.compare_rates(F.col("a"), F.col("b"), F.col("f")).alias("r")).collect():
        ratio, low, high, p = r["r"]
        assert math.isnan(ratio) and math.isnan(low) and math.isnan(high) and p == 1


def test_p_values_are_sums_of_probabilities(spark):
    for (a, b, f), got in told(spark, [(a, n - a, f) for n in (1, 7, 20) for a in range(n + 1) for f in (0.4, 1.0)]).items():
        n, p = a + b, f / (1 + f)
        pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        assert got[3] == pytest.approx(min(1, sum(x for x in pmf if x <= pmf[a] * (1 + 1e-7))), rel=1e-9)


def test_a_table_without_python(spark):
    df = spark.range(10).select(stats.compare_rates(F.col("id"), F.col("id") + 3, F.lit(1.2)).alias("r"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["release_verdicts", "early_warnings", "release_radar"])
def test_queries(spark, duck, name):
    same(Q.QUERIES[name](spark, DATA), duck, Q.ORACLE[name])
