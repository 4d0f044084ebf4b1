"""Rate tests: volume normalisation, exact binomial comparison, false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import exact

LEAST_COUNT, LEAST_THEMES, LEVEL = 10, 4, 0.95


def volume_ratio(counts: DataFrame, total_a: Column, total_b: Column, by: tuple[str, ...] = (), method: str = "median_of_ratios") -> DataFrame:
    """(*by, expected) from (a, b) per theme: exp of the median log ratio over themes with enough items, else the ratio of totals.

    total_a, total_b: expressions that are constant within a group of ``by``.
    """
    enough = F.col("a") + F.col("b") >= LEAST_COUNT
    ratio = F.when(enough, F.ln((F.col("a") + 0.5) / (F.col("b") + 0.5)))
    got = counts.groupBy(*by).agg(F.median(ratio).alias("m"), F.count(ratio).alias("n"), F.max(total_a).alias("ta"), F.max(total_b).alias("tb"))
    totals = F.when((F.col("ta") > 0) & (F.col("tb") > 0), F.col("ta") / F.col("tb")).otherwise(F.lit(float("nan")))
    use = (F.col("n") >= LEAST_THEMES) & F.lit(method != "total")
    return got.select(*by, F.when(use, F.exp("m")).otherwise(totals).alias("expected"))


def compare_rates(a: Column, b: Column, f: Column) -> Column:
    """struct<ratio, ci_low, ci_high, p_value> of count a against b, where a / b = f is expected: bounds of the ratio at LEVEL, and the exact two-sided test.

    Without a usable f there is no ratio and p is 1; without counts the bounds are 0 and infinity. All in Spark expressions, see ``exact``.
    """
    a, b, f = a.cast("double"), b.cast("double"), f.cast("double")
    n, nan, most = a + b, F.lit(float("nan")), F.lit(float("inf"))
    known = F.coalesce((f > 0) & (f < most), F.lit(False))  # not a number is above all numbers
    told = known & (n > 0)
    low, high = exact.interval(a, n, LEVEL)
    odds = lambda share: exact.let(share, lambda q: F.when(q >= 1, most).otherwise(q / (1 - q) / f))
    return F.struct(
        F.when(known, (a + 0.5) / (b + 0.5) / f).otherwise(nan).alias("ratio"),
        F.when(told, odds(low)).when(known, 0.0).otherwise(nan).alias("ci_low"),
        F.when(told, odds(high)).when(known, most).otherwise(nan).alias("ci_high"),
        F.when(told, exact.two_sided(a, n, f / (1 + f))).otherwise(1.0).alias("p_value"),
    )


def benjamini_hochberg(df: DataFrame, p: str = "p_value", by: tuple[str, ...] = (), q: str = "q_value") -> DataFrame:
    """df with q: p n / rank, made monotone from above. One row a test, so groups are as large as the number of themes."""
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = df.withColumns({"_rank": F.row_number().over(groups.orderBy(p)), "_n": F.count(F.lit(1)).over(groups)})
    raw = F.col(p) * F.col("_n") / F.col("_rank")
    return ranked.withColumn(q, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(raw).over(groups.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))))).drop("_rank", "_n")
