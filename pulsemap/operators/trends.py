"""Early warnings: recent against baseline rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mentions import daily_grid, daily_items, window_counts
from .stats import benjamini_hochberg, compare_rates, volume_ratio

RECENT_DAYS, BASELINE_DAYS, ALPHA, QUIET, EMERGING = 28, 84, 0.05, 5, 1.5


def status(alpha: float = ALPHA) -> Column:
    a, b, q, lift = (F.col(c) for c in ("recent_mentions", "baseline_mentions", "q_value", "lift"))
    sure = q < alpha
    return (
        F.when(a + b < QUIET, "quiet").when(sure & (b == 0), "new").when(sure & (lift >= EMERGING), "emerging").when(sure & (lift > 1), "rising").when(sure & (lift < 1), "declining").otherwise("stable")
    )


def detect_trends(mentions: DataFrame, feedback: DataFrame, as_of: Column, recent_days: int = RECENT_DAYS, baseline_days: int = BASELINE_DAYS, alpha: float = ALPHA, method: str = "median_of_ratios") -> DataFrame:
    """One row a theme. Window edges come from one aggregate row, so the counts stay one pass over the mentions."""
    end = F.date_trunc("day", as_of) + F.expr("interval 1 day")
    edge = feedback.agg(F.date_trunc("day", F.min("created_at")).alias("first"))
    day = lambda n: F.expr(f"interval {n} day")
    edges = edge.select(end.alias("end"), (end - day(recent_days)).alias("recent"), F.greatest(end - day(recent_days + baseline_days), F.col("first")).alias("base"))
    e = edges.first()  # three timestamps
    recent, base = (F.lit(e["recent"]), F.lit(e["end"])), (F.lit(e["base"]), F.lit(e["recent"]))
    counts = window_counts(mentions, {"a": recent, "b": base})
    inside = lambda w: (F.col("created_at") >= w[0]) & (F.col("created_at") < w[1])
    totals = feedback.agg(F.count(F.when(inside(recent), 1)).alias("total_a"), F.count(F.when(inside(base), 1)).alias("total_b"))
    counts = counts.crossJoin(totals)  # one row
    expected = volume_ratio(counts, F.col("total_a"), F.col("total_b"), method=method)
    tested = counts.crossJoin(expected).withColumn("r", compare_rates(F.col("a"), F.col("b"), F.col("expected")))
    rows = tested.select(
        "theme_id", F.col("a").alias("recent_mentions"), F.col("b").alias("baseline_mentions"), (F.col("a") / F.greatest("total_a", F.lit(1))).alias("recent_share"), (F.col("b") / F.greatest("total_b", F.lit(1))).alias("baseline_share"),
        F.col("r.ratio").alias("lift"), F.col("r.ci_low").alias("lift_ci_low"), F.col("r.ci_high").alias("lift_ci_high"), F.col("r.p_value").alias("p_value"), "expected",
    )
    return benjamini_hochberg(rows).withColumn("status", status(alpha))


def backtest(mentions: DataFrame, items: DataFrame, recent_days: int = RECENT_DAYS, baseline_days: int = BASELINE_DAYS, from_day: int = 42, alpha: float = ALPHA, method: str = "median_of_ratios") -> DataFrame:
    """(day, theme_id, ..., status): what detect_trends would have said at the end of each day, from day from_day of the items on.

    One query instead of a loop over days: windows are running sums over the dense grid of days and themes
    and over the days' items, the tests are rows, and false discovery is controlled within each day. A
    document has one day, so daily distinct counts add up; totals count every item once, with or without themes.
    """
    by_theme, by_day = Window.partitionBy("theme_id").orderBy("day"), Window.partitionBy(F.lit(0)).orderBy("day")  # one row a day

    def windows(w, n: str, a: str, b: str) -> list[Column]:
        return [F.sum(n).over(w.rowsBetween(1 - recent_days, 0)).alias(a), F.coalesce(F.sum(n).over(w.rowsBetween(1 - recent_days - baseline_days, -recent_days)), F.lit(0)).alias(b)]

    sums = daily_grid(mentions, items).select("day", "theme_id", *windows(by_theme, "n", "a", "b"))
    totals = daily_items(items).select("day", *windows(by_day, "n", "ta", "tb"), F.row_number().over(by_day).alias("i")).filter(F.col("i") > from_day)
    counts = sums.join(totals, "day")
    expected = volume_ratio(counts, F.col("ta"), F.col("tb"), ("day",), method)
    tested = counts.join(expected, "day").withColumn("r", compare_rates(F.col("a"), F.col("b"), F.col("expected")))
    rows = tested.select("day", "theme_id", F.col("a").alias("recent_mentions"), F.col("b").alias("baseline_mentions"), F.col("r.ratio").alias("lift"), F.col("r.p_value").alias("p_value"))
    return benjamini_hochberg(rows, by=("day",)).withColumn("status", status(alpha))
