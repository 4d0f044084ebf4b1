"""Release radar: what changed around each release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import saved
from .stats import benjamini_hochberg, compare_rates, volume_ratio

WINDOW_DAYS, ALPHA, SIDE_LIFT, SIDE_LEAST = 28, 0.05, 1.5, 5


def windows(releases: DataFrame, first_day: Column, end_day: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """releases with pre_start, pre_end, post_end: cut at the neighbouring release days and at the data's ends."""
    order = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a release day
    near = releases.select(F.to_date("date").alias("day")).distinct().withColumns({"before": F.lag("day").over(order), "after": F.lead("day").over(order)})
    out = releases.withColumn("day", F.to_date("date")).join(near, "day")
    return out.withColumns(
        {
            "pre_start": F.greatest(F.date_sub("day", days), F.coalesce("before", F.date_sub("day", days)), first_day),
            "pre_end": F.col("day"),
            "post_end": F.least(F.date_add("day", days), F.coalesce("after", F.date_add("day", days)), end_day),
        }
    ).drop("before", "after")


def verdict(alpha: float = ALPHA) -> Column:
    wide = (F.col("ci_low") <= 0) | (F.col("ci_high") / F.col("ci_low") > 6)
    few = F.col("pre_mentions") + F.col("post_mentions") < 20
    return (
        F.when(F.col("rate_ratio").isNull() | F.isnan("rate_ratio"), "Not enough data").when((F.col("p_value") >= alpha) & (few | wide), "Inconclusive").when(F.col("p_value") >= alpha, "No detectable change").when(F.col("rate_ratio") <= 0.5, "Resolved").when(F.col("rate_ratio") < 1, "Improved").otherwise("Worse")
    )


def release_counts(mentions: DataFrame, feedback: DataFrame, placed: DataFrame) -> DataFrame:
    """(version, theme_id, pre, post, n_pre, n_post). Days are counted once, then joined to the few release windows by day, an equi-join."""
    spans = placed.select("version", F.explode(F.expr("filter(sequence(pre_start, date_sub(greatest(post_end, pre_start), 1)), x -> pre_start < post_end)")).alias("day"), "pre_end").withColumn("side", F.when(F.col("day") < F.col("pre_end"), "pre").otherwise("post")).drop("pre_end")
    spans = F.broadcast(spans)  # at most 2 x WINDOW_DAYS rows a release
    docs = mentions.select(F.to_date("created_at").alias("day"), "theme_id", "doc").distinct().groupBy("day", "theme_id").agg(F.count(F.lit(1)).alias("n"))
    per = docs.join(spans, "day").groupBy("version", "theme_id").agg(F.sum(F.when(F.col("side") == "pre", F.col("n")).otherwise(0)).alias("pre"), F.sum(F.when(F.col("side") == "post", F.col("n")).otherwise(0)).alias("post"))
    items = feedback.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    totals = items.join(spans, "day").groupBy("version").agg(F.sum(F.when(F.col("side") == "pre", F.col("n")).otherwise(0)).alias("n_pre"), F.sum(F.when(F.col("side") == "post", F.col("n")).otherwise(0)).alias("n_post"))
    grid = placed.select("version").crossJoin(mentions.select("theme_id").distinct())  # releases x themes
    return grid.join(per, ["version", "theme_id"], "left").join(totals, "version", "left").na.fill(0, ["pre", "post", "n_pre", "n_post"])


def release_radar(mentions: DataFrame, feedback: DataFrame, releases: DataFrame, days: int = WINDOW_DAYS, alpha: float = ALPHA, method: str = "median_of_ratios") -> tuple[DataFrame, DataFrame]:
    """(one row a release, one row a suspected side effect). releases: version, date, title, theme_id (null without a match)."""
    low, high = feedback.agg(F.min(F.to_date("created_at")), F.date_add(F.max(F.to_date("created_at")), 1)).first()
    placed = windows(releases, F.lit(low), F.lit(high), days)
    counts = saved(release_counts(mentions, feedback, placed), "release-counts")  # releases x themes, read four times
    expected = volume_ratio(counts.withColumnsRenamed({"post": "a", "pre": "b"}), F.col("n_post"), F.col("n_pre"), ("version",), method)
    tested = saved(counts.join(expected, "version").filter("n_pre > 0 and n_post > 0").withColumn("r", compare_rates(F.col("post"), F.col("pre"), F.col("expected"))).select("version", "theme_id", F.col("pre").alias("pre_mentions"), F.col("post").alias("post_mentions"), F.col("r.ratio").alias("rate_ratio"), F.col("r.ci_low").alias("ci_low"), F.col("r.ci_high").alias("ci_high"), F.col("r.p_value").alias("p_value")), "release-tests")
    per_release = counts.groupBy("version").agg(F.max("n_pre").alias("n_pre"), F.max("n_post").alias("n_post"))
    radar = placed.join(per_release, "version", "left").join(tested, ["version", "theme_id"], "left").withColumns({"pre_days": F.datediff("pre_end", "pre_start"), "post_days": F.datediff("post_end", "pre_end")})
    empty = (F.coalesce("n_pre", F.lit(0)) == 0) | (F.coalesce("n_post", F.lit(0)) == 0)
    radar = radar.withColumn("verdict", F.when(empty, "Not enough data").when(F.col("theme_id").isNull(), "No matching theme").otherwise(verdict(alpha)))
    own = placed.select("version", F.col("theme_id").alias("own"))
    others = tested.join(own, "version").filter(F.col("own").isNull() | (F.col("own") != F.col("theme_id")))
    effects = benjamini_hochberg(others, by=("version",)).filter((F.col("q_value") < alpha) & (F.col("rate_ratio") >= SIDE_LIFT) & (F.col("post_mentions") >= SIDE_LEAST))
    return radar.select("version", "day", "title", "theme_id", "pre_days", "post_days", "pre_mentions", "post_mentions", "rate_ratio", "ci_low", "ci_high", "p_value", "verdict"), effects.select("version", "theme_id", "pre_mentions", "post_mentions", "rate_ratio", "q_value")
