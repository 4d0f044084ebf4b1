"""Agreement of found themes with known ones, from their contingency counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).cast("string").alias("t"), F.coalesce(F.col(pred).cast("string"), F.lit("(none)")).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """One row: items, adjusted_rand, nmi, homogeneity, completeness of (t, p, n)."""
    n2 = lambda c: F.col(c) * (F.col(c) - 1) / 2
    rows = table.groupBy("t").agg(F.sum("n").alias("m"))
    cols = table.groupBy("p").agg(F.sum("n").alias("m"))
    total = table.agg(F.sum("n").alias("n"), F.sum(n2("n")).alias("s"))
    side = lambda d, k: d.crossJoin(total.select("n")).agg(F.sum(n2("m")).alias(f"s{k}"), (-F.sum(F.col("m") / F.col("n") * F.ln(F.col("m") / F.col("n")))).alias(f"h{k}"))
    mutual = table.join(rows.withColumnRenamed("m", "mt"), "t").join(cols.withColumnRenamed("m", "mp"), "p").crossJoin(total.select(F.col("n").alias("nn"))).agg(F.sum(F.col("n") / F.col("nn") * F.ln(F.col("nn") * F.col("n") / (F.col("mt") * F.col("mp")))).alias("mi"))
    one = total.crossJoin(side(rows, "t")).crossJoin(side(cols, "p")).crossJoin(mutual)  # single rows
    chance = F.col("st") * F.col("sp") / (F.col("n") * (F.col("n") - 1) / 2)
    share = lambda x, y: F.when(y == 0, 1.0).otherwise(x / y)
    return one.select(
        F.col("n").alias("items"),
        F.when((F.col("st") + F.col("sp")) / 2 == chance, 1.0).otherwise((F.col("s") - chance) / ((F.col("st") + F.col("sp")) / 2 - chance)).alias("adjusted_rand"),
        share(F.col("mi"), (F.col("ht") + F.col("hp")) / 2).alias("nmi"), share(F.col("mi"), F.col("ht")).alias("homogeneity"), share(F.col("mi"), F.col("hp")).alias("completeness"),
    )


def majority(table: DataFrame) -> DataFrame:
    """(p, t): the most frequent known theme of each found one, ties to the smaller name."""
    return table.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), "t"))).filter("k = 1").select("p", "t")


def recovery(table: DataFrame) -> DataFrame:
    """One row a known theme: items, recovered_share, themes, largest_theme, largest_theme_share, largest_theme_purity."""
    # items without a theme are recovered by none
    named = table.join(majority(table.filter(F.col("p") != "(none)")).withColumnRenamed("t", "about"), "p", "left").withColumn("size", F.sum("n").over(Window.partitionBy("p")))
    order = Window.partitionBy("t").orderBy(F.desc("n"), "p")
    first = named.withColumn("k", F.row_number().over(order))
    return first.groupBy("t").agg(
        F.sum("n").alias("items"), (F.sum(F.when(F.col("about") == F.col("t"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recovered_share"), F.count(F.when(F.col("about") == F.col("t"), 1)).alias("themes"),
        F.max(F.when(F.col("k") == 1, F.col("p"))).alias("largest_theme"), (F.max(F.when(F.col("k") == 1, F.col("n"))) / F.sum("n")).alias("largest_theme_share"), F.max(F.when(F.col("k") == 1, F.col("n") / F.col("size"))).alias("largest_theme_purity"),
    ).withColumnRenamed("t", "true_theme")


def coverage(table: DataFrame) -> DataFrame:
    """One row: themes_found, true_themes, unassigned_share, mean_recovered_share of (t, p, n)."""
    none = F.col("p") == "(none)"
    counted = table.agg(F.countDistinct(F.when(~none, F.col("p"))).alias("themes_found"), F.countDistinct("t").alias("true_themes"), (F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)) / F.sum("n")).alias("unassigned_share"))
    return counted.crossJoin(recovery(table).agg(F.avg("recovered_share").alias("mean_recovered_share")))  # single rows


def sentiment_quality(scored: DataFrame) -> DataFrame:
    """(true_polarity, items, recall, mean_sentiment) of rows with sentiment and true_polarity; recall is null for neutral. Zero counts as positive."""
    right = F.when(F.col("true_polarity") == "positive", F.col("sentiment") >= 0).when(F.col("true_polarity") == "negative", F.col("sentiment") < 0)
    return scored.groupBy("true_polarity").agg(F.count(F.lit(1)).alias("items"), F.avg(right.cast("double")).alias("recall"), F.avg("sentiment").alias("mean_sentiment"))


def sign_accuracy(quality: DataFrame) -> DataFrame:
    """One row over the positive and negative items: items, sign_accuracy."""
    polar = quality.filter(F.col("recall").isNotNull())
    return polar.agg(F.sum("items").alias("items"), (F.sum(F.col("recall") * F.col("items")) / F.sum("items")).alias("sign_accuracy"))


def release_matching(radar: DataFrame, named: DataFrame, intended: DataFrame) -> DataFrame:
    """Whether each release was tied to the intended theme. named: (theme_id, true_theme), intended: (version, intended_theme)."""
    out = radar.select("version", "theme_id", "verdict").join(intended, "version", "left").join(named.select("theme_id", F.col("true_theme").alias("matched_true_theme")), "theme_id", "left")
    return out.withColumn("correct", F.coalesce(F.col("matched_true_theme") == F.col("intended_theme"), F.lit(False)))


def side_effect_precision(effects: DataFrame, named: DataFrame, events: DataFrame, before: int = 2, after: int = 28) -> DataFrame:
    """One row: flagged, real, spurious. An effect (theme_id, day) is real if its theme truly spiked about then."""
    spikes = events.filter("kind = 'spike'").select(F.col("theme").alias("true_theme"), "start_date")
    told = effects.select("version", "theme_id", "day").join(named, "theme_id", "left")
    near = F.datediff("start_date", "day").between(-before, after)
    # theme is the equi-key; a theme has a handful of known events
    real = told.join(spikes, (told["true_theme"] == spikes["true_theme"]) & near, "left_semi")
    return told.agg(F.count(F.lit(1)).alias("flagged")).crossJoin(real.agg(F.count(F.lit(1)).alias("real"))).withColumn("spurious", F.col("flagged") - F.col("real"))  # single rows


ALERTS, MOVING, GROWTH = ("new", "emerging"), ("new", "emerging", "rising", "declining"), ("spike", "gradual growth")


def _within(rows: DataFrame, events: DataFrame, grace: int) -> DataFrame:
    """Rows (true_theme, day) during one of the events of their theme, or up to grace days after its end; an event without an end goes on."""
    e = events.select(F.col("theme").alias("_theme"), "start_date", "end_date")
    during = (F.col("day") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("day") <= F.date_add("end_date", grace)))
    return rows.join(e, (F.col("true_theme") == F.col("_theme")) & during, "left_semi")


def alert_log(replayed: DataFrame, trailing: DataFrame, named: DataFrame, events: DataFrame, grace: int = 28) -> DataFrame:
    """(day, method, theme_id, true_theme, expected): the alerts of the rate test and of the naive rule, and whether a known rise explains each.

    replayed: what ``trends.backtest`` gives; trailing: ``mentions.trailing``, read for the days replayed.
    """
    days = replayed.select("day").distinct()
    tested = replayed.filter(F.col("status").isin(*ALERTS)).select("day", F.lit("rate_test").alias("method"), "theme_id")
    naive = trailing.filter("naive").join(days, "day", "left_semi").select("day", F.lit("naive_2x").alias("method"), "theme_id")
    log = tested.unionByName(naive).join(named, "theme_id", "left")
    known = _within(log, events.filter(F.col("kind").isin(*GROWTH)), grace).select("day", "method", "theme_id", F.lit(True).alias("expected"))
    return log.join(known, ["day", "method", "theme_id"], "left").select("day", "method", "theme_id", "true_theme", F.coalesce("expected", F.lit(False)).alias("expected"))


def detection(log: DataFrame, events: DataFrame) -> DataFrame:
    """(spike, started, method, first_alert, days_to_detect) for every known spike and method; null where it was missed."""
    spikes = events.filter("kind = 'spike'").select(F.col("theme").alias("spike"), F.col("start_date").alias("started")).crossJoin(log.sparkSession.createDataFrame([("rate_test",), ("naive_2x",)], "method string"))
    hits = log.select(F.col("method").alias("_m"), F.col("true_theme").alias("_t"), "day")
    seen = spikes.join(hits, (F.col("method") == F.col("_m")) & (F.col("spike") == F.col("_t")) & (F.col("day") >= F.col("started")), "left")
    return seen.groupBy("spike", "started", "method").agg(F.min("day").alias("first_alert")).withColumn("days_to_detect", F.datediff("first_alert", "started"))


def alert_summary(log: DataFrame, detected: DataFrame) -> DataFrame:
    """One row a method: spikes found and missed, days to find them, false alarms as days and as runs of days."""
    from .mentions import episodes

    false = log.filter(~F.col("expected"))
    runs = episodes(false.withColumn("theme_id", F.concat_ws("\x1f", "method", "theme_id"))).groupBy(F.substring_index("theme_id", "\x1f", 1).alias("method")).agg(F.count(F.lit(1)).alias("false_alarm_episodes"))
    days = false.groupBy("method").agg(F.count(F.lit(1)).alias("false_alarm_days"))
    found = detected.groupBy("method").agg(F.count("days_to_detect").alias("spikes_detected"), F.count(F.lit(1)).alias("spikes_total"), F.median("days_to_detect").alias("median_days_to_detect"))
    return found.join(runs, "method", "left").join(days, "method", "left").na.fill(0, ["false_alarm_episodes", "false_alarm_days"])


def spurious_trend_days(replayed: DataFrame, named: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """One row: days on which a known theme was called moving though no event of its lay within the windows' horizon."""
    moving = replayed.filter(F.col("status").isin(*MOVING)).join(named, "theme_id").filter("true_theme is not null").select("day", "theme_id", "true_theme")
    return moving.agg(F.count(F.lit(1)).alias("n")).crossJoin(_within(moving, events, horizon).agg(F.count(F.lit(1)).alias("k"))).select((F.col("n") - F.col("k")).alias("spurious_trend_days"))
