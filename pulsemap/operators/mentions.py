"""Aggregates over the mention table (doc, theme_id, created_at, account_id, mrr, plan, channel, sentiment)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEGATIVE = -0.2
SCORE_DAYS = 60


def mentions_of(segments: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row for each document and theme, ``primary`` where the theme comes first in the document."""
    first = segments.filter(F.col("theme_id").isNotNull()).groupBy("doc_id", "theme_id").agg(F.min("position").alias("position"))
    order = Window.partitionBy("doc_id").orderBy("position", "theme_id")
    return first.withColumn("primary", F.row_number().over(order) == 1).join(feedback.select("doc_id", "created_at", "account_id", "mrr", "plan", "channel", "sentiment"), "doc_id").withColumnRenamed("doc_id", "doc")


def with_accounts(feedback: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """feedback with mrr (0) and plan (unknown). Spark picks the join by size; accounts may be large."""
    if accounts is None:
        return feedback.withColumns({"mrr": F.lit(0.0), "plan": F.lit("unknown")})
    return feedback.join(accounts.select("account_id", "mrr", "plan"), "account_id", "left").withColumns({"mrr": F.coalesce("mrr", F.lit(0.0)), "plan": F.coalesce("plan", F.lit("unknown"))})


def visible(df: DataFrame, as_of: Column, column: str = "created_at") -> DataFrame:
    """Rows up to the end of the day of as_of."""
    return df.filter(F.col(column) < F.date_trunc("day", as_of) + F.expr("interval 1 day"))


def score_window(df: DataFrame, as_of: Column, days: int = SCORE_DAYS) -> DataFrame:
    """The calendar days that end with as_of's."""
    return visible(df, as_of).filter(F.col("created_at") >= F.date_trunc("day", as_of) - F.expr(f"interval {days - 1} day"))


def mix(mentions: DataFrame, column: str) -> DataFrame:
    """(theme_id, {column}_mix): shares of its values, rounded half-even to three places."""
    counts = mentions.groupBy("theme_id", column).count()
    shares = counts.withColumn("share", F.bround(F.col("count") / F.sum("count").over(Window.partitionBy("theme_id")), 3))
    return shares.groupBy("theme_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "share")))).alias(f"{column}_mix"))


def theme_metrics(mentions: DataFrame, n_docs: int | Column) -> DataFrame:
    """Counts, money and sentiment of each theme. An account's revenue is exposed once a theme, and its weight is shared over all its mentions. Mentions without an account are those of one account."""
    # per theme and account first: two small sums instead of a distinct over mentions, and an account's weight is a sum over its few themes
    pair = mentions.groupBy("theme_id", "account_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("doc").alias("docs"), F.max("mrr").alias("mrr"), F.sum(F.col("primary").cast("int")).alias("primary"), F.sum("sentiment").alias("sentiment"),
        F.count("sentiment").alias("scored"), F.sum(F.when(F.col("sentiment") < NEGATIVE, 1).otherwise(0)).alias("negative"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.sum("mrr").alias("mrr_rows"),
    )
    weighed = pair.withColumn("_all", F.sum("rows").over(Window.partitionBy("account_id")))
    return weighed.groupBy("theme_id").agg(
        F.sum("docs").alias("mentions"), F.sum("primary").alias("primary_mentions"), F.count(F.lit(1)).alias("accounts"), F.sum("mrr").alias("mrr_exposed"), F.sum(F.col("mrr_rows") / F.col("_all")).alias("mrr_weighted"),
        (F.sum("sentiment") / F.sum("scored")).alias("mean_sentiment"), (F.sum("negative") / F.sum("rows")).alias("negative_share"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).withColumns({"arr_exposed": F.col("mrr_exposed") * 12, "share": F.col("mentions") / F.greatest(F.lit(n_docs) if isinstance(n_docs, int) else n_docs, F.lit(1))})


def window_counts(mentions: DataFrame, windows: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(theme_id, one count for each half-open window): all windows in one pass."""
    inside = lambda w: (F.col("created_at") >= w[0]) & (F.col("created_at") < w[1])
    return mentions.groupBy("theme_id").agg(*[F.countDistinct(F.when(inside(w), F.col("doc"))).alias(name) for name, w in windows.items()])


def weekly_mentions(mentions: DataFrame, feedback: DataFrame) -> DataFrame:
    """(week, theme_id, n, total), long: Monday weeks with any feedback, zeros where a theme has none."""
    weeks = feedback.groupBy(F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(F.count(F.lit(1)).alias("total"))
    themes = mentions.select("theme_id").distinct()
    counts = mentions.groupBy(F.to_date(F.date_trunc("week", "created_at")).alias("week"), "theme_id").agg(F.countDistinct("doc").alias("n"))
    grid = weeks.crossJoin(themes)  # weeks x themes, a table of the report
    return grid.join(counts, ["week", "theme_id"], "left").select("week", "theme_id", F.coalesce("n", F.lit(0)).alias("n"), "total")


def calendar(items: DataFrame) -> DataFrame:
    """(day): every day from the first item's to the last's."""
    return items.agg(F.min(F.to_date("created_at")).alias("a"), F.max(F.to_date("created_at")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))


def daily_grid(mentions: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(day, theme_id, n) for every theme and day between the first and the last mention, or item where items are given."""
    counts = mentions.groupBy(F.to_date("created_at").alias("day"), "theme_id").agg(F.countDistinct("doc").alias("n"))
    days = calendar(mentions if items is None else items)
    return days.crossJoin(mentions.select("theme_id").distinct()).join(counts, ["day", "theme_id"], "left").select("day", "theme_id", F.coalesce("n", F.lit(0)).alias("n"))


def daily_items(items: DataFrame) -> DataFrame:
    """(day, n) of all items, days without any too."""
    counts = items.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar(items).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def trailing(grid: DataFrame) -> DataFrame:
    """The grid with the sums of the last 7 days and of the 28 before, and the naive rule of twice the usual and at least 5."""
    w = Window.partitionBy("theme_id").orderBy("day")
    out = grid.withColumns({"last7": F.sum("n").over(w.rowsBetween(-6, 0)), "prior28": F.coalesce(F.sum("n").over(w.rowsBetween(-34, -7)), F.lit(0))})
    return out.withColumn("naive", (F.col("last7") >= 2 * F.col("prior28") / 4) & (F.col("last7") >= 5))


def episodes(alerts: DataFrame) -> DataFrame:
    """(theme_id, first_day, last_day): runs of consecutive alert days."""
    w = Window.partitionBy("theme_id").orderBy("day")
    starts = alerts.select("theme_id", "day").distinct().withColumn("new", F.coalesce(F.datediff("day", F.lag("day").over(w)) != 1, F.lit(True)).cast("int"))
    return starts.withColumn("run", F.sum("new").over(w)).groupBy("theme_id", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("run")
