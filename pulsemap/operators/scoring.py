"""Priority scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Weights:
    reach: float = 0.25
    revenue: float = 0.35
    severity: float = 0.20
    momentum: float = 0.20

    def normalized(self) -> Weights:
        parts = (self.reach, self.revenue, self.severity, self.momentum)
        total = sum(parts)
        return Weights(*(p / total for p in parts)) if total > 0 else Weights(0.25, 0.25, 0.25, 0.25)


def score_themes(themes: DataFrame, weights: Weights = Weights(), tie: str = "theme_id") -> DataFrame:
    """themes with components, score, rank, vote_rank and rank_shift; praise is not scored. themes is a table of the report, one row a theme."""
    w, everyone = weights.normalized(), Window.partitionBy(F.lit(0))
    actionable = F.col("kind") != "praise"

    def scaled(c: str) -> Column:
        v = F.when(actionable, F.greatest(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0)
        return F.when(F.max(v).over(everyone) > 0, F.sqrt(v / F.max(v).over(everyone))).otherwise(0.0)

    lift = F.coalesce(F.col("lift"), F.lit(1.0))
    out = themes.withColumns(
        {
            "c_reach": scaled("accounts"),
            "c_revenue": scaled("mrr_weighted"),
            "c_severity": F.greatest(F.lit(0.0), F.least(F.lit(1.0), "negative_share")),
            "c_momentum": F.when(F.col("status").isin("new", "emerging", "rising"), F.least(F.lit(1.0), F.log2(F.greatest(lift, F.lit(1.0))) / 2)).otherwise(0.0),
        }
    )
    out = out.withColumn("score", F.when(actionable, 100 * (w.reach * F.col("c_reach") + w.revenue * F.col("c_revenue") + w.severity * F.col("c_severity") + w.momentum * F.col("c_momentum"))))
    number = lambda key, c: F.when(c, F.row_number().over(everyone.orderBy(key.desc_nulls_last(), tie)))
    out = out.withColumns({"rank": number(F.col("score"), F.col("score").isNotNull()), "vote_rank": number(F.when(actionable, F.col("mentions")), actionable)})
    return out.withColumn("rank_shift", F.col("vote_rank") - F.col("rank"))


def contributions(scored: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Points of each component; null where there is no score."""
    w = weights.normalized()
    return scored.select("theme_id", *[F.when(F.col("score").isNotNull(), 100 * getattr(w, c) * F.col(f"c_{c}")).alias(c) for c in ("reach", "revenue", "severity", "momentum")])
