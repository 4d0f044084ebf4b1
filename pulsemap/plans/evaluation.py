"""An analysis of a dataset with known truth, measured."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved
from ..operators import evaluate, mentions, trends
from ..sources.synthetic import Dataset
from .analysis import Analysis


def named_themes(a: Analysis, truth: DataFrame) -> DataFrame:
    """(theme_id, true_theme): what most of a theme's primary mentions are about."""
    return evaluate.majority(_primary(a, truth)).withColumnsRenamed({"p": "theme_id", "t": "true_theme"}).filter("theme_id != '(none)'")


def _primary(a: Analysis, truth: DataFrame) -> DataFrame:
    first = a.mentions.filter("primary").select(F.col("doc").alias("doc_id"), "theme_id")
    return evaluate.contingency(a.feedback.select("doc_id", "feedback_id").join(truth, "feedback_id").join(first, "doc_id", "left"), "true_theme", "theme_id")


def evaluate_all(a: Analysis, data: Dataset, warmup_days: int = 42) -> dict[str, DataFrame]:
    """Every measure as a small table."""
    config, table = a.config, _primary(a, data.ground_truth)
    named = saved(named_themes(a, data.ground_truth), "named")
    quality = evaluate.sentiment_quality(a.feedback.join(data.ground_truth, "feedback_id"))
    replayed = saved(trends.backtest(a.mentions, a.feedback, config.recent_days, config.baseline_days, warmup_days, config.alpha, config.volume_normalization), "replayed")
    log = saved(evaluate.alert_log(replayed, mentions.trailing(mentions.daily_grid(a.mentions, a.feedback)), named, data.events), "alerts")
    detected = evaluate.detection(log, data.events)
    out = {
        "themes": evaluate.agreement(table), "coverage": evaluate.coverage(table), "recovery": evaluate.recovery(table), "sentiment": quality, "sign_accuracy": evaluate.sign_accuracy(quality), "detection": detected, "alerts": evaluate.alert_summary(log, detected),
        "spurious": evaluate.spurious_trend_days(replayed, named, data.events, a.config.recent_days + a.config.baseline_days),
    }
    if a.radar is not None:
        out["releases"] = evaluate.release_matching(a.radar, named, data.release_truth)
        out["side_effects"] = evaluate.side_effect_precision(a.side_effects.join(a.radar.select("version", "day"), "version"), named, data.events)
    return out


def as_json(measures: dict[str, DataFrame]) -> str:
    return json.dumps({name: [json.loads(x) for x in df.toJSON().collect()] for name, df in measures.items()}, indent=2)
