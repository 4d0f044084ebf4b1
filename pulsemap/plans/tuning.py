"""What each part of an analysis is worth, and which threshold fits: the same data analysed under other settings and measured against its known truth."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import SparkSession

from ..operators.embed import Embedder
from ..sources import feedback
from ..sources.synthetic import Dataset
from .analysis import DISTANCE, Config, analyze
from .evaluation import evaluate_all

#: Settings that leave one part out.
ABLATIONS = {
    "default": {},
    "whole items instead of sentences": {"segment_sentences": False},
    "no boilerplate filter": {"boilerplate_threshold": 2.0},
    "no consolidation": {"consolidate": False},
    "normalised by total volume": {"volume_normalization": "total"},
}
COLUMNS = ("setting", "themes", "adjusted_rand", "nmi", "homogeneity", "mean_recovered_share", "spikes_detected", "spikes_total", "false_alarm_episodes", "spurious_trend_days")


def grid(thresholds: tuple[float, ...] = (DISTANCE - 0.1, DISTANCE, DISTANCE + 0.05), shares: tuple[float, ...] = (0.005, 0.01)) -> dict[str, dict]:
    """Every distance threshold with every least theme size."""
    return {f"distance {t:.2f}, least share {s:.3f}": {"distance_threshold": t, "min_theme_share": s} for t in thresholds for s in shares}


def compare(data: Dataset, settings: dict[str, dict] = ABLATIONS, config: Config = Config(), embedder: Embedder | None = None) -> Iterator[dict]:
    """One row a setting, as soon as it is measured; the tables of its analysis are deleted after it."""
    items, releases = feedback.load_feedback(data.feedback), feedback.load_releases(data.releases)
    accounts = None if data.accounts is None else feedback.load_accounts(data.accounts)
    for name, changed in settings.items():
        a = analyze(items, accounts, releases, replace(config, **changed), embedder=embedder)
        found = evaluate_all(a, data)
        row = {"setting": name, "themes": a.scored.count()}
        row |= found["themes"].first().asDict() | found["coverage"].first().asDict() | found["spurious"].first().asDict()
        told = found["alerts"].filter("method = 'rate_test'").first()
        row |= told.asDict() if told else {"spikes_detected": 0, "spikes_total": 0, "false_alarm_episodes": 0}
        yield {c: row[c] for c in COLUMNS}
        a.forget()


def table(spark: SparkSession, rows: Iterator[dict]):
    """The rows as a DataFrame, one a setting."""
    got = [tuple(r[c] for c in COLUMNS) for r in rows]
    return spark.createDataFrame(got, "setting string, themes long, adjusted_rand double, nmi double, homogeneity double, mean_recovered_share double, spikes_detected long, spikes_total long, false_alarm_episodes long, spurious_trend_days long")
