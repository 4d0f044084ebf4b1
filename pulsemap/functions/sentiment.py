"""Sentiment of texts and ratings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import ENGLISH, Language
from .text import bound, fold
from .workers import python_ready


def squash(total: Column) -> Column:
    return total / F.sqrt(total * total + 8.0)


def english_sentiment(text: Column) -> Column:
    """One pass over the tokens as Spark expressions: a hit's value, turned by a negation in the three tokens before, raised by an intensifier."""
    lang = ENGLISH
    words = F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "['’]", "")), F.lit("([a-z]+)"), F.lit(1))
    value = F.create_map(*[F.lit(x) for kv in lang.lexicon.items() for x in kv])
    raised = F.create_map(*[F.lit(x) for kv in lang.intensifiers.items() for x in kv])
    negations = F.array(*[F.lit(x) for x in sorted(lang.negations_before)])
    known = [w for w, v in lang.lexicon.items() if v]  # a set, where the map is searched from its start

    def scored(words: Column) -> Column:
        def hit(w: Column, i: Column) -> Column:
            v = F.try_element_at(value, w)
            turned = F.when(F.arrays_overlap(F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), negations), -0.6).otherwise(1.0)
            strong = F.when(i > 0, F.coalesce(F.try_element_at(raised, F.get(words, i - 1)), F.lit(1.0))).otherwise(1.0)
            return F.when(~w.isin(*known), 0.0).otherwise(v * turned * strong)

        return F.aggregate(F.transform(words, hit), F.lit(0.0), lambda s, x: s + x)

    total = bound(words, scored)
    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"))), F.lit(3)) * 0.15
    return F.coalesce(squash(total + F.signum(total) * marks), F.lit(0.0))


def stem_sentiment(text: Column, lang: Language) -> Column:
    """For languages whose entries are word pairs and beginnings of words; a pair uses both its words up, so the scan is sequential."""
    python_ready(SparkSession.getActiveSession())
    stems = sorted((k for k in lang.lexicon if " " not in k and len(k) >= 4), key=len, reverse=True)

    @F.pandas_udf("double")
    def score(lots: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float | None] = {}

        def word(w: str) -> float | None:
            if w not in known:
                if len(known) > 100_000:
                    known.clear()
                stem = next((k for k in stems if len(w) > 3 and w.startswith(k)), None)
                known[w] = lang.lexicon.get(w, lang.lexicon.get(stem) if stem else None)
            return known[w]

        def total(words: list[str]) -> float:
            out, i = 0.0, 0
            while i < len(words):
                pair = lang.lexicon.get(" ".join(words[i : i + 2])) if i + 1 < len(words) else None
                v, used = (pair, 2) if pair is not None else (word(words[i]), 1)
                if v:
                    v *= -0.6 if any(w in lang.negations_before for w in words[max(0, i - 3) : i]) else 1.0
                    v *= -0.6 if i + used < len(words) and words[i + used] in lang.negations_after else 1.0
                    out += v * (lang.intensifiers.get(words[i - 1], 1.0) if i else 1.0)
                i += used
            return out

        for lot in lots:
            yield lot.map(lambda w: total(list(w)))

    words = F.regexp_extract_all(fold(F.regexp_replace(F.coalesce(text, F.lit("")), "['’]", "")), F.lit(r"(?U)([^\W\d_]+)"), F.lit(1))
    t = score(words)
    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"))), F.lit(3)) * 0.15
    return F.coalesce(squash(t + F.signum(t) * marks), F.lit(0.0))


def text_sentiment(text: Column, lang: Language = ENGLISH) -> Column:
    return stem_sentiment(text, lang) if lang.by_prefix else english_sentiment(text)


def rating_sentiment(rating: Column, channel: Column) -> Column:
    """Survey scales run 0-10 around 7, stars 1-5 around 3."""
    survey = channel.isin("nps_survey", "survey") | (rating > 5)
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.when(F.isnan(rating) | rating.isNull(), F.lit(None).cast("double")).when(survey, clip((rating - 7) / 3)).otherwise(clip((rating - 3) / 2))


def score_feedback(feedback: DataFrame, lang: Language = ENGLISH) -> DataFrame:
    """feedback with ``sentiment``: 0.6 text + 0.4 rating where there is a rating."""
    rated = rating_sentiment(F.col("rating"), F.col("channel"))
    out = feedback.withColumn("_text", text_sentiment(F.col("text"), lang)).withColumn("_rated", rated)
    return out.withColumn("sentiment", F.when(F.col("_rated").isNull(), F.col("_text")).otherwise(0.6 * F.col("_text") + 0.4 * F.col("_rated"))).drop("_text", "_rated")
