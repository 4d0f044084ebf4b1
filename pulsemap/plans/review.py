"""An optional review of themes by a language model: names, kinds, summaries and duplicates.

The model is whatever callable the user brings, ``ask(instructions, prompt, schema) -> JSON text``; nothing here
talks to a service. Without a review the deterministic names and kinds stand.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .report import KINDS

INSTRUCTIONS = "You get a JSON list; each entry is a group of customer remarks with its keywords, counts and quotes. Reply in the given schema, one entry for each theme_id you can judge: a short title a product team would use, one of the listed kinds, one sentence on the need behind the quotes, and in duplicate_of the theme_id of a group about the very same need, or an empty string. Invent nothing that the quotes do not show."
_FIELDS = ("theme_id", "name", "kind", "summary", "duplicate_of")
SCHEMA = {
    "type": "object", "required": ["themes"], "additionalProperties": False,
    "properties": {"themes": {"type": "array", "items": {"type": "object", "required": list(_FIELDS), "additionalProperties": False, "properties": {f: {"type": "string"} | ({"enum": list(KINDS)} if f == "kind" else {}) for f in _FIELDS}}}},
}
_ROW = "theme_id string, name string, kind string, summary string, duplicate_of string"


def payload(scored: DataFrame) -> list[dict]:
    """What the model sees; one entry a theme."""
    rows = scored.select("theme_id", "keywords", F.col("mentions_all_time").alias("mentions"), F.round(F.coalesce("mean_sentiment", F.lit(0.0)), 2).alias("mean_sentiment"), "plan_mix", F.slice("examples", 1, 8).alias("quotes")).orderBy("theme_id")
    return [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect()]


def review(scored: DataFrame, ask: Callable[[str, str, dict], str]) -> DataFrame:
    """(theme_id, name, kind, summary, duplicate_of): unknown themes and repeats go; a duplicate of itself, or of nothing known, is cleared."""
    spark = scored.sparkSession
    reply = ask(INSTRUCTIONS, json.dumps(payload(scored)), SCHEMA)
    known = {r[0] for r in scored.select("theme_id").collect()}
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(reply), f"themes array<struct<{_ROW.replace(' string', ':string')}>>")["themes"]).alias("t")).select("t.*").collect()
    first = {}
    for r in rows:
        if r["theme_id"] in known:
            first.setdefault(r["theme_id"], r)
    clean = [(*r[:4], r["duplicate_of"] if r["duplicate_of"] in known - {r["theme_id"]} else "") for r in first.values()]
    return spark.createDataFrame(clean, _ROW)


def overlaid(scored: DataFrame, reviewed: DataFrame) -> DataFrame:
    """scored with the names, kinds and summaries of the review, where it has the theme."""
    r = reviewed.select("theme_id", F.col("name").alias("_name"), F.col("kind").alias("_kind"), "summary")
    return scored.join(r, "theme_id", "left").withColumns({"name": F.coalesce("_name", "name"), "kind": F.coalesce("_kind", "kind")}).drop("_name", "_kind")


def suggested_merges(reviewed: DataFrame) -> dict[str, str]:
    """For ``analysis.merge_themes``."""
    return {r[0]: r[1] for r in reviewed.filter("duplicate_of != ''").select("theme_id", "duplicate_of").collect()}
