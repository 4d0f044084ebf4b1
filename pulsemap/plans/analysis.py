"""The whole analysis: feedback in, ranked themes, warnings, release effects and insights out."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digest import table_digest
from ..functions.lexicon import language, stop_words, with_plain_variants
from ..functions.sentiment import score_feedback
from ..functions.shared import forget, saved, side_by_side
from ..functions.text import dot, fold, redact, segment_feedback
from ..operators import impact, mentions, scoring, themes, trends
from ..operators.embed import Embedder, get_embedder

#: Distance and boilerplate thresholds of the TF-IDF backend.
DISTANCE, BOILERPLATE = 0.90, 0.50


@dataclass(frozen=True)
class Config:
    language: str = "en"
    embedding: str = "tfidf"
    redact_pii: bool = True
    product_names: tuple[str, ...] = ()
    distance_threshold: float = DISTANCE
    boilerplate_threshold: float = BOILERPLATE
    min_theme_share: float = 0.005
    reassign_similarity: float = 0.5
    consolidate: bool = True
    segment_sentences: bool = True
    volume_normalization: str = "median_of_ratios"
    score_window_days: int = 60
    recent_days: int = 28
    baseline_days: int = 84
    alpha: float = 0.05
    impact_window_days: int = 28
    release_match_similarity: float = 0.35
    weights: scoring.Weights = field(default_factory=scoring.Weights)
    stop_words: tuple[str, ...] = ()


@dataclass
class Analysis:
    feedback: DataFrame
    segments: DataFrame
    mentions: DataFrame
    themes: DataFrame
    trends: DataFrame
    scored: DataFrame
    radar: DataFrame | None
    side_effects: DataFrame | None
    has_revenue: bool
    config: Config

    def forget(self) -> None:
        """Deletes the tables behind the analysis, which can't be read any more then."""
        forget(*(df for df in vars(self).values() if hasattr(df, "_saved_at")))


def content(segments: DataFrame, prototypes: DataFrame, threshold: float) -> DataFrame:
    """Segments that are not boilerplate, or all of a document that has nothing else. prototypes: a fixed list."""
    listed = prototypes.select(F.monotonically_increasing_id().alias("_p"), F.col("vector").alias("centroid"))
    near = themes.nearest(segments, listed, threshold, "_p").withColumn("boilerplate", F.col("_p").isNotNull()).drop("_p", "similarity")
    only = F.min(F.col("boilerplate").cast("int")).over(Window.partitionBy("doc_id")) == 1
    return near.withColumn("_only", only).filter(~F.col("boilerplate") | F.col("_only")).drop("_only", "boilerplate")


def consolidated(segments: DataFrame, stop: tuple[str, ...] = (), least_semantic: float = 0.45, least_lexical: float = 0.18) -> dict[int, int]:
    """Cluster to cluster: those alike in meaning and in words, merged by complete linkage, then numbered by size."""
    kept = segments.filter(F.col("cluster") >= 0)
    centers = {r["cluster"]: np.array(r["centroid"]) for r in themes.centroids(kept, "cluster").collect()}  # one row a cluster
    ids = sorted(centers)
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1)), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    tf = kept.select("cluster", F.explode(words).alias("term")).groupBy("cluster", "term").count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, "term").withColumn("x", (1 + F.ln("count")) * (F.ln((1 + len(ids)) / (1 + F.col("df"))) + 1))
    w = raw.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("cluster")))).select("cluster", "term", "x")
    # only pairs alike in meaning are compared in words; clusters number MICRO at most
    alike = np.stack([centers[i] for i in ids]) @ np.stack([centers[i] for i in ids]).T if ids else np.zeros((0, 0))
    near = {(ids[i], ids[j]): float(alike[i, j]) for i, j in zip(*np.nonzero(np.triu(alike >= least_semantic, 1)), strict=True)}
    ok: dict[tuple[int, int], float] = {}
    if near:
        spark = segments.sparkSession
        chosen = spark.createDataFrame([(int(i), int(j)) for i, j in near], "i int, j int")
        both = w.join(F.broadcast(chosen), w["cluster"] == chosen["i"]).select("i", "j", "term", "x")
        lexical = both.join(w.select(F.col("cluster").alias("j"), "term", F.col("x").alias("y")), ["j", "term"]).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
        ok = {(r["i"], r["j"]): near[r["i"], r["j"]] for r in lexical.filter(F.col("s") >= least_lexical).collect()}
    group = {i: {i} for i in ids}
    for (i, j), _ in sorted(ok.items(), key=lambda x: (x[1], x[0]), reverse=True):
        a, b = group[i], group[j]
        if a is not b and all((min(x, y), max(x, y)) in ok for x in a for y in b):
            a |= b
            for x in b:
                group[x] = a
    root = {i: min(group[i]) for i in ids}
    sizes = {r["cluster"]: r["count"] for r in kept.groupBy("cluster").count().collect()}
    total: dict[int, int] = {}
    for i, r in root.items():
        total[r] = total.get(r, 0) + sizes[i]
    order = {r: k for k, r in enumerate(sorted(total, key=lambda r: (-total[r], r)))}
    return {i: order[r] for i, r in root.items()}


def short_name(headline, limit: int = 60):
    """The headline without its end mark, cut at a space."""
    text = F.regexp_replace(F.trim(headline), "[.!?]+$", "")
    cut = F.regexp_replace(F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", ""), "[,;:]+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def describe(segments: DataFrame, feedback: DataFrame, config: Config) -> DataFrame:
    """(theme_id, name, headline, keywords, kind, examples, cohesion): the most central texts speak for a theme."""
    lang = language(config.language)
    centers = themes.centroids(segments, "theme_id")
    close = segments.join(F.broadcast(centers) if centers.count() <= themes.MICRO else centers, "theme_id").withColumn("similarity", dot(F.col("vector"), F.col("centroid")))
    by = Window.partitionBy("theme_id")
    # one wording: however it is cased and, beyond English, with or without accents; its best spelling has most accents, then capitals
    wording = F.lower("text") if lang.code == "en" else fold(F.col("text"))
    spelt = F.lit(0) if lang.code == "en" else F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")) * 1000 + F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))
    distinct = close.groupBy("theme_id", "text").agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("rows")).withColumns({"wording": wording, "spelt": spelt})
    same = Window.partitionBy("theme_id", "wording")
    distinct = distinct.withColumns({"n": F.sum("rows").over(same), "best": F.first("text").over(same.orderBy(F.desc("spelt"), "text"))})
    first = distinct.withColumn("k", F.row_number().over(by.orderBy(F.desc("similarity"), "text"))).filter("k <= 8")
    head = first.withColumn("h", F.row_number().over(by.orderBy((F.length("text") > 90), F.desc("n"), F.desc("spelt"), F.desc(F.round("similarity", 5)), "text")))
    said = F.col("text") if lang.code == "en" else F.col("best")
    texts = head.groupBy("theme_id").agg(F.regexp_replace(F.max(F.when(F.col("h") == 1, said)), r"\.+$", "").alias("headline"), F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("examples"))
    means = segments.select("theme_id", "doc_id").distinct().join(feedback.select("doc_id", "sentiment"), "doc_id").groupBy("theme_id").agg(F.avg("sentiment").alias("mean"))
    words = themes.keywords(segments, stop_words(lang, config.stop_words), lang=lang).groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), lambda x: x["term"]).alias("keywords"))
    out = texts.join(means, "theme_id").join(themes.cue_rates(segments, lang), "theme_id").join(words, "theme_id", "left").join(close.groupBy("theme_id").agg(F.avg("similarity").alias("cohesion")), "theme_id")
    return out.select("theme_id", short_name(F.col("headline")).alias("name"), "headline", "keywords", themes.kind(F.col("mean")).alias("kind"), "examples", "cohesion")


def match_releases(releases: DataFrame, centers: DataFrame, embedder: Embedder, floor: float) -> DataFrame:
    """releases with theme_id and match_similarity: the most similar theme, if similar enough."""
    texts = embedder.encode(releases.withColumn("_t", F.concat_ws(". ", "title", F.nullif("description", F.lit("")))), "_t")
    if hasattr(embedder, "semantic"):  # releases are not written in customers' words: by meaning alone
        texts, centers = texts.withColumn("vector", embedder.semantic(F.col("vector"))), centers.withColumn("centroid", embedder.semantic(F.col("centroid")))
    return themes.nearest(texts, centers, floor, "theme_id").withColumnRenamed("similarity", "match_similarity").drop("_t", "vector")


@dataclass
class Model:
    """Themes as discovered: feedback with money and sentiment, segments with vector, cluster and theme_id, and the fitted encoder."""

    feedback: DataFrame
    segments: DataFrame
    embedder: Embedder
    has_accounts: bool
    config: Config


def build_model(feedback: DataFrame, accounts: DataFrame | None = None, config: Config = Config(), embedder: Embedder | None = None) -> Model:
    """Redaction, sentiment, segments, vectors, clusters and their names. embedder: in place of the one the configuration names."""
    lang = language(config.language)
    stop = stop_words(lang, config.stop_words)
    fb = feedback.withColumn("text", redact(F.col("text"))) if config.redact_pii else feedback
    fb = saved(mentions.with_accounts(score_feedback(fb, lang), accounts), "feedback")
    segments = saved(segment_feedback(fb, config.product_names, lang, config.segment_sentences), "segments")
    embedder = (embedder or get_embedder(config.embedding, language=lang.code, stop=stop)).fit(segments)
    raw, segments = segments, embedder.encode(segments)
    spark = fb.sparkSession
    typed = with_plain_variants(lang.boilerplate) if lang.code == "tr" else lang.boilerplate
    prototypes = embedder.encode(spark.createDataFrame([(t,) for t in typed] or [("",)], "text string"))
    segments = saved(content(segments, prototypes, config.boilerplate_threshold).withColumn("id", F.struct("doc_id", "position")), "vectors")
    least = max(5, round(config.min_theme_share * fb.count()))
    placed = saved(segments.join(themes.cluster_vectors(segments.select("id", "vector"), config.distance_threshold, least, config.reassign_similarity), "id"), "clusters")
    forget(raw, segments)
    merged = consolidated(placed, stop) if config.consolidate else {r[0]: r[0] for r in placed.filter("cluster >= 0").select("cluster").distinct().collect()}
    names = spark.createDataFrame([(int(a), f"T{b + 1:02d}") for a, b in merged.items()], "cluster int, theme_id string")
    return Model(fb, placed.join(F.broadcast(names), "cluster", "left").drop("id", "cluster"), embedder, accounts is not None, config)


def resolved_merges(merges: dict[str, str], known: set[str]) -> dict[str, str]:
    """Where each theme ends up, chains followed; a chain that comes back to itself stops there, unknown names are left out."""
    step = {a: b for a, b in merges.items() if a in known and b in known and a != b}
    out = {}
    for start in step:
        seen, at = {start}, step[start]
        while at in step and at not in seen:
            seen.add(at)
            at = step[at]
        if at != start:
            out[start] = at
    return out


def merge_themes(model: Model, merges: dict[str, str]) -> Model:
    """The model with themes folded into others; the others keep their ids."""
    ids = {r[0] for r in model.segments.select("theme_id").distinct().collect() if r[0]}  # one row a theme
    to = resolved_merges(merges, ids)
    if not to:
        return model
    names = model.feedback.sparkSession.createDataFrame(list(to.items()), "theme_id string, _to string")
    moved = model.segments.join(F.broadcast(names), "theme_id", "left").withColumn("theme_id", F.coalesce("_to", "theme_id")).drop("_to")
    return replace(model, segments=moved)


def usable_weights(weights: scoring.Weights, has_revenue: bool) -> scoring.Weights:
    return weights if has_revenue else scoring.Weights(weights.reach, 0.0, weights.severity, weights.momentum)


def rescore(a: Analysis, weights: scoring.Weights) -> Analysis:
    """The analysis with other weights; nothing but the scores is computed again."""
    made = ("c_reach", "c_revenue", "c_severity", "c_momentum", "score", "rank", "vote_rank", "rank_shift")
    again = scoring.score_themes(a.scored.drop(*made), usable_weights(weights, a.has_revenue))
    return replace(a, scored=again, config=replace(a.config, weights=weights))


def analyze(feedback: DataFrame, accounts: DataFrame | None = None, releases: DataFrame | None = None, config: Config = Config(), as_of=None, embedder: Embedder | None = None, ask: Callable[[str, str, dict], str] | None = None) -> Analysis:
    """feedback, accounts and releases as the loaders give them. ask: a language model for a review of the themes, see ``plans.review``; if it fails, the themes stay as they are."""
    model = build_model(feedback, accounts, config, embedder)
    a = analyze_model(model, releases, as_of)
    if ask is None:
        return a
    from . import review

    try:
        told = review.review(a.scored, ask)
    except Exception as e:
        warnings.warn(f"the review failed, themes keep their names: {e}", stacklevel=2)
        return a
    if merges := review.suggested_merges(told):
        a = analyze_model(merge_themes(model, merges), releases, as_of)
    return replace(a, scored=review.overlaid(a.scored, told))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def analyze_once(root: str, feedback: DataFrame, accounts: DataFrame | None = None, releases: DataFrame | None = None, config: Config = Config()) -> Analysis:
    """analyze(), or the tables of an earlier one under root, if content of the inputs and settings are the same.

    The folder's name is the digest of both; it counts once its last file is there, so a broken run is done anew.
    """
    spark = feedback.sparkSession
    at = f"{root}/{table_digest(feedback, accounts, releases)}-{hashlib.sha256(repr(config).encode()).hexdigest()[:16]}"
    tables = ("feedback", "segments", "mentions", "themes", "trends", "scored", "radar", "side_effects")
    if not _exists(spark, f"{at}/done/_SUCCESS"):
        a = analyze(feedback, accounts, releases, config)
        for name in tables:
            if getattr(a, name) is not None:
                getattr(a, name).write.mode("overwrite").parquet(f"{at}/{name}")
        spark.createDataFrame([(a.has_revenue,)], "has_revenue boolean").coalesce(1).write.mode("overwrite").parquet(f"{at}/done")
        a.forget()
    held = [spark.read.parquet(f"{at}/{name}") if _exists(spark, f"{at}/{name}") else None for name in tables]
    return Analysis(*held, spark.read.parquet(f"{at}/done").first()[0], config)


def analyze_model(model: Model, releases: DataFrame | None = None, as_of=None) -> Analysis:
    """Mentions, metrics, warnings, scores and release effects of a model, as seen at the end of the day of as_of."""
    fb, placed, config = model.feedback, model.segments, model.config
    has_revenue = model.has_accounts and (fb.agg(F.sum("mrr")).first()[0] or 0) > 0
    tagged = placed.filter("theme_id is not null")
    rows = saved(mentions.mentions_of(placed, fb), "mentions")
    last = F.lit(fb.agg(F.max("created_at")).first()[0]) if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    seen, seen_fb = mentions.visible(rows, last), mentions.visible(fb, last)

    def themed() -> tuple[DataFrame, DataFrame, DataFrame]:
        described = describe(tagged, fb, config)
        window = mentions.score_window(seen, last, config.score_window_days)
        n = mentions.score_window(seen_fb, last, config.score_window_days).count()
        metrics = mentions.theme_metrics(window, n)
        warned = trends.detect_trends(seen, seen_fb, last, config.recent_days, config.baseline_days, config.alpha, config.volume_normalization)
        always = seen.groupBy("theme_id").agg(F.countDistinct("doc").alias("mentions_all_time"))
        table = described.join(metrics, "theme_id", "left").join(always, "theme_id", "left").join(warned, "theme_id", "left")
        for column in ("plan", "channel"):
            table = table.join(mentions.mix(window, column), "theme_id", "left")
        table = table.na.fill(0, ["mentions", "primary_mentions", "accounts", "mrr_exposed", "mrr_weighted", "negative_share", "arr_exposed", "share", "mentions_all_time"])
        return described, warned, saved(scoring.score_themes(table, usable_weights(config.weights, has_revenue)), "themes")

    def released() -> tuple[DataFrame | None, DataFrame | None]:
        if releases is None:
            return None, None
        matched = saved(match_releases(releases.filter(F.col("date") <= last), themes.centroids(tagged, "theme_id"), model.embedder, config.release_match_similarity), "releases")
        radar, effects = impact.release_radar(seen, seen_fb, matched, config.impact_window_days, config.alpha, config.volume_normalization)
        return tuple(side_by_side(lambda: saved(radar, "radar"), lambda: saved(effects, "side-effects")))

    (described, warned, scored), (radar, effects) = side_by_side(themed, released)
    return Analysis(fb, placed, rows, described, warned, scored, radar, effects, has_revenue, config)


def insights(a: Analysis, most: int = 6) -> list[dict[str, str]]:
    """kind and title of what to read first. Only rows of the report come to the driver."""
    road = [r.asDict() for r in a.scored.filter("score is not null").orderBy("rank").collect()]
    if not road:
        return []
    top = road[0]
    parts = sorted(("reach", "revenue", "severity", "momentum"), key=lambda c: -top[f"c_{c}"])[:2]
    out = [{"kind": "priority", "title": f"Top priority: {top['name']}", "detail": f"Score {top['score']:.0f}/100, mostly {parts[0]} and {parts[1]}: {top['mentions']} mentions from {top['accounts']} {'accounts' if a.has_revenue else 'users'}"}]
    for r in sorted((r for r in road if r["status"] in ("new", "emerging")), key=lambda r: -r["lift"])[:2]:
        out.append({"kind": "alert", "title": f"Early warning: {r['name']} is {r['status']}", "detail": f"{r['lift']:.1f}x its baseline (95% CI {r['lift_ci_low']:.1f}-{r['lift_ci_high']:.1f})"})
    for r in sorted((r for r in road if r["rank_shift"] < 0), key=lambda r: r["rank_shift"])[:1]:
        out.append({"kind": "loud", "title": f"Often mentioned, lower priority: {r['name']}", "detail": f"#{r['vote_rank']} by mentions, #{r['rank']} by priority"})
    dear = max(road, key=lambda r: r["mrr_weighted"])
    if a.has_revenue and dear["vote_rank"] > 3:
        out.append({"kind": "valuable", "title": f"Quiet, but expensive: {dear['name']}", "detail": f"#{dear['vote_rank']} by mentions, {dear['mrr_weighted']:.0f} weighted revenue a month"})
    if a.radar is not None:
        told = a.radar.filter(F.col("verdict").isin("Worse", "Resolved", "No detectable change")).orderBy(F.desc("day")).limit(2).collect()
        out += [{"kind": "release", "title": f"{r['version']} ({r['title']}): {r['verdict']}", "detail": f"mentions changed {r['rate_ratio'] - 1:+.0%} against all feedback"} for r in told]
    return out[:most]
