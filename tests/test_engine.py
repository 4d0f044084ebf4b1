"""Parts of the engine against brute force or known results."""

import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemap import __main__ as cli
from pulsemap.functions.lexicon import TURKISH
from pulsemap.operators import embed, impact, mentions, themes
from pulsemap.plans import analysis as A
from pulsemap.plans import tuning as T
from pulsemap.sources import feedback as S
from pulsemap.sources import synthetic as Y


def unit(rows):
    v = np.array(rows, float)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


def test_clusters_alike_in_meaning_and_words_merge(spark):
    """Of three clusters 0 and 1 share vectors, 0 and 2 words: 0 and 1 share both."""
    r = np.random.default_rng(0)
    a, b = np.eye(8)[0], np.eye(8)[1]
    said = {0: "calendar sync broken", 1: "calendar sync fails", 2: "calendar sync broken"}
    rows = [(c, said[c], unit([(b if c == 2 else a) + r.normal(0, 0.02, 8)])[0]) for c in range(3) for _ in range(20)]
    df = spark.createDataFrame(rows, "cluster int, text string, vector array<double>")
    got = A.consolidated(df)
    assert got[0] == got[1] == 0 and got[2] == 1
    assert A.consolidated(df.filter("cluster < 0")) == {}


@pytest.mark.parametrize(
    ("texts", "mean", "want"),
    [
        (["It crashes on startup", "There is a bug and an error", "This is broken"], -0.6, "bug"),
        (["Please add a dark mode", "We need an option to export", "Would love a filter, please add it"], 0.0, "feature_request"),
        (["The price is too high", "Pricing per seat is expensive", "Billing costs too much"], -0.4, "pricing"),
        (["I love it", "Great and simple", "Excellent tool"], 0.8, "praise"),
    ],
)
def test_kinds(spark, texts, mean, want):
    df = spark.createDataFrame([("T01", t) for t in texts], "theme_id string, text string")
    assert themes.cue_rates(df).select(themes.kind(F.lit(mean)).alias("k")).first()["k"] == want


def test_verdicts(spark):
    rows = [(None, None, None, None, 0, 0), (0.19, 0.12, 0.28, 1e-9, 136, 28), (1.08, 0.79, 1.47, 0.6, 86, 84), (2.2, 1.1, 4.88, 0.02, 12, 27), (0.58, 0.2, 2.0, 0.3, 8, 4), (0.7, 0.5, 0.9, 0.01, 60, 40), (0.9, 0.3, 2.7, 0.5, 90, 80)]
    df = spark.createDataFrame(rows, "rate_ratio double, ci_low double, ci_high double, p_value double, pre_mentions long, post_mentions long")
    assert [r[0] for r in df.select(impact.verdict()).collect()] == ["Not enough data", "Resolved", "No detectable change", "Worse", "Inconclusive", "Improved", "Inconclusive"]


def test_side_effects_are_other_themes_that_rise(spark):
    day = lambda k: f"2024-03-{k:02d} 10:00:00"
    said = [("T01", k) for k in range(1, 29) for _ in range(4)] + [("T02", k) for k in range(1, 29) for _ in range(1 if k < 15 else 9)] + [(f"T{t:02d}", k) for t in range(3, 9) for k in range(1, 29) for _ in range(3)]
    m = spark.createDataFrame([(i, t, day(k)) for i, (t, k) in enumerate(said)], "doc long, theme_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    releases = spark.createDataFrame([("1.0", "2024-03-15", "Rework", "T01")], "version string, date string, title string, theme_id string").withColumn("date", F.to_date("date"))
    radar, effects = impact.release_radar(m, m.withColumnRenamed("doc", "doc_id"), releases)
    assert [(r["theme_id"], r["verdict"]) for r in radar.collect()] == [("T01", "No detectable change")]
    assert [r["theme_id"] for r in effects.collect()] == ["T02"]


@pytest.mark.parametrize("look", [1, 20])
def test_keywords_by_brute_force(spark, monkeypatch, look):
    monkeypatch.setattr(themes, "LOOK", look)
    said = {"A": ["dark mode please", "a dark mode option", "dark theme option", "mode switch dark"], "B": ["slow sync error", "sync error again", "calendar sync slow"], "C": ["dark sync", "price plan price", "plan price high"]}
    df = spark.createDataFrame([(t, x) for t, xs in said.items() for x in xs], "theme_id string, text string")
    counts = {}
    for t, xs in said.items():
        c = Counter()
        for x in xs:
            w = re.findall(r"\b([a-z][a-z-]+)\b", x)
            c.update(w)
            c.update(" ".join(p) for p in zip(w, w[1:], strict=False))
        counts[t] = c
    df_of = Counter(w for c in counts.values() for w in c)
    for top in (3, 50):
        got = {}
        for r in themes.keywords(df, top=top).collect():
            got.setdefault(r["theme_id"], []).append((r["term"], round(r["weight"], 9)))
        for t, c in counts.items():
            raw = {w: (1 + math.log(n)) * (math.log(4 / (1 + df_of[w])) + 1) for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            want = []
            for w, x in sorted(((w, x / norm * (1.6 if " " in w else 1)) for w, x in raw.items()), key=lambda p: (-p[1], p[0])):
                if len(want) < top and not any(w in y or y in w for y, _ in want):
                    want.append((w, round(x, 9)))
            assert sorted(got[t]) == sorted(want)


def test_nearest_with_more_centers_than_a_block(spark, monkeypatch):
    r = np.random.default_rng(1)
    v, c = unit(r.normal(size=(40, 6))), unit(r.normal(size=(17, 6)))
    vectors = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id int, vector array<double>")
    centers = spark.createDataFrame([(f"L{k:02d}", x) for k, x in enumerate(c)], "label string, centroid array<double>")
    want = themes.nearest(vectors, centers, 0.3).orderBy("id").collect()
    monkeypatch.setattr(themes, "MICRO", 4)
    got = themes.nearest(vectors, centers, 0.3).select("id", "vector", "label", "similarity").orderBy("id").collect()
    s = np.array(v) @ np.array(c).T
    for k, (a, b) in enumerate(zip(want, got, strict=True)):
        best = f"L{s[k].argmax():02d}" if s[k].max() >= 0.3 else None
        assert a["label"] == b["label"] == best and abs(a["similarity"] - s[k].max()) < 1e-12 and abs(b["similarity"] - s[k].max()) < 1e-12


def texts(n):
    r = np.random.default_rng(3)
    words = [[f"{a}{b}" for b in "lorem ipsum dolor sit amet".split()] for a in "abcdefgh"]
    return [" ".join(r.choice(words[k % 8], 4)) for k in range(n)]


@pytest.mark.parametrize("n", [60, 1000, 1001])
def test_the_decomposition_is_the_same_on_any_number_of_texts(spark, n):
    """Similarities after the projection are those of an exact decomposition, above and below every size."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts(n))], "id int, text string")
    e = embed.TfidfEmbedder(dimensions=8).fit(df)
    terms = {r["id"]: r["t"] for r in df.select("id", e.terms(F.col("text")).alias("t")).collect()}
    x = np.zeros((n, len(e.weight)))
    for k, t in terms.items():
        for j, w in embed._weights(t, e.weight).items():
            x[k, j] = w
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    exact = x @ vt[:8].T
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    got = np.array([r["vector"] for r in e.encode(df).orderBy("id").collect()])
    assert s[7] > 1.05 * s[8]
    assert np.abs(got @ got.T - exact @ exact.T).max() < 0.02


def lengths(given):
    return np.array([[len(t), t.count("a") + 1.0, 1.0] for t in given])


def test_embedders_that_users_bring(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts(40))], "id int, text string")
    with pytest.warns(UserWarning):
        assert embed.get_embedder("minilm").name == "tfidf"
    with pytest.raises(ValueError):
        embed.get_embedder("hybrid", fallback=False)
    h = embed.get_embedder("hybrid", encode=lengths, language="tr", dimensions=4).fit(df)
    got = h.encode(df).withColumn("s", h.semantic(F.col("vector"))).orderBy("id").collect()
    v = lengths([r["text"] for r in got])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    words = np.array([r["vector"] for r in h.words.encode(df).orderBy("id").collect()])
    whole = np.array([r["vector"] for r in got])
    assert np.allclose(whole @ whole.T, 0.65 * v @ v.T + 0.35 * words @ words.T)
    assert np.allclose(np.array([r["s"] for r in got]), v)


def test_headlines(spark):
    lang = TURKISH
    rows = [("T01", k, 0, t) for k, t in enumerate(["canli destek yok.", "Canlı destek yok.", "canlı destek yok", "Destek yok"])]
    seg = spark.createDataFrame(rows, "theme_id string, doc_id long, position int, text string").withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    fb = seg.select("doc_id", F.lit(0.0).alias("sentiment"))
    assert lang.code == "tr"
    assert A.describe(seg, fb, A.Config(language="tr")).first()["headline"] == "Canlı destek yok"
    english = seg.withColumn("text", F.when(F.col("doc_id") < 2, "No support.").when(F.col("doc_id") == 2, "no support.").otherwise("Support is absent."))
    assert A.describe(english, fb, A.Config()).first()["headline"] == "No support"


def test_rows_are_numbered_by_time_then_source(spark):
    rows = [(f"2024-0{1 + k % 3}-{1 + k % 7:02d} {k % 24:02d}:00:00", f"text number {k}") for k in range(200)]
    got = S.load_feedback(spark.createDataFrame(rows, "date string, comment string").repartition(1)).collect()
    source = spark.createDataFrame(rows, "date string, comment string").repartition(1).collect()
    want = [t for _, _, t in sorted((d, k, t) for k, (d, t) in enumerate(source))]
    assert [r["text"] for r in sorted(got, key=lambda r: r["doc_id"])] == want
    assert sorted(r["doc_id"] for r in got) == list(range(200))
    assert {r["text"]: r["feedback_id"] for r in got} == {t: f"FB-{k + 1:05d}" for k, (_, t) in enumerate(source)}


def test_datasets_come_back(spark, tmp_path):
    one = Y.generate(spark, "team", days=30, accounts=20)
    one.save(f"file://{tmp_path}/set")
    two = Y.Dataset.load(spark, f"file://{tmp_path}/set")
    for name in ("feedback", "accounts", "releases", "ground_truth", "events", "release_truth"):
        a, b = getattr(one, name), getattr(two, name)
        assert a.columns == b.columns
        shown = lambda df: sorted(tuple("" if x is None else str(x) for x in r) for r in df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).collect())
        assert shown(a) == shown(b)


def test_synthetic_breadth():
    assert len(Y.SCENARIOS["team"]) == 12 and len(Y.SCENARIOS["canteen"]) == 13
    assert {t[2] for s in Y.SCENARIOS.values() for t in s} == {"negative", "neutral", "positive"}


@pytest.fixture(scope="module")
def analysed(spark):
    data = Y.generate(spark, "team", days=140, accounts=80, scale=0.35)
    told = []

    def ask(instructions, prompt, schema):
        told.append(json.loads(prompt))
        return json.dumps({"themes": [{"theme_id": told[0][0]["theme_id"], "name": "First of all", "kind": "ux", "summary": "s", "duplicate_of": ""}]})

    a = A.analyze(S.load_feedback(data.feedback), S.load_accounts(data.accounts), S.load_releases(data.releases), ask=ask)
    return data, a, told


def test_an_analysis_with_a_review_and_other_weights(spark, analysed):
    data, a, told = analysed
    rows = {r["theme_id"]: r for r in a.scored.collect()}
    assert len(rows) >= 5 and rows[told[0][0]["theme_id"]]["name"] == "First of all"
    again = {r["theme_id"]: r for r in A.rescore(a, cli.PRESETS["volume"]).scored.collect()}
    assert {k: v["mentions"] for k, v in rows.items()} == {k: v["mentions"] for k, v in again.items()}
    ranked = [r for r in again.values() if r["score"] is not None]
    assert min(ranked, key=lambda r: r["rank"])["mentions"] >= 0.5 * max(r["mentions"] for r in ranked)
    assert {r["version"] for r in a.radar.collect()} <= {"2.1", "2.2"}


def test_what_was_seen_by_a_day(spark, analysed):
    _, a, _ = analysed
    day = F.lit("2026-03-01").cast("timestamp_ntz")
    early = mentions.visible(a.mentions, day)
    assert 0 < early.count() < a.mentions.count()
    assert str(early.agg(F.max("created_at")).first()[0])[:10] <= "2026-03-01"


def test_a_failing_review_changes_nothing(spark, analysed):
    data, a, _ = analysed

    def broken(*_):
        raise RuntimeError("away")

    with pytest.warns(UserWarning):
        b = A.analyze(a.feedback.drop("mrr", "plan", "sentiment").limit(60), ask=broken)
    assert b.scored.columns


def test_settings_are_compared(spark):
    data = Y.generate(spark, "team", days=100, accounts=40, scale=0.25)
    settings = {k: T.ABLATIONS[k] for k in ("default", "whole items instead of sentences")}
    rows = {r["setting"]: r for r in T.table(spark, T.compare(data, settings)).collect()}
    assert list(rows) == list(settings)
    for r in rows.values():
        assert r["themes"] >= 3 and 0 < r["adjusted_rand"] <= 1 and 0 <= r["mean_recovered_share"] <= 1 and r["spikes_total"] == 1
    assert len(T.grid((0.8, 0.9), (0.01,))) == 2


def test_command_line(spark, tmp_path):
    o = cli.parser().parse_args(["analyze", "a.csv", "b.csv", "--out", "x", "--preset", "urgency", "--product-name", "P"])
    assert (o.feedback, o.out, o.preset, o.product_name, o.no_redact) == (["a.csv", "b.csv"], "x", "urgency", ["P"], False)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing"])
    cli.main(["generate", "--scenario", "canteen", "--days", "20", "--out", f"file://{tmp_path}/made"])
    assert Y.Dataset.load(spark, f"file://{tmp_path}/made", accounts=False).feedback.count() > 100
