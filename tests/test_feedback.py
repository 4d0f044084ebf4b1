"""The feedback engine: small fixtures with known results, and every registered query against its SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemap.functions import text as T
from pulsemap.functions.lexicon import TURKISH, language
from pulsemap.functions.sentiment import rating_sentiment, score_feedback, text_sentiment
from pulsemap.operators import embed, evaluate, mentions, scoring, stats, themes
from pulsemap.plans.queries import ORACLE, QUERIES
from pulsemap.sources import feedback as S

from . import reference_rates as rates

from .conftest import DATA, same


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE:
        same(df, duck, ORACLE[name])
    else:
        BY_HAND[name](df.collect())


def _verdicts(rows):
    assert rows and {r["verdict"] for r in rows} <= {"Not enough data", "No matching theme", "Inconclusive", "No detectable change", "Resolved", "Improved", "Worse"}
    for r in rows:  # a significant change leaves 1 out of the interval
        if r["ci_low"] is not None:
            assert r["ci_low"] <= r["ci_high"]
            if r["verdict"] in ("Resolved", "Improved", "Worse"):
                assert not r["ci_low"] <= 1 <= r["ci_high"] and (r["verdict"] == "Worse") == (r["ci_low"] > 1)


def _keywords(rows):
    by = {}
    for r in rows:
        by.setdefault(r["theme_id"], []).append(r["term"])
    assert by and all(1 <= len(t) <= 6 and not any(a != b and a in b for a in t for b in t) for t in by.values())


def _segments(rows):
    """Cut again in Python from the documents: every segment is a part of its document, up to its first letter's case."""
    import pyarrow.parquet as pq

    body = {d: t for d, t in zip(*(c.to_pylist() for c in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).columns), strict=True)}
    assert {r["doc_id"] for r in rows} == set(body)
    for r in rows:
        said = " ".join(r["text"].split())
        assert said[1:] in " ".join((body[r["doc_id"]] or "").split()) or r["text"] == "(empty)"


def _redacted(rows):
    import re

    text = "\n".join(str(r) for r in rows)
    assert not re.search(r"[\w.+-]+@[\w-]+\.[a-z]{2,}", text)


BY_HAND = {"release_verdicts": _verdicts, "theme_keywords": _keywords, "segments": _segments, "redacted": _redacted}


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "names", "want"),
    [
        ("[Bug] Hi team, The Android app is so slow. Please fix this asap. - Priya", (), ["The Android app is so slow.", "Please fix this asap."]),
        ('Call notes (Acme): the CTO said "We need SAML single sign-on." Renewal in 3 weeks.', (), ["We need SAML single sign-on."]),
        ("feature request: please add Tempo dark mode", ("Tempo",), ["Please add dark mode"]),
        ("iCloud sync fails.", (), ["iCloud sync fails."]),
        ("Best app ever! Thanks, Maria", (), ["Best app ever!"]),
        ("Sync broke. Also, add dark mode.", (), ["Sync broke.", "Add dark mode."]),
        ("", (), []),
        (None, (), []),
    ],
)
def test_segments(spark, text, names, want):
    assert one(spark, text, lambda c: T.segments(c, names)) == want


def test_segment_feedback_keeps_what_has_no_content(spark):
    rows = spark.createDataFrame([(0, "Thanks!"), (1, None), (2, "Sync broke. Also, add dark mode.")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["position"], r["text"]) for r in T.segment_feedback(rows).collect())
    assert got == [(0, 0, "Thanks!"), (1, 0, "(empty)"), (2, 0, "Sync broke."), (2, 1, "Add dark mode.")]


def test_fold(spark):
    assert one(spark, "İSTANBUL ILIK", T.tr_lower) == "istanbul ılık"
    assert one(spark, "Çalışmıyor, ÖDEME geçmiyor", T.fold) == "calismiyor, odeme gecmiyor"


def test_redact(spark):
    text = "Kart 4111 1111 1111 1111, IBAN TR33 0006 1005 1978 6457 8413 26, tel 0532 123 45 67, a.b@c.com, kimlik 10000000146, sipariş 1234567890123, 150 TL"
    got = one(spark, text, T.redact)
    assert all(tag in got for tag in ("[card]", "[iban]", "[phone]", "[email]", "[national-id]"))
    assert "1234567890123" in got and "150 TL" in got


def test_sentiment(spark):
    def score(t, lang=None):
        return one(spark, t, lambda c: text_sentiment(c, lang) if lang else text_sentiment(c))

    squash = lambda x: x / math.sqrt(x * x + 8)
    assert score("This is great") == pytest.approx(squash(2.2))
    assert score("not great") == pytest.approx(squash(2.2 * -0.6))
    assert score("very slow!!") == pytest.approx(squash(-1.5 * 1.3 - 0.3))
    assert score(None) == 0 and score("") == 0
    assert score("Uygulama çalışmıyor", TURKISH) < -0.2 and score("Güzel değil", TURKISH) < 0 < score("Sorunsuz çalışıyor", TURKISH)
    assert score("Merhaba, bakiyem yüklenmedi. İyi çalışmalar", TURKISH) < -0.2


def test_rating(spark):
    rows = spark.createDataFrame([(5.0, "app_store"), (1.0, "app_store"), (7.0, "survey"), (9.0, "app_store"), (None, "x")], "rating double, channel string")
    got = [r[0] for r in rows.select(rating_sentiment(F.col("rating"), F.col("channel"))).collect()]
    assert got == [1.0, -1.0, 0.0, pytest.approx(2 / 3), None]
    both = spark.createDataFrame([("great", 1.0, "app_store"), ("great", None, "app_store")], "text string, rating double, channel string")
    scored = [r["sentiment"] for r in score_feedback(both).collect()]
    assert scored[0] == pytest.approx(0.6 * scored[1] - 0.4)


def test_language():
    assert language("en").code == "en"
    with pytest.raises(ValueError):
        language("xx")


def test_rates():
    assert rates.compare(50, 50, 1.0)[0] == 1 and rates.compare(50, 50, 1.0)[3] > 0.5
    ratio, low, _, p = rates.compare(90, 30, 1.0)
    assert p < 1e-6 and low > 1.5
    assert rates.compare(100, 50, 2.0)[3] > 0.5
    assert rates.compare(0, 0, 1.0)[2] == math.inf and math.isnan(rates.compare(1, 1, math.nan)[0])
    assert rates.compare(86, 84, 1.0)[1] == pytest.approx(0.7490, abs=1e-3)


def test_two_sided_against_sums():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, p = int(r.integers(1, 80)), float(r.uniform(0.02, 0.98))
        a = int(r.integers(0, n + 1))
        pmf = [math.exp(rates._log_pmf(k, n, p)) for k in range(n + 1)]
        assert rates.two_sided(a, n, p) == pytest.approx(min(1, sum(x for x in pmf if x <= pmf[a] * (1 + 1e-7))), rel=1e-8)


def test_false_discovery(spark):
    rows = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.2,)], "p_value double")
    got = {r["p_value"]: r["q_value"] for r in stats.benjamini_hochberg(rows).collect()}
    assert got == {0.01: pytest.approx(0.04), 0.04: pytest.approx(0.16 / 3), 0.03: pytest.approx(0.16 / 3), 0.2: pytest.approx(0.2)}


def test_volume_ratio(spark):
    rows = spark.createDataFrame([(40, 40)] * 8 + [(400, 40)], "a long, b long")
    ratio = stats.volume_ratio(rows, F.lit(720), F.lit(360)).first()["expected"]
    assert ratio == pytest.approx(1.0)
    assert stats.volume_ratio(rows, F.lit(720), F.lit(360), method="total").first()["expected"] == 2


def test_scores(spark):
    rows = [("loud", "bug", 100, 10.0, 0.5, 1.0, "stable", 100), ("valuable", "bug", 10, 1000.0, 0.5, 1.0, "stable", 10), ("growing", "bug", 10, 10.0, 0.5, 4.0, "emerging", 10), ("praise", "praise", 500, 9999.0, 0.0, 1.0, "stable", 500)]
    df = spark.createDataFrame(rows, "theme_id string, kind string, accounts long, mrr_weighted double, negative_share double, lift double, status string, mentions long")
    rank = {r["theme_id"]: (r["rank"], r["score"]) for r in scoring.score_themes(df, scoring.Weights(0, 1, 0, 0)).collect()}
    assert rank["valuable"][0] == 1 and rank["praise"] == (None, None)
    scored = scoring.score_themes(df)
    parts = {r["theme_id"]: r for r in scoring.contributions(scored).collect()}
    for r in scored.filter("score is not null").collect():
        p = parts[r["theme_id"]]
        assert p["reach"] + p["revenue"] + p["severity"] + p["momentum"] == pytest.approx(r["score"])


def test_clusters(spark):
    r = np.random.default_rng(0)
    centers = r.normal(size=(3, 16))
    rows, k = [], 0
    for c, n in zip(centers, (200, 60, 12), strict=True):
        for _ in range(n):
            rows.append((k, (c / np.linalg.norm(c) + 0.05 * r.normal(size=16)).tolist()))
            k += 1
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {x["cluster"]: x["count"] for x in themes.cluster_vectors(df, 0.5, 5).groupBy("cluster").count().collect()}
    assert got == {0: 200, 1: 60, 2: 12}
    few = themes.cluster_vectors(df.filter("id < 100 or id >= 269"), 0.5, 5, 0.99)
    assert {x["cluster"] for x in few.filter("id >= 269").collect()} == {themes.OTHER}


def test_first_mention_is_primary(spark):
    segments = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, None)], "doc_id long, position int, theme_id string")
    fb = spark.createDataFrame([(1, "x", 1.0)], "doc_id long, account_id string, mrr double").selectExpr("*", "timestamp'2024-01-01' as created_at", "'p' as plan", "'c' as channel", "0.0D as sentiment")
    assert sorted((r["theme_id"], r["primary"]) for r in mentions.mentions_of(segments, fb).collect()) == [("a", True), ("b", False)]


def test_mentions_without_an_account_count(spark):
    raw = spark.createDataFrame([("2024-01-01", "a", "x"), ("2024-01-02", "b", None), ("2024-01-03", "c", None)], "created_at string, text string, account_id string")
    fb = mentions.with_accounts(S.load_feedback(raw), None).withColumn("sentiment", F.lit(-0.5))
    rows = mentions.mentions_of(spark.createDataFrame([(0, 0, "t"), (1, 0, "t"), (2, 0, "u")], "doc_id int, position int, theme_id string"), fb)
    got = {r["theme_id"]: (r["mentions"], r["accounts"], r["negative_share"], r["share"], str(r["last_seen"])[:10]) for r in mentions.theme_metrics(rows, 3).collect()}
    assert got == {"t": (2, 2, 1.0, 2 / 3, "2024-01-02"), "u": (1, 1, 1.0, 1 / 3, "2024-01-03")}


def test_the_whole_vocabulary_is_learned(spark):
    r = np.random.default_rng(2)
    said = [" ".join("".join(w) for w in r.choice(list("abcdefghijklmnopqrstuvwxyz"), (2500, 7))) for _ in range(3)]
    df = spark.createDataFrame([(k, said[k % 3]) for k in range(9)], "id int, text string")
    e = embed.TfidfEmbedder().fit(df)
    want = {t for x in said for w in x.split() for p in [f" {w} "] for n in (3, 4, 5) for t in (f"c:{p[i : i + n]}" for i in range(len(p) - n + 1))}
    assert want <= e.weight.keys() and len(e.weight) == len(e.projection) > 50_000
    v = {x["id"]: np.array(x["vector"]) for x in e.encode(df).collect()}
    assert all((v[a] @ v[b] > 0.999) == (a % 3 == b % 3) for a in v for b in v)
    assert np.allclose(e.projection.T @ e.projection, np.eye(e.projection.shape[1]), atol=1e-3)


def test_agreement_of_equal_labels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "t string, p int")
    got = evaluate.agreement(evaluate.contingency(df, "t", "p")).first()
    assert (got["adjusted_rand"], got["nmi"]) == (pytest.approx(1), pytest.approx(1))


def test_exports(spark, tmp_path):
    utf16 = tmp_path / "reviews_202403.csv"
    utf16.write_bytes("Review Title,Review Text,Star Rating,Date\nSüper,Çok pratik,5,2026-03-12\n,QR çalışmıyor,1,2026-03-11\n".encode("utf-16"))
    got = S.load_feedback(str(utf16), spark).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["QR çalışmıyor", "Süper. Çok pratik"] and [r["rating"] for r in got] == [1, 5]
    legacy = tmp_path / "talepler.csv"
    legacy.write_bytes("Talep No;Oluşturma Tarihi;Konu;Açıklama\n7;12.03.2026 10:15;Giriş;SMS kodu gelmiyor\n".encode("cp1254"))
    row = S.load_feedback(str(legacy), spark).first()
    assert row["text"] == "Giriş. SMS kodu gelmiyor" and str(row["created_at"]) == "2026-03-12 10:15:00" and row["feedback_id"] == "7"
    both = S.combine_feedback({"reviews_202403.csv": str(utf16), "talepler.csv": str(legacy)}, spark)
    assert {r["channel"] for r in both.collect()} == {"reviews", "talepler"} and both.select("feedback_id").distinct().count() == 3
    with pytest.raises(S.SchemaError, match="text"):
        S.load_feedback(spark.createDataFrame([("2024-01-01",)], "date string"))
    with pytest.raises(S.SchemaError):
        S.read_table("x.xlsx", spark)


@pytest.mark.parametrize(("values", "want"), [(["12.03.2026", "01.04.2026"], "2026-03-12"), (["14/03/2026"], "2026-03-14"), (["03/14/2026"], "2026-03-14"), (["2026-03-14T10:00:00Z"], "2026-03-14")])
def test_dates(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert str(df.select(S.parse_dates(df, "d").alias("x")).first()["x"])[:10] == want


def test_accounts_keep_the_first(spark):
    df = spark.createDataFrame([("a", "5"), ("a", "9"), ("b", "bad")], "account_id string, mrr string").coalesce(1)
    assert sorted((r["account_id"], r["mrr"], r["plan"]) for r in S.load_accounts(df).collect()) == [("a", 5.0, "unknown"), ("b", 0.0, "unknown")]
