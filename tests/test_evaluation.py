"""Merges, reviews, briefs, made-up data and the measures, on small inputs with known results."""

import datetime
import json

import pytest

from pulsemap.operators import evaluate as E
from pulsemap.plans import report as R
from pulsemap.plans import review as V
from pulsemap.plans.analysis import resolved_merges
from pulsemap.sources import synthetic as Y

D = datetime.date


def test_merges_follow_chains_and_stop_on_cycles():
    known = {"T01", "T02", "T03"}
    assert resolved_merges({"T03": "T02", "T02": "T01"}, known) == {"T03": "T01", "T02": "T01"}
    assert resolved_merges({"T01": "T01", "T02": "T09", "T09": "T01"}, known) == {}
    assert resolved_merges({"T01": "T02", "T02": "T01"}, known) == {}


def test_alerts_against_known_events(spark):
    events = spark.createDataFrame([("a", D(2024, 1, 2), D(2024, 1, 3), "spike")], "theme string, start_date date, end_date date, kind string")
    named = spark.createDataFrame([("T01", "a"), ("T02", "b")], "theme_id string, true_theme string")
    replayed = spark.createDataFrame([(D(2024, 1, 4), "T01", "new"), (D(2024, 1, 4), "T02", "emerging"), (D(2024, 1, 5), "T02", "new"), (D(2024, 1, 7), "T02", "new"), (D(2024, 1, 8), "T02", "stable")], "day date, theme_id string, status string")
    trailing = spark.createDataFrame([(D(2024, 1, 5), "T01", True), (D(2024, 1, 1), "T02", True)], "day date, theme_id string, naive boolean")
    log = E.alert_log(replayed, trailing, named, events)
    assert log.count() == 5 and log.filter("expected").count() == 2  # the naive alert of a day not replayed is left out
    found = {r["method"]: r for r in E.detection(log, events).collect()}
    assert found["rate_test"]["days_to_detect"] == 2 and found["naive_2x"]["days_to_detect"] == 3
    told = {r["method"]: r for r in E.alert_summary(log, E.detection(log, events)).collect()}
    assert (told["rate_test"]["false_alarm_episodes"], told["rate_test"]["false_alarm_days"]) == (2, 3)
    assert (told["naive_2x"]["spikes_detected"], told["naive_2x"]["false_alarm_days"]) == (1, 0)
    assert E.spurious_trend_days(replayed, named, events, 112).first()[0] == 3


def test_review_is_cleaned(spark):
    scored = spark.createDataFrame([("T01", ["k"], 5, -0.5, {"pro": 1.0}, ["q"], "n1", "bug"), ("T02", ["k"], 3, None, None, ["q"], "n2", "ux")], "theme_id string, keywords array<string>, mentions_all_time long, mean_sentiment double, plan_mix map<string,double>, examples array<string>, name string, kind string")
    entry = lambda t, d: {"theme_id": t, "name": f"new {t}", "kind": "bug", "summary": "s", "duplicate_of": d}
    asked = []

    def ask(instructions, prompt, schema):
        asked.extend(json.loads(prompt))
        return json.dumps({"themes": [entry("T02", "T01"), entry("T01", "T01"), entry("T09", ""), entry("T02", "T09")]})

    got = V.review(scored, ask)
    assert [x["theme_id"] for x in asked] == ["T01", "T02"]
    assert {tuple(r) for r in got.select("theme_id", "duplicate_of").collect()} == {("T01", ""), ("T02", "T01")}
    assert V.suggested_merges(got) == {"T02": "T01"}
    assert {r["name"] for r in V.overlaid(scored, got).collect()} == {"new T01", "new T02"}


def test_brief_without_revenue_or_trend():
    e = {
        "theme_id": "T01", "name": "Login", "type": "Bug", "kind": "bug", "representative_quote": "It fails", "window_days": 60, "mentions": 3, "mentions_all_time": 4, "people": "users", "accounts": 3, "share_of_all_feedback": 0.1,
        "channel_mix": {"app_store": 0.75, "survey": 0.25}, "trend": {"status": "quiet"}, "quotes": ["It fails"],
    }
    text = R.brief(e)
    assert "Too few" in text and "app store 75%, survey 25%" in text and "revenue" not in text


@pytest.mark.parametrize("scenario", ["team", "canteen"])
def test_synthetic_data_is_the_same_every_time(spark, scenario):
    one, two = (Y.generate(spark, scenario, days=40).feedback.orderBy("feedback_id").collect() for _ in range(2))
    assert one == two and len(one) > 200 and len({r["feedback_id"] for r in one}) == len(one)
    assert Y.generate(spark, scenario, seed=8, days=40).feedback.count() != len(one)


def test_synthetic_counts_have_the_rate(spark):
    from pyspark.sql import functions as F

    n = spark.range(4000).select(Y._poisson(F.lit(3.0), Y._uniform(F.lit(1), F.col("id"))).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(n[0] - 3) < 0.15 and abs(n[1] - 3) < 0.3


def test_unknown_scenario(spark):
    with pytest.raises(ValueError):
        Y.generate(spark, "nope")


@pytest.fixture(scope="module")
def built(spark):
    """A finished analysis put together by hand."""
    from pyspark.sql import functions as F

    from pulsemap.operators.scoring import score_themes
    from pulsemap.plans.analysis import Analysis, Config

    rows = [(k, f"F{k}", "crash" if k % 2 else "export") for k in range(20)]
    fb = spark.createDataFrame(rows, "doc_id long, feedback_id string, about string").withColumns({"created_at": (F.date_add(F.lit(D(2024, 3, 1)), F.floor(F.col("doc_id") / 2).cast("int"))).cast("timestamp_ntz"), "sentiment": F.lit(-0.5), "account_id": F.col("feedback_id"), "channel": F.lit("app"), "mrr": F.lit(90.0)})
    m = fb.select(F.col("doc_id").alias("doc"), F.when(F.col("about") == "crash", "T01").otherwise("T02").alias("theme_id"), "created_at", F.lit(True).alias("primary"))
    themes = spark.createDataFrame(
        [("T01", "Crash", "It crashes", ["crash"], "bug", ["It crashes"], 0.9, 10, 10, 900.0, 9e3, 8.0, -0.5, 0.9, 0.5, "new", 2.0, 1.2, 3.0, 0.01, {"pro": 1.0}, {"app": 1.0}), ("T02", "Nice", "Nice", ["nice"], "praise", ["Nice"], 0.9, 10, 10, 0.0, 0.0, 5.0, 0.5, 0.0, 0.5, "stable", 1.0, 0.8, 1.2, 0.9, {}, {"app": 1.0})],
        "theme_id string, name string, headline string, keywords array<string>, kind string, examples array<string>, cohesion double, mentions long, mentions_all_time long, mrr_weighted double, arr_exposed double, accounts double, mean_sentiment double, negative_share double, share double, status string, lift double, lift_ci_low double, lift_ci_high double, q_value double, plan_mix map<string,double>, channel_mix map<string,double>",
    )
    radar = spark.createDataFrame([("1.1", D(2024, 3, 5), "Fix", "T01", 4, 5, 0.5, 0.2, 0.9, "Resolved")], "version string, day date, title string, theme_id string, pre_mentions long, post_mentions long, rate_ratio double, ci_low double, ci_high double, verdict string")
    effects = spark.createDataFrame([("1.1", "T02", 1.8)], "version string, theme_id string, rate_ratio double")
    return Analysis(fb, m.withColumnRenamed("doc", "doc_id"), m, themes, themes, score_themes(themes.withColumn("accounts", F.col("accounts").cast("long"))).cache(), radar, effects, True, Config())


def test_report_is_written(spark, built, tmp_path):
    R.write_report(built, f"file://{tmp_path}/out", briefs=1)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/roadmap").columns == list(R.ROADMAP)
    assert "Crash" in spark.read.text(f"file://{tmp_path}/out/briefs/01-T01").toPandas()["value"].str.cat()
    assert R.timeline_themes(built) == ["T01"]
    page, text = R.html(built, {"sign accuracy": 0.875}), R.markdown(built, {"sign accuracy": 0.875})
    assert "<table>" in page and "<svg" in page and "0.875" in page and "4 → 5" in text
    assert "20 items from 20 accounts in 1 channels, 2024-03-01 to 2024-03-10, $1,800 MRR behind it; 2 themes hold 20 of the items, 1 of them are new or emerging." in text
    assert "| Crash | new | x2.00 | 1.20–3.00 |" in text and "| 1.1 | Nice | x1.80 |" in text


def test_all_measures(spark, built):
    from pulsemap.plans import evaluation

    truth = built.feedback.selectExpr("feedback_id", "about as true_theme", "'negative' as true_polarity")
    events = spark.createDataFrame([("crash", D(2024, 3, 4), None, 2.0, "spike")], "theme string, start_date date, end_date date, multiplier double, kind string")
    data = Y.Dataset(built.feedback, None, built.radar, truth, events, spark.createDataFrame([("1.1", "crash")], "version string, intended_theme string"))
    got = json.loads(evaluation.as_json(evaluation.evaluate_all(built, data, warmup_days=2)))
    assert got["themes"][0]["adjusted_rand"] == 1 and got["releases"][0]["correct"] and got["sign_accuracy"][0]["sign_accuracy"] == 1
    assert got["side_effects"] == [{"flagged": 1, "real": 0, "spurious": 1}]
