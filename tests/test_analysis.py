"""The analysis from end to end on a small made-up history."""

import random

import pytest

from pulsemap.operators.embed import get_embedder
from pulsemap.plans import analysis as A
from pulsemap.sources import feedback as S

SAID = {
    "crash": ["The Android app crashes on startup.", "App crashes every time on Android startup.", "Android startup crash again, app is broken."],
    "export": ["Please add an export to PDF.", "We need PDF export of the board.", "An option for PDF export is needed, please."],
    "price": ["The plan price is too expensive.", "Pricing per seat is expensive for us.", "Billing costs too much, the price per seat."],
}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(1)
    rows = []
    for k in range(240):
        day = r.randint(0, 111)
        topic = r.choice(["crash", "export", "price"]) if day < 84 else r.choice(["crash", "crash", "crash", "crash", "export", "price"])
        rows.append((f"2024-0{1 + day // 28}-{1 + day % 28:02d} 10:00:00", f"Hi team, {r.choice(SAID[topic])} Thanks!", f"a{k % 40}"))
    feedback = S.load_feedback(spark.createDataFrame(rows, "date string, comment string, customer_id string"))
    accounts = S.load_accounts(spark.createDataFrame([(f"a{k}", 100.0 * k, "pro") for k in range(40)], "account_id string, mrr double, plan string"))
    releases = S.load_releases(spark.createDataFrame([("2024-03-20", "1.1", "PDF export option", "")], "date string, version string, title string, description string"))
    return feedback, accounts, releases


def test_analyze(tables):
    a = A.analyze(*tables, config=A.Config(min_theme_share=0.02))
    rows = {r["theme_id"]: r for r in a.scored.collect()}
    assert 3 <= len(rows) <= 6 and a.has_revenue
    crash = next(r for r in rows.values() if "crash" in r["headline"].lower())
    assert crash["kind"] == "bug" and crash["lift"] > 1
    assert any(r["kind"] == "feature_request" for r in rows.values()) and any(r["kind"] == "pricing" for r in rows.values())
    assert a.radar.count() == 1 and a.radar.first()["verdict"]
    assert A.insights(a)[0]["kind"] == "priority"


def test_feedback_alone(tables):
    a = A.analyze(tables[0].limit(24))
    assert not a.has_revenue and a.radar is None


def test_unknown_embedding():
    with pytest.raises(ValueError):
        get_embedder("nope")
