"""The replay against detect_trends day by day."""

import datetime

import pytest
from pyspark.sql import functions as F

from pulsemap.operators import trends
from pulsemap.plans import queries as Q

from .conftest import DATA, same


@pytest.fixture(scope="module")
def told(spark):
    m, items = Q._items(spark, DATA)
    return m.cache(), items.cache()


@pytest.mark.parametrize("method", ["median_of_ratios", "total"])
def test_the_replay_is_a_loop_over_days(spark, told, method):
    m, items = told
    got = {}
    for r in trends.backtest(m, items, 5, 10, 12, 0.5, method).collect():
        got.setdefault(r["day"], {})[r["theme_id"]] = r
    first = items.agg(F.min(F.to_date("created_at"))).first()[0]
    assert sorted(got)[0] == first + datetime.timedelta(days=12)
    for day in sorted(got)[::6]:
        seen = lambda df, day=day: df.filter(F.col("created_at") < F.lit(day + datetime.timedelta(days=1)))
        at = F.lit(datetime.datetime.combine(day, datetime.time())).cast("timestamp_ntz")
        for r in trends.detect_trends(seen(m), seen(items), at, 5, 10, 0.5, method).collect():
            x = got[day][r["theme_id"]]
            assert (x["recent_mentions"], x["baseline_mentions"], x["status"]) == (r["recent_mentions"], r["baseline_mentions"], r["status"])
            assert x["lift"] == pytest.approx(r["lift"]) and x["p_value"] == pytest.approx(r["p_value"]) and x["q_value"] == pytest.approx(r["q_value"])


def test_days_and_totals_come_from_the_items(spark):
    """An item without a theme opens the calendar; one in two themes counts once."""
    at = lambda k: datetime.datetime(2024, 1, 1 + k)
    items = spark.createDataFrame([(at(0),), *[(at(k),) for k in range(3, 20)] * 3], "created_at timestamp_ntz")
    m = spark.createDataFrame([(k, t, at(k)) for k in range(3, 20) for t in ("a", "b")], "doc long, theme_id string, created_at timestamp_ntz")
    rows = trends.backtest(m, items, 5, 10, 12, method="total").collect()
    assert min(r["day"] for r in rows) == datetime.date(2024, 1, 13)
    last = next(r for r in rows if r["day"] == datetime.date(2024, 1, 20) and r["theme_id"] == "a")
    assert (last["recent_mentions"], last["baseline_mentions"]) == (5, 10)
    assert last["lift"] == pytest.approx((5.5 / 10.5) / (15 / 30))


@pytest.mark.parametrize("name", ["backtest", "backtest_by_volume", "alert_log", "alert_detection", "alert_summary"])
def test_queries(spark, duck, name):
    same(Q.QUERIES[name](spark, DATA), duck, Q.ORACLE[name])
