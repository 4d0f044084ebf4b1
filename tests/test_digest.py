"""Fingerprints of tables, analyses found again by them, and the report's pictures and figures."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from pulsemap.functions.digest import table_digest
from pulsemap.plans import analysis as A
from pulsemap.plans import charts, report
from pulsemap.sources import feedback as S
from pulsemap.sources import synthetic as Y

ROWS = [(1, "a", 1.5, {"x": 1, "y": 2}, ["p"]), (2, None, None, None, []), (2, None, None, None, []), (3, "", 0.0, {}, None)]
KIND = "id int, t string, v double, m map<string,int>, l array<string>"


def test_digests_follow_content_alone(spark):
    df = spark.createDataFrame(ROWS, KIND)
    one = table_digest(df)
    assert len(one) == 16
    assert one == table_digest(df.orderBy(F.desc("id")).repartition(5)) == table_digest(spark.createDataFrame(ROWS[::-1], KIND).coalesce(1))
    other = [
        df.limit(3), df.union(df.limit(1)), df.dropDuplicates(["id"]), df.withColumn("t", F.when(F.col("id") == 3, None).otherwise(F.col("t"))), df.withColumnRenamed("t", "u"), df.withColumn("id", F.col("id").cast("long")), df.select("t", "id", "v", "m", "l"), df.limit(0),
        spark.createDataFrame([(1, "a", 1.5, {"x": 2, "y": 1}, ["p"]), *ROWS[1:]], KIND),
    ]
    assert len({one, *map(table_digest, other)}) == len(other) + 1
    assert table_digest(df, None) != table_digest(None, df) != table_digest(df)


def test_nulls_keep_their_column(spark):
    a, b = (spark.createDataFrame([x], "a string, b string") for x in ((None, "x"), ("x", None)))
    assert table_digest(a) != table_digest(b)


def test_an_analysis_is_found_again(spark, tmp_path, monkeypatch):
    data = Y.generate(spark, "team", days=60, accounts=40, scale=0.3)
    items, accounts, releases = S.load_feedback(data.feedback), S.load_accounts(data.accounts), S.load_releases(data.releases)
    first = A.analyze_once(f"file://{tmp_path}/kept", items, accounts, releases)
    want = sorted(map(str, first.scored.collect()))
    page = report.html(first)
    assert page.count("<svg") == len(report.pictures(first)) >= 3
    for picture in report.pictures(first).values():
        ET.fromstring(picture)
    monkeypatch.setattr(A, "analyze", None)
    again = A.analyze_once(f"file://{tmp_path}/kept", items.repartition(3), accounts, releases)
    assert sorted(map(str, again.scored.collect())) == want and again.has_revenue == first.has_revenue


def test_pictures_are_drawn_from_any_rows():
    rows = [{"version": "1 & 2", "rate_ratio": 0.4, "ci_low": 0.0, "ci_high": float("inf"), "verdict": "Resolved"}]
    for picture in (charts.intervals(rows), charts.intervals([]), charts.lines([], {}), charts.slopes([]), charts.bars([{"name": "<x>", "score": 50.0}]), charts.slopes([{"name": "a", "vote_rank": 1, "rank": 9}]), charts.lines([{"theme_id": "T1", "week": "2024-01-01", "percent": None}], {})):
        assert ET.fromstring(picture).tag == "svg"
    assert report.format_q(0.0004) == "< 0.001" and report.format_q(0.0456) == "0.046"
