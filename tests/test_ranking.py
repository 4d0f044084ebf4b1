"""Row numbers in groups, against a sort in memory."""

import random

import pytest
from pyspark.sql import functions as F

from pulsemap.functions import ranking
from pulsemap.functions.shared import saved


def expected(rows, key):
    seen, out = {}, []
    for r in sorted(rows, key=key):
        seen[r[0]] = seen.get(r[0], -1) + 1
        out.append((*r, seen[r[0]]))
    return out


nulls_first = lambda x: (x is not None, x if x is not None else 0)


@pytest.mark.parametrize("groups", [1, 3, 400])
def test_numbers_follow_the_order_in_each_group(spark, groups):
    rng = random.Random(groups)
    rows = [(rng.choice([None, *map(str, range(groups))]) if rng.random() < 0.6 else "hot", rng.choice([None, *range(300)])) for _ in range(3000)]
    df = saved(spark.createDataFrame(rows, "g string, x int"), "rows")
    got = ranking.numbered(df, [F.col("g")], [F.col("x").asc_nulls_first()]).collect()
    want = expected(rows, lambda r: (nulls_first(r[0]) if r[0] is None else (True, r[0]), nulls_first(r[1])))
    assert sorted(map(str, got)) == sorted(f"Row(g={g!r}, x={x!r}, number={n})" for g, x, n in want)


def test_descending_and_without_groups(spark):
    df = saved(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), "rows")
    assert {r["x"]: r["k"] for r in ranking.numbered(df, [], [F.col("x").desc()], "k").collect()} == {x: 999 - x for x in range(1000)}


def test_equal_rows_spread_and_an_empty_table_gives_none(spark):
    df = saved(spark.range(20000).select(F.lit("a").alias("g"), F.lit(1).alias("x")), "rows")
    assert sorted(r["number"] for r in ranking.numbered(df, [F.col("g")], [F.col("x")]).collect()) == list(range(20000))
    assert ranking.numbered(saved(df.limit(0), "none"), [F.col("g")], [F.col("x")]).count() == 0


def test_values_and_nulls_have_keys_of_their_own(spark):
    rows = [(None, "a"), ("-", "a"), ("1:-", None), ("", "1:-"), ("a", ""), ("", "a")]
    keys = spark.createDataFrame(rows, "a string, b string").select(ranking.group_key([F.col("a"), F.col("b")]).alias("k"))
    assert keys.distinct().count() == len(rows)
