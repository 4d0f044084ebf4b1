"""What the largest task reads: no group or table is one task's, however few groups or partitions there are."""

import pytest
from pyspark.sql import functions as F

from pulsemap.operators import themes
from pulsemap.plans.queries import ORACLE, QUERIES

from .conftest import same


def most_read(spark, run) -> int:
    """Most rows that one task read from a shuffle while run() ran."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()) for s in (found.apply(k) for k in range(found.size()))}

    before = stages()
    run()
    most = 0
    for stage, attempt in stages() - before:
        tasks = sc.statusStore().taskList(stage, attempt, 10_000)
        for t in (tasks.apply(k) for k in range(tasks.size())):
            if t.taskMetrics().isDefined():
                most = max(most, t.taskMetrics().get().shuffleReadMetrics().recordsRead())
    return most


def test_keywords_of_a_theme_with_most_of_the_terms(spark):
    word = F.concat(F.lit("w"), F.translate((F.col("id") * 10 + F.col("k")).cast("string"), "0123456789", "abcdefghij"))
    words = spark.range(2000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("word", word)
    texts = words.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("text")).withColumn("theme_id", F.when(F.col("id") % 100 > 0, "large").when(F.col("id") > 0, "small")).localCheckpoint()
    got = []
    assert most_read(spark, lambda: got.extend(themes.keywords(texts).collect())) < 12_000  # 38,000 different terms, nearly all of one theme
    assert {r["theme_id"] for r in got} == {"large", "small", None} and len(got) == 18
    few = spark.createDataFrame([("A", None), (None, None)], "theme_id string, text string")
    assert themes.keywords(few).collect() == [] == themes.keywords(few.limit(0)).collect()


@pytest.fixture
def many_lines(spark, tmp_path):
    """20,000 lines of 5,000 orders in three weeks, of five brands."""
    k = F.col("id")
    spark.range(100).select(k.alias("c_custkey"), k.cast("double").alias("c_acctbal"), F.lit("m").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(50).select(k.alias("p_partkey"), (k % 5).cast("string").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    day = F.expr("timestamp'2024-01-01 12:00:00' + make_dt_interval(cast(id % 21 as int))")
    spark.range(5000).select(k.alias("o_orderkey"), (k % 100).alias("o_custkey"), day.alias("o_orderdate"), F.lit("p").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20000).select((k % 5000).alias("l_orderkey"), (k * 7 % 50).alias("l_partkey"), F.expr("cast(id div 5000 as int)").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def by_one_shuffle_partition(spark, run) -> int:
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        return most_read(spark, run)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def mentions_lie_in_parts_by_their_number(spark, d, name):
    """Not by the session's shuffle partitions, of which one would hold all lines."""
    import duckdb

    con, df = duckdb.connect(), QUERIES[name](spark, d)
    for table in ("customer", "part", "orders", "lineitem"):
        con.execute(f"create view {table} as select * from '{d}/{table}.parquet/*.parquet'")
    assert by_one_shuffle_partition(spark, lambda: same(df, con, ORACLE[name])) < 5_000


def test_weekly_in_parts(spark, many_lines):
    mentions_lie_in_parts_by_their_number(spark, many_lines, "weekly")


def test_timeline_shares_in_parts(spark, many_lines):
    mentions_lie_in_parts_by_their_number(spark, many_lines, "timeline_shares")
