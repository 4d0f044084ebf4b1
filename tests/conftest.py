import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(x):
    """A value that compares the same whichever engine it comes from."""
    import datetime
    import decimal

    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10] if str(x)[11:] in ("", "00:00:00") else str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 5)
    return str(x)


def same(df, con, sql):
    """Asserts that a DataFrame has the rows of the SQL, in any order."""
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    left = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    at = [want.columns.index(n) for n in names]
    right = sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    assert left == right
