"""Rendezvous sharding against a plain loop, and its law."""

import math
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pulsemap.llm import queries, sharding

from ..conftest import DATA, same


def draw(key, shard):
    digits = sha256(f"{'-' if key is None else key}#{shard // 4}".encode()).hexdigest()
    return (int(digits[shard % 4 * 16 :][:13], 16) + 1) / 2**52


def shard_of(key, weights):
    return min(range(len(weights)), key=lambda s: (-math.log(draw(key, s)) / weights[s], s))


def test_query_equals_sql(spark, duck):
    same(queries.op13_sharding(spark, DATA), duck, queries.OP13_SQL)


ROWS = [(None, "a"), (None, None), (5, "x"), (5, "x"), (5, "y"), (6, ""), (7, "é" * 100_000)] + [(k, "t") for k in range(100, 3100)]


def test_rows_weights_and_growth(spark):
    weights, more = [1.0, 2.5, 0.5, 1.0, 1.0], [1.5, 0.1]
    docs = spark.createDataFrame([(k, t, 1, "s") for k, t in ROWS], "doc_id long, text string, shard int, key string").repartition(5)
    got = sharding.assign(docs, weights, more).collect()
    plain = Counter()
    for k, t in ROWS:
        body = (t or "").encode()
        plain[k, len(body) + 8, zlib.crc32(body), shard_of(k, weights), shard_of(k, weights + more)] += 1
    assert Counter(tuple(r)[:5] for r in got) == plain
    for s in range(5):
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        keys = [(r["key"] is not None, r["key"] or 0, r["size"], r["text_crc32"]) for r in mine]
        assert keys == sorted(keys) and abs(len(mine) / len(ROWS) - weights[s] / sum(weights)) < 0.05
    assert all(r["grown_shard"] in (r["shard"], 5, 6) for r in got)
    moved = sum(r["grown_shard"] != r["shard"] for r in got) / len(got)
    assert abs(moved - sum(more) / (sum(weights) + sum(more))) < 0.05


def test_an_empty_table_and_bad_weights(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(docs, [1.0]).count() == 0
    for bad in ([], [0.0], [1.0, float("nan")], [-1.0]):
        with pytest.raises(ValueError):
            sharding.assign(docs, bad)


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "more") for k, t in ROWS], "doc_id long, text string, n string")
    sharding.write_shards(docs, [1.0] * 4, f"{tmp_path}/out", file_bytes=20_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.drop("shard").exceptAll(docs).isEmpty() and back.count() == len(ROWS)
    assert all(r["shard"] == shard_of(r["doc_id"], [1.0] * 4) for r in back.select("doc_id", "shard").collect())
    files = [r["f"] for r in back.select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) > 4
