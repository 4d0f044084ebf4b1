"""Exact top-k over many blocks, batches and odd vectors, against all products."""

import numpy as np
from pyspark.sql import functions as F

from pulsemap.llm import topk


def brute(rows, asks, k):
    """(query_id, rank, vec_id, score) by every product; results of equal query ids are ranked together."""
    found = {}
    for i, v in rows:
        if asks(i):
            found.setdefault(i, [])
            found[i] += sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))[:k]
    return sorted((i, n + 1, j, -s) for i, got in found.items() for n, (s, j) in enumerate(sorted(got)[:k]))


def run(spark, rows, asks, k=5, **given):
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    return sorted(tuple(r) for r in topk.top_k(df, asks(F.col("vec_id")), k, **given).collect())


def test_many_blocks_lengths_and_repeated_ids(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [int(x) for x in r.integers(-30, 30, d)]) for d, n in ((24, 300), (3, 40), (0, 3), (1, 1)) for i in r.integers(0, 250, n)]
    rows += rows[:20]  # equal ids, equal vectors
    for k in (1, 5, 60):
        assert run(spark, rows, lambda i: i % 3 == 0, k, block_components=500) == brute(rows, lambda i: i % 3 == 0, k)


def test_one_vector_in_most_rows_and_uneven_norms(spark):
    r = np.random.default_rng(6)
    rows = [(i, [3] * 16 if i % 3 else [int(x) for x in r.integers(-9, 9, 16) * (1 + 50 * (i % 5 == 0))]) for i in range(900)]
    assert run(spark, rows, lambda i: i % 50 == 0) == brute(rows, lambda i: i % 50 == 0, 5)


def test_components_beyond_doubles(spark):
    rows = [(i, [2**28 + i, -(2**27) * i]) for i in range(12)]
    assert run(spark, rows, lambda i: i < 4, 3) == brute(rows, lambda i: i < 4, 3)


def test_a_task_keeps_k_rows_a_query():
    """Over many batches what is held stays k rows a query, and the floors only rise."""
    r = np.random.default_rng(7)
    q, best = r.integers(-50, 50, (20, 8)), None
    best = topk.Best(np.arange(20), q, np.full(20, -np.inf), 4)
    seen = best.floor.copy()
    for b in range(10):
        best.meet(np.arange(100 * b, 100 * b + 100), r.integers(-50, 50, (100, 8)))
        assert len(best.row) <= 80 and (best.floor >= seen).all()
        seen = best.floor.copy()
