"""The decomposition on blocks against the one that holds all term vectors, and against an exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemap.functions.shared import saved
from pulsemap.operators import decompose, embed


#: Sizes at which a few hundred texts are many blocks, groups and triangles.
SMALL = decompose.Sizes(terms=512, piece=128, texts=64, weights=3000, merged=2)


def texts(n, seed=3):
    r = np.random.default_rng(seed)
    words = [["".join(r.choice(list("abcdefghijklmnop"), 6)) for _ in range(14)] for _ in range(12)]
    return [" ".join(r.choice(words[k % 12], 5)) for k in range(n)]


def test_start_is_the_same_in_pieces():
    n = decompose.SEEDED
    whole = decompose.start(0, 3 * n + 5, 4)
    assert whole.shape == (3 * n + 5, 4)
    for first, rows in ((n, 10), (2 * n, n + 5), (100, n), (n - 1, 2)):
        assert (decompose.start(first, rows, 4) == whole[first : first + rows]).all()


def test_triangles_of_any_number_of_tasks(spark):
    m = np.random.default_rng(0).standard_normal((500, 6)).astype(np.float32)
    rows = spark.createDataFrame([(bytearray(m[k : k + 20].tobytes()),) for k in range(0, 500, 20)], "m binary").repartition(9)
    r = decompose.triangle(rows, 6, 2)
    assert np.allclose(r.T @ r, m.T.astype(float) @ m, atol=1e-3)
    q = m @ decompose.inverse(r)
    assert np.allclose(q.T @ q, np.eye(6), atol=1e-4)


def test_blocks_give_the_leading_vectors(spark):
    """A table of known singular values, with empty rows and terms that no text has."""
    r = np.random.default_rng(1)
    u, v = (np.linalg.qr(r.standard_normal((n, 5)))[0] for n in (300, 80))
    a = u @ np.diag([9.0, 7, 5, 3, 2]) @ v.T
    a[7] = 0
    a[:, 11] = 0
    rows = [(k, np.flatnonzero(a[k]).tolist(), a[k][np.flatnonzero(a[k])].tolist()) for k in range(300)]
    t = decompose.tiles(saved(spark.createDataFrame(rows, "id long, tid array<long>, x array<float>").repartition(5), "weights"), 80)
    vectors, kept = decompose.leading(t, 80, 5, 4, 6)
    got = np.concatenate([np.frombuffer(x["m"], np.float32).reshape(-1, kept) for x in vectors.orderBy("piece").collect()])[:80]  # the last piece is filled up with zeros
    want = np.linalg.svd(a, full_matrices=False)[2][:5].T
    assert kept == 5 and np.abs(np.abs((got * want).sum(0)) - 1).max() < 1e-3


@pytest.mark.parametrize("n", [80, 700])
def test_vectors_are_those_of_the_held_vocabulary(spark, monkeypatch, n):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts(n), None, "", "zz"])], "id int, text string").repartition(4)
    held = embed.TfidfEmbedder(dimensions=10).fit(df)
    want = np.array([r["vector"] for r in held.encode(df).orderBy("id").collect()])
    monkeypatch.setattr(embed, "MOST_HELD", 0)
    spread = embed.TfidfEmbedder(dimensions=10).fit(df)
    assert spread.vocabulary is not None and not spread.weight and spread.size == held.size
    rows = spread.encode(df.withColumn("more", F.lit("x"))).orderBy("id").collect()
    got = np.array([r["vector"] for r in rows])
    assert [r["id"] for r in rows] == list(range(n + 3)) and {r["more"] for r in rows} == {"x"}
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-4


def test_many_blocks_and_groups(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts(400, 5))], "id int, text string").repartition(4)
    monkeypatch.setattr(embed, "MOST_HELD", 0)
    spread = embed.TfidfEmbedder(dimensions=8, sizes=SMALL).fit(df)
    assert spread.size > 2 * SMALL.terms
    got = np.array([r["vector"] for r in spread.encode(df).orderBy("id").collect()])
    monkeypatch.setattr(embed, "MOST_HELD", 1 << 30)
    want = np.array([r["vector"] for r in embed.TfidfEmbedder(dimensions=8).fit(df).encode(df).orderBy("id").collect()])
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-4
