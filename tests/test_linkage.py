"""Rounds of mutually nearest clusters against the chain, and blocked searches against whole products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemap.functions.shared import saved
from pulsemap.operators import linkage, themes


def vectors(n, seed=0, groups=9, d=12, spread=0.35):
    r = np.random.default_rng(seed)
    v = r.standard_normal((groups, d))[r.integers(0, groups, n)] + spread * r.standard_normal((n, d))
    v[n // 2 : n // 2 + n // 10] = v[0]  # a tenth is one vector
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v):
    return saved(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(6), "v")


@pytest.mark.parametrize(("cell", "lot"), [(16_384, 2_048), (40, 16)])
def test_closest_in_cells(spark, monkeypatch, cell, lot):
    monkeypatch.setattr(linkage, "CELL", cell)
    monkeypatch.setattr(linkage, "LOT", lot)
    v = vectors(300)
    df = frame(spark, v)
    s = np.round(v @ v.T, linkage.PLACES)
    np.fill_diagonal(s, -np.inf)
    got = {r["id"]: (r["other"], r["similarity"]) for r in linkage.closest(df, df).collect()}
    assert got == {k: (int(s[k].argmax()), s[k].max()) for k in range(300)}
    few = saved(df.filter("id < 20"), "few")
    s = np.round(v @ v[:20].T, linkage.PLACES)
    got = {r["id"]: r["other"] for r in linkage.closest(df, few, apart=False).collect()}
    assert got == {k: int(s[k].argmax()) for k in range(300)}
    one = saved(df.limit(1), "one")
    assert linkage.closest(one, one).count() == 0


@pytest.mark.parametrize("direct", [1, 40])
def test_rounds_give_the_clusters_of_the_chain(spark, direct):
    v = vectors(260, 4)
    want = themes.average_linkage(v, np.ones(len(v)), 0.3)
    values, first, n = np.unique(v, axis=0, return_index=True, return_counts=True)
    groups = saved(spark.createDataFrame([(int(k), x.tolist(), int(c)) for k, x, c in zip(first, values, n, strict=True)], "id long, v array<double>, n long").repartition(5), "groups")
    roots, rounds = linkage.linked(groups, 0.3, direct, themes.average_linkage)
    root = {r["gone"]: r["root"] for r in roots.collect()}
    place = {tuple(x): int(k) for k, x in zip(first, values, strict=True)}
    got = [root.get(place[tuple(x)], place[tuple(x)]) for x in v]
    assert len(set(want)) > 5 and 1 < rounds < 40
    assert len({(a, b) for a, b in zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_a_table_beyond_the_direct_size_has_the_same_clusters(spark, monkeypatch):
    v = vectors(240, 7)
    df = spark.createDataFrame([(f"k{k:03}", (3 * x).tolist()) for k, x in enumerate(v)], "id string, vector array<double>").repartition(4)
    want = {r["id"]: r["cluster"] for r in themes.cluster_vectors(df, 0.3, 12, 0.8).collect()}
    monkeypatch.setattr(themes, "DIRECT", 30)
    got = {r["id"]: r["cluster"] for r in themes.cluster_vectors(df, 0.3, 12, 0.8).collect()}
    assert got == want and -1 in set(want.values()) and len(set(want.values())) > 4


def test_no_cluster_is_large_enough(spark, monkeypatch):
    monkeypatch.setattr(themes, "DIRECT", 2)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(np.eye(5))], "id int, vector array<double>")
    assert {r["cluster"] for r in themes.cluster_vectors(df, 0.3, 2).collect()} == {-1}


def test_nearest_with_nulls_ties_and_many_centers(spark, monkeypatch):
    centers = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "label string, centroid array<double>")
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y"), (3, [-1.0, -1.0], "z"), (4, None, None)], "id int, vector array<double>, more string")
    want = [(1, "x", "a", 1.0), (2, "y", "c", 1.0), (3, "z", None, -1.0), (4, None, None, None)]
    for most in (3000, 2):
        monkeypatch.setattr(themes, "MICRO", most)
        assert [tuple(r) for r in themes.nearest(df, centers, 0.5).select("id", "more", "label", "similarity").orderBy("id").collect()] == want
    assert [r["label"] for r in themes.nearest(df, centers.limit(0), 0.5).collect()] == [None] * 4
