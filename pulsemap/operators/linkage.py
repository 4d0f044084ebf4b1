"""Average linkage under cosine distance for any number of unit vectors, by rounds of mutually nearest clusters.

The distance of two clusters is 1 minus the inner product of their mean vectors, so a cluster is its mean and
its size.  Average linkage is reducible: a merged cluster is no nearer to any other than the nearer of its
parts was.  Hence all pairs that are each other's nearest can merge at once, in any order, and give the
dendrogram of one merge at a time; a cluster's nearest stays the nearest unless it was merged; and a cluster
with none nearer than the threshold is finished and leaves the search.

Each round is a few joins of narrow tables and, for clusters whose nearest is unknown, a search in blocks:
queries and candidates are dealt into a grid of cells, each one matrix product, and the best of each row of
cells is kept.  Equal vectors are one cluster from the start.  When at most ``direct`` clusters are left, the
chain on the driver finishes the same dendrogram.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import forget, saved
from ..functions.text import bound
from ..functions.workers import python_ready

#: Rows of a cell's sides, and of a product in it.
CELL, LOT = 16_384, 2_048
#: Similarities are compared to so many places, so that both sides of a pair see the same.
PLACES = 12
FOUND = "id long, other long, similarity double"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _side(df: DataFrame, names: tuple[str, str], own: str, cells: int, other: str, others: int) -> DataFrame:
    """Each row in its cell of one side, once for each cell of the other. The sides' columns have names of their own, as both may come from one table."""
    return df.select(F.col("id").alias(names[0]), F.col("v").alias(names[1]), F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def closest(queries: DataFrame, candidates: DataFrame, apart: bool = True) -> DataFrame:
    """(id, other, similarity): the candidate of largest inner product for each query, of equals the smallest id; with ``apart`` never itself. Both are written tables (id, v)."""
    python_ready(queries.sparkSession)
    least = max(1, int(np.ceil(np.sqrt(2 * queries.sparkSession.sparkContext.defaultParallelism))))
    cells = [max(min(least, -(-n // 64)), -(-n // CELL)) for n in (queries.count(), candidates.count())]

    def best(left, right):
        out = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["id", "other", "similarity"])
        if not left.num_rows or not right.num_rows:
            return out
        right = right.sort_by("cid")
        q, c, qid, cid = matrix(left.column("qv")), matrix(right.column("cv")), left.column("qid").to_numpy(), right.column("cid").to_numpy()
        top, at = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
        for a in range(0, len(q), LOT):
            for b in range(0, len(c), LOT):
                s = np.round(q[a : a + LOT] @ c[b : b + LOT].T, PLACES)
                if apart:
                    place = np.minimum(np.searchsorted(cid[b : b + LOT], qid[a : a + LOT]), s.shape[1] - 1)
                    own = np.flatnonzero(cid[b : b + LOT][place] == qid[a : a + LOT])
                    s[own, place[own]] = -np.inf
                k = s.argmax(axis=1)
                x = s[np.arange(len(s)), k]
                better = np.flatnonzero(x > top[a : a + LOT])
                top[a + better], at[a + better] = x[better], cid[b + k[better]]
        seen = np.isfinite(top)
        return pa.table([pa.array(qid[seen]), pa.array(at[seen]), pa.array(top[seen])], ["id", "other", "similarity"])

    left, right = _side(queries, ("qid", "qv"), "q", cells[0], "c", cells[1]), _side(candidates, ("cid", "cv"), "c", cells[1], "q", cells[0])
    pairs = left.groupBy("q", "c").cogroup(right.groupBy("q", "c"))
    found = pairs.applyInArrow(best, FOUND)
    top = found.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("b"))
    return top.select("id", F.col("b.other").alias("other"), (-F.col("b.s")).alias("similarity"))


def _with_nearest(clusters: DataFrame, threshold: float) -> DataFrame:
    """(id, v, n, nn, near): the search for those whose nn is null; clusters without any nearer than the threshold are left out."""
    todo = saved(clusters.filter("nn is null").select("id", "v"), "todo")
    found = closest(todo, clusters).select("id", F.col("other").alias("_o"), F.col("similarity").alias("_s"))
    rows = clusters.join(found, "id", "left").select("id", "v", "n", F.coalesce("nn", "_o").alias("nn"), F.coalesce("near", "_s").alias("near"))
    out = saved(rows.filter(1 - F.col("near") < threshold), "clusters")
    forget(todo)
    return out


def _pairs(clusters: DataFrame) -> DataFrame:
    """(kept, gone) of mutually nearest clusters; the nearest pair of all if rounding hides every one."""
    narrow = clusters.select("id", "nn", "near")
    other = narrow.select(F.col("id").alias("_id"), F.col("nn").alias("_nn"))
    out = saved(narrow.join(other, (F.col("nn") == F.col("_id")) & (F.col("id") == F.col("_nn")) & (F.col("id") < F.col("_id"))).select(F.col("id").alias("kept"), F.col("_id").alias("gone")), "pairs")
    if not out.isEmpty():
        return out
    forget(out)
    first = narrow.select((-F.col("near")).alias("d"), F.least("id", "nn").alias("kept"), F.greatest("id", "nn").alias("gone")).orderBy("d", "kept", "gone").limit(1)
    return saved(first.select("kept", "gone"), "pairs")


def _merged(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """The clusters after the merges; what was merged, and whose nearest was, has to look anew."""
    to = pairs.select(F.col("kept").alias("_id"), F.col("kept").alias("_to")).unionByName(pairs.select(F.col("gone").alias("_id"), F.col("kept").alias("_to")))
    rows = clusters.join(to, F.col("id") == F.col("_id"), "left").drop("_id").join(to.select(F.col("_id").alias("_near"), F.lit(True).alias("_hit")), F.col("nn") == F.col("_near"), "left").drop("_near")
    stay = rows.filter("_to is null").select("id", "v", "n", F.when(F.col("_hit").isNull(), F.col("nn")).alias("nn"), F.when(F.col("_hit").isNull(), F.col("near")).alias("near"))
    two = rows.filter("_to is not null").groupBy("_to").agg(F.collect_list(F.struct("id", "v", "n")).alias("p"), F.sum("n").alias("n"))

    def mean(p):
        a, b = (F.get(p, F.lit(k)) for k in (0, 1))
        return F.zip_with(a["v"], b["v"], lambda x, y: (x * a["n"] + y * b["n"]) / (a["n"] + b["n"]))

    new = two.select(F.col("_to").alias("id"), bound(F.array_sort("p"), mean).alias("v"), "n", F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("near"))
    return saved(stay.unionByName(new), "merged")


def _roots(links: DataFrame) -> DataFrame:
    """(gone, root) from (kept, gone): each step doubles how far a row looks."""
    links = saved(links, "links")
    while True:
        up = links.select(F.col("gone").alias("_g"), F.col("kept").alias("_k"))
        far = saved(links.join(up, F.col("kept") == F.col("_g"), "left").select(F.coalesce("_k", "kept").alias("kept"), "gone", F.col("_k").isNotNull().alias("moved")), "links")
        forget(links)
        if far.filter("moved").isEmpty():
            return far.select("gone", F.col("kept").alias("root"))
        links = saved(far.select("kept", "gone"), "links")
        forget(far)


def linked(groups: DataFrame, threshold: float, direct: int, chain) -> tuple[DataFrame, int]:
    """((gone, root), rounds) for a written table (id, v, n) of mean vectors and sizes. ``chain(sums, sizes, threshold)`` labels what is left."""
    spark = groups.sparkSession
    clusters, links, rounds = groups.select("id", "v", F.col("n").cast("long").alias("n"), F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("near")), [], 0
    while clusters.count() > direct:
        near = _with_nearest(saved(clusters, "clusters") if not rounds else clusters, threshold)
        if near.isEmpty():
            clusters = near
            break
        pairs = _pairs(near)
        links.append(pairs)
        last, clusters, rounds = clusters, _merged(near, pairs), rounds + 1
        forget(near, *([last] if hasattr(last, "_saved_at") else []))
    left = clusters.select("id", "v", "n").orderBy("id").toArrow()  # at most ``direct`` rows
    if left.num_rows > 1:
        ids, v, n = left["id"].to_numpy(), matrix(left["v"]), left["n"].to_numpy().astype(float)
        labels = chain(v * n[:, None], n, threshold)
        first = {int(x): int(ids[np.flatnonzero(labels == x)[0]]) for x in np.unique(labels)}
        links.append(spark.createDataFrame([(first[int(x)], int(i)) for x, i in zip(labels, ids, strict=True) if first[int(x)] != i], "kept long, gone long"))
    if not links:
        return spark.createDataFrame([], "gone long, root long"), rounds
    return _roots(reduce(DataFrame.unionByName, links)), rounds
