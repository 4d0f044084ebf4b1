"""Exact top-k by inner product, by columnar branch and bound.

Queries are dealt into blocks of bounded size, each of which is broadcast and meets every candidate where
that lies, so candidates are never copied or shuffled; what leaves a task is at most k rows a query.
Inside a task the candidates of a batch lie dimension by dimension, the dimensions with the most mass
first.  Scores are summed one block of dimensions at a time; what a candidate can still gain is at most
the product of the remaining norms, so after each block the candidates that can't reach the query's floor
are dropped and the rest compacted.  The floor is a k-th best score already seen: at first among a few
candidates with the largest norms, known to all tasks, then among all the task has met.  A whole batch
whose norms can't reach a query's floor is not scored for it.  Equal scores are never dropped.

Contract: vectors that are null or hold null or non-finite components, and rows with a null id, take no
part; rows with equal ids are rows of their own, but never each other's candidates, and their results are
ranked together; vectors of unequal length are never compared; ties go to the smaller id; a query with
fewer than k candidates gets all; an empty table gives no rows; extra columns are dropped, whatever their
names; a vector's length is not limited, but one block holds at least one query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import python_ready, saved

K, SCALE, DIMS = 5, 256, 8
#: Components of the queries of one block, on the driver and in the broadcast; blocks whose results are put in one table.
BLOCK_COMPONENTS, BLOCKS_AT_ONCE = 1 << 21, 16
#: Queries and candidates scored at once; candidates that give the first floors.
TILE, BATCH, PROBE = 256, 8192, 1024
#: Components gathered at once for the probe of a batch.
GATHER = 1 << 22
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component."""
    e = F.col(embedding)
    good = e.isNotNull() & F.col(vec_id).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    return df.filter(good).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def whole_numbers(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """block_topk() for components of any size, without pruning; scores beyond 64 bits become the nearest that fits."""
    out: list[tuple[int, int, int]] = []
    for at, (i, row) in enumerate(zip(qid.tolist(), q.astype(object), strict=True)):
        scores = c.astype(object) @ row if c.shape[1] else np.zeros(len(c), object)
        best = sorted((-s, j) for s, j in zip(scores.tolist(), cid.tolist(), strict=True) if j != i)[:k]
        out += [(at, j, min(max(-s, -(2**63)), 2**63 - 1)) for s, j in best]
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def block_topk(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int = K, dims: int = DIMS, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, candidate ids, scores): the k best candidates of each query, its own id left out. floor: for each query a score below which none is wanted."""
    d = q.shape[1]
    largest = (float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))) * max(1, d)
    if largest >= 2**52:  # doubles would round
        return whole_numbers(qid, q, cid, c, k)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    order = np.argsort(-(c.astype(float) ** 2).sum(axis=0), kind="stable")
    q, down = q[:, order].astype(float), np.ascontiguousarray(c[:, order].T.astype(float))  # vertical: one row a dimension
    edges = [*range(0, d, dims), d] if d else [0]
    tail = lambda x, axis: np.stack([np.sqrt((np.take(x, range(e, d), axis=axis) ** 2).sum(axis=axis)) for e in edges])
    rest_q, rest_c = tail(q, 1), tail(down, 0)
    slack = 1e-6 * (1 + rest_q[0])
    hopeful = np.flatnonzero(rest_q[0] * rest_c[0].max(initial=0) + slack >= floor)
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(hopeful), TILE):
        some = hopeful[a : a + TILE]
        for column, got in zip(out, _tile(some, qid[some], q[some], cid, down, k, edges, rest_q[:, some], rest_c, slack[some], floor[some]), strict=True):
            column += got
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _tile(rows, qid, q, cid, down, k, edges, rest_q, rest_c, slack, floor) -> tuple[list, list, list]:
    d, first = len(down), edges[1] if len(down) else 0
    partial = q[:, :first] @ down[:first]
    own = qid[:, None] == cid[None, :]
    size = max(k, 16)  # fewer than k would give no bound of the k-th best
    if len(cid) > size + 1 and d and not np.isfinite(floor).all():
        probe = np.argpartition(np.where(own, np.inf, -partial), size, axis=1)[:, :size]
        step = max(1, GATHER // (d * size))
        exact = np.concatenate([np.einsum("qd,dqp->qp", q[a : a + step], down[:, probe[a : a + step]]) for a in range(0, len(q), step)])
        exact[np.take_along_axis(own, probe, 1)] = -np.inf
        floor = np.maximum(floor, np.sort(exact, axis=1)[:, -k])
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        alive = np.flatnonzero((partial[i] + rest_q[min(1, len(edges) - 1), i] * rest_c[min(1, len(edges) - 1)] + slack[i] >= floor[i]) & ~own[i])
        s = partial[i, alive]
        for b in range(1, len(edges) - 1):
            if not len(alive):
                break
            lo, hi = edges[b], edges[b + 1]
            s = s + q[i, lo:hi] @ down[lo:hi, alive]
            keep = s + rest_q[b + 1, i] * rest_c[b + 1, alive] + slack[i] >= floor[i]
            if not keep.all():
                alive, s = alive[keep], s[keep]
        if len(alive) > k:  # all that reach the k-th best score, ties too
            reach = s >= np.partition(s, len(s) - k)[len(s) - k]
            alive, s = alive[reach], s[reach]
        best = np.lexsort((cid[alive], -s))[:k]
        out_q.append(np.full(len(best), rows[i]))
        out_c.append(cid[alive[best]])
        out_s.append(np.rint(s[best]).astype(np.int64))
    return out_q, out_c, out_s


class Best:
    """The k best candidates so far of each query of one length; repeated query ids are queries of their own."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.qid, self.q, self.k, self.floor = qid, q, k, floor.copy()
        self.row, self.cid, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, cid: np.ndarray, c: np.ndarray) -> None:
        row, ids, score = (np.concatenate(x) for x in zip((self.row, self.cid, self.score), block_topk(self.qid, self.q, cid, c, self.k, floor=self.floor), strict=True))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        begin = np.searchsorted(row, row)
        keep = np.arange(len(row)) - begin < self.k
        self.row, self.cid, self.score = row[keep], ids[keep], score[keep]
        full = np.flatnonzero((np.arange(len(row)) - begin)[keep] == self.k - 1)
        self.floor[self.row[full]] = np.maximum(self.floor[self.row[full]], self.score[full])


def by_length(rows: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of (vec_id, v) rows, by length."""
    ids, v = rows.column("vec_id"), rows.column("v")
    ids, v = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, v))
    size, ids, out = v.value_lengths().to_numpy(), ids.to_numpy(zero_copy_only=False), {}
    for d in np.unique(size):
        use = size == d
        out[int(d)] = ids[use], v.filter(pa.array(use)).flatten().to_numpy().reshape(int(use.sum()), int(d))
    return out


def first_floors(queries: dict, probe: dict, k: int) -> dict[int, np.ndarray]:
    """For each query the k-th best score among the probe's candidates; no bound where there are fewer."""
    out = {}
    for d, (qid, q) in queries.items():
        best = Best(qid, q, np.full(len(qid), -np.inf), k)
        if d in probe:
            best.meet(*probe[d])
        out[d] = best.floor
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block_components: int = BLOCK_COMPONENTS) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, v): the k highest inner products of each query with other rows."""
    spark = vectors.sparkSession
    python_ready(spark)
    vectors = saved(vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks")), "topk-vectors")
    components = vectors.filter("asks").agg(F.sum(F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0
    blocks = -(-components // block_components)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    probe = by_length(vectors.select("vec_id", "v").orderBy(norm.desc(), "vec_id").limit(PROBE).toArrow()) if blocks else {}
    found: list[DataFrame] = []
    for b in range(blocks):
        mine = by_length(vectors.filter(F.col("asks") & (F.pmod(F.xxhash64("vec_id", F.size("v")), F.lit(blocks)) == b)).select("vec_id", "v").toArrow())
        found.append(_against(vectors, mine, first_floors(mine, probe, k), k))
        if len(found) > BLOCKS_AT_ONCE:
            found = [saved(reduce(DataFrame.union, found), "topk-found")]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _against(vectors: DataFrame, queries: dict, floors: dict, k: int) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast((queries, floors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = held.value
        best = {d: Best(qid, q, least[d], k) for d, (qid, q) in asked.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                for d, (cid, c) in by_length(batch.slice(at, BATCH)).items():
                    if d in best:
                        best[d].meet(cid, c)
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (b.qid[b.row], b.cid, b.score)], schema=_OUT)

    return vectors.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score long")
