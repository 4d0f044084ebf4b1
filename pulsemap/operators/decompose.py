"""Leading right singular vectors of a sparse table of weights (texts x terms) whose vocabulary fits no single machine.

Randomized subspace iteration on blocks (``Sizes``).  Terms are dealt into blocks, texts into blocks of
which several make a group; a tile holds the weights of one block of texts in one block of terms.
A pass multiplies the terms' vectors by the weights and their transpose:

* vectors and tiles meet by (block of terms, group of texts); each tile gives its texts' part of the product,
  parts are added up by block of texts;
* the products and the tiles meet by the same key; each group gives its part of the new term vectors, parts
  are added up by pieces of the block.

Between passes the vectors are made orthogonal by a tall-skinny QR: every task reduces its rows to one small
triangle, triangles are merged sixteen at a time, and only the last few (dimensions x dimensions) reach the
driver, whose inverse goes out with the next tasks.  Nothing else is collected or broadcast.

The start depends on term numbers alone, so results don't depend on how texts lie in partitions, and
``start`` gives the same numbers to whoever holds all vectors in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import forget, saved
from ..functions.workers import python_ready

#: Terms whose start comes from one seed.
SEEDED = 1 << 13
TILE = "tb int, grp int, db long, ids array<long>, at binary, row binary, x binary"


@dataclass(frozen=True)
class Sizes:
    """Terms a block, terms in one table row, texts a block, weights that one task multiplies, triangles merged at once."""

    terms: int = 1 << 17
    piece: int = 1 << 13
    texts: int = 1 << 10
    weights: int = 4_000_000
    merged: int = 16


def start(first: int, rows: int, dimensions: int) -> np.ndarray:
    """Rows first.. of the random start; SEEDED rows are drawn at once, with a seed of their own."""
    seeds = range(first // SEEDED, -(-(first + rows) // SEEDED))
    drawn = np.concatenate([np.random.default_rng([0, p]).standard_normal((SEEDED, dimensions), np.float32) for p in seeds] or [np.zeros((0, dimensions), np.float32)])
    return drawn[first % SEEDED :][:rows]


def _rows(data: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(-1, dimensions)


def summed_by(owner: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different owners, which must be sorted, and the sums of their rows."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[first], np.add.reduceat(rows, first)


@dataclass
class Tiles:
    """Weights cut up: table has a row a tile (COO within it, sorted by text)."""

    table: DataFrame
    term_blocks: int
    groups: int
    sizes: Sizes


def tiles(weights: DataFrame, terms: int, sizes: Sizes = Sizes()) -> Tiles:
    """weights: a written table (id, tid: array<long>, x: array<float>), tid below terms."""
    python_ready(weights.sparkSession)
    total = weights.agg(F.sum(F.size("tid").cast("long"))).first()[0] or 0
    block_terms, block_texts = sizes.terms, sizes.texts
    term_blocks = max(1, -(-terms // block_terms))
    groups = max(1, -(-total // (sizes.weights * term_blocks)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, block_texts):
                part = batch.slice(k, block_texts)
                ids, count = part.column(0), np.diff(part.column(1).offsets.to_numpy())
                tid, x = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy().astype(np.float32)
                row = np.repeat(np.arange(len(ids), dtype=np.int32), count)
                tb = (tid // block_terms).astype(np.int32)
                order = np.argsort(tb, kind="stable")
                edges = np.flatnonzero(np.diff(tb[order], prepend=-1, append=-1)) if len(tb) else np.zeros(0, int)
                out = []
                for a, b in zip(edges, edges[1:], strict=False):
                    o = order[a:b]
                    out.append((int(tb[o[0]]), block % 1_000_003 % groups, block, ids, (tid[o] % block_terms).astype(np.int32).tobytes(), row[o].tobytes(), x[o].tobytes()))
                block += 1
                if out:
                    columns = [pa.array([v[i] for v in out], t) for i, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int64()))]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(ids), pa.int32()), pa.concat_arrays([ids] * len(out)))
                    yield pa.RecordBatch.from_arrays([*columns, lists, *[pa.array([v[i] for v in out], pa.binary()) for i in (4, 5, 6)]], ["tb", "grp", "db", "ids", "at", "row", "x"])

    return Tiles(saved(weights.select("id", "tid", "x").mapInArrow(cut, TILE), "tiles"), term_blocks, groups, sizes)


def _replicated(df: DataFrame, key: str, n: int) -> DataFrame:
    """Each row once for each number below n: what has to meet every group, or every block of terms."""
    return df.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def added(parts: DataFrame, by: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Matrices ``m`` added up by key; the columns ``also`` are alike within a key."""
    names = [*by, *also]

    def add(key, table):
        total = np.frombuffer(table.column("m")[0].as_buffer(), np.float32).copy()
        for m in table.column("m")[1:]:
            total += np.frombuffer(m.as_buffer(), np.float32)
        return table.select(names).slice(0, 1).append_column("m", pa.array([total.tobytes()], pa.binary()))

    parts = parts.select(*names, "m")
    return parts.groupBy(*by).applyInArrow(add, parts.schema)


def _matrix(table: pa.Table, dimensions: int, sizes: Sizes) -> np.ndarray:
    """The pieces of one block of terms as one matrix."""
    out = np.zeros((sizes.terms, dimensions), np.float32)
    for piece, m in zip(table.column("piece").to_pylist(), table.column("m"), strict=True):
        got = _rows(m.as_buffer(), dimensions)
        at = piece * sizes.piece % sizes.terms
        out[at : at + len(got)] = got
    return out


def products(t: Tiles, vectors: DataFrame, dimensions: int) -> DataFrame:
    """(grp, db, ids, m): the texts' products with the term vectors, (tb, piece, m)."""
    sizes = t.sizes

    def run(left, right):
        out = {"grp": [], "db": [], "ids": [], "m": []}
        if left.num_rows:
            v = _matrix(right, dimensions, sizes)
            for tile in left.to_batches(max_chunksize=1):
                ids, (at, row), x = tile.column("ids")[0].as_py(), (np.frombuffer(tile.column(c)[0].as_buffer(), np.int32) for c in ("at", "row")), np.frombuffer(tile.column("x")[0].as_buffer(), np.float32)
                y = np.zeros((len(ids), dimensions), np.float32)
                owner, sums = summed_by(row, v[at] * x[:, None])
                y[owner] = sums
                for name, value in zip(out, (tile.column("grp")[0].as_py(), tile.column("db")[0].as_py(), ids, y.tobytes()), strict=True):
                    out[name].append(value)
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], list(out))

    pieces = _replicated(vectors, "grp", t.groups)
    parts = t.table.groupBy("tb", "grp").cogroup(pieces.groupBy("tb", "grp")).applyInArrow(run, "grp int, db long, ids array<long>, m binary")
    return added(parts, ["grp", "db"], ("ids",))


def transposed(t: Tiles, y: DataFrame, dimensions: int) -> DataFrame:
    """(tb, piece, m): the terms' products with the texts' matrices."""
    terms, piece = t.sizes.terms, t.sizes.piece

    def run(left, right):
        if not left.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["tb", "piece", "m"])
        held = {db: _rows(m.as_buffer(), dimensions) for db, m in zip(right.column("db").to_pylist(), right.column("m"), strict=True)}
        z, tb = np.zeros((terms, dimensions), np.float32), left.column("tb")[0].as_py()
        for tile in left.to_batches(max_chunksize=1):
            (at, row), x = (np.frombuffer(tile.column(c)[0].as_buffer(), np.int32) for c in ("at", "row")), np.frombuffer(tile.column("x")[0].as_buffer(), np.float32)
            order = np.argsort(at, kind="stable")
            owner, sums = summed_by(at[order], held[tile.column("db")[0].as_py()][row[order]] * x[order, None])
            z[owner] += sums
        used = [k for k in range(0, terms, piece) if z[k : k + piece].any()]
        return pa.table([pa.array([tb] * len(used), pa.int32()), pa.array([(tb * terms + k) // piece for k in used], pa.int32()), pa.array([z[k : k + piece].tobytes() for k in used], pa.binary())], ["tb", "piece", "m"])

    everywhere = _replicated(y.select("grp", "db", "m"), "tb", t.term_blocks)
    parts = t.table.groupBy("tb", "grp").cogroup(everywhere.groupBy("tb", "grp")).applyInArrow(run, "tb int, piece int, m binary")
    return added(parts, ["tb", "piece"])


def _triangle(stack: list[np.ndarray], dimensions: int) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(stack), mode="r") if stack else np.zeros((0, dimensions))
    return np.concatenate([r, np.zeros((dimensions - len(r), dimensions))])


def triangle(matrices: DataFrame, dimensions: int, merged: int = Sizes.merged) -> np.ndarray:
    """R of the QR of all rows of the matrices ``m``, by a tree of small triangles."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, any_ = np.zeros((0, dimensions)), False
        for batch in batches:
            for m in batch.column(0):
                r, any_ = _triangle([r, _rows(m.as_buffer(), dimensions).astype(float)], dimensions), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["k", "r"])

    def merge(key, table):
        r = _triangle([np.frombuffer(x.as_buffer()).reshape(dimensions, dimensions) for x in table.column("r")], dimensions)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["k", "r"])

    small = saved(matrices.select("m").mapInArrow(own, "k long, r binary"), "triangles")
    while small.count() > merged:
        fewer = saved(small.withColumn("k", F.floor(F.col("k") / merged)).groupBy("k").applyInArrow(merge, "k long, r binary"), "triangles")
        forget(small)
        small = fewer
    r = _triangle([np.frombuffer(row["r"]).reshape(dimensions, dimensions) for row in small.collect()], dimensions)
    forget(small)
    return r


def _times(vectors: DataFrame, right: np.ndarray) -> DataFrame:
    """Term vectors multiplied by a small matrix."""
    inner = len(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(_rows(m.as_buffer(), inner).astype(float) @ right).astype(np.float32).tobytes() for m in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.binary())], ["tb", "piece", "m"])

    return vectors.select("tb", "piece", "m").mapInArrow(run, "tb int, piece int, m binary")


def inverse(r: np.ndarray) -> np.ndarray:
    """What makes rows with triangle r orthogonal; directions without length stay without."""
    u, s, vt = np.linalg.svd(r)
    keep = s > 1e-12 * max(s.max(initial=0), 1e-300)
    return (vt.T[:, keep] / s[keep]) @ u.T[keep]


def leading(t: Tiles, terms: int, k: int, spare: int, passes: int, log: Callable[[str], None] | None = None) -> tuple[DataFrame, int]:
    """((tb, piece, m), dimensions): the terms' rows of the leading k right singular vectors, or of as many as there are."""
    spark, dimensions, sizes = t.table.sparkSession, min(k + spare, terms), t.sizes
    orthogonal = lambda z: _times(z, inverse(triangle(z, dimensions, sizes.merged)))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                m = start(p * sizes.piece, min(sizes.piece, terms - p * sizes.piece), dimensions).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p * sizes.piece // sizes.terms], pa.int32()), pa.array([p], pa.int32()), pa.array([m], pa.binary())], ["tb", "piece", "m"])

    pieces = -(-terms // sizes.piece)
    z = saved(spark.range(0, pieces, 1, min(pieces, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(drawn, "tb int, piece int, m binary"), "vectors")
    w = orthogonal(z)
    for i in range(passes):
        y = saved(products(t, w, dimensions), "products")
        new = saved(transposed(t, y, dimensions), "vectors")
        forget(z, y)
        z, w = new, orthogonal(new)
        if log:
            log(f"pass {i + 1} of {passes}")
    _, s, turn = np.linalg.svd(triangle(products(t, w, dimensions), dimensions, sizes.merged))
    kept = min(k, int((s**2 > 1e-6 * (s**2).max(initial=0)).sum()))
    out = saved(_times(w, turn[:kept].T), "projection")
    forget(z)
    return out, kept
