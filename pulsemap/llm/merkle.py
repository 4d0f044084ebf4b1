"""Merkle manifest of a dataset: one tree a group of rows (a language), one tree over their roots.

A leaf is the lowercase hex SHA-256 of a row's columns, each as `-` if null, else its UTF-8 byte count, a
colon and the value.  In a group leaves ascend by key, then by leaf; while several nodes remain, every 8
consecutive ones (the last run may be shorter, one node even) become the digest of their hex digests.  The
group roots, ordered by group (null first, UTF-8 bytewise), give the root the same way.

Leaves are cut into aligned blocks of 512, one row a block whose digests lie in one contiguous matrix of 64
bytes a node.  A block is climbed three levels: the matrix is reshaped by the fanout and each row hashed;
siblings of every node are found by index arithmetic.  The roots of blocks are cut into blocks again until
one node a group is left: each round's table has a 512th of the rows of the one before, and is written to the
shared folder.  Proofs come down the same way: a block learns the path above it once, by a join of blocks.

Contract: null keys come first, rows of equal key are ordered by leaf, repeated rows are leaves each; null
texts are `-`, empty ones `0:`; texts of any length are hashed whole in the scan and not moved; a group of
any size is many blocks; an empty table has no rows and no root; other columns are dropped, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import numbered, prefixed, tasks_for
from .common import python_ready, saved

FANOUT, HEIGHT, HEX = 8, 3, 64
BLOCK = FANOUT**HEIGHT
PATH = T.ArrayType(T.StructType().add("slot", "integer").add("siblings", "binary"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(prefixed, columns)), 256)


# ---- matrices of digests -------------------------------------------------------------------------


def hashed(rows: Sequence[bytes | memoryview]) -> np.ndarray:
    """The hex digests of the rows, 64 bytes each."""
    return np.frombuffer("".join([sha256(r).hexdigest() for r in rows]).encode(), np.uint8).reshape(-1, HEX)


def height_of(n: int) -> int:
    """Levels above n nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // FANOUT), up + 1
    return up


def climb(nodes: np.ndarray, block: int) -> list[np.ndarray]:
    """The levels of a block from its nodes to its root. Only a group's sole block stops below the full height."""
    levels = [nodes]
    for _ in range(HEIGHT if block else height_of(len(nodes))):
        flat, step = memoryview(np.ascontiguousarray(levels[-1])).cast("B"), FANOUT * HEX
        levels.append(hashed([flat[i : i + step] for i in range(0, len(flat), step)]))
    return levels


def siblings(level: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the nodes at places ``at``: slots in their runs, the others of each run as a matrix, and how many they are."""
    slot = at % FANOUT
    others = (at - slot)[:, None] + np.arange(FANOUT - 1) + (np.arange(FANOUT - 1) >= slot[:, None])
    count = (others < len(level)).sum(axis=1)
    return slot, level[np.minimum(others, len(level) - 1)], count


def folded(own: np.ndarray, slot: np.ndarray, others: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The parents of the digests ``own`` beside their siblings."""
    n, one = len(own), np.arange(FANOUT - 1)
    run = np.empty((n, FANOUT, HEX), np.uint8)
    run[np.arange(n)[:, None], one + (one >= slot[:, None])] = others
    run[np.arange(n), slot] = own
    flat = memoryview(run.reshape(-1)).cast("B")
    step = FANOUT * HEX
    return hashed([flat[i * step : i * step + (c + 1) * HEX] for i, c in enumerate(count.tolist())])


def folded_above(own: np.ndarray, path: list[dict]) -> np.ndarray:
    """Digests carried up one path that all share; equal ones are hashed once."""
    digests, place = np.unique(np.ascontiguousarray(own).view(f"S{HEX}").ravel(), return_inverse=True)
    for step in path:
        cut, others = step["slot"] * HEX, step["siblings"]
        digests = [sha256(others[:cut] + d + others[cut:]).hexdigest().encode() for d in list(digests)]
    return np.array(digests, f"S{HEX}")[place].view(np.uint8).reshape(-1, HEX)


# ---- Arrow stages ------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of hex digests as a matrix over the column's own bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    first = np.frombuffer(column.buffers()[1], kind)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + HEX * len(column)].reshape(-1, HEX)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``_run``, one table a run."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        rows = rows.combine_chunks()
        run = rows.column("_run")
        cuts = [0, *(np.flatnonzero(pc.not_equal(run[1:], run[:-1]).to_numpy()) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield rows.slice(a, b - a)
        left = rows.slice(cuts[-1])
    if left is not None:
        yield left


def _build(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a block: its nodes' digests side by side, what came with them as lists, and its root."""
    for rows in _blocks(batches):
        nodes, block = _matrix(rows.column("node")), rows.column("block")[0].as_py()
        offsets = pa.array([0, len(nodes)], pa.int32())
        lists = {n: pa.ListArray.from_arrays(offsets, rows.column(n).combine_chunks()).cast(schema.field(n).type) for n in ("key", "given") if n in rows.column_names}
        one = {"tree": rows.column("tree").slice(0, 1).combine_chunks(), "block": pa.array([block]), "nodes": pa.array([nodes.tobytes()], pa.binary()), "root": pa.array([climb(nodes, block)[-1].tobytes().decode()])}
        yield pa.RecordBatch.from_arrays([(one | lists)[f.name] for f in schema], schema=schema)


def _path(levels: list[np.ndarray], at: int) -> list[dict]:
    out = []
    for level in levels[:-1]:
        slot, others, count = siblings(level, np.array([at]))
        out.append({"slot": int(slot[0]), "siblings": others[0, : count[0]].tobytes()})
        at //= FANOUT
    return out


def _descend(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a node of a block: its path to the root."""
    for batch in batches:
        for row in batch.to_pylist():
            nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, HEX)
            levels, above = climb(nodes, row["block"]), row["above"] or []
            out = [{"tree": row["tree"], "at": row["block"] * BLOCK + i, "above": [*_path(levels, i), *above], "subroot": row["subroot"] or nodes[i].tobytes().decode(), "top": row["top"]} for i in range(len(nodes))]
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _prove(batches: Iterator[pa.RecordBatch], schema: pa.Schema, whole: bool) -> Iterator[pa.RecordBatch]:
    """One row a leaf: its proof, and the root that the digest given for it folds to."""
    text = lambda m: pa.StringArray.from_buffers(len(m), pa.py_buffer(np.arange(0, HEX * len(m) + 1, HEX, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(m)))
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            value = lambda name, row=row: row.column(name)[0].as_py()
            nodes, above = np.frombuffer(value("nodes"), np.uint8).reshape(-1, HEX), value("above") or []
            n, at = len(nodes), np.arange(len(nodes))
            own, parts = _matrix(row.column("given").flatten()), []
            for level in climb(nodes, value("block"))[:-1]:
                slot, others, count = siblings(level, at)
                own = folded(own, slot, others, count)
                flat, step = memoryview(np.ascontiguousarray(others).reshape(-1)).cast("B"), (FANOUT - 1) * HEX
                parts.append([flat[j * step : j * step + c * HEX] for j, c in enumerate(count.tolist())])
                at = at // FANOUT
            over = b"".join(step["siblings"] for step in above)
            proofs = [b"".join(p) + over for p in zip(*parts, strict=True)] if parts else [over] * n
            reached, top = text(folded_above(own, above)), value("top")
            alike = lambda v, n=n: pa.array([v] * n, pa.string())
            out = {"key": row.column("key").flatten(), "leaf": text(nodes), "tree": alike(value("tree")), "subroot": alike(value("subroot")), "root": alike(top), "proof_sha256": text(hashed(proofs)), "folded_root": reached, "verified": pc.equal(reached, top)}
            if whole:
                out["proof"] = pa.array([p.decode() for p in proofs], pa.string())
            yield pa.RecordBatch.from_arrays([out[f.name] for f in schema], schema=schema)


# ---- the manifest ------------------------------------------------------------------------------


def _stage(df: DataFrame, work, schema: T.StructType, **more) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    return df.mapInArrow(partial(work, schema=to_arrow_schema(schema), **more), schema)


def _cut(nodes: DataFrame) -> DataFrame:
    """Written blocks of (tree, at, node[, key, given])."""
    block = F.floor(F.col("at") / BLOCK)
    rows = nodes.withColumn("block", block).withColumn("_run", F.concat(prefixed(F.col("tree")), F.lit(":"), block.cast("string")))
    tasks = tasks_for(nodes)
    sorted_rows = rows.repartition(tasks, "_run").sortWithinPartitions("_run", "at")
    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in nodes.schema if f.name in ("key", "given")]
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("nodes", T.BinaryType()), *lists, T.StructField("root", T.StringType())])
    return saved(_stage(sorted_rows, _build, schema), "blocks")


def _rounds(blocks: DataFrame) -> list[DataFrame]:
    """Blocks, the blocks of their roots, and so on, until each tree is one block."""
    out = [blocks]
    while out[-1].agg(F.max("block")).first()[0]:
        out.append(_cut(saved(out[-1].select("tree", F.col("block").alias("at"), F.col("root").alias("node")), "roots")))
    return out


DESCENT = T.StructType().add("tree", "string").add("at", "long").add("above", PATH).add("subroot", "string").add("top", "string")


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path above each, and the roots at its ends. A block of a smaller tree may have passed rounds by unchanged."""
    p = paths.select(F.col("tree").alias("_t"), F.col("at").alias("_b"), "above", "subroot", "top")
    return blocks.join(p, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).drop("_t", "_b")


@dataclass
class Manifest:
    """blocks: the leaves' blocks, then those of each round; tops: the rounds over the group roots; root: None for an empty table."""

    blocks: list[DataFrame]
    tops: list[DataFrame]
    names: DataFrame
    root: str | None

    def paths(self) -> DataFrame:
        """(tree, at, above, subroot, top) of the leaves' blocks."""
        top = F.lit(self.root).cast("string")
        none = lambda b: b.withColumns({"above": F.lit(None).cast(PATH), "subroot": F.lit(None).cast("string"), "top": top})
        over = none(self.tops[-1])
        for below in reversed(self.tops[:-1]):
            over = _with_paths(below, _stage(over, _descend, DESCENT)).withColumn("subroot", F.lit(None).cast("string"))
        down = _stage(over, _descend, DESCENT)
        down = self.names.join(down.drop("tree"), "at").select("tree", F.lit(0).cast("long").alias("at"), "above", "subroot", "top")
        for below in reversed(self.blocks[1:]):
            down = _stage(_with_paths(below, down), _descend, DESCENT)
        return down

    def proofs(self, whole: bool = False) -> DataFrame:
        """(key, leaf, tree, subroot, root, proof_sha256, folded_root, verified) of each leaf, and with ``whole`` the proof: its siblings' digests in one text."""
        key = T.StructField("key", self.blocks[0].schema["key"].dataType.elementType)
        names = ["leaf", "tree", "subroot", "root", "proof_sha256", "folded_root"]
        schema = T.StructType([key, *[T.StructField(n, T.StringType()) for n in names], T.StructField("verified", T.BooleanType()), *[T.StructField("proof", T.StringType())] * whole])
        return _stage(_with_paths(self.blocks[0], saved(self.paths(), "paths")), _prove, schema, whole=whole)


def manifest(docs: DataFrame, columns: Sequence[str], key: str = "doc_id", tree: str = "lang", given: Sequence[Column] | None = None) -> Manifest:
    """The manifest of docs. ``given``: the columns as somebody hands them in now; their leaves are what proofs() carries up."""
    python_ready(docs.sparkSession)
    own = leaf([F.col(c) for c in columns])
    rows = docs.select(F.col(key).alias("key"), F.col(tree).alias("tree"), own.alias("node"), (leaf(given) if given else own).alias("given"))
    ordered = lambda df, *by: numbered(df, [F.col("tree")], [F.col(c).asc_nulls_first() for c in by], "at")
    blocks = _rounds(_cut(ordered(saved(rows, "leaves"), "key", "node")))
    roots = saved(blocks[-1].select(F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("root").alias("node")), "group-roots")
    ranked = saved(ordered(roots, "name"), "group-places")
    tops = _rounds(_cut(ranked.drop("name")))
    last = tops[-1].select("root").first()
    return Manifest(blocks, tops, ranked.select(F.col("name").alias("tree"), "at"), last and last[0])
