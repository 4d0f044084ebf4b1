"""SimHash near-duplicates: fingerprints of three-word shingles, linked by a binary trie self-join.

Fingerprints that differ in at most three of 64 bits agree in at least one of four blocks of 16, so each
distinct fingerprint goes to four groups, one for each block and its value.  A group's fingerprints,
sorted, are a binary trie: a node is a range, its children its two halves at the next bit.  The self-join
walks pairs of nodes down together, level by level for all groups of a task at once, adds up the bits in
which they differ, and drops a pair that exceeds the budget.  Pairs are not emitted: each task joins what
it links and sends one row for each fingerprint that is not the smallest of its set, which keeps every
connection and no quadratic output.  Components are then found by repeated minimum and pointer jumping.

A group of more than ``block_rows`` fingerprints is cut into parts by a few of its bits, those nearest to
one half ones.  Only parts whose bits differ within the budget are paired, and only parts that exist, so a
fingerprint is copied a few dozen times however large the group is.  A part that stays too large, since
its members hardly differ, is cut further by a hash.  Every pair of parts is a unit that any task can take.

Contract: a null or empty text, or one of white space only, has fingerprint zero and is linked like any
other; with fewer than three words the whole sequence is the one shingle; very long texts are read whole,
their shingles' bits summed in lots; equal texts share a component; rows with equal ids count as one
document's, repeated rows come back each; a tie, a bit set in just half the shingles, is zero; an empty
table gives no rows; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import forget, python_ready, saved, texts
from .idtable import batches_of

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: Largest part of a group, in fingerprints; larger groups are cut, by at most CUT_BITS bits before the hash.
BLOCK_ROWS, CUT_BITS = 2048, 20
#: Node pairs walked at once, and shingles summed at once.
WALK, SUM = 1 << 18, 1 << 16
#: Bytes of texts that are Python strings at once.
PART_BYTES = 1 << 20


def fingerprint(text: str) -> int:
    """64 bits, each set if set in over half the shingles' XXH64."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: only A-Z, and only the six ASCII white spaces
    if not words:
        return 0
    hash_of, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= SHINGLE:
        return hash_of(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    heads, tails = start[: 1 - SHINGLE].tolist(), (start + size)[SHINGLE - 1 :].tolist()
    hashes = np.array([hash_of(line[a:b], SEED) for a, b in zip(heads, tails, strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), SUM):
        ones += np.unpackbits(hashes[k : k + SUM].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in batches_of(b, 1, PART_BYTES)):
            fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return texts(docs, text, doc_id).mapInArrow(run, "doc_id long, fp long")


class Sets:
    """Disjoint sets of positions; add() joins many pairs at once, the smallest position names a set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def trie_join(fps: np.ndarray, nodes: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For sorted unsigned fingerprints: the position of the smallest member of each one's set.

    nodes: rows of (from, to, from, to), the pairs of ranges to start with, equal ranges for a join with
    itself; the two ranges of a row are equal or disjoint, and each is sorted.
    """
    sets = Sets(len(fps))
    stack = [(BITS - 1, nodes.astype(np.int64), np.zeros(len(nodes), np.int8))]
    while stack:
        bit, n, far = stack.pop()
        if len(n) > WALK:
            stack += [(bit, n[k : k + WALK], far[k : k + WALK]) for k in range(0, len(n), WALK)]
            continue
        single = (n[:, 1] - n[:, 0] == 1) & (n[:, 3] - n[:, 2] == 1)
        if single.any():  # two leaves: the remaining bits at once
            a, b = n[single, 0], n[single, 2]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= budget
            sets.add(a[near], b[near])
            n, far = n[~single], far[~single]
        if not len(n):
            continue
        if bit < 0:  # equal fingerprints under one node
            for a0, a1, b0, _ in n:
                sets.add(np.arange(a0, a1), np.full(a1 - a0, b0))
                sets.add(np.array([a0]), np.array([b0]))
            continue
        # where each range passes from 0 to 1 at this bit: the count of zeros before, from a running sum
        zeros = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)])
        cut_a = n[:, 0] + zeros[n[:, 1]] - zeros[n[:, 0]]
        cut_b = n[:, 2] + zeros[n[:, 3]] - zeros[n[:, 2]]
        same = n[:, 0] == n[:, 2]
        low = np.stack([n[:, 0], cut_a, n[:, 2], cut_b], 1)
        high = np.stack([cut_a, n[:, 1], cut_b, n[:, 3]], 1)
        cross = np.stack([n[:, 0], cut_a, cut_b, n[:, 3]], 1)
        back = np.stack([cut_a, n[:, 1], n[:, 2], cut_b], 1)[~same]
        n = np.concatenate([low, high, cross, back])
        far = np.concatenate([far, far, far + 1, far[~same] + 1]).astype(np.int8)
        alone = (n[:, 0] == n[:, 2]) & (n[:, 1] - n[:, 0] == 1)
        keep = (n[:, 1] > n[:, 0]) & (n[:, 3] > n[:, 2]) & (far <= budget) & ~alone
        n, far = n[keep], far[keep]
        if len(n):
            stack.append((bit - 1, n, far))
    return sets.root


def _join_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, lo, hi, part, fp), those of a unit together; gives (fp, root) for what each unit links."""
    held: list[np.ndarray] = []

    def joined(rows: np.ndarray) -> pa.RecordBatch:
        fps = rows[:, 4].astype(np.int64).view(np.uint64)
        order = np.lexsort((fps, rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
        rows, fps = rows[order], fps[order]
        part_starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]))
        ends = np.append(part_starts[1:], len(rows))
        lo, hi, part = rows[part_starts, 1], rows[part_starts, 2], rows[part_starts, 3]
        own = lo == hi
        nodes = [np.stack([part_starts[own], ends[own], part_starts[own], ends[own]], 1)]
        left = np.flatnonzero(~own & (part == lo))
        left = left[left + 1 < len(part_starts)]
        left = left[(rows[part_starts[left], :3] == rows[part_starts[left + 1], :3]).all(axis=1)]
        nodes.append(np.stack([part_starts[left], ends[left], part_starts[left + 1], ends[left + 1]], 1))
        root = trie_join(fps, np.concatenate(nodes))
        linked = np.flatnonzero(root != np.arange(len(root)))
        pairs = np.unique(np.stack([fps[linked].view(np.int64), fps[root[linked]].view(np.int64)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
        if sum(map(len, held)) >= WALK:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            whole = last[-1] + 1 if len(last) else 0
            if whole:
                yield joined(rows[:whole])
            held = [rows[whole:]]
    if held and sum(map(len, held)):
        yield joined(np.concatenate(held))


def _cuts(keyed: DataFrame, block_rows: int) -> DataFrame:
    """(block, bits) for groups beyond block_rows: enough bits, those whose ones are nearest to half of the group, to cut it into parts of that size."""
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(1)).alias(f"ones{b}") for b in range(BITS)]
    many = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *ones).filter(F.col("n") > block_rows)
    ranked = F.array_sort(F.array(*[F.struct(F.abs(F.col(f"ones{b}") * 2 - F.col("n")).alias("off"), F.lit(b).alias("bit")) for b in range(BITS)]))
    count = F.least(F.ceil(F.log2(F.col("n") / block_rows)) + 1, F.lit(CUT_BITS)).cast("int")
    return many.select("block", F.transform(F.slice(ranked, 1, count), lambda x: x["bit"]).alias("bits"))


def _masks(bits: int, budget: int) -> list[int]:
    """The numbers of so many bits with at most budget ones."""
    return [sum(1 << b for b in some) for k in range(min(bits, budget) + 1) for some in combinations(range(bits), k)]


def links(fps: DataFrame, block_rows: int = BLOCK_ROWS, budget: int = BUDGET) -> DataFrame:
    """(a, b): for distinct fingerprints ``fp``, rows that connect exactly what is within the budget, directly or through others."""
    spark = fps.sparkSession
    width = BITS // (budget + 1)
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(k) * (1 << width) + F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1) for k in range(budget + 1)])).alias("block"))
    large = saved(_cuts(keyed, block_rows), "hot-blocks")
    whole = lambda df: df.select("block", *[F.lit(0).cast("long").alias(c) for c in ("lo", "hi", "part")], "fp")
    n = large.count()
    if not n:
        units = whole(keyed)
    else:
        named = F.broadcast(large) if n <= 100_000 else large  # at most 4 * 65,536 rows
        place = F.aggregate("bits", F.lit(0).cast("long"), lambda acc, b: acc * 2 + F.call_function("getbit", F.col("fp"), b).cast("long"))
        cut = saved(keyed.join(named, "block").select("block", F.size("bits").alias("p"), place.alias("cell"), "fp"), "hot-parts")
        sizes = saved(cut.groupBy("block", "p", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("m")), "hot-sizes")
        masks = spark.createDataFrame([(p, m) for p in range(CUT_BITS + 1) for m in _masks(p, budget)], "p int, mask long")
        other = sizes.select("block", F.col("cell").alias("other"), F.col("m").alias("m_other"))
        near = sizes.join(F.broadcast(masks), "p").withColumn("other", F.col("cell").bitwiseXOR(F.col("mask"))).join(other, ["block", "other"]).select("block", "cell", "m", "other", "m_other")
        own = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("fp"), F.col("m"))
        to = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_other") - 1))
        pairs = cut.join(near, ["block", "cell"]).select("block", own.alias("part"), "fp", "other", to.alias("sub")).withColumn("other", F.col("other") * (1 << 32) + F.col("sub"))
        hot = pairs.select("block", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "fp")
        units = hot.union(whole(keyed.join(named, "block", "left_anti")))
    return units.repartition("block", "lo", "hi").sortWithinPartitions("block", "lo", "hi").mapInArrow(_join_units, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root) for every vertex of (a, b) that is not the smallest of its component.

    Each round ties a vertex and its neighbours to the smallest of them, until nothing changes, which always
    comes, as roots only fall; the number of rounds is about the logarithm of the longest path. Every round is a table in the shared folder.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).filter("v != root").distinct(), name)
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now
        seen = state
        both = now.select(F.col("v").alias("u"), F.col("root").alias("w")).union(now.select(F.col("root").alias("u"), F.col("v").alias("w")))
        least = saved(both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("u", "w").alias("least")), name)
        # a side of its own table: adaptive execution may split a vertex with very many neighbours
        moved = both.join(least, "u").select(F.col("w").alias("v"), F.col("least").alias("root")).union(least.select(F.col("u").alias("v"), F.col("least").alias("root")))
        before, now = now, saved(moved.filter("v != root").distinct(), name)
        forget(before, least)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """docs with one row of each set that links connect: that of the smallest id (rows without one last), then text, then other columns.

    Sets are named by fingerprints, so neither repeated nor missing ids matter. Of a large set only one row a task is shuffled.
    """
    python_ready(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in batches_of(b, at, PART_BYTES)):
            fps = np.array([fingerprint(t or "") for t in part.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(part.columns, fields=list(part.schema)), pa.array(fps, pa.int64())], ["row", "fp"])

    # the row travels as one struct, so no column of the input can clash
    rows = saved(docs.mapInArrow(run, StructType([StructField("row", docs.schema), StructField("fp", LongType())])), "simhash-rows")
    rooted = components(links(rows.select("fp").distinct(), budget=budget), "simhash-links").select(F.col("v").alias("fp"), "root")
    named = rows.join(rooted, "fp", "left").select("row", F.coalesce("root", "fp").alias("root"))
    others = [F.col("row")[c] for c, t in docs.dtypes if c not in (doc_id, text) and "map<" not in t and "variant" not in t]  # what has an order
    order = Window.partitionBy("root").orderBy(F.col("row")[doc_id].asc_nulls_last(), F.col("row")[text], *others)
    first = named.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return first.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links reach."""
    marked = saved(with_fingerprints(docs, doc_id, text), "simhash")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    rooted = components(links(distinct.select("fp"), budget=budget), "simhash-links")
    members = rooted.select(F.col("v").alias("fp"), "root").union(rooted.select(F.col("root").alias("fp"), "root").distinct())
    firsts = members.join(distinct, "fp")
    least = saved(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    linked = members.join(least, "root").select("fp", "component_id")
    named = saved(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
