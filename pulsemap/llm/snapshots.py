"""Difference of two snapshots of a table, rows whose key changed recognised by their content.

Both sides become narrow rows: key and a digest a column (null stays null).  They meet in a full outer
sort-merge join on the key, nulls equal.  What stays unpaired is numbered per content, the earlier side's
rows by ascending and the later side's by descending key, and a null-safe sort-merge join on content and
number pairs them.

Texts are hashed where they are scanned and don't move.  Numbers per content come from ranges of (content,
key) with counts carried on, so a content of any share of the rows spreads over tasks; nothing but one row a
task passes through the driver, and nothing is broadcast but that.

Contract: nulls equal only nulls, in keys and in columns.  Keys may repeat: copies of one row on both sides
pair first, then the rest of a key by order of content, what is left over counts as unpaired.  Null keys
come before all others (so last where keys descend).  Equal contents with equal keys are interchangeable.
Very long texts are hashed whole; either side may be empty; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from .common import saved


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column).cast("string").cast("binary"), 256))


def _side(rows: DataFrame, key: str, columns: Sequence[str], carry: Mapping[str, Column], name: str) -> DataFrame:
    """(key, c: struct of digests, more: struct of what is carried), written."""
    content = F.struct(*[_digest(c).alias(f"c{i}") for i, c in enumerate(columns)])
    more = F.struct(F.lit(True).alias("here"), *[v.alias(n) for n, v in carry.items()])
    return saved(rows.select(F.col(key).alias("key"), content.alias("c"), more.alias("more")), name)


def _joined(earlier: DataFrame, later: DataFrame, on: Sequence[str]) -> DataFrame:
    """(e, l): the rows of both sides as structs, one null where it has no partner."""
    e = earlier.select(F.struct("key", "c", "more").alias("e"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(on)])
    later = later.select(F.struct("key", "c", "more").alias("l"), *[F.col(c).alias(f"l{i}") for i, c in enumerate(on)])
    equal = reduce(lambda a, b: a & b, [F.col(f"e{i}").eqNullSafe(F.col(f"l{i}")) for i in range(len(on))])
    return e.join(later.hint("merge"), equal, "full_outer").select("e", "l")


def _repeats(side: DataFrame) -> bool:
    return not side.groupBy("key").count().filter("count > 1").isEmpty()


def _unpaired(pairs: DataFrame, side: str, other: str) -> DataFrame:
    return pairs.filter(F.col(other).isNull()).select(f"{side}.*")


def _by_key(earlier: DataFrame, later: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The full outer join on the key, written."""
    if not (_repeats(earlier) or _repeats(later)):
        return saved(_joined(earlier, later, ["key"]), "pairs")
    content = [f"c.c{i}" for i in range(len(columns))]
    copies = lambda df: numbered(df, [F.col("key"), *map(F.col, content)], [], "n")
    first = saved(_joined(copies(earlier), copies(later), ["key", *content, "n"]), "copies")
    rest = [numbered(_unpaired(first, a, b), [F.col("key")], [F.col(c).asc_nulls_first() for c in content], "n") for a, b in (("e", "l"), ("l", "e"))]
    both = first.filter(F.col("e").isNotNull() & F.col("l").isNotNull())
    return saved(both.unionByName(_joined(*rest, ["key", "n"])), "pairs")


def compare(earlier: DataFrame, later: DataFrame, key: str, columns: Sequence[str], carry: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, old_key, op, changed, carried columns) of each pair and each unpaired row.

    op: same, update, rekey, insert, delete.  changed: names of a pair's differing columns.  carry: named
    expressions over the later snapshot's columns, null for deleted rows.
    """
    carry = carry or {}
    absent = {n: F.lit(None).cast(t) for n, t in later.select(*[v.alias(n) for n, v in carry.items()]).dtypes}
    pairs = _by_key(_side(earlier, key, columns, absent, "earlier"), _side(later, key, columns, carry, "later"), columns)
    content = [f"c.c{i}" for i in range(len(columns))]
    gone = numbered(_unpaired(pairs, "e", "l"), [F.col(c) for c in content], [F.col("key").asc_nulls_first()], "n")
    came = numbered(_unpaired(pairs, "l", "e"), [F.col(c) for c in content], [F.col("key").desc_nulls_last()], "n")
    kept = pairs.filter(F.col("e").isNotNull() & F.col("l").isNotNull()).withColumn("rekeyed", F.lit(False))
    rows = kept.unionByName(_joined(gone, came, [*content, "n"]).withColumn("rekeyed", F.lit(True)))
    names = [F.when(~F.col(f"e.c.c{i}").eqNullSafe(F.col(f"l.c.c{i}")), c) for i, c in enumerate(columns)]
    paired = F.col("e").isNotNull() & F.col("l").isNotNull()
    changed = F.when(paired, F.concat_ws(",", *names)).otherwise("")
    op = F.when(F.col("e").isNull(), "insert").when(F.col("l").isNull(), "delete").when(F.col("rekeyed"), "rekey").when(changed == "", "same").otherwise("update")
    new_key = F.when(F.col("l").isNull(), F.col("e.key")).otherwise(F.col("l.key"))
    return rows.select(new_key.alias("key"), F.col("e.key").alias("old_key"), op.alias("op"), changed.alias("changed"), *[F.col(f"l.more.{n}").alias(n) for n in carry])
