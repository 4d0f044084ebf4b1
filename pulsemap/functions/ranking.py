"""Row numbers within groups without one task a group: ranges are sorted apart and their counts carried on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import saved
from .workers import python_ready

#: Rows sorted in one task.
ROWS_A_TASK = 500_000


def prefixed(value: Column) -> Column:
    """A value as text that says where it ends: `-` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(columns: Sequence[Column]) -> Column:
    """32 bytes that tell combinations of values apart, nulls equal to nulls; empty without columns."""
    return F.unhex(F.sha2(F.concat(*map(prefixed, columns)), 256)) if columns else F.lit(b"")


def tasks_for(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> int:
    """How many tasks sort df, a written table: its rows decide, beyond two a core."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers sorted rows within their runs of one ``_g``, and says which belong to the first run."""
    from pyspark import TaskContext

    part, last, rows, first = TaskContext.get().partitionId(), None, 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g, at = batch.column("_g"), np.arange(n)
        new = np.zeros(n, bool)
        new[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is not None and g[0].as_py() != last
        begin = np.maximum.accumulate(np.where(new, at, -1))
        number = np.where(begin < 0, at + rows, at - begin)
        in_first = first & (begin < 0)
        last, rows, first = g[n - 1].as_py(), int(number[-1]) + 1, bool(in_first[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(number), pa.array(in_first)], [*batch.schema.names, "_part", "_n", "_in_first"])


def _carried(local: DataFrame) -> list[tuple[int, int]]:
    """(part, rows of its first group that lie in parts before), where there are any. One row a part is all the driver sees."""
    ends = local.groupBy("_part").agg(F.min("_g").alias("first"), F.max(F.struct("_g", "_n")).alias("last"), F.sum(F.col("_in_first").cast("long")).alias("in_first"))
    open_group, rows, out = None, 0, []
    for r in sorted(ends.collect()):
        before = rows if r["first"] == open_group else 0
        if before:
            out.append((r["_part"], before))
        alone = r["first"] == r["last"]["_g"]
        open_group, rows = r["last"]["_g"], (before + r["in_first"] if alone else r["last"]["_n"] + 1)
    return out


def numbered(df: DataFrame, group: Sequence[Column], order: Sequence[Column], number: str = "number") -> DataFrame:
    """df, a written table, with each row's number within its group, from 0, by the given sort orders.

    Nulls of a group are equal to each other. Rows that agree in group and order are numbered in any order.
    Rows are cut into ranges of (group, order), so a group of any size spreads over tasks, and equal rows too;
    only the groups and counts at the ends of each range, one row a task, pass through the driver.
    """
    spark = df.sparkSession
    python_ready(spark)
    keyed = df.select("*", group_key(group).alias("_g"), F.monotonically_increasing_id().alias("_tie"))
    by = [F.col("_g"), *order, F.col("_tie")]
    ranged = keyed.repartitionByRange(tasks_for(df), *by).sortWithinPartitions(*by).drop("_tie")
    schema = T.StructType([*ranged.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_in_first", T.BooleanType())])
    local = saved(ranged.mapInArrow(_runs, schema), "numbered")
    before = _carried(local)
    plain = F.col("_n")
    if before:
        carried = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
        local = local.join(carried, "_part", "left")
        plain = F.col("_n") + F.when(F.col("_in_first"), F.coalesce("_before", F.lit(0))).otherwise(0)
    return local.select(*df.columns, plain.alias(number))
