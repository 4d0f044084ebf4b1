"""A fingerprint of what tables hold, whatever the order and partitions of their rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(column: Column, kind: T.DataType) -> Column:
    """What Spark hashes; a map as its entries in order."""
    return F.array_sort(F.map_entries(column)) if isinstance(kind, T.MapType) else column


def table_digest(*frames: DataFrame | None) -> str:
    """16 hex digits of the frames' columns, types and rows; a frame that is None counts as absent.

    Two 64-bit hashes a row, nulls marked, are added up as decimals and folded by exclusive or, with the number
    of rows: one aggregate a frame, whose parts merge in any order, and one row of the driver. Repeated rows count.
    """
    told = []
    for df in frames:
        if df is None:
            told.append("none")
            continue
        cells = [x for f in df.schema.fields for x in (F.col(f"`{f.name}`").isNull(), _plain(F.col(f"`{f.name}`"), f.dataType))]
        hashes = df.select(*[F.xxhash64(F.lit(seed), *cells).alias(f"h{seed}") for seed in (1, 2)])
        sums = [F.sum(F.col(h).cast("decimal(20,0)")).cast("string") for h in ("h1", "h2")]
        row = hashes.agg(F.count(F.lit(1)), *sums, F.bit_xor("h1"), F.bit_xor("h2")).first()
        told.append(f"{[(f.name, f.dataType.simpleString()) for f in df.schema.fields]} {tuple(row)}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:16]
