"""Rendezvous hashing of stable record keys over weighted shards.

Each pair of key and shard has a draw u in (0, 1] from SHA-256 of the key and the shard's number, four draws
a digest.  A row goes where -ln(u) / weight is least, equals to the lower shard.  Draws don't depend on how
many shards there are, so another shard takes rows only into itself, about its share of the weights, and the
rows of a removed last shard spread over the others.  Nothing is kept but the weights; no row is moved to
decide.

Within a shard rows have slots from 0 without gaps, in order of key.  They come from sorted ranges of
(shard, key) whose counts are carried on, so a heavy shard or a repeated key spreads over tasks.

Contract: null is a key like any other; rows of equal keys share a shard and are in order of size and CRC;
null and empty texts have no bytes; long texts are hashed whole; an empty table gives no rows; other columns
don't matter, whatever their names.  Weights are finite and above 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered, prefixed
from ..functions.text import bound
from .common import saved

#: Bytes of text that a written file aims at.
FILE_BYTES = 256 << 20
DIGITS = 13


def draws(key: Column, shards: int) -> Column:
    """array<double> in (0, 1], the draw of each shard for the key."""
    text = F.coalesce(key.cast("string"), F.lit("-"))
    digests = F.transform(F.sequence(F.lit(0), F.lit((shards - 1) // 4)), lambda b: F.sha2(F.concat(text, F.lit("#"), b.cast("string")), 256))
    cut = lambda d, s: F.substr(d, s % 4 * 16 + 1, F.lit(DIGITS))
    number = lambda t: F.conv(t, 16, 10).cast("long")
    some = F.sequence(F.lit(0), F.lit(shards - 1))
    return bound(digests, lambda ds: F.transform(some, lambda s: (number(cut(F.element_at(ds, F.floor(s / 4).cast("int") + 1), s)) + 1) / float(1 << 4 * DIGITS)))


def scores(key: Column, weights: Sequence[float]) -> Column:
    """array<struct<score, shard>>: the least one's shard takes the row."""
    if not weights or not all(math.isfinite(w) and w > 0 for w in weights):
        raise ValueError("weights must be finite and above 0")
    each = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(draws(key, len(weights)), lambda u, s: F.struct((-F.log(u) / F.element_at(each, s + 1)).alias("score"), s.alias("shard")))


def assign(docs: DataFrame, weights: Sequence[float], more: Sequence[float] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot). ``more``: the weights of shards added later; grown_shard is where rows are then."""
    said = F.coalesce(F.col(text), F.lit(""))
    where = lambda s: F.array_min(s)["shard"]
    both = bound(scores(F.col(key), [*weights, *more]), lambda s: F.struct(where(F.slice(s, 1, len(weights))).alias("shard"), where(s).alias("grown_shard")))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(said) + 8).cast("long").alias("size"), F.crc32(said).alias("text_crc32"), both.alias("at")).select("key", "size", "text_crc32", "at.*")
    return numbered(saved(rows, "sharded"), [F.col("shard")], [F.col(c).asc_nulls_first() for c in ("key", "size", "text_crc32")], "slot")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Writes docs whole, all columns, in folders ``shard=<number>`` of files of about file_bytes, sorted by key in each.

    Rows are dealt by shard, key and a hash of the text, so that a heavy shard or key is several files.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(said).cast("long") + 8)).first()[0] or 0
    placed = docs.withColumn("shard", F.array_min(scores(F.col(key), weights))["shard"]).withColumn("_t", F.xxhash64(said))
    by = ["shard", F.col(key).asc_nulls_first(), "_t"]
    placed.repartitionByRange(max(len(weights), -(-total // file_bytes)), *by).sortWithinPartitions(*by).drop("_t").write.partitionBy("shard").parquet(path)
