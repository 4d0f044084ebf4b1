"""CSV files read by byte ranges, line breaks within quotes included.

Spark's text source cuts a file into ranges of whole lines.  Whether a range begins within a quoted value
depends on all before it, so the first pass takes both cases: for each range it tells in which state the range
ends if it began outside quotes, and if it began inside.  Those two bits a range are put together in order, which
gives every range its state.  The second pass then makes records of lines.  A record that goes over the end of
a range is cut there; its parts, at most two a range, are joined by a small aggregation.  Fields are split by
``from_csv`` within Spark.

The first pass also tells whether all bytes are valid UTF-8, and whether Windows-1254 leaves any undefined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import saved
from ..functions.workers import python_ready

BOM = b"\xef\xbb\xbf"
#: Bytes without a meaning in Windows-1254.
UNDEFINED = re.compile(b"[\x81\x8d\x8e\x8f\x90\x9d\x9e]")
WITHIN = re.compile(b'(?:[^"]+|"")*+')


def advanced(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted value is open after the line. A quote opens one only where a field begins; a value with a quote in it that is neither doubled nor at its end goes on to the separator."""
    at = 0
    while True:
        if not inside and line[at : at + 1] == b'"':
            inside, at = True, at + 1
        if inside:
            at = WITHIN.match(line, at).end()
            if at >= len(line):
                return True
            inside = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, first byte of the range, lines) of the ranges in a batch of lines."""
    files, blocks = batch.column(1), batch.column(2)
    if not batch.num_rows:
        return
    new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield files[a].as_py(), blocks[a].as_py(), batch.column(0).slice(a, b - a)


def _quoted(lines: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()


def _valid(lines: pa.Array) -> bool:
    try:
        lines.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def _summary(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[pa.RecordBatch]:
    """One row a range: its end state for either beginning, and what its bytes say of the encoding."""
    names = ["file", "block", "outside", "inside", "valid", "undefined"]
    at, ends, valid, undefined = None, [False, True], True, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, *ends, valid, undefined)], names)

    for batch in batches:
        for file, block, lines in _runs(batch):
            if at != (file, block):
                if at is not None:
                    yield row()
                at, ends, valid, undefined = (file, block), [False, True], True, False
            for k in _quoted(lines):
                line = lines[k].as_py()
                line = line[3:] if block == 0 and line.startswith(BOM) else line
                ends = [advanced(line, e, sep) for e in ends] if ends[0] != ends[1] else [advanced(line, ends[0], sep)] * 2
            if not _valid(lines):
                valid = False
                undefined = undefined or any(UNDEFINED.search(x) for x in lines.to_pylist())
    if at is not None:
        yield row()


def _records(batches: Iterator[pa.RecordBatch], sep: bytes, inside_at: set[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """Records of lines. ``head``: begun in an earlier range; ``open``: not ended in this one."""
    names = ["rec", "file", "block", "seq", "head", "open"]
    at, held, head, inside, seq = None, [], False, False, 0
    out: list[tuple] = []

    def done(opened: bool) -> None:
        nonlocal held, head, seq
        text = b"\n".join(held)
        if head or opened or text.strip(b"\r"):
            out.append((text, *at, -1 if head else seq, head, opened))
            seq += not head
        held, head = [], False

    def flushed() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
        out.clear()
        return made

    for batch in batches:
        for file, block, lines in _runs(batch):
            if at != (file, block):
                if held:
                    done(True)
                at, inside, seq = (file, block), (file, block) in inside_at, 0
                head = inside
            body, n, quoted = lines.to_pylist(), 0, _quoted(lines)
            if block == 0 and body and body[0].startswith(BOM):
                body[0] = body[0][3:]
            for k in [*quoted, len(body)]:
                if inside:
                    held += body[n:k]
                else:
                    for line in body[n:k]:
                        held = [line]
                        done(False)
                if k < len(body):
                    held.append(body[k])
                    inside = advanced(body[k], inside, sep)
                    if not inside:
                        done(False)
                n = k + 1
            if len(out) > 10_000:
                yield flushed()
    if held:
        done(True)
    if out:
        yield flushed()


@dataclass
class Scan:
    """records: (rec: binary, file, block, seq), header included as the first record of its file."""

    records: DataFrame
    valid: bool
    undefined: bool
    ranges: int


def _states(rows: list) -> set[tuple[str, int]]:
    """The ranges that begin inside quotes."""
    out, file, inside = set(), None, False
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        inside = inside and r["file"] == file
        file = r["file"]
        if inside:
            out.add((file, r["block"]))
        inside = r["inside"] if inside else r["outside"]
    return out


def scan(spark: SparkSession, path: str, sep: str, line_end: str = "\n") -> Scan:
    """The records of a file, or of all files of a folder. One row a range, as a scheduler keeps, comes to the driver."""
    python_ready(spark)
    lines = spark.read.option("lineSep", line_end).text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    by = sep.encode()
    told = lines.mapInArrow(lambda b: _summary(b, by), "file string, block long, outside boolean, inside boolean, valid boolean, undefined boolean").collect()
    inside_at = _states(told)
    found = lines.mapInArrow(lambda b: _records(b, by, inside_at), "rec binary, file string, block long, seq long, head boolean, open boolean")
    if inside_at:
        found = saved(found, "records")
        cut = found.filter("head or open")
        within = Window.partitionBy("file").orderBy("block", "seq")  # at most two rows a range
        parts = cut.withColumn("which", F.sum((~F.col("head")).cast("long")).over(within)).groupBy("file", "which").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "rec"))).alias("p"))
        text = F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0))["rec"], lambda a, x: F.concat(a, F.lit(line_end.encode()), x["rec"]))
        joined = parts.select(text.alias("rec"), "file", F.get("p", F.lit(0))["block"].alias("block"), F.get("p", F.lit(0))["seq"].alias("seq"))
        found = found.filter("not head and not open").select("rec", "file", "block", "seq").unionByName(joined)
    return Scan(found.select("rec", "file", "block", "seq"), all(r["valid"] for r in told), any(r["undefined"] for r in told), len(told))


def fields(text: Column, columns: list[str], sep: str) -> list[Column]:
    """The record's fields, as the CSV reader gives them."""
    parsed = F.from_csv(text, ", ".join(f"c{k} string" for k in range(len(columns))), {"sep": sep, "escape": '"', "multiLine": "true"})
    return [parsed[f"c{k}"].alias(c) for k, c in enumerate(columns)]
