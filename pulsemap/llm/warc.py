"""WARC archives with an index of byte ranges.

Writing: each task writes one gzip member a record into archives of its own in a shared folder and gives
one index row a record: file, offset, length, URL and payload digest.  The index is written before
anything reads, so a lost task leaves a file no row points to.  Of equal payloads of at least
``least_bytes``, the one with the smallest page_id is a response, the others are revisits that refer to it.

Reading: the index rows of the wanted records are sorted by place, neighbouring ranges are joined into one
read while the gap is small and the read is not too long, and records are cut from what was read.  A
response's payload is checked against its digest.  The number of reading tasks follows from the bytes to
read, not from the size of the index.

Contract: null html is an empty payload; a null URL is left out; every row is a record, also of rows with
equal ids or wholly repeated ones: of equal payloads all rows with the smallest id are responses, and a
row without an id is a response; payloads of any length are written whole; an empty table gives an empty
index; extra columns are dropped, whatever their names.  The payload's length stands in the block's HTTP header, for revisits too.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, saved, shared_dir

LEAST_BYTES = 100
#: An archive is closed beyond this size; ranges are read together over gaps up to GAP, to READ at most; a task reads about TASK.
ARCHIVE, GAP, READ, TASK, LEVEL = 512 << 20, 64 << 10, 8 << 20, 16 << 20, 1
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses. Only digests are grouped; texts move once at most, by page_id."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digested = rows.withColumn("digest", F.sha2("html", 256))
    large = digested.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    first = saved(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-first")
    revisits = saved(large.join(first, "digest").filter("page_id != refers_to").distinct(), "warc-revisits")
    return digested.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of one record; payload is null for revisits."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda v: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", v)) else None
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    url, kind, digest = fields.get("WARC-Target-URI"), fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return number(fields["WARC-Record-ID"]), url, kind, number(fields.get("WARC-Refers-To", "")), n, digest, payload if kind == "response" else None


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of with_revisits(); gives the index, itself already written."""
    spark = rows.sparkSession
    python_ready(spark)
    to = folder or shared_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(to)
        task, count, out, offset, name = TaskContext.get(), 0, None, 0, ""
        try:
            for batch in batches:
                index = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset > ARCHIVE:
                        if out is not None:
                            out.close()
                        store.create_dir(path, recursive=True)
                        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{count}.warc.gz"
                        out, offset, count = store.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20), 0, count + 1
                    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    raw = press.compress(record(page_id, url, html.encode(), digest, refers_to)) + press.flush()
                    out.write(raw)
                    index.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, f"{to}/{name}", offset, len(raw)))
                    offset += len(raw)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), _INDEX.types, strict=True)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return saved(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """From sorted (offset, length): (from, to, members) of each read."""
    members: list[tuple[int, int]] = []
    for at, n in places:
        if members and (at - (members[-1][0] + members[-1][1]) > gap or at + n - members[0][0] > most):
            yield members[0][0], members[-1][0] + members[-1][1], members
            members = []
        members.append((at, n))
    if members:
        yield members[0][0], members[-1][0] + members[-1][1], members


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given index rows, in any selection; payloads=False leaves the payload column null."""
    python_ready(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, source = None, None
        for batch in batches:
            files, places = batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            k = 0
            while k < len(files):
                end = k
                while end < len(files) and files[end] == files[k]:
                    end += 1
                if files[k] != name:
                    name = files[k]
                    store, path = fs.FileSystem.from_uri(name)
                    source = store.open_input_file(path)
                for low, high, members in ranges(places[k:end]):
                    data = source.read_at(high - low, low)
                    rows = [parse(zlib.decompress(data[at - low : at - low + n], 31)) for at, n in members]
                    if not payloads:
                        rows = [(*r[:-1], None) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)
                k = end

    places = index.select("file", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    span = F.floor(F.col("offset") / READ)
    return places.repartition(max(1, -(-total // TASK)), "file", span).sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)
