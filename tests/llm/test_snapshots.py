"""Snapshot differences against a plain loop over both sides."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pulsemap.llm import queries, snapshots
from pulsemap.llm.common import table

from ..conftest import DATA, same

COLUMNS = ["text", "lang", "source"]
low = lambda x: (x is not None, x if x is not None else 0)


def brute(earlier, later):
    """Rows are (key, text, lang, source); keys don't repeat."""
    old, new = {r[0]: r for r in earlier}, {r[0]: r for r in later}
    out, gone, came = [], defaultdict(list), defaultdict(list)
    for k in old.keys() | new.keys():
        if k in old and k in new:
            changed = [c for c, a, b in zip(COLUMNS, old[k][1:], new[k][1:], strict=True) if a != b]
            out.append((k, k, "update" if changed else "same", ",".join(changed), new[k]))
        elif k in old:
            gone[old[k][1:]].append(k)
        else:
            came[new[k][1:]].append(k)
    for content in gone.keys() | came.keys():
        a, b = sorted(gone[content], key=low), sorted(came[content], key=low, reverse=True)
        for i in range(max(len(a), len(b))):
            was, there = i < len(a), i < len(b)
            op = "rekey" if was and there else "insert" if there else "delete"
            out.append((b[i] if there else a[i], a[i] if was else None, op, "", (b[i], *content) if there else None))
    digest = lambda r: r and sha256("\n".join("~" if v is None else v for v in r[1:]).encode()).hexdigest()
    return Counter((*r[:4], digest(r[4])) for r in out)


def got(df):
    return Counter(tuple(r) for r in df.select("key", "old_key", "op", "changed", "row_sha256").collect())


def carried():
    return {"row_sha256": F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("~")) for c in COLUMNS]), 256)}


def test_query_equals_sql_and_the_loop(spark, duck):
    df = queries.op12_snapshots(spark, DATA)
    same(df, duck, queries.OP12_SQL)
    rows = [(r["doc_id"], *[r[c] for c in COLUMNS]) for r in table(spark, DATA, "documents").collect()]
    later = [tuple(r) for r in queries.later_snapshot(table(spark, DATA, "documents")).collect()]
    assert got(df) == brute(rows, later)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 != 0 for r in rows) + sum(zlib.crc32(str(r[0]).encode()) % 10 == 5 for r in rows) == len(later)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_contents_nulls_and_long_texts(spark, seed):
    """Most unpaired rows share one content; keys and contents may be null."""
    rng = random.Random(seed)
    content = lambda: rng.choice([("same", "en", None)] * 6 + [(None, None, None), ("", "en", "s"), ("long " * 40_000, "en", "s"), ("~", None, "s"), (None, "~", "s")])
    earlier = [(k, *content()) for k in [None, *range(0, 3000)]]
    later = [(k, *content()) for k in [*rng.sample(range(3000), 1500), *range(-1400, 0)]]
    frame = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n int, c string")
    assert got(snapshots.compare(frame(earlier), frame(later), "doc_id", COLUMNS, carried())) == brute(earlier, later)


def test_repeated_keys_pair_copies_first(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string")
    a = frame([("x", "1"), ("x", "1"), ("x", "2"), (None, "n")] + [("hot", str(i)) for i in range(500)] + [("z", "moved")])
    b = frame([("x", "1"), ("x", "3"), ("x", "2"), ("x", "1"), (None, "n"), (None, "m")] + [("hot", str(i)) for i in range(1, 500)] + [("y", "moved")])
    rows = Counter((r["key"], r["old_key"], r["op"]) for r in snapshots.compare(a, b, "k", ["v"]).collect())
    assert rows == {("x", "x", "same"): 3, ("x", None, "insert"): 1, (None, None, "same"): 1, (None, None, "insert"): 1, ("hot", "hot", "same"): 499, ("hot", "hot", "delete"): 1, ("y", "z", "rekey"): 1}


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    none = some.limit(0)
    ops = lambda a, b: Counter(r["op"] for r in snapshots.compare(a, b, "k", ["v"]).collect())
    assert ops(none, none) == {} and ops(some, none) == {"delete": 2} and ops(none, some) == {"insert": 2}


def test_columns_without_any_value(spark, tmp_path):
    """Parquet may know no type for them; Spark then reads another than string."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, got = 40, []
    for kind in (pa.null(), pa.string()):
        at = tmp_path / str(kind)
        at.mkdir()
        pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": [f"t{k % 7}" for k in range(n)], "lang": ["en"] * n, "source": pa.array([None] * n, kind)}), at / "documents.parquet")
        got.append(sorted(map(str, queries.op12_snapshots(spark, str(at)).collect())))
    assert got[0] == got[1] and len(got[0]) >= n
