"""The manifest against a plain tree in memory."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from ..conftest import DATA
from pyspark.sql import functions as F

from pulsemap.llm import merkle, queries

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at - at % 8
        out.append((at % 8, [d for i, d in enumerate(level[run : run + 8], run) if i != at]))
        at //= 8
    return out


def climbed(digest, steps):
    for slot, others in steps:
        digest = H(*others[:slot], digest, *others[slot:])
    return digest


def brute(rows, tampered):
    """rows: dicts of the leaf's columns."""
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((H(*[part(r[c]) for c in queries.LEAF]), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        by[name].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = {name: tree([d for d, _ in by[name]]) for name in names}
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (digest, r) in enumerate(by[name]):
            steps = path(trees[name], i) + path(top, k)
            given = H(*[part(v) for v in [r[c] for c in queries.LEAF[:-1]] + [tampered(r)]])
            reached = climbed(given, steps)
            out.append((r["doc_id"], digest, trees[name][-1][0], top[-1][0], H(*[d for _, others in steps for d in others]), reached, reached == top[-1][0]))
    return sorted(out, key=str)


def lowered(r):
    if r["text"] is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3:
        return r["text"]
    return r["text"].translate(str.maketrans(queries.CAPITALS, queries.SMALL))


def test_query_equals_the_plain_tree(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op11_merkle(spark, DATA)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, lowered)


def odd_rows():
    rng = random.Random(5)
    rows = [dict(doc_id=i, source="s", lang="big", n_chars=1, text=f"Text {i}") for i in range(4 * 512 + 9)]
    rows += [dict(doc_id=i, source=None, lang=f"l{i % 70:02}", n_chars=None, text=rng.choice([None, "", "É", "a" * 100_000])) for i in range(150)]
    rows += [dict(doc_id=None, source="s", lang=None, n_chars=i % 3, text="x") for i in range(30)] * 2
    rows += [dict(doc_id=7, source="s", lang="exact", n_chars=0, text=str(i)) for i in range(512)]
    return rows


def test_many_blocks_groups_nulls_ties_and_clashing_columns(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame([{**r, "node": "n", "tree": 1, "at": 2} for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string, tree int, at int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted([tuple(r) for r in queries.op11_merkle(spark, str(tmp_path)).collect()], key=str) == brute(rows, lowered)


def test_whole_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, "x", str(i)) for i in range(20)], "doc_id long, lang string, text string")
    m = merkle.manifest(docs, ["doc_id", "text"])
    for r in m.proofs(whole=True).collect():
        assert r["verified"] and r["root"] == m.root and H(r["proof"]) == r["proof_sha256"]
        assert len(r["proof"]) == 64 * (7 + 2 if r["key"] < 16 else 3 + 2)


def test_an_empty_table_has_no_root(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    m = merkle.manifest(docs, ["doc_id", "text"])
    assert m.root is None and m.proofs().count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512])
def test_a_block_by_itself(n):
    nodes = [H(str(i)) for i in range(n)]
    levels = merkle.climb(np.frombuffer("".join(nodes).encode(), np.uint8).reshape(-1, 64), 0)
    assert ["".join(x) for x in tree(nodes)] == [x.tobytes().decode() for x in levels]
