"""Personal data and licenses: held-out quality, families of rules, long texts full of matches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pulsemap.llm import licenses, pii, simhash
from pulsemap.llm.common import table

from ..conftest import DATA


def planted(spark, seed=991, n=1200):
    """Snippets of another seed than the training's inside pieces of the tables' own clean texts: (text, start, end, label)."""
    r = random.Random(seed)
    bodies = [row["text"] for row in table(spark, DATA, "documents").filter("text is not null and not text rlike '[0-9@]'").orderBy("doc_id").limit(300).collect()]
    out = []
    for snippet, label in pii.snippets(n, seed):
        words = r.choice(bodies).split(" ")
        at = r.randrange(max(1, len(words) - 12))
        head, tail = " ".join(words[at : at + 6]), " ".join(words[at + 6 : at + 12])
        cut = len(snippet) - len(snippet.lstrip())
        out.append((f"{head} {snippet[cut:]} {tail}", len(head) + 1, len(head) + 1 + len(snippet) - cut, label))
    return out


def test_recall_and_precision_in_the_tables_own_texts(spark):
    rows = planted(spark)
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(rows)], "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.with_spans(df, pii.trained(spark)).collect()}
    hit = {1: 0, 0: 0}
    kinds: dict[str, list[int]] = {}
    for k, (_, start, end, label) in enumerate(rows):
        inside = [s for s in found[k] if s[1] < end and start < s[2]]
        hit[label] += bool(inside)
        for s in inside:
            kinds.setdefault(s[0], [0, 0])[label] += 1
    n = {v: sum(r[3] == v for r in rows) for v in (0, 1)}
    print("recall", hit[1] / n[1], "false", hit[0] / n[0], {k: (v[1], round(v[1] / sum(v), 3)) for k, v in kinds.items()})
    assert hit[1] / n[1] >= 0.9
    assert hit[1] / (hit[1] + hit[0]) >= 0.95
    assert set(kinds) >= {"number", "phone_local", "secret", "email_odd", "iban", "national_id"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("the key token 24be9aa0517c3d2e86b1f04c7a9902a3 was leaked", {"secret"}),
        ("secret: xoxb-1234567890-abcdefghij is live", {"secret"}),
        ("write to jörg.müller@exämple.de please", {"email_odd"}),
        ("account GB82 WEST 1234 5698 7654 32 is mine", {"iban"}),
        ("his ssn 123-45-6789 was shown", {"national_id"}),
        ("see doi 10.1038/nature.123456789 for more", set()),
        ("commit 24be9aa0517c3d2e86b1f04c7a9902a3aabbccdd fixed it", set()),
        ("order 1234567890123456 was sent", set()),
    ],
)
def test_kinds(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {s["kind"] for s in pii.with_spans(df, pii.trained(spark)).first()["spans"]} == want


def test_account_number_check(spark):
    df = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB83WEST12345698765432",), ("DE89370400440532013000",)], "s string")
    assert [r[0] for r in df.select(pii.mod97(F.col("s"))).collect()] == [True, False, True]


def test_spans_of_a_long_text_take_near_linear_time(spark):
    model, took = pii.trained(spark), []
    bit = 'mail a@b.co call (415) 555-0199 token = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c" card 4111111111111111 ssn 123-45-6789. '
    for n in (500, 4000):
        df = spark.createDataFrame([(1, bit * n)], "doc_id long, text string")
        began = time.time()
        spans = pii.with_spans(df, model).select(F.size("spans")).first()[0]
        took.append(time.time() - began)
        assert spans == 5 * n
    assert took[1] < 16 * max(took[0], 1.0)


def test_licenses_of_a_long_text_take_near_linear_time():
    took = []
    for n in (2000, 16_000):
        began = time.process_time()
        got = licenses.scan("released under the mit license. apache license version 2.0 cc by nc 4.0 \n" * n)
        took.append(time.process_time() - began)
        assert got[1] == 3 * n and len(got[5]) == 3 * n
    assert took[1] < 16 * max(took[0], 0.2)


def test_uncovered_is_the_greedy_pass():
    r = random.Random(1)
    for _ in range(300):
        spans = [(a, a + r.randint(1, 9)) for a in (r.randint(0, 30) for _ in range(r.randint(0, 40)))]
        kept: list[int] = []
        for k, (a, b) in enumerate(spans):
            if not any(spans[j][0] <= a and b <= spans[j][1] for j in kept):
                kept.append(k)
        assert list(licenses.uncovered(spans)) == kept


def test_text_without_a_license():
    assert not licenses.scan("nothing of this kind, no licence named, mit der zeit, a bsd of sorts is an apache")[5]
    for text in ("released under the mit license", "released under the MIT Licence"):
        assert {d["label"] for d in licenses.scan(text)[5]} == {"mit"}


def test_a_tight_cluster_is_cut_and_keeps_its_links(spark):
    """Thousands of near fingerprints in one group: the same sets as by brute force, and no unit of work holds them all."""
    import numpy as np

    r = np.random.default_rng(3)
    near = [0x1234_5678_9ABC_DEF0 ^ sum(1 << int(b) for b in r.choice(48, r.integers(0, 12), replace=False)) for _ in range(1500)]
    far = [int(x) for x in r.integers(0, 1 << 63, 500)]
    fps = np.unique(np.array(near + far, np.uint64))
    root = np.arange(len(fps))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        least = np.where(close, root[None, :], len(fps)).min(axis=1)
        if (least == root).all():
            break
        root = least
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["v"]: r["root"] for r in simhash.components(simhash.links(df, block_rows=64)).collect()}
    sets: dict[int, set] = {}
    for k, x in enumerate(fps.view(np.int64).tolist()):
        sets.setdefault(got.get(x, x), set()).add(int(root[k]))
    assert all(len(v) == 1 for v in sets.values()) and len(sets) == len(np.unique(root))
