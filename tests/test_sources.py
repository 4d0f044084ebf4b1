"""Files in ranges against Spark's own reader in one task, JSON, source order, unions of exports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pulsemap.sources import csvscan
from pulsemap.sources import feedback as S


@pytest.fixture
def ranges(spark):
    """Files are cut into ranges of two thousand bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def whole(spark, path, sep=",", encoding="UTF-8"):
    return [tuple(r) for r in spark.read.options(header=True, sep=sep, multiLine=True, escape='"', encoding=encoding).csv(str(path)).collect()]


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def messy(seed, n, sep=",", end="\n"):
    rng = random.Random(seed)
    odd = ["plain", "", "a, b", 'say "x"', "two\nlines", "three\n\nlines\n", 'ends "', "ş ğ é", "long " * 60, ";|\t", 'x\n"y"\nz']
    rows = [sep.join(["id", "comment", "more"])]
    for k in range(n):
        a, b = rng.choice(odd), rng.choice([*odd, '5" screen', '"abc"def'])
        b = b if '"' in b and b[0] != "s" and "\n" not in b and rng.random() < 0.5 and "ends" not in b else quoted(b)
        rows.append(sep.join([str(k), quoted(a), b]))
        if rng.random() < 0.03:
            rows.append("")
    return end.join(rows) + (end if seed % 2 else "")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sep", [",", ";"])
def test_ranges_give_the_rows_of_one_task(spark, tmp_path, ranges, seed, sep):
    path = tmp_path / "x.csv"
    path.write_bytes(messy(seed, 300, sep).encode())
    df = S.read_csv(spark, str(path), "_at")
    got = df.orderBy("_at").drop("_at").collect()
    assert csvscan.scan(spark, str(path), sep).ranges > 5
    assert [tuple(r) for r in got] == whole(spark, path, sep)
    assert df.columns == ["id", "comment", "more", "_at"]


def test_a_value_over_many_ranges(spark, tmp_path, ranges):
    path = tmp_path / "x.csv"
    long = "\n".join(f"line {k}" for k in range(2000))
    path.write_text(f'a,b\n1,{quoted(long)}\n2,x\n3,{quoted(long)}\n')
    assert [tuple(r) for r in S.read_csv(spark, str(path), "_at").orderBy("_at").drop("_at").collect()] == [("1", long), ("2", "x"), ("3", long)]


def test_windows_line_ends_marks_and_encodings(spark, tmp_path, ranges):
    body = messy(3, 200, ";", "\r\n")
    for name, data, encoding in (("u.csv", b"\xef\xbb\xbf" + body.encode(), "UTF-8"), ("w.csv", body.encode("cp1254"), None), ("l.csv", body.replace("ş ğ", "\x8d").encode("latin-1"), "ISO-8859-1")):
        path = tmp_path / name
        path.write_bytes(data)
        plain = tmp_path / f"plain-{name}"
        plain.write_bytes(data if encoding else body.encode())
        got = [tuple(r) for r in S.read_csv(spark, str(path), "_at").orderBy("_at").drop("_at").collect()]
        assert got == whole(spark, plain, ";", encoding or "UTF-8"), name


def test_a_header_alone(spark, tmp_path):
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    assert S.read_csv(spark, str(empty)).count() == 0


@pytest.mark.parametrize(("line", "inside", "want"), [(b'1,"a', False, True), (b'b",c', True, False), (b'5" x,y', False, False), (b'"a""', False, True), (b'"a"""', False, False), (b'"abc"def,"g', False, True), (b'x"y,"', True, True), (b"", True, True), (b"", False, False), (b',"",', False, False)])
def test_states_of_lines(line, inside, want):
    assert csvscan.advanced(line, inside, b",") is want


def test_json_lines_and_json(spark, tmp_path):
    rows = [{"date": "2024-03-02", "comment": "b", "score": 4}, {"date": "2024-03-01", "comment": "ü\nx"}, {"date": "2024-03-02", "comment": "a"}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "x.json").write_text(json.dumps(rows))
    for name in ("x.jsonl", "x.json"):
        got = S.load_feedback(str(tmp_path / name), spark).orderBy("doc_id").collect()
        assert [(r["doc_id"], r["text"], r["feedback_id"], r["rating"]) for r in got] == [(0, "ü\nx", "FB-00002", None), (1, "b", "FB-00001", 4.0), (2, "a", "FB-00003", None)]


def test_one_second_for_all_rows_spreads(spark, tmp_path, ranges, monkeypatch):
    """A bulk import has one timestamp: rows keep the order of the file, and no task sorts more than its share."""
    from pulsemap.functions import ranking

    (tmp_path / "x.csv").write_text("id,date,text\n" + "".join(f"i{k},2024-03-01,text {k}\n" for k in range(4000)))
    sizes = []
    keep = ranking._carried
    monkeypatch.setattr(ranking, "_carried", lambda local: (sizes.append([r["count"] for r in local.groupBy("_part").count().collect()]), keep(local))[1])
    got = S.load_feedback(str(tmp_path / "x.csv"), spark).orderBy("doc_id").collect()
    assert [r["feedback_id"] for r in got] == [f"i{k}" for k in range(4000)] and [r["doc_id"] for r in got] == list(range(4000))
    assert max(sizes[-1]) < 2 * 4000 / len(sizes[-1]) and len(sizes[-1]) > 4


def test_ties_follow_the_exports_and_names_their_stems(spark, tmp_path):
    (tmp_path / "202601.csv").write_text("date,text\n2024-01-01,z\n2024-01-01,a\n")
    (tmp_path / "app_reviews_202602.csv").write_text("date,text\n2024-01-01,m\n2023-01-01,first\n")
    paths = [str(tmp_path / "202601.csv"), str(tmp_path / "app_reviews_202602.csv")]
    got = S.combine_feedback({p: p for p in paths}, spark).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["first", "z", "a", "m"]
    assert [r["feedback_id"] for r in got] == ["app_reviews_202602:FB-00002", "202601:FB-00001", "202601:FB-00002", "app_reviews_202602:FB-00001"]
    assert {r["channel"] for r in got} == {"202601", "app_reviews"}


def test_frequent_accounts_keep_their_first_row(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("account_id"), F.col("id").alias("mrr"))
    got = S.load_accounts(df.coalesce(1))
    assert got.filter("account_id = 'hot'").first()["mrr"] == 0 and got.count() == 2001
