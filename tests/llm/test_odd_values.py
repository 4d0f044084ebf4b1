"""What the operators give on odd tables: the same for a text as in a plain table, whatever its row's id, neighbours and other columns."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pulsemap.llm import langid, licenses, packing, pii, simhash
from pulsemap.llm import queries as Q
from pulsemap.llm.common import table

from .test_operators import ODD, naive_simhash, odd  # noqa: F401


@pytest.fixture(scope="module")
def plain(tmp_path_factory):
    """The odd texts with an id each and no other column."""
    at = tmp_path_factory.mktemp("plain")
    n = len(ODD)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": ODD, "lang": [None, *["en"] * (n - 2), "fr"]}), at / "documents.parquet")
    return str(at)


def rows(df, leave=("doc_id",)):
    return Counter(tuple(str(r[c]) for c in df.columns if c not in leave) for r in df.collect())


@pytest.mark.parametrize(("name", "leave"), [("op2_licenses", ("doc_id",)), ("op4_bpe", ("doc_id",)), ("op10_pii", ("doc_id",)), ("op8_simhash", ("doc_id", "component_id"))])
def test_results_follow_the_text_alone(spark, odd, plain, name, leave):  # noqa: F811
    assert rows(Q.queries()[name](spark, odd), leave) == rows(Q.queries()[name](spark, plain), leave)


def test_repeated_rows_and_ids_are_packed_each(spark, odd):  # noqa: F811
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(Q.vocabulary("word_bpe_49k.json").decode())
    want = Counter()
    docs = table(spark, odd, "documents").select("doc_id", "text").collect()
    for r in docs:
        want.update((r["doc_id"], v) for v in [*lib.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID])
    got = Counter()
    for r in packing.pack_documents(table(spark, odd, "documents"), Q.vocabulary("word_bpe_49k.json")).collect():
        got.update((r["doc_id"], int(v)) for v in np.frombuffer(r["ids"], "<u4"))
    assert got == want


def test_licenses_of_odd_texts(spark, odd):  # noqa: F811
    got = {r["doc_id"]: r for r in licenses.scan_documents(table(spark, odd, "documents").filter("doc_id is not null")).collect()}
    at = ODD.index("MIT license under the MIT License")
    assert (got[at]["n_words"], got[at]["n_base"], got[at]["first_word"], got[at]["base_labels"]) == (6, 1, 2, ["mit"])
    assert got[ODD.index("")]["n_words"] == 0 and got[ODD.index("")]["detections"] == []


def test_languages_of_odd_texts(spark, odd):  # noqa: F811
    docs = table(spark, odd, "documents")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.train(docs)).collect()]
    body = [t or "" for t in ODD]
    letters = {i: any(c.isalpha() for c in t) for i, t in zip([None, *range(1, len(ODD) - 1), len(ODD) - 2], body, strict=True)}
    for i, lang, score in got:
        if i != len(ODD) - 2:  # that id stands in two rows
            assert (lang != "und") == letters[i] and 0 <= score <= 1 and (lang != "und" or score == 0)


@pytest.mark.parametrize("n", [1000, 3000])
def test_every_language_is_learned(spark, n):
    """Each language has a word of its own; no language goes, and the matrix stays within its bound."""
    word = lambda k: "".join(chr(0x4E00 + int(d)) for d in f"{k:04}") + chr(0xAC00 + k)
    rows_ = [(k, word(k % n) * 3, f"l{k % n:04}") for k in range(4 * n)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string").repartition(8)
    model = langid.train(docs)
    assert len(model.langs) >= 0.98 * n and model.table.size <= langid.MOST_CELLS
    right = [r["lang_pred"] == f"l{r['doc_id'] % n:04}" for r in langid.predict(docs, model).collect() if f"l{r['doc_id'] % n:04}" in model.langs]
    assert sum(right) > 0.98 * len(right)


def test_too_many_labels_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 5)
    docs = spark.createDataFrame([(k, "abc", f"l{k}") for k in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(docs)


def test_many_languages_score_in_small_pieces(spark, monkeypatch):
    r = np.random.default_rng(0)
    table_ = np.log(r.random((langid.BUCKETS, 40)).astype(np.float32) + 0.01)
    m = langid.Model([f"l{k:02d}" for k in range(40)], table_, np.zeros(40))
    given = ["the quick brown fox " * 300, "x", "", "über älter " * 500]
    want = m.predict(given)
    monkeypatch.setattr(langid, "CELLS", 1 << 22)
    again = m.predict(given)
    assert want[0] == again[0] and np.allclose(want[1], again[1])


def test_fingerprints_of_odd_texts(spark, odd):  # noqa: F811
    for r in Q.op8_simhash(spark, odd).collect():
        if r["doc_id"] is not None and r["doc_id"] != len(ODD) - 2 and len(ODD[r["doc_id"]] or "") < 50_000:
            assert int(r["fingerprint"], 16) == naive_simhash(ODD[r["doc_id"]] or "")
    assert simhash.fingerprint("") == 0


def test_uneven_ids_meet_their_next(spark):
    """Ids packed at one end with far outliers, beyond what a long can span: the next text is still the next id's."""
    from pulsemap.llm import fingerprint

    ids = [-(2**63), 5, *range(100, 3100), 2**62, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string").repartition(7)
    for each in (64, 1024):
        got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(docs, each).select("doc_id", "next_text").collect()}
        assert got == {a: f"text of {b}" for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_redaction_keeps_the_rows(spark, odd):  # noqa: F811
    docs = table(spark, odd, "documents")
    got = pii.redact_documents(docs, pii.trained(spark))
    assert got.columns == docs.columns and got.count() == len(ODD)
    said = {r["text"] for r in got.collect()}
    assert None in said and any("[EMAIL]" in t for t in said if t) and not any("a@b.c" in t for t in said if t)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from pulsemap.functions import shared

    one = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        shared.shared_dir(one, "x")
    one.sparkContext.master = "local[2]"
    assert shared.shared_dir(one, "x").startswith("file:")


def test_a_very_long_conversation(spark):
    """80,000 turns in one conversation, in runs of any length: everything comes back, the mask covers each assistant text."""
    import time

    from pyspark.sql import functions as F

    from pulsemap.llm import chat

    turns = spark.range(80_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.xxhash64("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("</s>é "), "id").alias("text"))
    began = time.time()
    done = chat.format_conversations(turns)
    r = done.select(F.length("formatted").alias("n"), chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said"), "loss").first()
    took = time.time() - began
    rows_ = turns.orderBy("turn").collect()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(t["role"], t["text"]) for t in rows_]
    assert r["said"] == "".join(t["text"] for t in rows_ if t["role"] == "assistant")
    assert took < 30, took


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_sums_before(spark, n):
    from pyspark.sql import functions as F

    from pulsemap.llm import chat

    xs = [k * 7 % 11 for k in range(n)]
    got = spark.createDataFrame([(xs,)], "xs array<int>").select(chat.sums_before(F.col("xs")).alias("s")).first()["s"]
    assert got == [sum(xs[:k]) for k in range(n)]
