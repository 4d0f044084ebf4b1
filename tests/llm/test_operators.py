"""The ten operators and the pipeline against brute force, the libraries they follow, and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsemap.llm import bpe, chat, fingerprint, langid, licenses, packing, pii, simhash, topk, warc
from pulsemap.llm import queries as Q
from pulsemap.llm.common import table, texts

from ..conftest import DATA, same

LONG = "lorem ipsum. dolor\n" * 20_000
ODD = [None, "", "   \n", "a", "a b", "é́ ß 世界 🙂", "MIT license under the MIT License", "x" * 100_000, "9" * 30_000, "+1 " * 3000, "a@b.c " * 2000, LONG, "<|endoftext|> </s>[INST] \\ <|turn|>", "!!! ??? 123", "same text here is", "same text here is", "\x00\x01"]


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Tables with nulls everywhere, repeated rows and ids, ties, long and empty texts, and columns whose names clash with the operators' own."""
    at = tmp_path_factory.mktemp("odd")
    n = len(ODD)
    ids = [None, *range(1, n - 1), n - 2]
    clash = {c: ["x"] * n for c in ("ids", "fp", "spans", "sketch", "row", "body", "clean", "_text", "_key", "_stretch", "digest", "component_id", "score", "label")}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": ODD, "lang": [None, *["en"] * (n - 2), "fr"], "source": [None] * n, "n_chars": pa.array([None if t is None else len(t) for t in ODD], pa.int64()), **clash}), at / "documents.parquet")
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": [None, *["http://x/\r\n%0A"] * (n - 1)], "html": ODD, **{k: v for k, v in clash.items()}}), at / "pages.parquet")
    v = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [0.5, 0.5], [0.5, 0.5], [1.0], [-0.001, 0.25], *[[0.1 * k, 0.2] for k in range(n - 9)]]
    pq.write_table(pa.table({"vec_id": pa.array([None, *[50 * k for k in range(1, n)]], pa.int64()), "embedding": pa.array(v, pa.list_(pa.float32())), "v": ["x"] * n}), at / "embeddings.parquet")
    conv = pa.table({"conv_id": pa.array([None, 1, 1, 1, 1, 1, 2, 2], pa.int64()), "turn": pa.array([0, 0, 1, 1, 2, None, 0, 0], pa.int64()), "role": ["user", "user", "user", "user", "assistant", None, "assistant", "assistant"], "text": [None, "<|turn|>\\<|", "", "b", "</s> é🙂\n", "[INST]", "x", "x"], "t": ["x"] * 8, "formatted": ["y"] * 8})
    pq.write_table(conv, at / "conversations.parquet")
    return str(at)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "embeddings", "conversations"):
        whole = pq.read_table(f"{DATA}/{name}.parquet")
        pq.write_table(whole.slice(0, 0), at / f"{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", [*Q.queries(), "pipeline"])
def test_odd_and_empty_tables(spark, odd, empty, name):
    f = Q.queries().get(name) or corpus_pipeline.run
    got = f(spark, odd).count()
    if name not in ("op1_packing", "pipeline", "op3_chat", "op6_topk"):
        assert got == len(ODD)
    assert f(spark, empty).count() == (1 if name == "op3_chat" else 0)


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, duck, name):
    same(Q.queries()[name](spark, DATA), duck, Q.oracle_sql()[name])


def strings(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("ab \nétheLL's'd12.,!|́ßΣ世🙂\t\xa0") for _ in range(r.randint(0, 60))) for _ in range(n)] + [t or "" for t in ODD]


def test_bpe_follows_the_library():
    from tokenizers import Tokenizer

    raw = Q.vocabulary("byte_bpe_50k.json")
    lib, codec = Tokenizer.from_str(raw.decode()), bpe.Codec(raw)
    assert len(codec.whole) == lib.get_vocab_size() - 1  # every entry can be reached
    given = strings(2000)
    for text, ids in zip(given, codec.encode(given), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(Q.vocabulary("byte_bpe_50k.json").decode())
    body = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    for r in Q.op4_bpe(spark, DATA).collect():
        ids = lib.encode(body[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_follow_the_library():
    from tokenizers import Tokenizer

    raw = Q.vocabulary("word_bpe_49k.json")
    lib, own, given = Tokenizer.from_str(raw.decode()), packing.WordTokenizer(raw), strings(2000, 2)
    for text, ids in zip(given, own.encode(given), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_words_that_shortcuts_must_leave_to_the_library():
    import unicodedata

    from tokenizers import Tokenizer

    raw = Q.vocabulary("word_bpe_49k.json")
    lib, own = Tokenizer.from_str(raw.decode()), packing.WordTokenizer(raw)
    given = ["a <|EndOfText|> b", "A <|endoftext|>X <|StartOfText|>.", "CUMHUR\u0130YET\u0130.", "\u0130,", "H\u0331 T\u0308 W\u030a Y\u030a J\u030c T\u0344 H\u0334\u0331"]
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha() and (c < 0x3000 or unicodedata.normalize("NFC", chr(c).lower()) != chr(c))]
    given += [f"x{c}. {c}," for c in letters] + [f"{chr(c)}{chr(m)}" for c in range(65, 91) for m in range(0x300, 0x370)]
    for text, ids in zip(given, own.encode(given), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(Q.vocabulary("word_bpe_49k.json").decode())
    docs = {r["doc_id"]: [*lib.encode(r["text"], add_special_tokens=False).ids, 1] for r in table(spark, DATA, "documents").collect()}
    rows = Q.op1_packing(spark, DATA).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(docs[i]))
            assert r["ids_crc32"] == zlib.crc32(np.array(docs[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(docs[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0


def test_chat_comes_back(spark, odd):
    got = {r["conv_id"]: r for r in chat.format_conversations(table(spark, odd, "conversations")).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", "[INST]"), ("user", "<|turn|>\\<|"), ("user", ""), ("user", "b"), ("assistant", "</s> é🙂\n")]
    assert got[1]["formatted"].count("<|turn|>") == 3  # turns of one role in a row are one message
    assert got[1]["said"] == "</s> é🙂\n" and got[2]["said"] == "xx" and got[None]["said"] == ""


def test_licenses():
    assert 200 <= sum(map(len, licenses.rules()[0].values()))
    n, base, first, last, labels, found = licenses.scan("Released under the MIT License.\nÉté: Apache License, Version 2.0; see under the MIT license")
    assert (n, base, first, last, labels) == (16, 3, 1, 12, ["apache-2", "mit"])
    assert {d["label"] for d in found} >= {"mit", "apache-2"}
    kept = licenses.scan("licensed under cc by nc sa 4.0")[5]
    assert [d["label"] for d in kept if d["start"] >= 2] == [] and "cc-by-nc-sa" in {d["label"] for d in kept}
    for a in kept:  # nothing kept lies inside another of no lower priority
        assert not any(b is not a and b["start"] <= a["start"] and a["end"] <= b["end"] and b["rule"] < a["rule"] for b in kept)
    assert licenses.scan("") == (0, 0, None, None, [], [])
    text = "no license here, mit der Zeit"
    assert licenses.scan(text)[0] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))


def test_license_base_counts(spark):
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    body = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    for r in Q.op2_licenses(spark, DATA).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body[r["doc_id"]]))
        places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_language_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, DATA, "documents").collect()}
    rows = Q.op5_langid(spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_does_not_depend_on_neighbours(spark):
    model = langid.train(table(spark, DATA, "documents"))
    given = ["der und die", "", "123", None, "the and of", LONG]
    given = [g or "" for g in given]
    whole = model.predict(given)
    alone = [model.predict([g]) for g in given]
    assert whole[0] == [a[0][0] for a in alone] and np.allclose(whole[1], [a[1][0] for a in alone])
    assert whole[0][1:4] == ["und"] * 3


def test_topk_against_all_products():
    r = np.random.default_rng(1)
    for n, d in ((300, 64), (40, 3), (6, 8), (1, 2)):
        c = r.integers(-40, 40, (n, d))
        c[n // 2 :] = c[: n - n // 2][: len(c[n // 2 :])]
        ids = r.permutation(n)
        qs, cs, ss = topk.block_topk(ids[:5], c[:5], ids, c)
        for k in range(min(5, n)):
            want = sorted((-int(c[k] @ c[j]), int(ids[j])) for j in range(n) if ids[j] != ids[k])[:5]
            assert [(-int(s), int(i)) for q, i, s in zip(qs, cs, ss, strict=True) if q == k] == want


def naive_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return label
        label = new


def test_simhash(spark):
    body = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    ids = sorted(body)
    fps = np.array([naive_simhash(body[i]) for i in ids], np.uint64)
    label = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op8_simhash(spark, DATA).collect()}
    assert got == {i: (f"{int(fps[k]):016x}", ids[label[k]]) for k, i in enumerate(ids)}


def test_trie_join_and_cut_groups(spark):
    r = np.random.default_rng(0)
    found = set()
    for b in r.integers(0, 2**63, 40, dtype=np.uint64):
        c = int(b)
        for _ in range(12):
            for _ in range(int(r.integers(0, 4))):
                c ^= 1 << int(r.integers(0, 64))
            found.add(c)
    fps = np.array(sorted(found), np.uint64)
    want = brute_components(fps)
    assert (simhash.trie_join(fps, np.array([[0, len(fps), 0, len(fps)]])) == want).all()
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for rows in (3, 2048):  # groups beyond the limit are cut, with the same links
        root = {x["v"]: x["root"] for x in simhash.components(simhash.links(df, block_rows=rows)).collect()}
        sets = {}
        for f, k in zip(fps.view(np.int64).tolist(), want, strict=True):
            sets.setdefault(int(k), set()).add(root.get(f, f))
        assert all(len(s) == 1 for s in sets.values()) and len({next(iter(s)) for s in sets.values()}) == len(sets)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100) if k != 60], "a long, b long")
    root = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(root[v] == (0 if v <= 60 else 61) for v in root) and len(root) == 99


def test_fingerprints(spark):
    body = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    ids = sorted(body)
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4)) if w}
    prints, off = {}, []
    for r in Q.op7_fingerprint(spark, DATA).collect():
        k = ids.index(r["doc_id"])
        text, after = body[ids[k]], body[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        a, b = shingles(text), shingles(edited)
        off.append(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(off).max() < 0.2 and np.abs(off).mean() < 0.03


def test_sketches_merge(spark):
    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k}" for k in range(1500)))], "a string, b string")
    s = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "x"), "b", "y").select(fingerprint.distinct_shingles(F.col("x")).alias("n"), fingerprint.resemblance(F.col("x"), F.col("y")).alias("r"), fingerprint.containment(F.col("y"), F.col("x")).alias("c"), (fingerprint.merged(F.col("x"), F.col("y")) == F.col("x")).alias("same")).first()
    assert abs(s["n"] - 2996) < 900 and abs(s["r"] - 0.5) < 0.2 and s["c"] > 0.7 and s["same"]


def test_archives(spark, tmp_path):
    pages = table(spark, DATA, "pages")
    index = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}")
    want = {r["page_id"]: (r["url"], r["html"]) for r in pages.collect()}
    some = warc.read_records(index.filter("page_id % 7 = 3")).collect()
    assert {r["page_id"] for r in some} == {i for i in want if i % 7 == 3}
    for r in some:
        url, html = want[r["page_id"]]
        assert r["url"] == url and r["payload_bytes"] == len(html.encode())
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html.encode()


def test_ranges_are_joined():
    assert [(a, b) for a, b, _ in warc.ranges([(0, 10), (12, 5), (100, 5), (200, 50)], gap=10, most=60)] == [(0, 17), (100, 105), (200, 250)]
    assert [(a, b) for a, b, _ in warc.ranges([(0, 10), (10, 10), (20, 10)], gap=0, most=20)] == [(0, 20), (20, 30)]


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_personal_data(spark):
    r = random.Random(3)
    bits = ["a@b.c", "+1 ", "1.2", "255.", "4111 1111 1111 1111", "4111-1111-1111-1111", "x", "@", ".", "-", " ", "9", "é", "🙂", "(0)", "\n", "12", "@b.co.uk", "+", "token = 24be64439e3e49cf46b2d7c90f3602a3"]
    given = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    model = pii.trained(spark)
    more = 0
    for row in pii.with_spans(df, model).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect():
        got = [tuple(s) for s in row["spans"]]
        base = base_spans(row["text"])
        assert [s for s in got if s[0] in pii.BASE_KINDS] == base
        added = [s for s in got if s[0] in pii.MORE_KINDS]
        more += len(added)
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base)
        spans = sorted((a, -b, k) for k, a, b in got)
        want, at = "", 0
        for a, b, k in spans:
            if a >= at:
                want += row["text"][at:a] + f"[{k.upper()}]"
            at = max(at, -b)
        assert row["clean"] == want + row["text"][at:]
    assert more


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], DATA))
        assert kept[-1].columns == docs.columns
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(kept[1]).collect()}
    left = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    assert set(left) == set(near.values())
    assert not any(base_spans(t) for t in left.values())
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)
    assert texts(docs).count() == len(near)


def test_near_duplicates_are_dropped_by_row(spark):
    a, b, c, d = "one two three four five", "six seven eight nine ten", "Six seven  eight nine ten", "red green blue black white"
    rows = [(1, b, "x"), (3, a, "x"), (3, b, "x"), (5, a, "x"), (3, a, "x"), (None, a, "x"), (None, d, "y"), (None, d, "x"), (1, c, "x"), (1, "up and down we go", "x"), (7, None, "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, DATA)
    assert got.schema == df.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, c, "x"), (3, a, "x"), (None, d, "x"), (1, "up and down we go", "x"), (7, None, "x")], key=str)


def test_texts_with_a_letter_stay_whatever_the_labels(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 3 == 1)
    free = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 3 != 1)
    for labelled, lang in ((held, None), (free, None), (held, "en"), (free, "und")):  # no label, none to learn from, and one like the mark of the unknown
        df = spark.createDataFrame([(labelled, "some text", lang), (100, "Größe", None), (101, "12 !", None), (102, None, None)], "doc_id long, text string, lang string")
        assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, DATA).collect()) == sorted([labelled, 100])


def a_match(parsed, r):
    """A random string that a parsed regular expression matches."""
    from re import _constants as C

    out = ""
    for op, x in parsed:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(a_match(x[2], r) for _ in range(r.randint(x[0], min(x[1], x[0] + 2))))
        elif op is C.BRANCH:
            out += a_match(r.choice(x[1]), r)
        elif op is C.SUBPATTERN:
            out += a_match(x[3], r)
        elif op is C.IN:
            kind, y = r.choice(x)
            out += r.choice("abc") if kind is C.CATEGORY else chr(r.randint(*y) if kind is C.RANGE else y)
        elif op is C.LITERAL:
            out += chr(x)
        else:
            assert op in (C.ASSERT, C.AT)
    return out


def test_keywords_are_in_every_match_of_their_rules():
    from re import _parser

    r, by_word, wrong = random.Random(5), licenses.rules()[0], set()
    every = {rule[0]: rule for some in by_word.values() for rule in some}
    for number, _, _, _, pattern in every.values():
        inner = pattern.pattern.decode().removeprefix("(?:^|(?<= ))").removesuffix("(?= |$)")
        for _ in range(300):
            text = a_match(_parser.parse(inner), r)
            assert pattern.search(text.encode()), text
            if inner.startswith("(?:(?:asl|al) 2"):  # the one rule that asks for a word elsewhere
                text += " apache"
            if not any(rule[0] == number for word in text.encode().split() for rule in by_word.get(word, ())):
                wrong.add((number, text))
    assert not wrong
    for text, label in (("Released under the MIT Licence", "mit"), ("neither the name of X nor the names of its contributors may be used to endorse", "bsd-3-clause"), ("Universal Permissive License", "upl-1"), ("the Q Public License", "qpl-1")):
        assert label in {d["label"] for d in licenses.scan(text)[5]}


def test_topk_beyond_the_probe(spark):
    r = np.random.default_rng(4)
    n, d = 400, 24
    c = r.integers(-40, 40, (n, d)) // np.arange(1, d + 1)
    ids = r.permutation(n)
    for k in (16, 17, 50, 398, 399, 500):
        qs, cs, ss = topk.block_topk(ids[:20], c[:20], ids, c, k)
        for i in range(20):
            want = sorted((-int(c[i] @ c[j]), int(ids[j])) for j in range(n) if j != i)[:k]
            assert [(-int(s), int(x)) for q, x, s in zip(qs, cs, ss, strict=True) if q == i] == want
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, c.tolist(), strict=True)], "vec_id long, v array<long>")
    assert topk.top_k(df, F.col("vec_id") < 3, 50).count() == 150


def test_only_kept_spans_displace_others(spark):
    rows = [[(0, 0, 10, 3.0), (1, 8, 20, 2.0), (2, 18, 30, 1.0)], [(0, 5, 9, 1.0), (1, 5, 9, 1.0), (2, 0, 5, 0.5)], [], [(3, 0, 2, -1.0), (0, 1, 3, 4.0), (1, 2, 4, 5.0), (2, 3, 9, 4.5)]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, c array<struct<g:int,start:int,end:int,odds:double>>")
    got = {r["k"]: [(c["g"], c["start"], c["end"]) for c in r["kept"]] for r in df.select("k", pii.without_overlaps(F.col("c")).alias("kept")).collect()}
    assert got == {0: [(0, 0, 10), (2, 18, 30)], 1: [(2, 0, 5), (0, 5, 9)], 2: [], 3: [(3, 0, 2), (1, 2, 4)]}
