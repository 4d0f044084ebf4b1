"""The queries of this subpackage: thin derivations from the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, langid, licenses, merkle, packing, pii, sharding, simhash, snapshots, topk, warc
from .common import table, texts


def vocabulary(name: str) -> bytes:
    """The bytes of a public tokenizer's file; read on the driver and broadcast, about 2 MB."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_documents(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    read = chat.format_conversations(turns).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
with raw as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select *, row_number() over w as n, lag(role) over w as before,
    length(text) + (length(text) - length(replace(text, '\', '')))
      + len(regexp_extract_all(text, '<(\||/?s>|</?SYS|start_of_turn|end_of_turn)|\[/?INST\]')) as chars
  from raw window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars + case when before is not distinct from role then 8 else length(role) + 23 end)::bigint as formatted_chars
from t group by conv_id
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.recode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id != c.vec_id
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprint.fingerprint_with_edits(texts(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
r as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes, payload_digest,
  case when first < page_id then 'revisit' else 'response' end as record_type,
  case when first < page_id then first end as refers_to
from r
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(texts(table(spark, sf_dir, "documents")), pii.trained(spark))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(line(of(*pii.BASE_KINDS)), 256).alias("base_sha256"),
        line("spans").alias("spans"),
    )


#: CRC-32 of {}, ASCII text, byte by byte and bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda k, i: xor(k >> 1, (k & 1) * 3988292384))), 4294967295)"""
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))
    tree = merkle.manifest(table(spark, sf_dir, "documents"), LEAF, given=[*map(F.col, LEAF[:-1]), tampered])
    return tree.proofs().select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _part_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar) || ':' || ({value})::varchar, '-')"


OP11_SQL = f"""
with recursive crc as (
  select *, {CRC_SQL.format("(doc_id::varchar)")} % 3 = 0 as hit from documents
), leaves as (
  select doc_id, dense_rank() over (order by lang nulls first) - 1 as tree,
    sha256({" || ".join(map(_part_sql, LEAF))}) as leaf,
    sha256({" || ".join(map(_part_sql, (*LEAF[:-1], f"case when hit then translate(text, '{CAPITALS}', '{SMALL}') else text end")))}) as given
  from crc
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from leaves
), nodes as (
  select tree, 0 as level, place, leaf as digest, count(*) over (partition by tree) as n from placed
  union all
  select tree, level + 1, place // 8, sha256(string_agg(digest, '' order by place)), (n + 7) // 8
  from nodes where n > 1 group by tree, level, place // 8, n
), subroots as (select tree, digest as subroot from nodes where n = 1),
tops as (
  select 0 as level, tree as place, subroot as digest, count(*) over () as n from subroots
  union all
  select level + 1, place // 8, sha256(string_agg(digest, '' order by place)), (n + 7) // 8
  from tops where n > 1 group by level, place // 8, n
), siblings as (
  select l.tree, l.place, 0 as part, s.level, s.place as spot, s.digest
  from placed l join nodes s on s.tree = l.tree and s.n > 1
    and s.place // 8 = l.place // (8 ** (s.level + 1))::bigint and s.place != l.place // (8 ** s.level)::bigint
  union all
  select l.tree, l.place, 1, s.level, s.place, s.digest
  from placed l join tops s on s.n > 1
    and s.place // 8 = l.tree // (8 ** (s.level + 1))::bigint and s.place != l.tree // (8 ** s.level)::bigint
), proofs as (
  select tree, place, sha256(string_agg(digest, '' order by part, level, spot)) as proof_sha256 from siblings group by tree, place
), folds as (
  select tree, place, 0 as level, place as spot, given as digest from placed
  union all
  select f.tree, f.place, f.level + 1, f.spot // 8,
    sha256(string_agg(case when s.place = f.spot then f.digest else s.digest end, '' order by s.place))
  from folds f join nodes s on s.tree = f.tree and s.level = f.level and s.n > 1 and s.place // 8 = f.spot // 8
  group by f.tree, f.place, f.level, f.spot
), reached as (
  select tree, place, arg_max(digest, level) as digest from folds group by tree, place
), top_folds as (
  select tree, place, 0 as level, tree as spot, digest from reached
  union all
  select f.tree, f.place, f.level + 1, f.spot // 8,
    sha256(string_agg(case when s.place = f.spot then f.digest else s.digest end, '' order by s.place))
  from top_folds f join tops s on s.level = f.level and s.n > 1 and s.place // 8 = f.spot // 8
  group by f.tree, f.place, f.level, f.spot
), ends as (
  select tree, place, arg_max(digest, level) as folded_root from top_folds group by tree, place
), root as (select digest as root from tops where n = 1)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from placed join subroots using (tree) join ends using (tree, place) left join proofs using (tree, place) cross join root
"""


def later_snapshot(docs: DataFrame) -> DataFrame:
    """What op12 compares documents with."""
    # a column without any value may have another type than string
    key, text, lang, source = F.col("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]
    rows = docs.select(key, text, lang, source, (F.crc32(key.cast("string")) % 10).alias("h"))
    h, moved = F.col("h"), -1 - key
    keys = F.when(h == 5, F.array(key, moved)).when(h.isin(3, 4), F.array(moved)).otherwise(F.array(key))
    return rows.filter(~h.eqNullSafe(0)).select(
        F.explode(keys).alias("doc_id"),
        F.when(h == 1, F.concat(F.coalesce(text, F.lit("")), F.lit("+"))).otherwise(text).alias("text"),
        F.when(h == 2, source).otherwise(lang).alias("lang"),
        F.when(h == 2, lang).when(h == 4, F.lit(None)).otherwise(source).alias("source"),
    )


def op12_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, columns = table(spark, sf_dir, "documents"), ["text", "lang", "source"]
    row = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    return snapshots.compare(docs, later_snapshot(docs), "doc_id", columns, {"row_sha256": row})


OP12_SQL = f"""
with numbered as (
  select doc_id, text, lang, source, {CRC_SQL.format("(doc_id::varchar)")} % 10 as h from documents
), later as (
  select unnest(case when h = 5 then [doc_id, -1 - doc_id] when h in (3, 4) then [-1 - doc_id] else [doc_id] end) as key,
    case when h = 1 then coalesce(text, '') || '+' else text end as text,
    case when h = 2 then source else lang end as lang,
    case when h = 2 then lang when h = 4 then null else source end as source
  from numbered where h != 0
), pairs as (
  select e.doc_id as old_key, l.key, e.doc_id is not null as was, l.key is not null as is_there,
    e.text as old_text, e.lang as old_lang, e.source as old_source, l.text, l.lang, l.source
  from documents e full join later l on e.doc_id = l.key
), gone as (
  select old_key, old_text as text, old_lang as lang, old_source as source,
    row_number() over (partition by old_text, old_lang, old_source order by old_key) as n from pairs where not is_there
), came as (
  select key, text, lang, source, row_number() over (partition by text, lang, source order by key desc) as n from pairs where not was
), moved as (
  select g.old_key, c.key, c.text, c.lang, c.source from gone g full join came c
    on g.text is not distinct from c.text and g.lang is not distinct from c.lang and g.source is not distinct from c.source and g.n = c.n
), every as (
  select key, old_key, text, lang, source, concat_ws(',', case when text is distinct from old_text then 'text' end,
    case when lang is distinct from old_lang then 'lang' end, case when source is distinct from old_source then 'source' end) as changed, 'update' as op
  from pairs where was and is_there
  union all
  select key, old_key, text, lang, source, '',
    case when key is null then 'delete' when old_key is null then 'insert' else 'rekey' end from moved
)
select coalesce(key, old_key) as key, old_key, case when op = 'update' and changed = '' then 'same' else op end as op, changed,
  case when op != 'delete' then sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) end as row_sha256
from every
"""

SHARDS = 24


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0])
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP13_SQL = f"""
with bits as (
  select i, list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda k, z: xor(k >> 1, (k & 1) * 3988292384)) as v
  from (select unnest(range(256)) as i)
), folding as (select list(v order by i) as steps from bits),
docs as (
  select row_number() over () as row, doc_id, strlen(coalesce(text, '')) + 8 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) as text_crc32
  from documents, folding
), drawn as (
  select row, s, ('0x' || substr(sha256(coalesce(doc_id::varchar, '-') || '#' || (s // 4)), (s % 4 * 16 + 1)::bigint, 13))::bigint as draw
  from docs, (select unnest(range({SHARDS + 1})) as s)
), chosen as (
  select row, (arg_max(s, draw) filter (s < {SHARDS}))::int as shard, arg_max(s, draw)::int as grown_shard from drawn group by row
)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard
from docs join chosen using (row)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_licenses": op2_licenses,
        "op3_chat": op3_chat,
        "op4_bpe": op4_bpe,
        "op5_langid": op5_langid,
        "op6_topk": op6_topk,
        "op7_fingerprint": op7_fingerprint,
        "op8_simhash": op8_simhash,
        "op9_warc": op9_warc,
        "op10_pii": op10_pii,
        "op11_merkle": op11_merkle,
        "op12_snapshots": op12_snapshots,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op6_topk": OP6_SQL, "op9_warc": OP9_SQL, "op11_merkle": OP11_SQL, "op12_snapshots": OP12_SQL, "op13_sharding": OP13_SQL}
