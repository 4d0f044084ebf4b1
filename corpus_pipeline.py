"""The corpus pipeline: language ID, near-duplicates, personal data, packing.

Each stage reads what the one before it kept. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsemap.llm import common, langid, packing, pii, queries, simhash

#: SQL has no expression for hashed n-grams, XXH64 or the tokenizer.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects, those without a letter (null and empty texts too), go; all others stay, each row and column as it was.

    A missing ``lang`` is filled with the predicted one. Ties go to the first language by name; without labelled rows no text with a letter goes.
    """
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links connect, repeated rows too, one row stays: that of the smallest id, then text, then the other columns; rows without an id come last.

    Null and empty texts are one group. Texts of any length are read whole; an empty table stays empty; all columns stay.
    """
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; no row goes, and rows without such spans, null texts too, stay as they were, in all columns.

    Equal texts, repeated rows too, are redacted alike; of overlapping spans the likelier counts, ties go to the first; texts of any length are read whole.
    """
    return pii.redact_documents(docs, pii.trained(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its ids, of sequences of at most 2048 tokens; a null or empty text is its end id alone.

    Repeated rows are packed each, texts of any length are cut, an empty table gives no rows; other columns than id and text are dropped.
    """
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read is deleted once it is written, so one table is left for the last."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
