"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of other characters than letters become one space, and the one- to
three-character grams are hashed into ``BUCKETS``.  Training counts grams of at most about
``ROWS_PER_LANG`` rows a language, drawn by a hash of the id, a documented bound of what the classifier is
fitted to; every language is learned.  The matrix of log-probabilities (buckets x languages) is broadcast; it
has at most ``MOST_CELLS`` numbers, so beyond a thousand languages there are fewer buckets, a power of two.
Scoring adds the matrix rows of a batch's grams up by document in numpy, over whole texts, in pieces whose
size falls with the number of languages.  Texts become Python strings and grams in lots of about ``LOT``
characters, so a worker holds little beside the batch at hand, however large its texts and batches.

Contract: null text, or text without a letter: ``und`` with score 0; equal probability goes to the first
language by name; without training rows every document is ``und``; very long texts are scored in pieces
whose sums are added; repeated rows are scored each; an empty table gives no rows; extra columns are
dropped, whatever their names.  More than ``MOST_LANGS`` different labels raise ValueError: a column with
that many isn't one of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, texts
from .idtable import batches_of

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.1
ROWS_PER_LANG, MOST_LANGS = 2000, 1 << 15
#: Numbers in the broadcast matrix (128 MB), and languages that a training task counts before it hands on.
MOST_CELLS, OPEN_LANGS = 1 << 25, 64
#: Characters of one text scored at once, and characters times languages.
PIECE, CELLS = 1 << 20, 1 << 23
#: Characters of several texts scored at once, and bytes of texts that are Python strings at once.
LOT, PART_BYTES = 1 << 17, 1 << 20
UNKNOWN = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x32000)] + [False])


def grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed grams (orders x positions), the start of each piece's positions, and whether it has a letter."""
    raw = np.frombuffer("\n\n".join([*pieces, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # lower-casing may lengthen, so the ends are found again by length
    size = np.array([len(p.lower()) + 2 for p in pieces])
    begin = np.cumsum(size) - size
    letter = _letters()[np.minimum(raw, 0x32000)]
    has = np.add.reduceat(letter, begin, dtype=np.int64) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    keep[begin] = True
    keep[begin + size - 2] = keep[begin + size - 1] = True
    kept = np.where(letter, raw, np.uint32(32))[keep]
    start = (np.cumsum(keep) - keep)[begin]
    h, out = kept * _MIX[0], []
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            h = h * _MIX[1] + np.concatenate([kept[order - 1 :], np.full(order - 1, 32, np.uint32)]) * _MIX[0]
        if order in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * _MIX[2]
            out.append((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.stack(out), start, has


def pieces_of(texts_: list[str], most: int = PIECE) -> Iterator[tuple[list[str], list[int]]]:
    """Whole texts in lots of about LOT characters, those longer than ``most`` cut: pieces and the numbers of their texts."""
    lot, owner, size = [], [], 0
    for i, t in enumerate(texts_):
        for k in range(0, max(1, len(t)), most):
            lot.append(t[k : k + most])
            owner.append(i)
            size += len(lot[-1])
            if size >= LOT:
                yield lot, owner
                lot, owner, size = [], [], 0
    if lot:
        yield lot, owner


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.table, self.prior = langs, table, prior

    def predict(self, texts_: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        return self.judge(texts_)[:2]

    def judge(self, texts_: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether there is a letter: without languages all texts are UNKNOWN, with a letter or not."""
        langs, score, letter, step = [], [np.zeros(0)], [np.zeros(0, bool)], max(16, CELLS // max(1, len(self.langs)))
        for k in range(0, len(texts_), step):
            a, b, c = self._judge(texts_[k : k + step])
            langs += a
            score.append(b)
            letter.append(c)
        return langs, np.concatenate(score), np.concatenate(letter)

    def _judge(self, texts_: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n, mask = len(self.langs), np.uint32(len(self.table) - 1)
        total, letter = np.zeros((len(texts_), n)), np.zeros(len(texts_), bool)
        for lot, owner in pieces_of(texts_, max(1024, min(PIECE, CELLS // max(1, n)))):
            hashed, start, has = grams(lot)
            at = np.array(owner)
            np.logical_or.at(letter, at, has)
            if n:
                row = sum(self.table[h & mask] for h in hashed)
                np.add.at(total, at, np.add.reduceat(row, start, axis=0, dtype=np.float64))
        if not n:
            return [UNKNOWN] * len(texts_), np.zeros(len(texts_)), letter
        total += self.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], np.where(letter, share, 0.0), letter


def buckets_for(langs: int) -> int:
    """The most buckets, a power of two up to BUCKETS, whose matrix stays within MOST_CELLS."""
    return min(BUCKETS, 1 << (MOST_CELLS // max(1, langs)).bit_length() - 1)


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Learns from text and lang of the documents that are not held out."""
    spark = docs.sparkSession
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = dict(sorted((r["lang"], r["count"]) for r in usable.groupBy("lang").count().limit(MOST_LANGS + 1).collect()))
    if len(found) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} different languages")
    langs, buckets = list(found), buckets_for(len(found))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    shares = F.broadcast(spark.createDataFrame([(lang, min(1.0, rows_per_lang / n)) for lang, n in found.items()], "lang string, _share double"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("_share") * 1_000_000
    sample = usable.select("doc_id", "lang", "text").join(shares, "lang").filter(drawn).select("lang", "text")
    python_ready(spark)

    def handed_on(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], ["lang", "bucket", "n"])
        sums.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in (p for b in batches for p in batches_of(b, 1, PART_BYTES)):
            names, bodies = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lot, owner in pieces_of(bodies):
                hashed, start, _ = grams(lot)
                hashed = hashed & np.uint32(buckets - 1)
                ends = np.append(start[1:], hashed.shape[1])
                for i, a, b in zip(owner, start, ends, strict=True):
                    if names[i] not in sums and len(sums) >= OPEN_LANGS:
                        yield from handed_on(sums)
                    got = sums.setdefault(names[i], np.zeros(buckets, np.int64))
                    got += np.bincount(hashed[:, a:b].ravel(), minlength=buckets)
        yield from handed_on(sums)

    # at most as many rows as the matrix has numbers
    summed = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table, place = np.zeros((buckets, len(langs)), np.float64), {lang: k for k, lang in enumerate(langs)}
    table[summed["bucket"].to_numpy(), np.array([place[x] for x in summed["lang"].to_pylist()], int)] = summed["n"].to_numpy()
    every = table.sum(axis=0, dtype=np.float64) + SMOOTHING * buckets
    table += SMOOTHING
    table /= every
    np.log(table, out=table)
    sizes = np.array(list(found.values()), float)
    return Model(langs, table.astype(np.float32), np.log(sizes / sizes.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every document."""
    spark = docs.sparkSession
    python_ready(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in batches_of(b, 1, PART_BYTES)):
            langs, score = held.value.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that hold a letter, whether or not the model knows a language; a null ``lang`` becomes the predicted one, all else stays."""
    spark = docs.sparkSession
    python_ready(spark)
    held = spark.sparkContext.broadcast(model)
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in batches_of(b, at, PART_BYTES)):
            found, _, letter = held.value.judge([t or "" for t in part.column(at).to_pylist()])
            if lang is not None and held.value.langs:
                filled = pc.coalesce(part.column(lang), pa.array(found, part.schema.field(lang).type))
                part = pa.RecordBatch.from_arrays([filled if k == lang else c for k, c in enumerate(part.columns)], schema=part.schema)
            yield part.filter(pa.array(letter, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
