"""Text vectors: TF-IDF of words and characters, reduced by a singular value decomposition; encoders that users bring; both together.

An embedder has ``name``, ``fit(df, text)``, which gives the embedder, and ``encode(df, text)``, which adds unit
vectors ``vector``. Those with a part for meaning alone also have ``semantic(vector)``, that part as unit vector.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.ranking import numbered
from ..functions.shared import forget, saved
from ..functions.text import unit
from ..functions.workers import python_ready
from . import decompose

MOST_DIMENSIONS = 128
#: Bytes of term vectors that the driver and the workers hold whole; a larger vocabulary is decomposed in blocks.
MOST_HELD = 64 << 20
#: The decomposition: dimensions beyond those wanted, passes over the texts, weights a task, weights and terms at once.
SPARE, PASSES, TASK_WEIGHTS, LOT, BLOCK_TERMS = 10, 6, 400_000, 100_000, 100_000


class Embedder(Protocol):
    name: str

    def fit(self, df: DataFrame, text: str = "text") -> Embedder: ...

    def encode(self, df: DataFrame, text: str = "text") -> DataFrame: ...


class TfidfEmbedder:
    """fit() learns terms, weights and the projection from texts; encode() adds unit vectors ``vector``.

    Word terms: one and two words, in at least 2 texts and at most 40 % of them; character terms: three to
    five characters within padded words, in at least 3 texts. Sublinear counts, smooth idf, each of the two
    parts of unit length. All such terms are kept, however many. The decomposition is a randomized one with a
    fixed seed, the same for any number of texts. Vectors of up to MOST_HELD bytes are held whole and sent to
    the workers; beyond, ``decompose`` runs the same iteration on blocks of terms and texts, and vocabulary,
    weights and vectors stay tables: ``encode`` then writes what it is given and joins.
    """

    name = "tfidf"

    def __init__(self, stop: tuple[str, ...] = (), dimensions: int = MOST_DIMENSIONS, sizes: decompose.Sizes = decompose.Sizes()):
        self.stop, self.dimensions, self.sizes = stop, dimensions, sizes
        self.size, self.vocabulary, self.vectors, self.width = 0, None, None, 0
        self.weight: dict[str, tuple[int, float]] = {}
        self.projection = np.zeros((0, 0), np.float32)

    def terms(self, text: Column) -> Column:
        """Terms with repeats; words carry the mark w:, character terms c:."""
        words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))
        kept = F.filter(words, lambda w: ~w.isin(*self.stop)) if self.stop else words
        pairs = F.zip_with(kept, F.slice(kept, 2, F.size(kept) + 1), lambda a, b: F.concat(a, F.lit(" "), b))
        pairs = F.filter(pairs, lambda p: p.isNotNull())
        padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        grams = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.concat(F.lit("c:"), F.substr(w, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))
        chars = F.flatten(F.transform(padded, lambda w: F.concat(*[grams(w, n) for n in (3, 4, 5)])))
        return F.concat(F.transform(F.concat(kept, pairs), lambda w: F.concat(F.lit("w:"), w)), chars)

    def fit(self, df: DataFrame, text: str = "text") -> TfidfEmbedder:
        python_ready(df.sparkSession)
        termed = df.select(self.terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        n = df.count()
        seen = termed.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        word = F.startswith("term", F.lit("w:"))
        fit = seen.filter((word & (F.col("df") >= 2) & (F.col("df") <= 0.4 * n)) | (~word & (F.col("df") >= 3)))
        words = saved(fit.select("term", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")
        self.size = words.count()
        k = max(2, min(self.dimensions, self.size - 1, n - 1))
        if 4 * self.size * (k + SPARE) > MOST_HELD:
            self._fit_blocks(df, text, words, k)
            return self
        found = words.orderBy(*_numbering()).toArrow()
        forget(words)
        self.weight = {t: (j, x) for j, (t, x) in enumerate(zip(found["term"].to_pylist(), found["idf"].to_pylist(), strict=True))}
        self.projection = np.eye(max(1, self.size), dtype=np.float32) if self.size < 3 or n < 3 else self._decomposed(termed, k)
        return self

    def _fit_blocks(self, df: DataFrame, text: str, words: DataFrame, k: int) -> None:
        self.vocabulary = saved(numbered(words, [], _numbering(), "tid"), "vocabulary")
        forget(words)
        weights = saved(self._weights(df.select(F.monotonically_increasing_id().alias("id"), F.col(text).alias("text"))), "weights")
        tiles = decompose.tiles(weights, self.size, self.sizes)
        self.vectors, self.width = decompose.leading(tiles, self.size, k, SPARE, PASSES)
        forget(weights, tiles.table)

    def _weights(self, texts: DataFrame) -> DataFrame:
        """(id, tid, x) from (id, text): terms counted where their text lies, joined to the vocabulary, scaled part by part."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, lists = batch.columns
                each = pa.table([ids.take(pc.list_parent_indices(lists)), lists.flatten()], ["id", "term"]).group_by(["id", "term"]).aggregate([([], "count_all")])
                yield from each.select(["id", "term", "count_all"]).to_batches()

        counts = texts.select("id", self.terms(F.coalesce("text", F.lit(""))).alias("t")).mapInArrow(count, "id long, term string, count_all long")
        raw = counts.join(self.vocabulary, "term").select("id", "tid", F.startswith("term", F.lit("w:")).alias("word"), ((1 + F.ln("count_all")) * F.col("idf")).alias("raw"))
        square = lambda part: F.sum(F.when(part, F.col("raw") * F.col("raw")))
        whole = raw.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tid", "word", "raw"))).alias("s"), square(F.col("word")).alias("words"), square(~F.col("word")).alias("chars"))
        x = F.transform("s", lambda s: (s["raw"] / F.sqrt(F.when(s["word"], F.col("words")).otherwise(F.col("chars")))).cast("float"))
        return whole.select("id", F.transform("s", lambda s: s["tid"]).alias("tid"), x.alias("x"))

    def _encode_blocks(self, df: DataFrame, text: str) -> DataFrame:
        rows = saved(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
        tiles = decompose.tiles(saved(self._weights(rows.select(F.col("_row").alias("id"), F.col(text).alias("text"))), "weights"), self.size, self.sizes)
        width = self.width

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    v = np.frombuffer(m.as_buffer(), np.float32).reshape(-1, width).astype(float)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["_row", "vector"])

        found = decompose.products(tiles, self.vectors, width).select("ids", "m").mapInArrow(unpacked, "_row long, vector array<double>")
        none = F.array_repeat(F.lit(0.0), width)
        return rows.join(found, "_row", "left").withColumn("vector", F.coalesce("vector", none)).drop("_row")

    def _decomposed(self, termed: DataFrame, k: int) -> np.ndarray:
        """The leading k right singular vectors of the weights (texts x terms), columns of unit length.

        Subspace iteration: each pass multiplies the terms' vectors by the weights and their transpose, and
        then makes the columns orthogonal on the driver. Weights of up to MOST_HELD bytes are multiplied
        there too; more stay in a table, whose tasks give one matrix each.
        """
        size, held = len(self.weight), termed.sparkSession.sparkContext.broadcast(self.weight)

        def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [_weights(t, held.value) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float32()))], ["at", "x"])

        sparse = saved(termed.mapInArrow(weights, "at array<int>, x array<float>"), "weights")
        total = sparse.agg(F.sum(F.size("at").cast("long"))).first()[0] or 0
        local = 8 * total <= MOST_HELD
        dealt = None if local else saved(sparse.repartition(int(total // TASK_WEIGHTS + 1)), "dealt")
        squared = _squared_here(sparse.toArrow(), size) if local else lambda w: self._squared(dealt, int(total // TASK_WEIGHTS + 1), w)
        w = np.linalg.qr(decompose.start(0, size, min(k + SPARE, size)).astype(float))[0]
        for _ in range(PASSES):
            w = np.linalg.qr(squared(w))[0]
        values, turn = np.linalg.eigh(w.T @ squared(w))
        forget(sparse, *([] if local else [dealt]))
        top = np.argsort(-values)[:k]
        top = top[values[top] > 1e-6 * values.max()]
        return (w @ turn[:, top]).astype(np.float32)

    def _squared(self, dealt: DataFrame, tasks: int, w: np.ndarray) -> np.ndarray:
        """The product of the weights' transpose, the weights and w, from tasks that hold w."""
        vectors = dealt.sparkSession.sparkContext.broadcast(w.astype(np.float32))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, out = vectors.value, None
            for batch in batches:
                at, x, ends = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), batch.column(0).offsets.to_numpy()
                ends, row = ends - ends[0], 0
                while row < batch.num_rows:
                    to = max(row + 1, int(np.searchsorted(ends, ends[row] + LOT, "right")) - 1)
                    i, y, owner = at[ends[row] : ends[to]], x[ends[row] : ends[to]], np.repeat(np.arange(to - row), np.diff(ends[row : to + 1]))
                    row = to
                    if not len(i):
                        continue
                    out = np.zeros_like(v) if out is None else out
                    texts = np.zeros((owner[-1] + 1, v.shape[1]), np.float32)
                    rows, sums = decompose.summed_by(owner, v[i] * y[:, None])
                    texts[rows] = sums
                    order = np.argsort(i, kind="stable")
                    terms, sums = decompose.summed_by(i[order], texts[owner[order]] * y[order, None])
                    out[terms] += sums
            for a in range(0, 0 if out is None else len(out), BLOCK_TERMS):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([out[a : a + BLOCK_TERMS].tobytes()], pa.binary())], ["a", "m"])

        z, parts = np.zeros(w.shape), dealt.mapInArrow(part, "a long, m binary")
        for r in (parts if tasks <= self.sizes.merged else decompose.added(parts, ["a"])).toLocalIterator():
            got = np.frombuffer(r["m"], np.float32).reshape(-1, w.shape[1])
            z[r["a"] : r["a"] + len(got)] += got
        vectors.unpersist()
        return z

    def encode(self, df: DataFrame, text: str = "text") -> DataFrame:
        spark = df.sparkSession
        python_ready(spark)
        if self.vocabulary is not None:
            return self._encode_blocks(df, text)
        held = spark.sparkContext.broadcast((self.weight, self.projection))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, projection = held.value
            for batch in batches:
                out = []
                for terms in batch.column(batch.num_columns - 1).to_pylist():
                    got = _weights(terms, weight)
                    v = np.array(list(got.values())) @ projection[list(got)] if got else np.zeros(projection.shape[1])
                    out.append((v / max(np.linalg.norm(v), 1e-12)).astype(float))
                columns = [*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "vector"])

        # a map over batches, not a column expression: the optimizer may move those into lambdas, where no UDF can run
        schema = StructType([*df.schema.fields, StructField("vector", ArrayType(DoubleType()))])
        return df.select("*", self.terms(F.coalesce(F.col(text), F.lit(""))).alias("_terms")).mapInArrow(run, schema)


def _squared_here(weights: pa.Table, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """The product of the weights' transpose, the weights and a matrix, from weights in memory; a thread for each few columns."""
    lists, threads = weights["at"].combine_chunks(), 8
    at, x = lists.flatten().to_numpy(), weights["x"].combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(at, kind="stable")

    def added(into: np.ndarray, to: np.ndarray, of: np.ndarray, source: np.ndarray, by: np.ndarray) -> np.ndarray:
        for a in range(0, len(to), LOT):
            rows, sums = decompose.summed_by(to[a : a + LOT], source[of[a : a + LOT]] * by[a : a + LOT, None])
            into[rows] += sums
        return into

    def some(v: np.ndarray) -> np.ndarray:
        y = added(np.zeros((len(lists), v.shape[1]), np.float32), owner, at, v, x)
        return added(np.zeros((size, v.shape[1]), np.float32), at[order], owner[order], y, x[order])

    def squared(w: np.ndarray) -> np.ndarray:
        with ThreadPoolExecutor(threads) as pool:
            return np.concatenate(list(pool.map(some, np.array_split(np.ascontiguousarray(w, np.float32), min(threads, w.shape[1]), axis=1))), axis=1).astype(float)

    return squared


def _numbering() -> list[Column]:
    """Terms are numbered in this order, which deals frequent ones evenly over blocks."""
    return [F.xxhash64("term"), F.col("term")]


def _weights(terms, weight: dict[str, tuple[int, float]]) -> dict[int, float]:
    """Unit tf-idf weights by column; words and characters are scaled apart."""
    counts: dict[str, int] = {}
    for t in terms:
        if t in weight:
            counts[t] = counts.get(t, 0) + 1
    out: dict[int, float] = {}
    for mark in ("w:", "c:"):
        part = {weight[t][0]: (1 + np.log(c)) * weight[t][1] for t, c in counts.items() if t.startswith(mark)}
        norm = np.sqrt(sum(x * x for x in part.values()))
        out |= {k: float(x / norm) for k, x in part.items()}
    return out


def _encoded(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """df with ``vector`` from a function of texts, run over batches in Python workers."""
    python_ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(encode(batch.column(batch.num_columns - 1).to_pylist()), float) if batch.num_rows else np.zeros((0, 1))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(v), pa.list_(pa.float64()))], [*batch.schema.names[:-1], "vector"])

    schema = StructType([*df.schema.fields, StructField("vector", ArrayType(DoubleType()))])
    return df.select("*", F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


class SentenceEmbedder:
    """Unit vectors of a sentence encoder that the user brings: ``encode(texts)`` gives one row a text. It is sent to the workers, so it must pickle, or load its model there."""

    def __init__(self, encode: Callable[[list[str]], np.ndarray], name: str = "sentence"):
        self.function, self.name = encode, name

    def fit(self, df: DataFrame, text: str = "text") -> SentenceEmbedder:
        return self

    def encode(self, df: DataFrame, text: str = "text") -> DataFrame:
        return _encoded(df, text, self.function)

    def semantic(self, vector: Column) -> Column:
        return vector


class HybridEmbedder:
    """Two embedders' vectors side by side, scaled so that the cosine is their weighted mean: ``weight`` for meaning, the rest for words."""

    name = "hybrid"

    def __init__(self, meaning: Embedder, words: Embedder, weight: float = 0.8):
        self.meaning, self.words, self.weight, self.split = meaning, words, weight, None

    def fit(self, df: DataFrame, text: str = "text") -> HybridEmbedder:
        self.meaning, self.words = self.meaning.fit(df, text), self.words.fit(df, text)
        return self

    def encode(self, df: DataFrame, text: str = "text") -> DataFrame:
        scaled = lambda column, share: F.transform(column, lambda x: x * float(np.sqrt(share)))
        one = self.meaning.encode(df, text).withColumnRenamed("vector", "_meaning")
        if self.split is None:
            first = one.select(F.size("_meaning")).first()
            self.split = first[0] if first else 0
        both = self.words.encode(one, text)
        return both.withColumn("vector", F.concat(scaled("_meaning", self.weight), scaled("vector", 1 - self.weight))).drop("_meaning")

    def semantic(self, vector: Column) -> Column:
        return unit(F.slice(vector, 1, self.split))


#: The share of meaning in hybrid vectors, by language.
MEANING = {"en": 0.8, "tr": 0.65}
NAMES = ("tfidf", "hybrid", "minilm", "multilingual")


def get_embedder(name: str = "tfidf", encode: Callable[[list[str]], np.ndarray] | None = None, language: str = "en", fallback: bool = True, **options) -> Embedder:
    """An embedder by name. Sentence encoders and hybrids need ``encode``, since no model weights are here; without it they warn and fall back to TF-IDF, or raise."""
    if name not in NAMES and not name.startswith("st:"):
        raise ValueError(f"unknown embedding {name!r}; there are {', '.join(NAMES)} and st:<model>")
    if name != "tfidf" and encode is None:
        if not fallback:
            raise ValueError(f"{name!r} needs a sentence encoder")
        warnings.warn(f"no sentence encoder for {name!r}; TF-IDF takes its place", stacklevel=2)
    elif name == "hybrid":
        return HybridEmbedder(SentenceEmbedder(encode), TfidfEmbedder(**options), MEANING.get(language, MEANING["en"]))
    elif name != "tfidf":
        return SentenceEmbedder(encode, name)
    return TfidfEmbedder(**options)
