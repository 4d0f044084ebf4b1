"""Theme discovery: prototypes, clusters, centroids, keywords, kinds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.lexicon import ENGLISH, Language
from ..functions.ranking import numbered
from ..functions.shared import forget, saved
from ..functions.text import dot, fold, tr_lower, unit
from ..functions.workers import python_ready
from .linkage import closest, linked, matrix

#: Most vectors clustered in one place; beyond, rounds of merges come first. Most centers that are sent to every worker.
DIRECT, MICRO = 6000, 3000
#: Similarities this close count as equal.
SAME = 1e-12
#: Terms looked at first for each keyword wanted; more are where these overlap.
LOOK = 20
#: Bytes of text whose terms are counted in one task. Rows a task holds while it looks for each theme's strongest terms.
BYTES_A_TASK, HELD = 16 << 20, 200_000
OTHER = -1


def centroids(vectors: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """(label, centroid, size): unit mean vectors. Sums run by label and dimension, with partial aggregation."""
    flat = vectors.select(label, F.posexplode(vector).alias("k", "x"))
    sums = flat.groupBy(label, "k").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    rows = sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"), F.max("n").alias("size"))
    return rows.select(label, unit(F.col("mean")).alias("centroid"), "size")


def nearest(vectors: DataFrame, centers: DataFrame, floor: float, key: str = "label", vector: str = "vector") -> DataFrame:
    """vectors with (key, similarity) of the most similar center, null below the floor; of equals the smallest key.

    One matrix product a batch. Up to MICRO centers go to every worker; more are dealt into cells with the vectors, which are written for that.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    kind = centers.schema[key].dataType
    held = centers.select(key, "centroid").limit(MICRO + 1).toArrow()
    schema = StructType([*vectors.schema.fields, StructField(key, kind), StructField("similarity", DoubleType())])
    if held.num_rows > MICRO:
        names = saved(numbered(saved(centers.select(key, "centroid"), "centers"), [], [F.col(key)], "_c"), "centers")
        rows = saved(vectors.withColumn("_row", F.monotonically_increasing_id()), "vectors")
        found = closest(rows.filter(F.size(vector) > 0).select(F.col("_row").alias("id"), F.col(vector).alias("v")), names.select(F.col("_c").alias("id"), F.col("centroid").alias("v")), apart=False)
        named = found.join(names.select(F.col("_c").alias("other"), key), "other").select(F.col("id").alias("_row"), key, "similarity")
        return rows.join(named, "_row", "left").withColumn(key, F.when(F.col("similarity") >= floor, F.col(key))).select(*schema.names)
    held = held.sort_by(key)
    c = spark.sparkContext.broadcast(matrix(held["centroid"]) if held.num_rows else None)
    names, arrow = held[key].combine_chunks(), to_arrow_schema(schema)
    at = vectors.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, given = batch.num_rows, batch.column(at)
            x, k = np.full(n, np.nan), np.zeros(n, np.int64)
            there = np.flatnonzero(pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False)) if c.value is not None else []
            if len(there):
                s = matrix(given.take(pa.array(there))) @ c.value.T
                k[there] = (s >= s.max(axis=1, keepdims=True) - SAME).argmax(axis=1)
                x[there] = s[np.arange(len(s)), k[there]]
            best, label = pa.array(x, mask=np.isnan(x)), names.take(pa.array(k, mask=~(x >= floor))) if len(names) else pa.nulls(n, names.type)
            yield pa.RecordBatch.from_arrays([*batch.columns, label.cast(arrow.field(key).type), best], schema=pa.schema([*batch.schema, arrow.field(key), arrow.field("similarity")]))

    return vectors.mapInArrow(run, schema)


def cohesion(vectors: DataFrame, centers: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """(label, cohesion): mean cosine to the centroid."""
    return vectors.join(F.broadcast(centers) if centers.count() <= MICRO else centers, label).groupBy(label).agg(F.avg(dot(unit(F.col(vector)), F.col("centroid"))).alias("cohesion"))


def average_linkage(sums: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Labels by average-linkage clustering of unit vectors under cosine distance, cut at the threshold.

    The mean distance of two clusters is 1 - <S, T> / (n m) for vector sums S, T and sizes n, m, so
    merging keeps sums only. Nearest-neighbour chains; average linkage never inverts.
    """
    sums, sizes = sums.astype(float).copy(), sizes.astype(float).copy()
    n = len(sums)
    parent, alive, chain = np.arange(n), np.ones(n, bool), []
    merges: list[tuple[float, int, int]] = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        at = chain[-1]
        distance = 1 - sums @ sums[at] / (sizes * sizes[at])
        distance[~alive] = np.inf
        distance[at] = np.inf
        to = int(distance.argmin())
        if len(chain) > 1 and distance[chain[-2]] <= distance[to]:
            to = chain[-2]
            chain = chain[:-2]
            merges.append((float(distance[to]), min(at, to), max(at, to)))
            keep, gone = merges[-1][1:]
            sums[keep] += sums[gone]
            sizes[keep] += sizes[gone]
            alive[gone] = False
        else:
            chain.append(to)
    for height, a, b in merges:
        if height < threshold:
            parent[b] = a
    for _ in range(n):
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    return np.unique(parent, return_inverse=True)[1]


def tidy(labels: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, least: int, reassign: float) -> np.ndarray:
    """Clusters below the least size go to the nearest large one, if similar enough, else to OTHER; labels by size, ties by the first member."""
    total = np.bincount(labels, sizes)
    big = np.flatnonzero(total >= least)
    out = labels.copy()
    small = ~np.isin(labels, big)
    if small.any():
        if len(big):
            c = np.stack([(vectors[labels == b] * sizes[labels == b, None]).sum(0) for b in big])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            similarity = vectors[small] @ c.T
            out[small] = np.where(similarity.max(1) >= reassign, big[similarity.argmax(1)], OTHER)
        else:
            out[small] = OTHER
    found = [x for x in np.unique(out) if x != OTHER]
    order = sorted(found, key=lambda x: (-sizes[out == x].sum(), int(np.flatnonzero(out == x)[0])))
    renamed = {x: k for k, x in enumerate(order)} | {OTHER: OTHER}
    return np.array([renamed[x] for x in out])


def _tidy_table(placed: DataFrame, least: int, reassign: float) -> DataFrame:
    """``tidy`` for a written table (id, v, label): (id, cluster)."""
    of = lambda df: df.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    big = saved(of(placed).filter(F.col("size") >= least).select("label"), "large")
    inside = placed.join(big, "label")
    centers = saved(centroids(inside, "label", "v").select("label", "centroid"), "large-centers")
    outside = saved(placed.join(big, "label", "left_anti").select("id", "v"), "small")
    moved = nearest(outside, centers, reassign, "label", "v").select("id", "label")
    labels = saved(inside.select("id", "label").unionByName(moved), "labels")
    ranks = numbered(saved(of(labels.filter("label is not null")), "sizes"), [], [F.desc("size"), F.col("first")], "cluster")
    return labels.join(ranks.select("label", F.col("cluster").cast("int").alias("cluster")), "label", "left").select("id", F.coalesce("cluster", F.lit(OTHER)).alias("cluster"))


def cluster_vectors(vectors: DataFrame, threshold: float, least: int, reassign: float = 0.5, key: str = "id") -> DataFrame:
    """(key, cluster) by average linkage, small clusters dissolved. At most DIRECT vectors are clustered on the driver; more by rounds of merges, to the same clusters."""
    n = vectors.count()
    spark = vectors.sparkSession
    if n == 0:
        return spark.createDataFrame([], f"{key} {dict(vectors.dtypes)[key]}, cluster int")
    if n <= DIRECT:
        rows = vectors.select(key, unit(F.col("vector")).alias("v")).orderBy(key).toArrow()
        keys, v = rows[key].to_pylist(), rows["v"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        sizes = np.ones(n)
        labels = average_linkage(v, sizes, threshold) if n >= 3 else np.zeros(n, int)
        labels = tidy(labels, v, sizes, least, reassign)
        return spark.createDataFrame([(tuple(k.values()) if isinstance(k, dict) else k, int(x)) for k, x in zip(keys, labels, strict=True)], f"{key} {dict(vectors.dtypes)[key]}, cluster int")
    rows = saved(numbered(saved(vectors.select(F.col(key).alias("_key"), unit(F.col("vector")).alias("v")), "units"), [], [F.col("_key")], "_row"), "units")
    groups = saved(rows.groupBy("v").agg(F.min("_row").alias("id"), F.count(F.lit(1)).alias("n")), "groups")
    roots, _ = linked(groups, threshold, DIRECT, average_linkage)
    label = F.coalesce("root", "id").alias("label")
    placed = saved(rows.join(groups.select("v", "id"), "v").join(roots, F.col("id") == F.col("gone"), "left").select("_key", "v", F.col("_row"), label), "placed")
    done = _tidy_table(placed.select(F.col("_row").alias("id"), "v", "label"), least, reassign)
    return placed.select("_key", "_row").join(done, F.col("_row") == F.col("id")).select(F.col("_key").alias(key), "cluster")


def cue_rates(segments: DataFrame, lang: Language = ENGLISH) -> DataFrame:
    """(theme_id, bug, feature_request, pricing): shares of texts with such a cue."""
    said = fold(F.col("text")) if lang.code == "tr" else F.lower("text")
    rate = lambda patterns: F.avg(said.rlike("(?U)" + "|".join(patterns)).cast("double"))
    return segments.groupBy("theme_id").agg(*[rate(p).alias(k) for k, p in lang.cues.items()])


def kind(mean_sentiment: Column) -> Column:
    """bug, feature_request, pricing, praise or ux from cue rates and the mean sentiment."""
    bug, ask, price, s = F.col("bug"), F.col("feature_request"), F.col("pricing"), mean_sentiment
    return (
        F.when(bug.isNull(), "other").when(price >= 0.35, "pricing").when((s >= 0.35) & (bug < 0.2), "praise").when(bug >= F.greatest(F.lit(0.3), ask), "bug").when((bug >= F.greatest(F.lit(0.2), ask)) & (s < -0.2), "bug").when(ask >= 0.3, "feature_request").otherwise("ux")
    )


def overlap(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def leading(terms: DataFrame, k: int) -> DataFrame:
    """The rows (theme_id, term, weight, ...) that can be among their theme's k strongest, equal ones by term: each task keeps k or a few more a theme of what it reads, without sorting it whole."""
    python_ready(terms.sparkSession)

    def strongest(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("theme_id", "ascending"), ("weight", "descending"), ("term", "ascending")])
        theme, at = pc.dictionary_encode(rows["theme_id"], null_encoding="encode").combine_chunks().indices.to_numpy(), np.arange(rows.num_rows)
        begin = np.maximum.accumulate(np.where(np.diff(theme, prepend=-1) != 0, at, 0))
        return rows.filter(pa.array(at - begin < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > HELD:
                held = strongest(pa.Table.from_batches(held)).to_batches()
                if sum(b.num_rows for b in held) > HELD // 2:  # many themes
                    yield from held
                    held = []
        if any(b.num_rows for b in held):
            yield from strongest(pa.Table.from_batches(held)).to_batches()

    return terms.mapInArrow(run, terms.schema)


def keywords(segments: DataFrame, stop: tuple[str, ...] = (), top: int = 6, lang: Language = ENGLISH) -> DataFrame:
    """(theme_id, term, weight): the strongest one- and two-word terms of each theme by class-based TF-IDF.

    Texts are dealt into pieces of BYTES_A_TASK, their counts into as many parts by term, so a task holds no more in a large table or for a theme with most of the terms.
    """
    spark = segments.sparkSession
    found = F.regexp_extract_all(tr_lower(F.col("text")), F.lit(r"(?U)([^\W\d_]{2,})"), F.lit(1)) if lang.code == "tr" else F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z][a-z-]+)\b"), F.lit(1))
    words = F.filter(found, lambda w: ~w.isin(*stop) if stop else F.lit(True))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.expr("cast(array() as array<string>)"))
    n, size = segments.groupBy("theme_id").agg(F.sum(F.octet_length("text")).alias("bytes")).agg(F.count(F.lit(1)), F.sum("bytes")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-(size or 0) // BYTES_A_TASK))
    piece = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    pieces = segments.select("theme_id", "text", piece.alias("_piece")).repartitionById(parts, "_piece").select("_piece", "theme_id", words.alias("w"))
    counted = pieces.select("_piece", "theme_id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("_piece", "theme_id", "term").count()
    tf = counted.repartition(parts, "term").groupBy("theme_id", "term").agg(F.sum("count").alias("count"))
    df = F.count(F.lit(1)).over(Window.partitionBy("term"))  # one row a theme that has the term
    terms = saved(tf.withColumn("df", df).select("theme_id", "term", ((1 + F.ln("count")) * (F.ln((1 + n) / (1 + F.col("df"))) + 1)).alias("raw")), "terms")
    norms = terms.groupBy(F.col("theme_id").alias("_theme")).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"), F.count(F.lit(1)).alias("terms"))
    weight = F.col("raw") / F.col("_norm") * F.when(F.contains("term", F.lit(" ")), 1.6).otherwise(1.0)
    norm = terms.join(F.broadcast(norms), F.col("theme_id").eqNullSafe(F.col("_theme"))).select("theme_id", "term", weight.alias("weight"), "terms")
    by = Window.partitionBy("theme_id").orderBy(F.desc("weight"), "term")
    best = leading(norm, LOOK * top).withColumn("k", F.row_number().over(by)).filter(F.col("k") <= LOOK * top)
    listed = best.groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("k", "term", "weight"))).alias("all"), F.max("terms").alias("terms"))  # at most LOOK x top terms a theme
    empty = F.expr("cast(array() as array<struct<k:int,term:string,weight:double>>)")
    chosen = F.aggregate("all", empty, lambda acc, x: F.when((F.size(acc) < top) & ~F.exists(acc, lambda y: overlap(y["term"], x["term"])), F.array_append(acc, x)).otherwise(acc))
    rows = [(r["theme_id"], x["term"], x["weight"], len(r["chosen"]) < top and r["terms"] > LOOK * top) for r in listed.select("theme_id", "terms", chosen.alias("chosen")).collect() for x in r["chosen"]]  # at most top rows a theme
    found = {(t, w): x for t, w, x, _ in rows}
    short = {t for t, _, _, more in rows if more}
    while short:  # themes whose best terms nearly all overlap: a further term each, from all there are
        held = {t: [w for u, w in found if u == t] for t in short}
        known = spark.createDataFrame(list(held.items()), f"theme_id {dict(norm.dtypes)['theme_id']}, held array<string>")
        free = norm.join(F.broadcast(known), "theme_id").filter(~F.exists("held", lambda y: overlap(y, F.col("term"))))
        more = leading(free.select("theme_id", "term", "weight"), 1).groupBy("theme_id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "term")).alias("x")).select("theme_id", "x.term", (-F.col("x.w")).alias("weight")).collect()
        found |= {(r["theme_id"], r["term"]): r["weight"] for r in more}
        short = {r["theme_id"] for r in more if len(held[r["theme_id"]]) + 1 < top}
    forget(terms)
    return spark.createDataFrame([(t, w, x) for (t, w), x in found.items()], f"theme_id {dict(norm.dtypes)['theme_id']}, term string, weight double")
