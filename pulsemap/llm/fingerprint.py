"""Bottom-k sketches of word shingles, in Spark expressions only.

A document's sketch is the ``k`` smallest distinct hashes of its shingles of five words.  Sketches of
parts merge to the sketch of the whole, and two of them estimate resemblance, containment and the number
of distinct shingles.  Words are runs of letters and digits, lower-cased.

Contract: a null text is an empty one, whose sketch is empty; a text of fewer than five words has one
shingle, all of it; very long texts are read whole; two empty sketches resemble each other fully, an empty
and another not at all; equal texts have equal sketches whatever row they stand in; repeated rows follow
one another; ties of ids go by text, rows without an id come first; an empty table gives no rows; extra
columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, WORDS = 128, 5
#: Rows aimed at for each stretch of neighbouring ids; the most stretches, whose first ids are one small table; cuts by quantiles.
STRETCH_ROWS, MOST_STRETCHES, CUTS = 1024, 1 << 20, 1024


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """df with the sketch of column ``text`` as array<long> ``name``."""
    hashes = df.withColumn("_words", F.transform(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, words)))
    hashes = hashes.withColumn("_hashes", F.when(F.size("_words") > 0, shingles).otherwise(F.expr("cast(array() as array<bigint>)")))
    return hashes.withColumn(name, F.slice(F.sort_array(F.array_distinct("_hashes")), 1, k)).drop("_words", "_hashes")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the smallest hashes of both that lie in both, 0 to 1."""
    both = merged(a, b, k)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; above, from the place of the k-th hash among all 64-bit values."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash, smallest first."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document beside the next in order of doc_id (equal ids by text; null ids first); the first follows the last.

    Ids are cut at their quantiles, and between two cuts into stretches of equal width, so uneven ids
    spread too. A copy of each stretch's first rows ends the stretch before it, and the neighbours meet
    without a global sort. Only the stretches' first ids form a table of their own, of bounded size. Rows
    of one id stay together.
    """
    probs = [k / CUTS for k in range(CUTS)]
    low, high, n, found = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1)), F.percentile_approx("doc_id", probs, 10 * CUTS)).first()
    low, high = (0, 0) if low is None else (low, high)
    cuts = sorted({low, *(found or [])})
    parts = -(-n // stretch_rows) if n <= stretch_rows * MOST_STRETCHES else MOST_STRETCHES
    cuts = cuts[:: max(1, -(-len(cuts) // max(1, parts)))]
    each = max(1, parts // len(cuts))
    widths = [max(1, -(-(b - a) // each)) for a, b in zip(cuts, [*cuts[1:], high + 1], strict=True)]
    longs = lambda xs: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)")
    key = F.coalesce(F.col("doc_id"), F.lit(low))
    # the last cut at or below the key, by halving steps
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    nth = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(longs(cuts), at + step) <= F.col("_key")), at + step).otherwise(at))
    placed = docs.withColumn("_key", key).withColumn("_cut", nth)
    past = F.col("_key").cast("decimal(20,0)") - F.element_at(longs(cuts), F.col("_cut")) if max(widths) * each >= 1 << 63 else F.col("_key") - F.element_at(longs(cuts), F.col("_cut"))
    placed = placed.withColumn("_stretch", F.col("_cut").cast("long") * (1 << 32) + F.floor(past / F.element_at(longs(widths), F.col("_cut")) if each > 1 else F.lit(0)).cast("long")).drop("_cut")
    heads = placed.groupBy("_stretch").agg(F.min("_key").alias("_head"))
    order = Window.orderBy("_stretch")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_head", F.coalesce(F.lag("_stretch").over(order), F.max("_stretch").over(whole)).alias("_before"))
    copied = placed.join(F.broadcast(heads), placed["_key"] == heads["_head"], "left").select(
        "doc_id", "text", "_key", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_stretch"), F.lit(False).alias("_copy")))).otherwise(F.array(F.struct(F.col("_stretch"), F.lit(False).alias("_copy")), F.struct(F.col("_before").alias("_stretch"), F.lit(True).alias("_copy"))))).alias("_to")
    )
    dealt = copied.select("doc_id", "text", "_key", F.col("_to._stretch").alias("_stretch"), F.col("_to._copy").alias("_copy")).repartition("_stretch")
    after = Window.partitionBy("_stretch").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "text")
    return (
        with_sketch(dealt, "text", "sketch")
        .withColumns({"next_text": F.lead("text").over(after), "next_sketch": F.lead("sketch").over(after)})
        .filter(~F.col("_copy"))
        .select("doc_id", "text", "sketch", "next_text", "next_sketch")
    )


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Sketches of each document and of its edited text, whose second half comes from the next document."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substr("next_text", F.lit(1), half)))
    return with_sketch(edited.drop("text", "next_text"), "edited", "edited_sketch")
