"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of one role become one message
whose texts stay apart by a part mark; messages are concatenated as

    <|turn|>ROLE<|text|>TEXT<|part|>TEXT<|end|><|turn|>...

Texts and roles are escaped: a backslash is doubled, and one is put after the first character of every
control string (those above and those of common other templates), so no control string survives inside a
text and the original comes back exactly.  ``loss`` lists (start, length) in code points of the formatted
string, one span for each assistant text.

Contract: a null text or role is an empty one; a null turn sorts first; rows with equal turns are ordered
by role, then text, and all count; an empty table gives no conversations; extra columns are dropped. Texts
of any length are kept whole. A conversation is one row, put together in one task in time near linear in its
turns, so it has to fit into a string of 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
LOSS_ROLE = "assistant"
#: A character of a control string's head, seen before the rest of it.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS|start_of_turn|end_of_turn)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def sums_before(numbers: Column, block: int = 256) -> Column:
    """For each number the sum of those before it. Appending copies an array, so sums run in blocks and over the blocks' ends."""
    nothing = lambda: F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("before"))
    run = lambda xs: F.aggregate(xs, nothing(), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")))

    def joined(blocks: Column) -> Column:
        firsts = run(F.transform(blocks, lambda b: b["sum"]))["before"]
        return F.flatten(F.zip_with(blocks, firsts, lambda b, first: F.transform(b["before"], lambda x: x + first)))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda k: run(F.slice(xs, k * block + 1, block)))
    return bound(numbers, lambda xs: F.when(F.size(xs) == 0, F.expr("cast(array() as array<int>)")).otherwise(bound(cut(xs), joined)))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss) for each conversation."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    runs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    runs = runs.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])))
    merged = runs.select(
        "conv_id",
        F.transform(
            "at",
            lambda first, k: F.struct(
                escaped(F.get("t", first)["role"]).alias("role"),
                (F.get("t", first)["role"] == LOSS_ROLE).alias("loss"),
                F.transform(F.slice("t", first + 1, F.coalesce(F.get("at", k + 1), F.size("t")) - first), lambda x: escaped(x["text"])).alias("parts"),
            ),
        ).alias("messages"),
    )
    written = merged.select(
        "conv_id",
        "messages",
        F.array_join(F.transform("messages", lambda m: F.concat(F.lit(TURN), m["role"], F.lit(TEXT), F.array_join(m["parts"], PART), F.lit(END))), "").alias("formatted"),
    )
    # every text with what stands before it, so that a running sum gives its place
    places = F.flatten(
        F.transform(
            "messages",
            lambda m: F.transform(
                m["parts"],
                lambda p, k: F.struct(
                    F.when(k == 0, F.length(m["role"]) + len(TURN + TEXT)).otherwise(len(PART)).alias("before"),
                    F.length(p).alias("length"),
                    F.when(k == F.size(m["parts"]) - 1, len(END)).otherwise(0).alias("after"),
                    m["loss"].alias("loss"),
                ),
            ),
        )
    )
    begins = lambda p, at: F.struct((at + p["before"]).alias("start"), p["length"].alias("length"), p["loss"].alias("loss"))
    spans = F.zip_with("places", sums_before(F.transform("places", lambda p: p["before"] + p["length"] + p["after"])), begins)
    lossy = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
    return written.withColumn("places", places).select("conv_id", "formatted", lossy.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted string: the turns before merging and escaping."""
    messages = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, F.length(formatted) + 1)
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                F.split(F.regexp_extract(m, r"(?s)<\|text\|>(.*)<\|end\|>$", 1), r"<\|part\|>", -1),
                lambda p: F.struct(unescaped(F.substring_index(m, TEXT, 1)).alias("role"), unescaped(p).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, loss: Column, block: int = 256) -> Column:
    """The text under the loss mask, unescaped. A string is searched from its start for each place, so spans, which are in order, are cut out of pieces that hold a block of them."""

    def cut(spans: Column) -> Column:
        first, last = F.get(spans, F.lit(0))["start"], F.element_at(spans, -1)
        piece = F.substr(formatted, first + 1, last["start"] + last["length"] - first)
        return bound(piece, lambda p: F.transform(spans, lambda s: unescaped(F.substr(p, s["start"] - first + 1, s["length"]))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(loss) - 1) / block).cast("int")), lambda k: cut(F.slice(loss, k * block + 1, block)))
    return F.when(F.size(loss) == 0, "").otherwise(F.array_join(F.flatten(blocks), ""))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: both texts are made of another template's control strings."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
