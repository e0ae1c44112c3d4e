"""Chat formatting with one training example per assistant turn, in DataFrame functions only.

A turn is written as::

    [INST]role[/INST]text</s>\\n

In roles and texts the characters ``\\``, ``<`` and ``[`` are escaped reversibly
(``\\`` as ``\\\\``, ``<`` as ``<\\``, ``[`` as ``[\\``), so that no marker can occur
inside them; one pass over the escaped text restores it.

Prefix-target expansion makes every assistant turn an example of its own, whose
context is all turns before it and whose reply alone is trained.  All examples of
a conversation are prefixes of one formatted text; they are kept as character
ranges into it, so that their number times their length is never written.
``materialise`` cuts the texts out where they are wanted.

Defined results: null text or role is empty; turns go by (turn, role, written text)
with a null turn first; equal rows are equal turns; rows with a null conv_id are one
conversation; a conversation without assistant turns has no examples; a very long
text is a turn like any other; an empty table has no conversations; other columns
are ignored.  A conversation is one row of the result and is put together in one
task, which holds it a few times: at most a few hundred MB of text each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template's control strings.
OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and replies array<struct<turn, context_end, start, end>>.

    Ranges count characters from 0; an example's text is formatted[0:end] and its
    loss mask is [start, end).  A conversation is one output value, so its turns
    meet in one task; nothing larger than a conversation does.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE)).alias("head"),
        escape(text).alias("body"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    head, body = F.length("head").cast("long"), F.length("body").cast("long")
    placed = rows.withColumn("at", F.coalesce(F.sum(head + body + len(CLOSE)).over(before), F.lit(0)).cast("long"))
    reply = F.struct("turn", F.col("at").alias("context_end"), (F.col("at") + head).alias("start"), (F.col("at") + head + body).alias("end"))
    part = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("written"), F.when(F.col("role") == "assistant", reply).alias("reply"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["written"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["reply"].isNotNull()), lambda p: p["reply"]).alias("replies"),
    )


def examples(formatted: DataFrame, *carried: str, outer: bool = False) -> DataFrame:
    """Prefix-target expansion: one row per assistant turn with its ranges and the columns ``carried``.

    With ``outer`` a conversation without assistant turns is one row of no example.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    return formatted.select("conv_id", *carried, explode("replies").alias("example", "r")).select("conv_id", "example", "r.*", *carried)


def trained_text(formatted: DataFrame, *carried: str) -> DataFrame:
    """One row per conversation, conv_id, the (per conversation constant) columns ``carried`` and trained: the replies of its examples, in order, as one text."""
    said = F.col("formatted").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    rows = examples(formatted, "formatted", *carried, outer=True).select("conv_id", *carried, "example", unescape(said).alias("reply"))
    parts = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "reply"))))
    return rows.groupBy("conv_id", *carried).agg(F.array_join(F.transform(parts, lambda p: p["reply"]), "").alias("trained"))


def materialise(formatted: DataFrame) -> DataFrame:
    """The examples with context and reply as texts (the reply is what the loss mask covers)."""
    rows = formatted.select("conv_id", "formatted", F.posexplode("replies").alias("example", "r"))
    context = F.substring("formatted", F.lit(1), F.col("r.start").cast("int"))
    reply = F.substring("formatted", (F.col("r.start") + 1).cast("int"), (F.col("r.end") - F.col("r.start")).cast("int"))
    return rows.select("conv_id", "example", F.col("r.turn").alias("turn"), context.alias("context"), reply.alias("reply"))


def read_back(formatted: DataFrame, *carried: str) -> DataFrame:
    """Turns parsed out of the formatted texts, and the trained replies cut out by their ranges.

    conv_id, turns array<struct<role, text>>, replies_text array<string>, formatted_chars, and the columns ``carried``.
    """
    pieces = F.slice(F.split("formatted", r"</s>\n"), 1, F.size(F.split("formatted", r"</s>\n")) - 1)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p.substr(F.lit(len(OPEN) + 1), F.length(p)), MIDDLE, 1)).alias("role"),
            unescape(p.substr(F.instr(p, MIDDLE) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )
    cut = F.transform("replies", lambda r: unescape(F.col("formatted").substr((r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), cut.alias("replies_text"), F.length("formatted").cast("long").alias("formatted_chars"), *carried)
