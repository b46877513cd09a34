"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role become one block, in which the texts stay apart by a mark, so that nothing is lost.

    <turn role>text</turn>            one turn
    <turn role>text<next>text</turn>  adjacent turns of one role

Control strings all begin with ``<``, and a text never holds one: ``\\`` is written
``\\e`` and ``<`` is written ``\\l`` (and ``>`` in a role ``\\g``). Undoing ``\\g``, ``\\l``
and then ``\\e`` gives the text back. The output is a list of segments, each with a flag
that says whether it is trained on, and their concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
OPEN, NEXT, CLOSE = "<turn ", "<next>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``(conv_id, formatted, segments array<struct<piece, loss>>)``, one row per conversation.

    Rows are ordered by turn, then role and text (null first). A null role or text is
    read as empty; rows with a null ``conv_id`` form one conversation; repeated rows
    are repeated turns; an empty table gives no rows; other columns are not read.
    """
    one = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    talks = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    count = F.size("turns")
    starts = F.filter(
        F.sequence(F.lit(0), count - 1),
        lambda i: (i == 0) | (F.get(F.col("turns.role"), i) != F.get(F.col("turns.role"), F.greatest(i - 1, F.lit(0)))),
    )
    runs = talks.withColumn("starts", starts).withColumn("ends", F.array_append(F.slice("starts", 2, F.size("starts")), count))

    def block(first: Column, end: Column) -> Column:
        role = F.get(F.col("turns.role"), first)
        texts = F.slice(F.col("turns.text"), first + 1, end - first)
        mark = lambda piece: F.struct(piece.alias("piece"), F.lit(False).alias("loss"))
        said = F.flatten(
            F.transform(texts, lambda t, i: F.array(mark(F.when(i == 0, F.concat(F.lit(OPEN), _escape_role(role), F.lit(">"))).otherwise(F.lit(NEXT))), F.struct(escape(t).alias("piece"), (role == trained_role).alias("loss"))))
        )
        return F.array_append(said, mark(F.lit(CLOSE)))

    segments = F.flatten(F.transform(F.arrays_zip("starts", "ends"), lambda r: block(r["starts"], r["ends"])))
    return runs.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join("segments.piece", "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.split(formatted, CLOSE)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), ">", 1)
        body = F.substr(block, F.lit(len(OPEN) + 2) + F.length(role))
        return F.transform(F.split(body, NEXT), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, read from the output."""
    under = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["piece"]), ""))
    read = formatted.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), under.alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("bigint").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars",
    )
