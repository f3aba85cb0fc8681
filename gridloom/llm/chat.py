"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and joined: adjacent turns of one role merge
into one block, in which a separator marks where a turn ends, so nothing is lost. The template is

    <|start:role|>first text<|turn|>next text of the same role<|end|>

Inside texts and roles, control strings (these marks, and those of other common templates: </s>, <s>,
[INST], [/INST]) are broken up by an escape mark after their first character, and the escape mark
itself is escaped, so that parsing gives back every text exactly.

The join is associative: a piece of a conversation is (first role, last role, body without the outer
marks). Turns are first joined in groups of `group` turn numbers and the pieces then joined per
conversation, so that a conversation with very many turns isn't sorted or joined in one go; what one
task must hold at last is the formatted conversation itself, which is the result.

Defined results: a null text or role is empty; turns are ordered by turn (null first), then role and
text, so ties and repeated rows have a fixed order and all stay; rows with a null conv_id form one
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, JOINT = "<|start:", "<|end|>", "<|turn|>"
MARK = "␛"  # the escape mark: MARK + e stands for itself, MARK + c breaks a control string
#: Control strings are recognised by their first character and what follows it.
CONTROL = r"(<(?=\||/?s>)|\[(?=/?INST\])|\|(?=>))"
GROUP = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK + "e")), CONTROL, "$1" + MARK + "c")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "c"), F.lit("")), F.lit(MARK + "e"), F.lit(MARK))


def opened(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("|>"))


def fold(pieces: Column) -> Column:
    """Joins an array of (first, last, body, n) in order into one such struct; every body is copied once.

    Adjacent blocks of one role merge: what stands before a piece depends on the role that the piece before it
    ends with, so all joints are known at once and the bodies are concatenated in one step.
    """
    before = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: p["last"])
    after = F.slice(pieces, 2, F.size(pieces))

    def joined(role, piece):
        joint = F.when(role == piece["first"], F.lit(JOINT)).otherwise(F.concat(F.lit(CLOSE), opened(piece["first"])))
        return F.concat(joint, piece["body"])

    head, end = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)
    rest = F.array_join(F.zip_with(before, after, joined), "")
    return F.struct(
        head["first"].alias("first"),
        end["last"].alias("last"),
        F.concat(head["body"], rest).alias("body"),
        F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n"),
    )


def piece(x: Column) -> Column:
    return F.struct(x["first"].alias("first"), x["last"].alias("last"), x["body"].alias("body"), x["n"].alias("n"))


def formatted(turns: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted."""
    role = escape(F.coalesce("role", F.lit("")))
    text = escape(F.coalesce("text", F.lit("")))
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / group).alias("part"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("first"),
            text.alias("body"),
            role.alias("last"),
            F.lit(1).cast("long").alias("n"),
        ).alias("one"),
    )
    parts = rows.groupBy("conv_id", "part").agg(fold(F.transform(F.sort_array(F.collect_list("one")), piece)).alias("p"))
    whole = parts.groupBy("conv_id").agg(
        fold(
            F.transform(F.sort_array(F.collect_list(F.struct(F.col("part"), F.col("p")))), lambda x: piece(x["p"]))
        ).alias("p")
    )
    return whole.select(
        "conv_id", F.col("p.n").alias("n_turns"), F.concat(opened(F.col("p.first")), F.col("p.body"), F.lit(CLOSE)).alias("formatted")
    )


def parsed(formatted_text: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss); loss marks the assistant's."""
    blocks = F.split(formatted_text, r"<\|end\|>", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block):
        role_end = F.locate("|>", block)
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), role_end - len(OPEN) - 1))
        texts = F.split(F.substring(block, role_end + 2, F.char_length(block)), r"<\|turn\|>", -1)
        return F.transform(
            texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), (role == "assistant").alias("loss"))
        )

    return F.flatten(F.transform(blocks, turns))


def read_back(table: DataFrame) -> DataFrame:
    """conv_id, turns (parsed from `formatted`), formatted."""
    return table.select("conv_id", parsed(F.col("formatted")).alias("turns"), "formatted")


def digests(table: DataFrame) -> DataFrame:
    """What the formatted text says, as counts and digests."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read_back(table).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
