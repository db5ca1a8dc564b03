"""Chat formatting with Spark expressions: turns become marked, reversible text with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, ROLE_END, TURN_END = "### ", ": ", "</turn>"
# Control strings and how they are written inside texts and roles; the backslash comes first when escaping, last when reading.
ESCAPES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))
ROLE_ESCAPES = ((":", "\\3"), ("\n", "\\4"))
SEGMENT_TURNS = 256


def escape(text: Column, role: bool = False) -> Column:
    for control, written in (*ESCAPES, *(ROLE_ESCAPES if role else ())):
        text = F.replace(text, F.lit(control), F.lit(written))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for control, written in reversed((*ESCAPES, *(ROLE_ESCAPES if role else ()))):
        text = F.replace(text, F.lit(written), F.lit(control))
    return text


def _pieces(turns: Column, loss_role: str) -> Column:
    """Pieces (text, in_loss) of ordered turns: header when the role changes, then text and end mark of every turn."""

    def of_turn(turn: Column, i: Column) -> Column:
        merged = (i > 0) & (F.get(turns, i - 1)["role"] == turn["role"])
        header = F.when(merged, F.lit("")).otherwise(F.concat(F.lit(HEADER), escape(turn["role"], role=True), F.lit(ROLE_END)))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("in_loss"))
        return F.array(piece(header, F.lit(False)), piece(escape(turn["text"]), turn["role"] == loss_role), piece(F.lit(TURN_END), F.lit(False)))

    return F.flatten(F.transform(turns, of_turn))


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted text and its pieces (text, in_loss), whose texts joined give the formatted text.

    A conversation's rows are ordered by (turn, role, text), nulls first; null texts and roles count as empty, and rows with
    a null conv_id form one conversation. Adjacent turns of one role are merged under one header; each turn keeps its own
    end mark, so merging loses nothing. The loss mask covers the escaped text of each turn of `loss_role`, no marks. Repeated
    rows are turns of their own. Other columns are ignored; an empty table gives an empty result. Turns are formatted in
    runs of 256 turn numbers, so that only finished runs of a long conversation meet in its row.
    """
    turns = conversations.select(
        "conv_id", F.floor(F.col("turn") / SEGMENT_TURNS).alias("run"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"),
    )
    runs = turns.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    runs = runs.select("conv_id", F.struct(
        "run", F.get("turns", F.lit(0))["role"].alias("first_role"), F.element_at("turns", -1)["role"].alias("last_role"),
        _pieces(F.col("turns"), loss_role).alias("pieces"),
    ).alias("part"))
    chats = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    def joined(part: Column, i: Column) -> Column:
        merged = (i > 0) & (F.get(F.col("parts"), i - 1)["last_role"] == part["first_role"])
        return F.when(merged, F.slice(part["pieces"], F.lit(2), F.size(part["pieces"]))).otherwise(part["pieces"])

    chats = chats.select("conv_id", F.flatten(F.transform("parts", joined)).alias("pieces"))
    return chats.select("conv_id", F.array_join(F.col("pieces")["text"], "").alias("formatted"), "pieces")


def read_chats(formatted: str | Column) -> Column:
    """The turns (role, text) of a formatted text, the inverse of format_chats."""
    column = F.col(formatted) if isinstance(formatted, str) else formatted
    blocks = F.split(column, HEADER)
    blocks = F.slice(blocks, F.lit(2), F.size(blocks))

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, ROLE_END, 1), role=True)
        texts = F.split(F.substring(block, F.locate(ROLE_END, block) + len(ROLE_END), F.length(block)), TURN_END)
        texts = F.slice(texts, F.lit(1), F.size(texts) - 1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(pieces: str | Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["in_loss"]), lambda p: unescape(p["text"])), "")
