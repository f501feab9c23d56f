"""Preference formatting, in DataFrame functions only.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns (equal role and text, in order) is rendered once as the prompt; what follows
in each is rendered as its completion, with a mask: the character spans of the
completion that a loss may see, which are the assistant's texts and their end
marks.  The layout of a turn is MARKS[0] role newline text MARKS[1] newline.

Both sides of a pair are gathered by one aggregate on the pair, so there is one
shuffle and no join; what a task holds at once is one rendered pair.

Defined results: turns are ordered by turn number (null first), then role, then
text; a null role or text renders as empty, but equals only null; a side that is
missing has no turns, so the prompt is empty; rows without a pair or side belong
to no pair; a turn that is repeated is rendered as often as it comes; equal
conversations leave both completions empty (`identical`); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that begin and end a turn.
MARKS = ("<|im_start|>", "<|im_end|>")
#: Roles whose texts are not masked.
LEARNED = ("assistant",)


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(MARKS[0]), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(MARKS[1] + "\n"))), "")


def _spans(turns: Column) -> Column:
    """Spans [start, end) of learned texts with their end marks, in the rendered turns."""
    role, text = (lambda t: F.coalesce(t["role"], F.lit(""))), (lambda t: F.coalesce(t["text"], F.lit("")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(MARKS[0]) + F.length(role(t)) + 1
        end = start + F.length(text(t)) + len(MARKS[1])
        one = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + 1).cast("int").alias("at"), F.when(role(t).isin(*LEARNED), F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask, prompt_turns,
    chosen_turns, rejected_turns, identical) of turns (pair_id, side, turn, role,
    text), side being `chosen` or `rejected`."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, turn))).alias(name)
    pairs = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(side("chosen"), side("rejected"))
    both = F.least(F.size("chosen"), F.size("rejected"))
    differs = lambda i: ~(F.col("chosen")[i]["role"].eqNullSafe(F.col("rejected")[i]["role"]) & F.col("chosen")[i]["text"].eqNullSafe(F.col("rejected")[i]["text"]))
    places = F.when(both > 0, F.sequence(F.lit(0), both - 1)).otherwise(F.array().cast("array<int>"))
    cut = pairs.withColumn("prompt_turns", F.coalesce(F.array_min(F.filter(places, differs)), both))
    rest = lambda name: F.slice(F.col(name), F.col("prompt_turns") + 1, F.greatest(F.size(name) - F.col("prompt_turns"), F.lit(0)))
    parted = cut.select(
        "pair_id",
        "prompt_turns",
        F.slice("chosen", F.lit(1), F.col("prompt_turns")).alias("shared"),
        rest("chosen").alias("c"),
        rest("rejected").alias("r"),
    )
    return parted.select(
        "pair_id",
        _render(F.col("shared")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_mask"),
        _spans(F.col("r")).alias("rejected_mask"),
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        F.size("c").cast("long").alias("chosen_turns"),
        F.size("r").cast("long").alias("rejected_turns"),
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns of pairs made of conversations 2n (chosen) and 2n + 1 (rejected)."""
    number = F.col("conv_id").cast("long")
    return conversations.select(F.floor(number / 2).cast("long").alias("pair_id"), F.when(F.pmod(number, F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text").where("pair_id is not null")
