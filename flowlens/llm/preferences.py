"""Preference formatting of conversations (operator 8).

A pair of a chosen and a rejected conversation is cut at their longest common
prefix of turns (equal role and text). The prefix is rendered once as the prompt;
the rest of either conversation is its completion, with a mask that trains on the
assistant's turns only. Everything is DataFrame operations: turns are compared by
(pair, position), and a conversation is put together by one aggregation.

Defined results: turns are ordered by turn number, then role and text, nulls
first; null roles and texts render as empty; a repeated turn row is a turn of its
own; conversations with a null id are dropped; if one conversation is a prefix of
the other its completion is empty; if the two are equal both are, and
``identical`` is true; of conversations that are as long the one with the smaller id
counts as longer; texts of any length are rendered whole; an empty table gives an empty
one. Columns other than conv_id, turn, role and text, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import dense_ranks

OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("")), F.lit(after), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, ...), role, text. A conversation is the unit of the
    output, so its turns meet in one task."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("pos", F.row_number().over(w) - 1).select("conv_id", "pos", "role", "text")


def pair_by_opening(turns: DataFrame) -> DataFrame:
    """(chosen, rejected) for conversations with the same opening turn: the one
    with most characters (ties: the smallest id) is chosen, each other one is
    rejected against it. One row for each conversation but the chosen ones."""
    first = turns.where("pos = 0").select("conv_id", F.xxhash64("role", "text").alias("opening"), F.struct("role", "text").alias("turn"))
    size = turns.groupBy("conv_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    sized = first.join(size, "conv_id")
    best = sized.groupBy("opening", "turn").agg(F.min(F.struct((-F.col("chars")).alias("less"), "conv_id")).alias("b")).select("opening", "turn", F.col("b.conv_id").alias("chosen"))
    both = sized.alias("s").join(best.alias("b"), (F.col("s.opening") == F.col("b.opening")) & F.col("s.turn").eqNullSafe(F.col("b.turn")))
    return both.where("s.conv_id != b.chosen").select("chosen", F.col("s.conv_id").alias("rejected"))


def pair_neighbours(turns: DataFrame, paired: DataFrame) -> DataFrame:
    """(chosen, rejected) for conversations that ``paired`` leaves out: ranks 2k and
    2k + 1 by id among them, with the longer one (ties: the smaller id) chosen; of
    an odd number the last has no partner."""
    size = turns.groupBy("conv_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    used = paired.select(F.explode(F.array("chosen", "rejected")).alias("conv_id")).distinct()
    left = dense_ranks(size.join(used, "conv_id", "left_anti"), ["conv_id"])
    by = left.groupBy(F.expr("rank div 2").alias("k")).agg(F.min(F.struct((-F.col("chars")).alias("less"), "conv_id")).alias("a"), F.max(F.struct((-F.col("chars")).alias("less"), "conv_id")).alias("b"))
    return by.where("a.conv_id != b.conv_id").select(F.col("a.conv_id").alias("chosen"), F.col("b.conv_id").alias("rejected"))


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask,
    rejected_mask (arrays of start, end: code points of the completion that are
    trained on), identical. ``turns`` as ``ordered`` gives them."""
    # with each turn where its rendering ends in the conversation, by the exchange that puts it together
    w = Window.partitionBy("conv_id").orderBy("pos")
    turns = turns.withColumn("upto", F.sum(F.length(rendered(F.col("role"), F.col("text")))).over(w))
    body = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text", "upto"))).alias("turns"))
    joined = pairs.select("chosen", "rejected").distinct().join(body.toDF("chosen", "a"), "chosen").join(body.toDF("rejected", "b"), "rejected")
    differs = F.filter(
        F.sequence(F.lit(0), F.least(F.size("a"), F.size("b")) - 1),
        lambda i: ~(F.get("a", i)["role"].eqNullSafe(F.get("b", i)["role"]) & F.get("a", i)["text"].eqNullSafe(F.get("b", i)["text"])),
    )
    joined = joined.withColumn("n", F.coalesce(F.get(differs, F.lit(0)), F.least(F.size("a"), F.size("b"))))

    def text(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda t: rendered(t["role"], t["text"])), "")

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))

    def mask(side: str) -> Column:
        # a trained span is the text and its end mark
        before = F.coalesce(F.get(side, F.col("n") - 1)["upto"], F.lit(0))

        def span(t: Column) -> Column:
            end = t["upto"] - before
            start = end - len(CLOSE) - F.length(F.coalesce(t["text"], F.lit("")))
            return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

        return F.transform(F.filter(rest(side), lambda t: t["role"].eqNullSafe("assistant")), span)

    return joined.select(
        F.col("chosen").alias("chosen_id"),
        F.col("rejected").alias("rejected_id"),
        F.col("n").cast("int").alias("n_common"),
        text(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        text(rest("a")).alias("chosen"),
        text(rest("b")).alias("rejected"),
        mask("a").alias("chosen_mask"),
        mask("b").alias("rejected_mask"),
        ((F.col("n") == F.size("a")) & (F.col("n") == F.size("b"))).alias("identical"),
    )
