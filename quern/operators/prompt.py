"""Prompts of ranked sections and messages fitted to a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import token_estimate, trim_to_tokens

# Headings of retrieved sections in the order in which they are given up; others are kept longest. The first two go before any history.
SECTIONS = ["## Web Search Context", "## URL Context", "## Retrieved Context", "## File Context"]
DISPOSABLE = 1


def section_rank(text):
    """The place of a section's heading in ``SECTIONS``, or the number of them."""
    rank = F.lit(len(SECTIONS))
    for k, head in reversed(list(enumerate(SECTIONS))):
        rank = F.when(F.startswith(text, F.lit(head)), k).otherwise(rank)
    return rank


def fit_prompt(messages: DataFrame, sections: DataFrame, ceiling: int, low: float = 0.85, floor: int = 4, least_query: int = 512) -> DataFrame:
    """(conv_id, kind, place, tokens, trimmed, text): what of each conversation's messages (conv_id, turn, role, text) and sections (conv_id, place, text) fits ``ceiling`` tokens.

    A conversation that fits stays whole. From another go, until it fits ``low`` of the ceiling: first sections of the disposable headings by rank and place,
    but never the last one; then the oldest messages between the leading system messages and the last message while more than ``floor`` of them are left,
    and those before the first that isn't an assistant's. Where it is still over the ceiling the other sections go by rank and place, then the last one as well; then a
    last message of the user is cut, if ``least_query`` tokens or more are left for it. Messages, and the sections together, count 4 tokens more than their texts.
    Each step is a running sum over one order, so a conversation is never walked. Sections of a conversation without messages are left out.
    """
    whole, oldest = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn")
    upto = oldest.rowsBetween(Window.unboundedPreceding, 0)
    said = messages.select("conv_id", "turn", "role", "text").withColumn("tokens", token_estimate(F.col("text")) + 4)
    given = Window.partitionBy("conv_id").orderBy("rank", "place")
    earlier = lambda c: F.coalesce(F.sum(c).over(given.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = sections.select("conv_id", "place", "text").withColumns({"rank": section_rank(F.col("text")), "tokens": token_estimate(F.col("text"))})
    held = held.withColumns({"_nth": F.row_number().over(given), "_many": F.count("*").over(whole), "_before": earlier("tokens")})
    spoken = said.groupBy("conv_id").agg(F.sum("tokens").alias("_said"))
    sums = spoken.join(held.groupBy("conv_id").agg((F.sum("tokens") + 4).alias("_held")), "conv_id", "left")
    sums = sums.select("conv_id", (F.col("_said") + F.coalesce("_held", F.lit(0))).alias("_total"))
    over, target = F.col("_total") > ceiling, int(ceiling * low)
    # sections that go first
    first = held.join(sums, "conv_id").withColumn("_gone", over & (F.col("rank") <= DISPOSABLE) & (F.col("_total") - F.col("_before") > target) & (F.col("_nth") < F.col("_many")))
    freed = first.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("_gone"), F.col("tokens"))), F.lit(0)).alias("_freed"))
    # history, oldest first
    talk = said.join(sums, "conv_id").join(freed, "conv_id", "left").withColumn("_left_over", F.col("_total") - F.coalesce("_freed", F.lit(0)))
    speaks = F.coalesce(F.col("role") != "system", F.lit(True))
    talk = talk.withColumns({"_last": F.col("turn") == F.max("turn").over(whole), "_spoke": F.coalesce(F.max(speaks).over(upto), F.lit(False))}).withColumn("_h", F.col("_spoke") & ~F.col("_last"))
    before = F.coalesce(F.sum(F.when(F.col("_h"), F.col("tokens"))).over(oldest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count_if("_h").over(oldest.rowsBetween(0, Window.unboundedFollowing))
    talk = talk.withColumn("_gone", over & F.col("_h") & (F.col("_left_over") - before > target) & (left > floor)).filter(~F.col("_gone")).drop("_gone")
    opening = F.min(F.when(F.col("_h") & ~F.col("role").eqNullSafe("assistant"), F.col("turn"))).over(whole)
    talk = talk.withColumn("_first", opening).filter(~over | ~F.col("_h") | F.coalesce(F.col("turn") >= F.col("_first"), F.lit(False)))
    kept = talk.groupBy("conv_id").agg(F.sum("tokens").alias("_said"))
    # the other sections, and the last one with them
    second = first.filter(~F.col("_gone")).join(kept, "conv_id").withColumns({"_now": F.sum("tokens").over(whole) + F.col("_said") + 4, "_before": earlier("tokens")})
    second = second.filter(~(over & (F.col("_now") - F.col("_before") > ceiling) & (F.col("_nth") < F.col("_many"))))
    stay = second.withColumn("_now", F.sum("tokens").over(whole) + F.col("_said") + 4).filter(~over | (F.col("_now") <= ceiling))
    room = talk.join(stay.groupBy("conv_id").agg((F.sum("tokens") + 4).alias("_held")), "conv_id", "left")
    room = room.withColumn("_now", F.sum("tokens").over(whole) + F.coalesce("_held", F.lit(0))).withColumn("_room", ceiling - (F.col("_now") - F.col("tokens")) - 8)
    cut = (F.col("_now") > ceiling) & F.col("_last") & F.col("role").eqNullSafe("user") & (F.col("_room") >= least_query)
    told = room.withColumn("trimmed", cut).withColumn("text", F.when(cut, trim_to_tokens(F.col("text"), F.col("_room"))).otherwise(F.col("text")))
    told = told.withColumn("tokens", F.when(F.col("trimmed"), token_estimate(F.col("text")) + 4).otherwise(F.col("tokens")))
    rows = lambda df, kind, place, trimmed: df.select("conv_id", F.lit(kind).alias("kind"), F.col(place).cast("long").alias("place"), F.col("tokens").cast("long").alias("tokens"), trimmed, "text")
    return rows(told, "message", "turn", F.col("trimmed")).unionByName(rows(stay, "section", "place", F.lit(False).alias("trimmed")))
