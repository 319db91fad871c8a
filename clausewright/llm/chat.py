"""Chat formatting by multi-party perspective rotation; DataFrame functions only.

Every participant's view of a dialogue shows that speaker as the assistant and the others as named users; the
loss mask covers the assistant's turns. A view is a table of turns with character offsets, so that a dialogue
of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the chat format.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers of one block, whose offsets one task sums.
BLOCK = 512


def head(speaker: Column, view: Column) -> Column:
    return F.when(speaker == view, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), speaker, F.lit("\n")))


def rotate(turns: DataFrame) -> DataFrame:
    """Views of ``turns`` (conv_id, turn, role, text): one row for each turn and participant of its dialogue.

    Rows: conv_id, view (the participant shown as assistant), turn, position (in the dialogue, from 0), speaker,
    segment (the turn as rendered), loss (whether the mask covers it), char_start and char_end of the segment
    and mask_start and mask_end of the masked part (text and end mark; without loss both are char_start) in the
    view's rendered text. Turns are in order of turn, speaker, text; equal rows are each a turn. A null role is
    the speaker "unknown", a null text is empty, null turn numbers come first. A row without conv_id belongs to
    no dialogue with others and is one of its own. No rows give no rows; other columns are ignored.
    """
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("bigint"))
    alone, rows = rows.where("conv_id IS NULL"), rows.where("conv_id IS NOT NULL")
    # participants are combined before the shuffle; written, so that adaptive execution can split a long dialogue in the join
    views = written(rows.select(F.col("conv_id").alias("view_conv"), F.col("speaker").alias("view")).distinct(), "participants")
    seen = rows.join(views, rows["conv_id"] == views["view_conv"]).drop("view_conv")
    seen = seen.withColumn("segment", F.concat(head(F.col("speaker"), F.col("view")), "text", F.lit(END)))
    # offsets: within each block of turn numbers, then over the blocks' totals
    inside = W.partitionBy("conv_id", "view", "block").orderBy("turn", "speaker", "text").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("segment").cast("bigint")
    placed = seen.withColumns({"in_block": F.coalesce(F.sum(size).over(inside), F.lit(0)), "at_block": F.count("*").over(inside)})
    totals = rows.groupBy("conv_id", "block", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))
    both = totals.join(views, totals["conv_id"] == views["view_conv"]).drop("view_conv")
    whole = F.col("chars") + F.col("n") * (F.length(head(F.col("speaker"), F.col("view"))) + len(END))
    sums = both.groupBy("conv_id", "view", "block").agg(F.sum(whole).alias("chars"), F.sum("n").alias("n"))
    before = W.partitionBy("conv_id", "view").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sums.select(F.col("conv_id").alias("b_conv"), F.col("view").alias("b_view"), F.col("block").alias("b_block"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("b_chars"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b_n"))
    # a dialogue within one block has nothing before it
    blocks = written(blocks.where("b_n > 0"), "dialogue-blocks")
    same = (placed["conv_id"] == blocks["b_conv"]) & (placed["view"] == blocks["b_view"]) & (placed["block"] == blocks["b_block"])
    start = F.col("in_block") + F.coalesce("b_chars", F.lit(0))
    loss = F.col("speaker") == F.col("view")
    out = placed.join(blocks, same, "left").select("conv_id", "view", "turn", (F.col("at_block") + F.coalesce("b_n", F.lit(0))).alias("position"), "speaker", "segment", loss.alias("loss"), start.alias("char_start"), (start + size).alias("char_end"))
    own = F.concat(head(F.col("speaker"), F.col("speaker")), "text", F.lit(END))
    zero = F.lit(0).cast("bigint")
    out = out.union(alone.select("conv_id", F.col("speaker").alias("view"), "turn", zero.alias("position"), "speaker", own.alias("segment"), F.lit(True).alias("loss"), zero.alias("char_start"), F.length(own).cast("bigint").alias("char_end")))
    masked = F.col("char_start") + len(f"{START}assistant\n")
    return out.withColumns({"mask_start": F.when(F.col("loss"), masked).otherwise(F.col("char_start")), "mask_end": F.when(F.col("loss"), F.col("char_end") - 1).otherwise(F.col("char_start"))})
