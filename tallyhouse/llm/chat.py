"""Multi-party perspective rotation of dialogues.

Every participant of a conversation (every role but ``system``) gets a view of
the whole dialogue in which that speaker is the assistant, all others are named
users and system turns stay system turns. A view is one row per turn: its
rendered segment, the segment's start in the view, and the span that counts for
the loss, which is the assistant's own words and end mark and empty elsewhere.
Views stay rows, so no conversation is gathered into one value.

Starts are running sums over blocks of ``BLOCK`` consecutive ranks: sums inside a
block, and sums of whole blocks. A conversation of any length spans many blocks,
so none is summed in one task.

Defined cases: a null role is the participant "unknown", a null text is empty, a
null turn comes first; rows without a conv_id form one conversation; rows that
repeat are turns of their own; equal turns go by role, then text; conversations
of system turns only have no view; control marks inside a text get a blank after
"<" so that they can't close a segment; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ranked_key

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK = 4096


def views(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, position, speaker, segment, start, mask_start, mask_end), positions in code points of the view."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                                 F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    people = turns.where("role != 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    both = turns.join(people, turns["conv_id"].eqNullSafe(people["_conv"]))
    speaker = (F.when(F.col("role") == "system", F.lit("system")).when(F.col("role") == F.col("perspective"), F.lit("assistant"))
               .otherwise(F.concat(F.lit("user name="), "role")))
    head = F.concat(F.lit(OPEN), "speaker", F.lit("\n"))
    drawn = (both.withColumn("speaker", speaker)
             .select("conv_id", "perspective", "turn", "role", "text", "speaker", F.length(head).alias("head"),
                     F.concat(head, "text", F.lit(CLOSE)).alias("segment")))
    ranked = ranked_key(drawn, ["conv_id", "perspective", "turn", "role", "text"], "rank")
    view, key = ["conv_id", "perspective"], [F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("perspective")]
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumn("size", F.length("segment").cast("long"))
    inside = Window.partitionBy(*key, "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    blocks = ranked.groupBy(*view, "block").agg(F.sum("size").alias("sum"), F.min("rank").alias("from"))
    before = Window.partitionBy(*view).orderBy("block")
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"), F.col("block").alias("_block"),
        (F.sum("sum").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("earlier"),
        F.min("from").over(Window.partitionBy(*view)).alias("first"))
    joined = ranked.join(blocks, ranked["conv_id"].eqNullSafe(blocks["_conv"]) & (ranked["perspective"] == blocks["_who"])
                         & (ranked["block"] == blocks["_block"]))
    start = F.col("earlier") + F.col("inside")
    own = F.col("speaker") == "assistant"
    return joined.select(*view, (F.col("rank") - F.col("first")).alias("position"), "speaker", "segment", start.alias("start"),
                         F.when(own, start + F.col("head")).otherwise(start).alias("mask_start"),
                         F.when(own, start + F.col("size")).otherwise(start).alias("mask_end"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
v AS (SELECT t.conv_id, perspective, turn, role, text,
             CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END AS speaker
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, '<|im_start|>' || speaker || chr(10) || text || '<|im_end|>' || chr(10) AS segment,
             length('<|im_start|>' || speaker) + 1 AS head FROM v),
w AS (SELECT *, row_number() OVER o - 1 AS position, sum(length(segment)) OVER o - length(segment) AS start
      FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, speaker, segment, CAST(start AS BIGINT) AS start,
       CAST(CASE WHEN speaker = 'assistant' THEN start + head ELSE start END AS BIGINT) AS mask_start,
       CAST(CASE WHEN speaker = 'assistant' THEN start + length(segment) ELSE start END AS BIGINT) AS mask_end
FROM w
"""
