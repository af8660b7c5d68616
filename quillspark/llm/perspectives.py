"""Chat formatting (operator 9): multi-party perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as the
assistant and all others as named users: one row for each perspective and turn, with the
rendered segment, its place in the whole rendering (characters and position) and whether
the loss counts it (the assistant's content and its closing mark).  Concatenating the
segments of a perspective by position gives the whole rendering.

Conversations may hold any share of all rows: places are running sums within blocks of
consecutive turns, and blocks' totals are summed in turn, so that no task holds a whole
conversation's text.  All of it is columns.

Edge cases: a null or empty text is an empty message; a null role is the participant
`unknown`; a null conv_id is a conversation of its own; turns that share a number are
ordered by role and text, and equal rows are messages each; an empty table gives an empty
result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table

BLOCK_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, shown_as, segment, start, end, mask_start, mask_end (null where nothing counts)."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK_TURNS}"), F.lit(-1)))
    speakers = rows.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # sizes of both renderings of a turn, so that running sums are taken once and not for each perspective
    seen = rows.join(speakers, rows.conv_id.eqNullSafe(speakers.conv_id)).drop(speakers.conv_id)
    own = F.col("speaker") == F.col("perspective")
    shown = seen.withColumn("shown_as", F.when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("speaker"))))
    shown = shown.withColumn("head", F.concat(F.lit(OPEN), "shown_as", F.lit("\n"))).withColumn("segment", F.concat("head", "text", F.lit(CLOSE + "\n")))
    shown = shown.withColumn("size", F.length("segment").cast("bigint"))
    order = "order by turn nulls first, speaker, text rows unbounded preceding"
    inner = shown.withColumn("upto", F.expr(f"sum(size) over (partition by conv_id, perspective, block {order})")).withColumn("nth", F.expr(f"row_number() over (partition by conv_id, perspective, block order by turn nulls first, speaker, text)"))
    blocks = shown.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    before = blocks.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.expr("sum(size) over (partition by conv_id, perspective order by block) - size").alias("size_before"), F.expr("sum(n) over (partition by conv_id, perspective order by block) - n").alias("n_before"),
    )
    out = inner.join(before, inner.conv_id.eqNullSafe(before.c) & (inner.perspective == before.p) & (inner.block == before.b))
    end = F.col("size_before") + F.col("upto")
    start = end - F.col("size")
    return out.select(
        "conv_id", "perspective", (F.col("n_before") + F.col("nth") - 1).cast("bigint").alias("position"), "turn", "speaker", "shown_as", "segment", start.alias("start"), end.alias("end"),
        F.when(own, start + F.length("head")).alias("mask_start"), F.when(own, end - 1).alias("mask_end"),
    )


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, rendered from each participant's perspective."""
    return rotate(table(spark, sf_dir, "conversations"))


OP9_SQL = """
with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
s as (select distinct conv_id, speaker as perspective from t),
r as (
  select t.conv_id, s.perspective, t.turn, t.speaker, t.text, case when t.speaker = s.perspective then 'assistant' else 'user name=' || t.speaker end as shown_as
  from t join s on t.conv_id is not distinct from s.conv_id),
g as (select *, '<|im_start|>' || shown_as || chr(10) || text || '<|im_end|>' || chr(10) as segment from r),
w as (
  select *, cast(sum(length(segment)) over o as bigint) as "end", row_number() over o - 1 as position
  from g window o as (partition by conv_id, perspective order by turn nulls first, speaker, text rows unbounded preceding))
select conv_id, perspective, cast(position as bigint) as position, turn, speaker, shown_as, segment, "end" - length(segment) as "start", "end",
  case when speaker = perspective then "end" - length(segment) + length('<|im_start|>' || shown_as) + 1 end as mask_start,
  case when speaker = perspective then "end" - 1 end as mask_end
from w
"""
