"""Chat formatting: multi-party perspective rotation.

Every participant of a dialogue takes the assistant's part once: that
speaker's turns are rendered as the assistant's and are trained on, all others
as users with their names.  System turns are instructions, not a participant.
A dialogue of P participants and T turns gives P renderings of T segments; a
rendering is its segments in order, and ``char_start``/``char_end`` place each
in it.  A segment is a header, the turn's text and an end mark.  The loss mask
is ``target_start`` to ``target_end``: text and end mark of the assistant's
turns, so that a model learns to answer and to stop, not to write headers.

Texts and names cannot forge a header or an end: every mark begins with ``<|``
and ends with ``|>``, which are escaped in both, and a name has no line breaks.

Segments stay rows, so that a dialogue with a third of all turns is never
gathered in one string or task; offsets are running sums in two levels, over
ranges of turns and then within each.

Defined results: a null text is empty; a null or empty role is named
``unknown``; null ``conv_id``s form one dialogue; a null turn comes first;
turns that tie are ordered by role, then text, and repeated rows stay as
repeated segments; a dialogue with system turns only gives no rendering; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import table

RANGE = 256
#: Fixed values of the rendering.
END = "<|end|>"


def _escaped(text) -> F.Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, is_target, char_start, char_end, target_start, target_end (null unless is_target)."""
    t = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown")).alias("speaker"),
        F.concat(_escaped(F.coalesce("text", F.lit(""))), F.lit(END)).alias("body"),
    )
    cast = t.filter(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    head = F.when(F.col("speaker") == F.col("perspective"), F.lit("<|assistant|>")).when(F.col("speaker") == system, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user name="), F.translate(_escaped(F.col("speaker")), "\r\n", "  "), F.lit("|>")))
    seg = (
        t.join(cast, F.col("conv_id").eqNullSafe(F.col("c")))
        .select("conv_id", "perspective", "turn", "speaker", F.concat(head, F.lit("\n"), "body", F.lit("\n")).alias("segment"), F.length("body").cast("long").alias("m"), (F.col("speaker") == F.col("perspective")).alias("is_target"), F.floor(F.col("turn") / RANGE).alias("r"))
        .withColumn("n", F.length("segment").cast("long"))
    )
    whole = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("r")).rowsBetween(Window.unboundedPreceding, -1)
    starts = seg.groupBy("conv_id", "perspective", "r").agg(F.sum("n").alias("n")).select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("r").alias("s"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("base"))
    inner = Window.partitionBy("conv_id", "perspective", "r").orderBy(F.asc_nulls_first("turn"), "speaker", "segment").rowsBetween(Window.unboundedPreceding, 0)
    return (
        seg.withColumn("upto", F.sum("n").over(inner))
        .join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("r").eqNullSafe(F.col("s")))
        .withColumn("upto", F.col("base") + F.col("upto"))
        .select(
            "conv_id", "perspective", "turn", "speaker", "segment", "is_target", (F.col("upto") - F.col("n")).alias("char_start"), F.col("upto").alias("char_end"),
            F.when(F.col("is_target"), F.col("upto") - 1 - F.col("m")).alias("target_start"), F.when(F.col("is_target"), F.col("upto") - 1).alias("target_end"),
        )
    )


def op5_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


QUERIES = {"op5_chat_perspectives": op5_chat_perspectives}

ORACLES = {
    "op5_chat_perspectives": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') || '<|end|>' AS body FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT conv_id, perspective, turn, speaker,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>' ELSE '<|user name=' || translate(replace(replace(speaker, '<|', '<\|'), '|>', '|\>'), chr(13) || chr(10), '  ') || '|>' END
           || chr(10) || body || chr(10) AS segment, length(body) AS m
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c
), o AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING) AS upto FROM s
)
SELECT conv_id, perspective, turn, speaker, segment, speaker = perspective AS is_target,
       CAST(upto - length(segment) AS BIGINT) AS char_start, CAST(upto AS BIGINT) AS char_end,
       CASE WHEN speaker = perspective THEN CAST(upto - 1 - m AS BIGINT) END AS target_start, CASE WHEN speaker = perspective THEN CAST(upto - 1 AS BIGINT) END AS target_end
FROM o
""",
}
