"""Multi-party perspective rotation of conversations, in DataFrame operations only.

For every participant the dialogue is rendered once with that speaker as the assistant and all others as named users;
what the assistant says is to be learnt, all else is masked. A rendering is a sequence of segments, one per turn, each
with its place in the rendered text. Places are running sums taken within stretches of turns and then over the
stretches, so that a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Roles that give instructions and take no part: they keep their own header in every rendering.
NARRATORS = ("system",)
STRETCH = 256


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """One row per conversation, participant and turn: conv, perspective, turn, speaker, as_role, segment, start,
    mask_from, mask_to (code points in the rendering; equal when nothing of the segment is learnt).

    Segments follow each other by turn, ties by speaker and text; a null turn comes first, a null role speaks as
    "unknown", null text is empty. "<|" inside a text or a name becomes "< |", so that it can't pass for a header.
    A conversation of narrators alone, or a null conversation id, gives no rendering. Rows that repeat are rendered
    each.
    """
    said = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    ).filter(F.col("conv").isNotNull())
    speakers = said.filter(~F.col("speaker").isin(*narrators)).select("conv", F.col("speaker").alias("perspective")).distinct()
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    learnt = F.col("speaker") == F.col("perspective")
    as_role = F.when(learnt, "assistant").when(F.col("speaker").isin(*narrators), F.col("speaker")).otherwise("user")
    head = F.concat(F.lit("<|im_start|>"), "as_role", F.when(F.col("as_role") == "user", F.concat(F.lit(" name="), safe("speaker"))).otherwise(""), F.lit("\n"))
    rows = said.join(speakers, "conv").withColumn("as_role", as_role).withColumn("head", head).withColumn("tail", F.concat(safe("body"), F.lit("<|im_end|>\n")))
    rows = rows.select("conv", "perspective", "turn", "speaker", "body", "as_role", F.concat("head", "tail").alias("segment"), F.length("head").cast("long").alias("h"), F.length("tail").cast("long").alias("t"))
    rows = rows.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH))
    key = ["conv", "perspective"]
    whole = rows.groupBy(*key, "stretch").agg(F.sum(F.col("h") + F.col("t")).alias("size"))
    before = whole.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    inside = Window.partitionBy(*key, "stretch").orderBy(F.col("turn").asc_nulls_first(), "speaker", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("h") + F.col("t")).over(inside)).join(before, [*key, "stretch"])
    end = F.col("end") + F.col("before")
    start = end - F.col("h") - F.col("t")
    from_ = F.when(learnt, start + F.col("h")).otherwise(end)
    return placed.select(
        F.col("conv").alias(conv_col), "perspective", F.col("turn").alias(turn_col), "speaker", "as_role", "segment", start.alias("start"), from_.alias("mask_from"), end.alias("mask_to")
    )


def assembled(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, perspective, text, spans): each rendering as one string with the spans to learn. Only for conversations
    that fit in a row; ``perspectives`` has no such bound and has settled what nulls mean. Perspectives without anything
    to learn have no spans; an empty table gives an empty result; columns other than those of ``perspectives`` are not read."""
    parts = F.sort_array(F.collect_list(F.struct("start", "segment", "mask_from", "mask_to")))
    whole = segments.groupBy(conv_col, "perspective").agg(parts.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["mask_from"] < x["mask_to"]), lambda x: F.struct(x["mask_from"].alias("from"), x["mask_to"].alias("to")))
    return whole.select(conv_col, "perspective", F.concat_ws("", F.col("p.segment")).alias("text"), spans.alias("spans"))


SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body
              FROM conversations WHERE conv_id IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
roles AS (SELECT s.*, p.perspective,
                 CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user' END AS as_role
          FROM said s JOIN speakers p USING (conv_id)),
parts AS (SELECT *, '<|im_start|>' || as_role
                    || CASE WHEN as_role = 'user' THEN ' name=' || replace(speaker, '<|', '< |') ELSE '' END || chr(10) AS head,
                 replace(body, '<|', '< |') || '<|im_end|>' || chr(10) AS tail
          FROM roles),
placed AS (SELECT *, CAST(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, perspective
                            ORDER BY turn NULLS FIRST, speaker, body
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS mask_to
           FROM parts)
SELECT conv_id, perspective, turn, speaker, as_role, head || tail AS segment,
       CAST(mask_to - length(head) - length(tail) AS BIGINT) AS start,
       CAST(CASE WHEN speaker = perspective THEN mask_to - length(tail) ELSE mask_to END AS BIGINT) AS mask_from, mask_to
FROM placed
"""
