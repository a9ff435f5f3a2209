"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once more: that
speaker's messages as ``assistant``, every other speaker's as ``user name=<speaker>``,
system messages as ``system``.  The mask spans of a rendering cover the assistant's
text and closing marker, in characters; nothing else is trained on.

A conversation is rendered in parts of ``turns`` turn numbers, so a part's messages are
few however long the conversation is; parts in order make the dialogue.  Messages are
gathered a part at a time; participants are a set per conversation, pre-aggregated before
the shuffle.

Cases: a null or empty text is an empty message; a null role is the speaker
``unknown``; a null turn goes to part -1; ties of a turn are ordered by role and text;
repeated rows are repeated messages; a conversation with system messages only has no
participant and no rendering; a null conv_id is a conversation of its own; markers
inside a text are broken by a space, so a text can't open or close a message; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Turn numbers in a part.
TURNS = 64


def _text(column: str) -> Column:
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def rendered(conversations: DataFrame, *, turns: int = TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_messages, n_trained, rendered, spans), one row a part and participant."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    turn = F.col("turn").cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), _text("text").alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / turns), F.lit(-1)).cast("long")
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    speakers = rows.where("role <> 'system'").groupBy(F.col("conv_id").alias("of")).agg(F.collect_set("role").alias("speakers"))
    views = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.of)).select("conv_id", "part", "messages", F.explode("speakers").alias("perspective"))

    def opening(message: Column) -> Column:
        said = F.when(message.role == "system", F.lit("system")).when(message.role == F.col("perspective"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), message.role))
        return F.concat(F.lit("<|im_start|>"), said, F.lit("\n"))

    pieces = F.transform("messages", lambda m: F.struct(opening(m).alias("head"), F.concat(m.text, F.lit("<|im_end|>")).alias("body"), (m.role == F.col("perspective")).alias("own")))
    views = views.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        begin = state.at + F.length(piece.head)
        end = begin + F.length(piece.body)
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(piece.own, F.concat(state.spans, F.array(span))).otherwise(state.spans).alias("spans"))

    return views.select(
        "conv_id",
        "perspective",
        "part",
        F.size("messages").cast("long").alias("n_messages"),
        F.size(F.filter("pieces", lambda p: p.own)).cast("long").alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", start, step).spans, ",").alias("spans"),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
    coalesce(CAST(floor(turn / 64.0) AS BIGINT), -1) AS part
  FROM conversations
), views AS (
  SELECT r.*, s.perspective FROM rows r
  JOIN (SELECT DISTINCT conv_id, role AS perspective FROM rows WHERE role <> 'system') s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), pieces AS (
  SELECT *, role = perspective AS own,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' AS body
  FROM views
), placed AS (
  SELECT *, row_number() OVER w AS k, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS s
  FROM pieces WINDOW w AS (PARTITION BY conv_id, part, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, part, count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_trained,
  string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CAST(s AS VARCHAR) || ':' || CAST(s + length(body) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE own), '') AS spans
FROM placed GROUP BY conv_id, perspective, part
"""
