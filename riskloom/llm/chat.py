"""Chat formatting: logged conversations that are a prefix of a longer one are dropped, the others are rendered.

A log often holds the same conversation after each of its turns. Per turn, a rolling hash of all turns up to it is kept
(exclusive or of 2 x 64-bit hashes salted by the turn's position, as a running window). A conversation whose last rolling
hash is an earlier one of another conversation, at the same position, is a prefix of it and goes (anti-join). Of equal
conversations the one with the smallest conv_id stays. Only DataFrame operations are used.

Turns are ordered by turn (null first), then role, then text. A null role is `unknown`, a null text is empty. Rows without
conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Very long texts are rendered whole; a
conversation is rendered as one row, so its turns meet in one task. Only conv_id, turn, role and text are read, so extra columns
may have any name; an empty table gives no rows. `<|` in a text is written `<\\u200b|`, so that no text can forge a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    salted = [F.xxhash64(F.lit(salt), "pos", F.length("role"), "role", "text") for salt in (17, 91)]
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumn("pos", F.row_number().over(in_order))
        .withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))
        .withColumn("h1", F.bit_xor(salted[0]).over(so_far))
        .withColumn("h2", F.bit_xor(salted[1]).over(so_far))
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and n_copies (equal conversations, itself included) of those that are no proper prefix of another."""
    turns = _turns(conversations).select("conv_id", "pos", "n_turns", "h1", "h2")
    whole = turns.where("pos = n_turns").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = turns.where("pos < n_turns").select("pos", "h1", "h2").distinct()
    return whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, rendered."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\u200b|"))
    role = F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("<\u200b|"))
    line = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    key = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), line.alias("line"))
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(key)).alias("turns"))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.line", "").alias("rendered"))
    )


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered for every maximal conversation."""
    kept = maximal_conversations(conversations)
    return render(conversations.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


#: The same rows, by comparing the turns themselves.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns,
         string_agg('<|im_start|>' || replace(role, '<|', '<' || chr(8203) || '|') || chr(10)
                    || replace(text, '<|', '<' || chr(8203) || '|') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM t GROUP BY conv_id
), u AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns
)
SELECT c.conv_id, CAST(c.n_turns AS BIGINT) AS n_turns, CAST(u.n_copies AS BIGINT) AS n_copies, c.rendered
FROM u JOIN c USING (conv_id)
WHERE NOT EXISTS (
  SELECT 1 FROM c AS l
  WHERE l.n_turns > c.n_turns AND l.turns[1] = c.turns[1] AND l.turns[1:c.n_turns] = c.turns
)
"""
