"""Event-sourced reconstruction of conversations and their rendering for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.llm.common import table

#: Markers of the template. A text never holds "<" after escaping, so none can be forged.
OPEN, BODY, CLOSE = "<turn ", ">\n", "\n</turn>\n"
LOSS = "assistant"


def escape(text: Column) -> Column:
    r"""Backslash becomes two, "<" becomes \l and ">" \g; undone by `unescape` for every text."""
    for plain, safe in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Pairs of backslashes split the text first, so that one left over before a letter is an escape."""
    parts = F.split(text, r"\\\\", -1)
    plain = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.array_join(F.transform(parts, plain), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages from a log: conv_id, message, role, text.

    `events` has conv_id, seq, message, kind, role, text. kind is `message` (a whole message),
    `delta` (text to append), `edit` (replaces the message's text) or `regenerate` (replaces it and
    drops every message of the conversation whose first event came between its own start and the
    regeneration). A message's text is that of its last message, edit or regenerate event followed by
    the deltas after it, in order of seq, then kind and text where seq ties; its role is that of its
    first event that has one. Null role and text are empty; null seq comes first.

    Messages are folded by (conversation, message), so a long conversation is spread over tasks until
    it is rendered; no array grows by appending.
    """
    of = Window.partitionBy("conv_id", "message")
    step = F.struct(
        F.col("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("role", F.lit("")).alias("role"),
    )
    logs = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(step)).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i))
    folded = logs.withColumn("_base", F.coalesce(F.array_max(resets), F.lit(0))).select(
        "conv_id", "message",
        F.col("log")[0]["seq"].alias("began"),
        F.col("log")[F.col("_base")]["seq"].alias("settled"),
        (F.col("log")[F.col("_base")]["kind"] == "regenerate").alias("again"),
        F.coalesce(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != "")[0], F.lit("")).alias("role"),
        F.array_join(
            F.transform(F.expr("slice(log, _base + 1, size(log))"), lambda e: e["text"]), ""
        ).alias("text"),
    )
    # a message falls if a regeneration of an earlier message was logged after the message began
    cutoff = F.max(F.when(F.col("again"), F.col("settled"))).over(
        Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("began"), "message")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        folded.withColumn("_cutoff", cutoff)
        .where(F.col("_cutoff").isNull() | (F.col("began") > F.col("_cutoff")))
        .drop("settled", "again", "_cutoff")
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted.

    Messages stand in the order they began, then by message, role and text; each is one marked turn.
    """
    turn = F.struct("began", "message", F.col("role"), F.col("text"))
    held = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    mark = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(CLOSE))
    return held.select("conv_id", F.array_join(F.transform("turns", mark), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text, loss); the inverse of `render`.

    Only an assistant's own text lies under the loss mask, not the markers around it.
    """
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    at = lambda p: F.locate(BODY, p)

    def turn(p):
        role = unescape(p.substr(F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1))
        text = unescape(p.substr(at(p) + len(BODY), F.length(p)))
        return F.struct(role.alias("role"), text.alias("text"), (role == LOSS).alias("loss"))

    return F.transform(pieces, turn)


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, rendered and read back."""
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    # a row is a whole message; rows that repeat a turn stay messages of their own
    same = Window.partitionBy("conv_id", "turn").orderBy(
        F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    )
    events = logs.unionByName(own).select(
        "conv_id", F.col("turn").alias("seq"), F.struct("turn", F.row_number().over(same).alias("n")).alias("message"),
        F.lit("message").alias("kind"), "role", "text",
    )
    out = render(fold_events(events)).withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = {
    "op10_chat_formatting": r"""
WITH logs AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (SELECT *,
  '<turn ' || replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g') || '>' || chr(10)
  || replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g') || chr(10) || '</turn>' || chr(10) AS piece
  FROM logs),
held AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length(piece)) AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM held""",
}
