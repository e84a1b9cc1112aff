"""Message sources (A1, A2): untrusted request bodies -> message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions.windows import exclusive_running_total

BODY_SCHEMA = ("struct<messages:array<struct<role:string,content:string>>, model:string, "
               "temperature:double, max_tokens:int, pii_strategy:string>")


def read_messages(requests: DataFrame, body_col: str = "body", key: str = "request_id") -> DataFrame:
    """A1: one row per message ``key, turn, role, content``; anything malformed -> no rows.

    ``from_json`` in PERMISSIVE mode yields null for bodies that are not JSON or
    whose ``messages`` is not an array of objects; those requests get no rows
    (the proxy's empty message list).
    """
    parsed = F.from_json(F.col(body_col), BODY_SCHEMA, {"mode": "PERMISSIVE"})
    msgs = F.coalesce(parsed["messages"], F.array().cast("array<struct<role:string,content:string>>"))
    return (requests.select(key, F.posexplode(msgs).alias("turn", "m"))
            .select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content")))


def flatten_segments(messages: DataFrame, conv: str = "conv_id", turn: str = "turn",
                     text_col: str = "text") -> DataFrame:
    """A2 without gathering a conversation: each message's offset in the flattened text.

    The flattened request text is all contents joined by one space, null as
    ''. Instead of building that string per conversation, every message gets
    ``start`` (its offset in the joined text) from a skew-safe running total;
    ``total_length`` is the joined length. Spans found per message map to
    flattened offsets by adding ``start``.
    """
    m = messages.select(conv, turn, F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    m = m.withColumn("_w", F.length("content") + 1)
    m = exclusive_running_total(m, [conv], turn, "_w", "start")
    tot = m.groupBy(conv).agg((F.sum("_w") - 1).alias("total_length"))
    return m.drop("_w").join(tot, conv)


def flatten_text(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """A2 as one string per conversation (for bounded requests only: gathers the conversation)."""
    return (messages.groupBy(conv)
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(
                F.struct(F.col(turn), F.coalesce(F.col(text_col), F.lit("")).alias("c")))), lambda x: x["c"]),
                " ").alias("text")))
