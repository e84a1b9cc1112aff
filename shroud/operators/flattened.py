"""C1 on whole requests: detection over all messages of a conversation joined by one space.

A value can begin in one message and end in the next. The joined text is never built:
messages get their offset in it, and consecutive ones are put together in blocks of about
``BLOCK`` characters. Where a block has a *quiet* blank (no digit within ``REACH``
characters on either side) no match and no context of a match reaches across it, so
detection on both sides is independent. Between its first and last quiet blank a block is
scanned on its own. What lies outside is scanned together with its neighbours: the end of
one block, blocks without a quiet blank, and the beginning of the next block that has one
make one chain. So a conversation of any length is split over tasks, and a chain is only
long where the text itself is an unbroken row of numbers.

Defined results: a null text counts as empty; offsets are code points of the joined
text; rows without a conversation or a turn are left out; turns must be unique within a conversation.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions import kernel
from shroud.functions.windows import exclusive_running_total
from shroud.operators.detect import SPAN_FIELDS, pii_spans
from shroud.session import materialize
from shroud.sources.messages import flatten_segments

BLOCK = 4096
#: A match with white space in it, and what it looks at around it, has a digit at most
#: so far from that white space (the longest case: an account number whose last groups are letters).
REACH = 40
_QUIET = re.compile(rf"(?<=[^0-9]{{{REACH}}}) (?=[^0-9]{{{REACH}}})")
SPANS = T.ArrayType(T.StructType([T.StructField(f.name, T.LongType() if f.name in ("start", "end") else f.dataType) for f in SPAN_FIELDS]))


def quiet_range(text: str) -> tuple[int, int] | None:
    """First and last quiet blank of a text (the condition reads the same backwards)."""
    first = _QUIET.search(text)
    if not first:
        return None
    return first.start(), len(text) - 1 - _QUIET.search(text[::-1]).start()


def text_blocks(messages: DataFrame, conv: str, turn: str, text_col: str) -> DataFrame:
    """(conv, block, at, text): the joined text in pieces of whole messages; one space lies between two pieces."""
    rows = messages.where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
    placed = flatten_segments(rows, conv, turn, text_col).select(conv, "start", "content")
    parts = placed.groupBy(conv, F.expr(f"start div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("start", "content"))).alias("m"))  # at most BLOCK messages
    return parts.select(conv, "block", F.col("m")[0]["start"].alias("at"), F.array_join(F.transform("m", lambda x: x["content"]), " ").alias("text"))


def _scan_blocks(blocks: DataFrame, conv: str) -> DataFrame:
    """Per block the spans of its inner part, whether it has one, and what is left on both sides."""
    schema = T.StructType([blocks.schema[conv], blocks.schema["block"], T.StructField("closed", T.LongType()), T.StructField("head_at", T.LongType()), T.StructField("head", T.StringType()),
                           T.StructField("tail_at", T.LongType()), T.StructField("tail", T.StringType()), T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        for batch in batches:
            closed, head, tail_at, tail, spans = [], [], [], [], []
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = quiet_range(text)
                a, b = got or (len(text), len(text))
                closed.append(int(got is not None))
                head.append(text[:a])
                tail_at.append(at + b if got else None)
                tail.append(text[b:] if got else None)
                spans.append([{"rank": r, "type": t, "start": s + at + a, "end": e + at + a, "value": v} for r, t, s, e, v in kernel.pii_spans(text[a:b])])
            yield pa.RecordBatch.from_arrays([batch.column(conv), batch.column("block"), pa.array(closed, pa.int64()), batch.column("at"), pa.array(head, pa.string()),
                                              pa.array(tail_at, pa.int64()), pa.array(tail, pa.string()), pa.array(spans, kind)], schema.names)

    return blocks.mapInArrow(run, schema)


def chains(scanned: DataFrame, conv: str) -> DataFrame:
    """(conv, at, text): what the blocks left over, put together from one quiet blank to the next."""
    edges = exclusive_running_total(scanned.drop("spans"), [conv], "block", "closed", "chain")
    ends = edges.where("closed = 1").select(conv, (F.col("chain") + 1).alias("chain"), F.col("tail_at").alias("at"), F.col("tail").alias("text"))
    pieces = edges.select(conv, "chain", F.col("head_at").alias("at"), F.col("head").alias("text")).unionByName(ends)
    whole = pieces.groupBy(conv, "chain").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("p"))
    return whole.select(conv, F.col("p")[0]["at"].alias("at"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def request_spans(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """Accepted spans of every conversation's joined text: conv, rank, type, start, end, value."""
    scanned = materialize(_scan_blocks(text_blocks(messages, conv, turn, text_col), conv))
    inner = scanned.select(conv, F.explode("spans").alias("s")).select(conv, "s.*")
    seams = pii_spans(chains(scanned, conv), "text", [conv, "at"])
    seams = seams.select(conv, "rank", "type", (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"), "value")
    return inner.unionByName(seams)


def request_verdicts(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """C1 verdict of every conversation: conv, detected, matches, types (in pattern order, one entry for each pattern that matched)."""
    spans = request_spans(messages, conv, turn, text_col)
    found = spans.groupBy(conv).agg(F.count(F.lit(1)).alias("matches"), F.sort_array(F.collect_set(F.struct("rank", "type"))).alias("_t"))  # as many types as patterns
    every = messages.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(conv).distinct()
    types = F.transform(F.coalesce("_t", F.array().cast("array<struct<rank:int,type:string>>")), lambda x: x["type"])
    return every.join(found, conv, "left").select(conv, F.col("matches").isNotNull().alias("detected"), F.coalesce("matches", F.lit(0)).alias("matches"), types.alias("types"))
