"""Registered queries over whole conversations: detection across messages, leaks across turns, the clean cache on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroud.operators import flattened as FL
from shroud.operators import leaks as LK
from shroud.operators import mask as MK
from shroud.operators import policy as PO
from shroud.plans import catalog as C
from shroud.plans import oracle as O
from shroud.session import materialize
from shroud.sources.tables import table
from shroud.streaming import stream as ST

register = C.register

# Values that begin at the end of one message and end at the beginning of the next, and some within one.
_END = """CASE (conv_id + turn) % 7
    WHEN 0 THEN ' mi tarjeta es 4' || lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') || ' 1111'
    WHEN 1 THEN ' el DNI es ' || CAST(20000000 + (conv_id * 31 + turn) % 70000000 AS VARCHAR)
    WHEN 2 THEN ' here is the routing number'
    WHEN 3 THEN ' afiliación 28 ' || CAST(1000000000 + conv_id * 100 + turn AS VARCHAR)
    WHEN 4 THEN ' escribe a u' || CAST(conv_id AS VARCHAR) || '@example.org'
    ELSE '' END"""
_BEGIN = """CASE WHEN turn = 0 THEN '' ELSE CASE (conv_id + turn - 1) % 7
    WHEN 0 THEN '2222 3333 y ya está. '
    WHEN 1 THEN 'Z, gracias. '
    WHEN 2 THEN CAST(100000000 + (conv_id * 100 + turn) % 99999999 AS VARCHAR) || ' as asked. '
    WHEN 3 THEN '07 es el número. '
    ELSE '' END END"""
SPLIT_SQL = f"SELECT conv_id, turn, role, {_BEGIN} || coalesce(text, '') || {_END} AS text FROM {{conversations}}"
_FLAT = f"SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM ({SPLIT_SQL.format(conversations='conversations')}) GROUP BY conv_id"


def split_conversations(spark, sf):
    """conversations with values that two messages share, by the same SQL text as the oracle's."""
    table(spark, sf, "conversations").createOrReplaceTempView("_conversations")
    return spark.sql(SPLIT_SQL.format(conversations="_conversations").replace("VARCHAR", "STRING"))


@register("c1_request_spans", f"""
WITH flat AS ({_FLAT}), m AS ({O.pattern_matches_sql('flat', 'conv_id', 'text')})
SELECT k AS conv_id, type, value, count(*) AS matches FROM m GROUP BY k, type, value""")
def c1_request_spans(spark, sf):
    """C1 over each request's joined messages: the values found, also those that two messages share."""
    return FL.request_spans(split_conversations(spark, sf)).groupBy("conv_id", "type", "value").agg(F.count(F.lit(1)).alias("matches"))


@register("c1_request_verdicts", f"""
WITH flat AS ({_FLAT}), m AS ({O.pattern_matches_sql('flat', 'conv_id', 'text')}),
     t AS (SELECT k, string_agg(type, ',' ORDER BY rank) AS types FROM (SELECT DISTINCT k, rank, type FROM m) GROUP BY k),
     n AS (SELECT k, count(*) AS matches FROM m GROUP BY k)
SELECT f.conv_id, n.k IS NOT NULL AS detected, coalesce(n.matches, 0) AS matches, coalesce(t.types, '') AS types
FROM flat f LEFT JOIN n ON n.k = f.conv_id LEFT JOIN t ON t.k = f.conv_id""")
def c1_request_verdicts(spark, sf):
    """C1 verdict of each request: detected, matches, types in pattern order."""
    return FL.request_verdicts(split_conversations(spark, sf)).withColumn("types", F.array_join("types", ","))


# A routing number is only recognised beside its word: masked where it stands so, left where it is repeated alone.
_ROUTING = "CAST(100000000 + (conv_id * 7919) % 99999999 AS VARCHAR)"
LEAKY_SQL = f"""SELECT conv_id, turn, role, coalesce(text, '')
    || CASE WHEN turn % 4 = 0 AND conv_id % 3 <> 0 THEN ' Routing number ' || {_ROUTING} || '.' ELSE '' END
    || CASE WHEN turn % 4 = 1 AND conv_id % 3 <> 1 THEN ' As I wrote, (' || {_ROUTING} || ') is mine.' ELSE '' END
    || CASE WHEN turn % 4 = 2 THEN ' Write to c' || CAST(conv_id AS VARCHAR) || '@example.org.' ELSE '' END AS text
FROM {{conversations}}"""


@register("d8_conversation_leaks", f"""
WITH c AS (SELECT conv_id, turn, {_ROUTING} AS value FROM conversations)
SELECT conv_id, turn, 'ROUTING' AS type, value FROM c
WHERE conv_id % 3 = 2 AND turn % 4 = 1 AND conv_id IN (SELECT conv_id FROM c WHERE turn % 4 = 0)""")
def d8_conversation_leaks(spark, sf):
    """Values masked in one turn that another turn still shows."""
    table(spark, sf, "conversations").createOrReplaceTempView("_conversations")
    src = spark.sql(LEAKY_SQL.format(conversations="_conversations").replace("VARCHAR", "STRING"))
    return LK.conversation_leaks(MK.anonymize(src))


# Few texts, so that most requests repeat one; the model fails or finds something now and then.
_REPEATED = """SELECT event_id AS request_id, ts, 'Resumen de ' || event_type || ' para el grupo ' || CAST(user_id % 3 AS VARCHAR) AS text,
    CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 11 = 1 THEN 'found' ELSE 'clean' END AS ner_status FROM {events}"""


@register("h4_cache_skips", f"""
WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ts, request_id) AS i FROM ({_REPEATED.format(events='events')})),
w AS (SELECT text, i, request_id, ts, ner_status AS said, true AS asked, CASE WHEN ner_status = 'clean' THEN ts + INTERVAL 1 HOUR END AS until FROM q WHERE i = 1
      UNION ALL
      SELECT q.text, q.i, q.request_id, q.ts, q.ner_status, w.until IS NULL OR q.ts >= w.until,
             CASE WHEN w.until IS NULL OR q.ts >= w.until THEN CASE WHEN q.ner_status = 'clean' THEN q.ts + INTERVAL 1 HOUR ELSE w.until END ELSE w.until END
      FROM w JOIN q ON q.text = w.text AND q.i = w.i + 1)
SELECT request_id, sha256(text) AS hash, asked, CASE WHEN asked THEN said ELSE 'clean' END AS ner_status FROM w""")
def h4_cache_skips(spark, sf):
    """H4: requests that repeat a text judged clean within the hour aren't asked; they arrive day by day, over several runs of one stream."""
    table(spark, sf, "events").createOrReplaceTempView("_events")
    rows = spark.sql(_REPEATED.format(events="_events").replace("VARCHAR", "STRING"))
    return in_periods(spark, rows, "cache-skips", ST.clean_cache_skips, ST._H4_OUT).select("request_id", "hash", "asked", "ner_status")


def in_periods(spark, rows, name, stream, schema, periods=3):
    """What a stream over ``rows`` gives that arrive in periods of their ``ts``, each in a later run on the same state."""
    base = ST.new_run(spark, name)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    out = spark.createDataFrame([], schema)
    for k in range(periods if first else 0):
        low, high = (first + (last - first) * x / periods for x in (k, k + 1))
        some = rows.where((F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) if k < periods - 1 else F.lit(True)))
        some.write.mode("append").parquet(f"{base}/arrived")
        out = ST.run_to_table(stream(spark.readStream.schema(some.schema).parquet(f"{base}/arrived")), name, base=base)
    return out


@register("h3_edge_quota_stream", C._e5_sql("""SELECT request_id, kp_user_id AS user_id, rl_seq, rl_allowed, edge_seq,
    CASE WHEN pre = 'edge' THEN edge_seq <= edge_lim END AS edge_allowed, FALSE AS late FROM x WHERE authorized"""))
def h3_edge_quota_stream(spark, sf):
    """H3 with E4: the daily and the edge counter on the request stream (= e5's edge outcomes)."""
    wants = PO.path_before_edge(F.lit(True)) == "edge"
    rows = C.verdicts(spark, sf).where("authorized").select("request_id", "ts", "kp_user_id", "kp_tier", "kp_edge_limit", wants.alias("wants_edge"))
    stream = lambda s: ST.quota_stream(s, C.REPLAY_DAILY_LIMITS, C.REPLAY_EDGE_LIMITS, PO.EDGE_FALLBACK_LIMIT)
    return in_periods(spark, rows, "quota", stream, ST._QUOTA_OUT)


_ORIGINALS = f"SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS resp_id, text FROM ({O.PLANTED_CONVERSATIONS_SQL})"


def _masked_replies(spark, sf):
    """(token map, replies): every masked message as a reply that quotes it."""
    m = materialize(MK.anonymize(C.planted_conversations(spark, sf)))
    return MK.token_map(m, ["conv_id"]), m.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("resp_id"), F.col("masked").alias("text"))


@register("d9_restored_texts", _ORIGINALS)
def d9_restored_texts(spark, sf):
    """D9 row by row: restoring every masked message gives its text."""
    known, replies = _masked_replies(spark, sf)
    return MK.restore(replies, known).select("resp_id", F.coalesce("restored", F.lit("")).alias("text"))


@register("h6_restored_pieces", _ORIGINALS)
def h6_restored_pieces(spark, sf):
    """H6 row by row: replies arrive in chunks of seven characters, in no order; each piece given out is restored by itself."""
    known, replies = _masked_replies(spark, sf)
    last = F.greatest(F.ceil(F.length("text") / 7.0), F.lit(1)) - 1
    chunks = replies.select("resp_id", "conv_id", last.alias("_last"), F.posexplode(C.seven_characters("text")).alias("chunk_no", "text")).withColumn("is_last", F.col("chunk_no") == F.col("_last")).drop("_last")
    base = ST.new_run(spark, "pieces")
    chunks.repartition("resp_id", "chunk_no").write.parquet(f"{base}/arrived")
    arrived = spark.read.parquet(f"{base}/arrived")
    source = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", max(1, len(arrived.inputFiles()) // 3)).parquet(f"{base}/arrived")
    pieces = ST.run_to_table(ST.piece_stream(source), "pieces", base=base).withColumn("piece_id", F.concat_ws("#", "resp_id", "piece_no"))
    back = MK.restore(pieces, known, resp_key="piece_id")
    whole = back.groupBy("resp_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", F.coalesce("restored", F.lit("")).alias("t")))).alias("p"))  # one response's pieces
    return whole.select("resp_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
