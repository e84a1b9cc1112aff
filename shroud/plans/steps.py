"""More registered queries: NER replies and cache, outbound bodies, responses, log and report sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shroud.operators import mask as MK
from shroud.operators import ner as NR
from shroud.operators import policy as PO
from shroud.plans import catalog as C
from shroud.plans import derived as D
from shroud.plans import oracle as O
from shroud.plans.catalog import REGISTRY, register
from shroud.session import ensure_checkpoint_dir
from shroud.sources import logs as LG
from shroud.sources.tables import table
from shroud.streaming import stream as ST

SYSTEM_TEXT = "Answer the request as asked."

_AUTHORIZED = f"""kp AS ({C.KP_SQL}), rq AS ({C.RQ_SQL}),
au AS (SELECT rq.*, kp.tier AS kp_tier, kp.provider AS kp_provider, kp.cloud_model AS kp_cloud_model FROM rq
       JOIN kp ON rq.api_key = kp.api_key AND starts_with(rq.api_key, 'key_live_'))"""


def authorized(spark, sf):
    return PO.authorize(C.requests(spark, sf), C.key_policy(spark, sf)).where("authorized")


def scratch(spark, stem: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ C3-C5, F9: the model's replies
_REPLY_SQL = """
SELECT request_id, text,
  CASE WHEN request_id % 34 = 0 THEN 'Sorry, nothing to report.'
       WHEN request_id % 34 = 17 THEN 'Result: {"entities": [{"type": "ORG",'
       WHEN request_id % 17 = 1 THEN 'Result: {"entities": [{"type": "ORG"},'
       WHEN request_id % 17 = 2 THEN '{"entities": "none"}'
       WHEN request_id % 17 = 3 THEN CAST(NULL AS STRING)
       WHEN request_id % 17 = 4 THEN '{"entities": [{"type": "ORG", "value": ""}, {"type": "", "value": "Resumen"}]}'
       WHEN request_id % 17 = 5 THEN '{"entities": [{"type": "ORG", "value": "something never written"}]}'
       ELSE 'Here: {"entities": [{"type": "EVENT", "value": "RESUMEN del Evento"}]} done' END AS reply
FROM """


@register("c3_ner_verdicts", f"""
WITH rq AS ({C.RQ_SQL})
SELECT request_id, CASE WHEN request_id % 17 IN (1, 3) THEN 'error' WHEN request_id % 17 IN (0, 2, 4, 5) THEN 'clean' ELSE 'found' END AS ner_status,
  CASE WHEN request_id % 17 > 5 THEN 'EVENT=RESUMEN del Evento' ELSE '' END AS entities
FROM rq""")
def c3_ner_verdicts(spark, sf):
    """Replies in prose, cut short, of another shape, absent or paraphrasing, read and kept only where verbatim."""
    v = D._view(C.requests(spark, sf).select("request_id", "text"), "replied")
    out = NR.ner_verdicts(spark.sql(_REPLY_SQL + v))
    return out.select("request_id", "ner_status", F.array_join(F.transform(
        "ner_entities", lambda e: F.concat_ws("=", e["type"], e["value"])), ";").alias("entities"))


@register("c5_texts_needing_ner", """
WITH t AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS hash FROM conversations),
c AS (SELECT DISTINCT hash FROM t WHERE conv_id % 3 = 0 AND turn < 3)
SELECT DISTINCT hash FROM t WHERE hash NOT IN (SELECT hash FROM c)""")
def c5_texts_needing_ner(spark, sf):
    """Each distinct text without a clean verdict of the last hour. One conversation in three
    has verdicts, by turn 0, 20, 40, 60... minutes old; those of an hour and more have expired."""
    conv = table(spark, sf, "conversations", "conv_id", "turn", "text")
    as_of = F.timestamp_seconds(F.lit(1_700_000_000))
    judged = conv.where("conv_id % 3 = 0").withColumn("ner_status", F.lit("clean"))
    cache = judged.select(NR.text_hash(F.col("text")).alias("hash"),
                          F.timestamp_seconds(F.lit(1_700_000_000) - F.col("turn") * 1200).alias("cached_at"))
    return NR.needs_ner(conv, cache, as_of).select("hash")


@register("c5_cache_updates", f"""
WITH rq AS ({C.RQ_SQL})
SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM rq WHERE request_id % 17 IN (0, 2, 4, 5)""")
def c5_cache_updates(spark, sf):
    """Cache entries of clean verdicts; neither findings nor errors are cached."""
    v = D._view(C.requests(spark, sf).select("request_id", "text"), "replied")
    return NR.cache_updates(NR.ner_verdicts(spark.sql(_REPLY_SQL + v)), F.current_timestamp()).select("hash")


@register("h4_clean_cache_stream", f"""
WITH rq AS ({C.RQ_SQL})
SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM rq WHERE request_id % 17 IN (0, 2, 4, 5)""")
def h4_clean_cache_stream(spark, sf):
    """H4: the same cache entries from the stream of verdicts, each text once."""
    reqs = D.requests(spark, ST.table_stream(spark, sf, "events")).select("request_id", "ts", "text")
    v = D._view(reqs, "replied")
    verdicts = NR.ner_verdicts(spark.sql(_REPLY_SQL.replace("request_id, text,", "request_id, ts, text,") + v))
    return ST.run_to_table(ST.clean_cache_stream(verdicts), C._sink("h4")).select("hash")


# ------------------------------------------------------------------ D6: choices
@register("d6_restore_choices", f"""
WITH s AS ({O.PLANTED_CONVERSATIONS_SQL})
SELECT conv_id, turn, 3 AS choices, text AS first, CAST(NULL AS VARCHAR) AS second, 'Eco: ' || text AS third FROM s""")
def d6_restore_choices(spark, sf):
    """Each masked message comes back as three choices, one of them without content."""
    m = MK.anonymize(C.planted_conversations(spark, sf))
    tm = MK.token_map(m, ["conv_id"])

    def choice(content):
        return F.struct(F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"))
    resp = m.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("resp_id"), F.array(
        choice(F.col("masked")), choice(F.lit(None).cast("string")), choice(F.concat(F.lit("Eco: "), F.col("masked")))).alias("choices"))
    got = F.transform("choices", lambda c: c["message"]["content"])
    return MK.restore_choices(resp, tm).select("conv_id", "turn", F.size("choices").alias("choices"), got[0].alias("first"),
                                               got[1].alias("second"), got[2].alias("third"))


# ------------------------------------------------------------------ E6-E11: bodies
@register("e6_outbound_body", f"""
WITH {_AUTHORIZED},
mv AS (SELECT request_id, t AS masked FROM ({O.sequential_mask_sql("SELECT request_id, text FROM au", key="request_id", numbered=True)})),
m AS (SELECT au.*, mv.masked, coalesce(CASE WHEN model <> '' THEN model END, kp_cloud_model) AS chosen,
             coalesce(kp_provider, 'openai') AS prefix FROM au JOIN mv ON mv.request_id = au.request_id)
SELECT request_id, CASE WHEN contains(chosen, '/') THEN chosen ELSE prefix || '/' || chosen END AS model, temperature,
  max_tokens AS max_completion_tokens, 'user' AS role, masked AS content FROM m""")
def e6_outbound_body(spark, sf):
    """The body sent upstream for every authorized request, its message masked."""
    r = authorized(spark, sf)
    keys = ["request_id", "model", "temperature", "max_tokens", "kp_cloud_model", "kp_provider"]
    m = MK.mask_texts(r, "text", keys)
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("masked").alias("content")))
    body = PO.outbound_body(m, F.coalesce("kp_provider", F.lit(PO.DEFAULT_PROVIDER)), messages)
    out = m.select("request_id", body.alias("b"))
    return out.select("request_id", "b.model", "b.temperature", "b.max_completion_tokens",
                      F.col("b.messages")[0]["role"].alias("role"), F.col("b.messages")[0]["content"].alias("content"))


@register("e10_edge_payload", f"""
WITH {_AUTHORIZED}
SELECT request_id, 'system,user' AS roles,
  CASE WHEN request_id % 4 = 0 THEN 'given' ELSE '{SYSTEM_TEXT}' END AS system_text, text AS user_text,
  coalesce(max_tokens, 1024) AS max_tokens, coalesce(CASE WHEN request_id % 5 <> 0 THEN temperature END, 0.7) AS temperature FROM au""")
def e10_edge_payload(spark, sf):
    """What the edge model gets; one request in four brings its own system message."""
    r = authorized(spark, sf)

    def msg(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    own = F.when(F.col("request_id") % 4 == 0, F.array(msg("system", F.lit("given")), msg("user", F.col("text")))) \
        .otherwise(F.array(msg("user", F.col("text"))))
    p = r.select("request_id", PO.edge_payload(own, SYSTEM_TEXT, F.col("max_tokens"),
                                               F.when(F.col("request_id") % 5 != 0, F.col("temperature"))).alias("p"))
    return p.select("request_id", F.array_join(F.col("p.messages.role"), ",").alias("roles"),
                    F.col("p.messages")[0]["content"].alias("system_text"), F.col("p.messages")[1]["content"].alias("user_text"),
                    "p.max_tokens", "p.temperature")


# ------------------------------------------------------------------ E13, E14: what the client sees
@register("e13_client_errors")
def e13_client_errors(spark, sf):
    """Requests per error class of the client; the error code is the outcome where the proxy names it."""
    d = C.decided(spark, sf)
    code = F.when(F.col("outcome").isin("strategy_mismatch", "ner_unavailable"), F.col("outcome"))
    return (d.select(F.coalesce(PO.classify_outcome(F.col("status_code"), code), F.lit("none")).alias("error_class"))
            .groupBy("error_class").agg(F.count(F.lit(1)).alias("requests")))


REGISTRY["e13_client_errors"] = (REGISTRY["e13_client_errors"][0], C._e5_sql("""
SELECT CASE outcome WHEN 'unauthorized' THEN 'authentication' WHEN 'rate_limited' THEN 'rate_limit'
  WHEN 'edge_rate_limited' THEN 'rate_limit' WHEN 'strategy_mismatch' THEN 'strategy_mismatch'
  WHEN 'ner_unavailable' THEN 'ner_unavailable' WHEN 'invalid_json' THEN 'api_error' ELSE 'none' END AS error_class,
  count(*) AS requests FROM y GROUP BY 1"""))


@register("e14_parse_response", f"""
WITH rq AS ({C.RQ_SQL})
SELECT request_id, CASE WHEN request_id % 6 = 0 THEN '' ELSE 'resp-' || CAST(request_id AS VARCHAR) END AS id,
  CASE WHEN request_id % 6 IN (0, 1) THEN 'cloud' ELSE 'edge' END AS routed_to,
  request_id % 6 = 2 AS anonymized, CASE WHEN request_id % 6 = 2 THEN CAST(request_id % 9 AS INTEGER) ELSE 0 END AS pii_matches,
  CASE WHEN request_id % 6 > 1 THEN 1 ELSE 0 END AS choices, CASE WHEN request_id % 6 > 1 THEN text END AS content
FROM rq""")
def e14_parse_response(spark, sf):
    """Response JSON, complete, partial or unreadable, as typed fields with the client's defaults."""
    r = C.requests(spark, sf).select("request_id", "text")
    kind = F.col("request_id") % 6
    rid = F.concat(F.lit("resp-"), F.col("request_id").cast("string"))
    choices = F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message")))
    body = F.when(kind == 0, F.lit("upstream broke")).when(kind == 1, F.to_json(F.struct(rid.alias("id")))).otherwise(
        F.to_json(F.struct(rid.alias("id"), F.lit("edge").alias("routed_to"), F.when(kind == 2, True).alias("anonymized"),
                           F.when(kind == 2, F.col("request_id") % 9).alias("pii_matches"), choices.alias("choices"))))
    p = r.select("request_id", PO.parse_response(body).alias("p"))
    return p.select("request_id", "p.id", "p.routed_to", "p.anonymized", "p.pii_matches", F.size("p.choices").alias("choices"),
                    F.get("p.choices", F.lit(0))["message"]["content"].alias("content"))


# ------------------------------------------------------------------ A5, A6, A9, A10: sinks
@register("a5_log_round_trip", C._e5_sql(f"SELECT * FROM ({C._E12_FINAL})"))
def a5_log_round_trip(spark, sf):
    """A5: audit rows appended to the day-partitioned log and read back."""
    path = scratch(spark, "request-log")
    LG.write_request_log(PO.log_rows(C.decided(spark, sf)), path)
    return spark.read.parquet(path).withColumn("pii_types", F.array_join("pii_types", ","))


_A6_RESPONSE = """'{"id":"r-' || CAST(request_id AS VARCHAR) || '","choices":[{"message":{"content":"[EMAIL_1]"}}]}'"""


@register("a6_live_dev_log", f"""
WITH d AS ({C._e5_sql(f"SELECT l.*, rq.text FROM ({C._E12_FINAL}) l JOIN rq USING (request_id)")}),
     p AS (SELECT request_id, t AS prompt FROM ({O.sequential_mask_sql("SELECT request_id, text FROM d", key="request_id", numbered=True)}))
SELECT request_id, 'devlog:' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(date_part('milliseconds', ts) % 1000 AS VARCHAR), 3, '0')
  || 'Z:' || coalesce(api_key_id, 'unknown') AS log_key, prompt, {_A6_RESPONSE} AS response
FROM d JOIN p USING (request_id)
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def a6_live_dev_log(spark, sf):
    """The development log with its masked prompts and the responses, as it stands at the time of the last event: what is older than seven days is gone."""
    path = scratch(spark, "dev-log")
    exchanges = C.requests(spark, sf).select("request_id", "text", F.expr(_A6_RESPONSE.replace("VARCHAR", "STRING")).alias("response"))
    LG.write_dev_log(PO.log_rows(C.decided(spark, sf)), exchanges, path)
    as_of = table(spark, sf, "events", "ts").agg(F.max("ts").alias("t")).collect()[0]["t"]
    return LG.live_dev_log(spark.read.parquet(path), F.lit(as_of)).select("request_id", "log_key", "prompt", "response")


@register("a9_report_round_trip", """
SELECT event_type, count(*) AS events, CAST('2024-02-10' AS DATE) AS run_date FROM events GROUP BY event_type""")
def a9_report_round_trip(spark, sf):
    """A report section written for two days, the newer one written again; the latest is read."""
    path = scratch(spark, "report")
    events = table(spark, sf, "events", "event_id", "event_type")
    full = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    LG.write_report(events.where("event_id % 2 = 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("events")), path, "2024-02-09")
    LG.write_report(full.where("events < 0"), path, "2024-02-10")
    LG.write_report(full, path, "2024-02-10")
    return LG.latest_report(spark.read.parquet(path))
