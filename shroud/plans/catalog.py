"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder reads the driver tables under ``sf_dir`` (or data Spark derives
from them), so its work grows with the tables. Names carry the SURVEY §2
operator id they exercise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.functions.windows import spread, tasks_for
from shroud.session import ensure_checkpoint_dir, materialize
from shroud.operators import corpus, detect
from shroud.plans import oracle as O
from shroud.sources import logs as LG
from shroud.sources.tables import table

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents", "doc_id", "text"))


def customer_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled cases, one per customer row; materialized once (it feeds many branches)."""
    return materialize(corpus.generate(table(spark, sf, "customer", "c_custkey"), "c_custkey"))


# ------------------------------------------------------------------ C: detection
@register("c1_pii_type_counts", f"""
SELECT type, count(DISTINCT k) AS docs, count(*) AS matches
FROM ({O.pattern_matches_sql('documents', 'doc_id', 'text')}) GROUP BY type""")
def c1_pii_type_counts(spark, sf):
    return detect.pii_type_counts(documents(spark, sf))


# ------------------------------------------------------------------ B: corpus
@register("b1_eval_cases", corpus.oracle_cases_sql("customer", "c_custkey"))
def b1_eval_cases(spark, sf):
    return corpus.eval_cases(customer_corpus(spark, sf))


@register("b1_eval_entities", corpus.oracle_entities_sql("customer", "c_custkey"))
def b1_eval_entities(spark, sf):
    return corpus.eval_entities(customer_corpus(spark, sf))


# ------------------------------------------------------------------ shared derived inputs
from shroud.functions import idgen as _G  # noqa: E402
from shroud.operators import evaluate as EV  # noqa: E402
from shroud.operators import mask as MK  # noqa: E402
from shroud.operators import ner as NR  # noqa: E402
from shroud.operators import policy as PO  # noqa: E402
from shroud.plans import derived as D  # noqa: E402

# Scaled-down daily quotas so that denials occur on the driver's event volume
# (10k events, 150 users, 30 days); the operator default is the proxy's.
REPLAY_DAILY_LIMITS = {"free": 2, "pro": 4, "enterprise": 1000}
REPLAY_EDGE_LIMITS = {"free": 1, "pro": 2, "enterprise": 50}


def key_policy(spark, sf):
    return D.key_policy(spark, table(spark, sf, "customer", "c_custkey", "c_name"))


def requests(spark, sf):
    return D.requests(spark, table(spark, sf, "events"))


def request_tasks(spark, sf) -> int:
    """Tasks for a kernel over the requests' texts (the count comes from the files' footers)."""
    return tasks_for(spark, table(spark, sf, "events").count())


def verdicts(spark, sf):
    """Policy, verdict and reply of every request. Texts are scanned and left behind before the
    policy join, which carries verdict columns only; what the row or its key already rejects
    has no verdict. The result is stored, as it feeds several branches."""
    r = D.with_request_ner(spark, spread(requests(spark, sf), request_tasks(spark, sf)))
    live = F.col("body_ok") & F.coalesce(F.col("api_key").startswith(PO.KEY_PREFIX), F.lit(False))
    r = r.withColumn("text", F.when(live, F.col("text")))
    r = r.select("*", detect.detect_pii("text").alias("_v"), detect.secret_types("text").alias("_s")).drop("text")
    r = PO.authorize(D.with_provider_reply(spark, r), key_policy(spark, sf))
    mode = PO.strategy_mode(F.col("kp_pii_strategy"))
    scan = PO.may_be_scanned(F.col("authorized"), F.col("body_ok"), mode, F.col("body_strategy"))
    none = F.array().cast("array<string>")
    return materialize(r.select(
        "*", F.when(scan, F.col("_s")).otherwise(none).alias("secret_types"), (scan & F.col("_v.detected")).alias("regex_detected"),
        F.when(scan, F.col("_v.types")).otherwise(none).alias("regex_types"), F.when(scan, F.col("_v.matches")).otherwise(0).alias("regex_matches"),
        (scan & (F.size("_s") > 0)).alias("has_secret")).drop("_v", "_s"))


def decided(spark, sf):
    """E5 over every request."""
    r = verdicts(spark, sf)
    authd = PO.daily_quota(r.where("authorized"), REPLAY_DAILY_LIMITS)
    unauth = r.where("NOT authorized")
    for c, t in [("rl_day", "date"), ("rl_seq", "long"), ("rl_limit", "int"), ("rl_allowed", "boolean"),
                 ("rl_remaining", "long"), ("rl_reset", "string")]:
        unauth = unauth.withColumn(c, F.lit(None).cast(t))
    both = authd.unionByName(unauth.withColumn("rl_allowed", F.lit(True)))
    return PO.route(both, REPLAY_EDGE_LIMITS)


def _sql_view(name: str, sql: str) -> str:
    return f"{name} AS ({sql})"


KP_SQL = D.KEY_POLICY_SQL.format(customer="customer")
RQ_SQL = D.requests_sql("events")


# ------------------------------------------------------------------ A: sources/sinks
@register("a3_authorize", f"""
WITH kp AS ({KP_SQL}), rq AS ({RQ_SQL})
SELECT rq.request_id, kp.user_id AS user_id, kp.tier AS tier, (kp.api_key IS NOT NULL) AS authorized
FROM rq LEFT JOIN kp ON rq.api_key = kp.api_key AND starts_with(rq.api_key, 'key_live_')""")
def a3_authorize(spark, sf):
    r = PO.authorize(requests(spark, sf), key_policy(spark, sf))
    return r.select("request_id", F.col("kp_user_id").alias("user_id"), F.col("kp_tier").alias("tier"), "authorized")


@register("a4_key_info", f"""
WITH kp AS ({KP_SQL})
SELECT api_key, coalesce(provider, 'openai') AS provider, coalesce(provider_mode, 'managed') AS provider_mode,
       cloud_model FROM kp""")
def a4_key_info(spark, sf):
    return PO.key_info(key_policy(spark, sf))


# ------------------------------------------------------------------ E: policy replay
@register("e1_resolve_strategy", f"""
WITH kp AS ({KP_SQL}), rq AS ({RQ_SQL}),
j AS (SELECT rq.request_id, rq.body_strategy, coalesce(kp.pii_strategy, 'anonymize') AS mode
      FROM rq JOIN kp ON rq.api_key = kp.api_key AND starts_with(rq.api_key, 'key_live_'))
SELECT request_id, mode AS strategy_mode,
  CASE WHEN mode = 'custom' THEN CASE WHEN body_strategy IN ('edge', 'anonymize') THEN body_strategy ELSE 'anonymize' END
       ELSE mode END AS applied_strategy,
  (mode <> 'custom' AND body_strategy IS NOT NULL AND body_strategy <> '' AND body_strategy <> mode) AS strategy_mismatch
FROM j""")
def e1_resolve_strategy(spark, sf):
    r = PO.authorize(requests(spark, sf), key_policy(spark, sf)).where("authorized")
    mode = PO.strategy_mode(F.col("kp_pii_strategy"))
    return r.select("request_id", mode.alias("strategy_mode"),
                    PO.resolve_strategy(mode, F.col("body_strategy")).alias("applied_strategy"),
                    PO.strategy_mismatch(mode, F.col("body_strategy")).alias("strategy_mismatch"))


_LIM = REPLAY_DAILY_LIMITS


@register("e3_daily_quota", f"""
WITH kp AS ({KP_SQL}), rq AS ({RQ_SQL}),
j AS (SELECT rq.request_id, rq.ts, kp.user_id, kp.tier FROM rq
      JOIN kp ON rq.api_key = kp.api_key AND starts_with(rq.api_key, 'key_live_')),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, request_id) AS seq,
        CASE tier WHEN 'pro' THEN {_LIM['pro']} WHEN 'enterprise' THEN {_LIM['enterprise']} ELSE {_LIM['free']} END AS lim
      FROM j)
SELECT request_id, user_id, seq AS rl_seq, lim AS rl_limit, seq <= lim AS rl_allowed,
       greatest(lim - seq, 0) AS rl_remaining, strftime(CAST(ts AS DATE), '%Y-%m-%d') || 'T23:59:59Z' AS rl_reset
FROM n""")
def e3_daily_quota(spark, sf):
    r = PO.authorize(requests(spark, sf), key_policy(spark, sf)).where("authorized")
    q = PO.daily_quota(r, REPLAY_DAILY_LIMITS)
    return q.select("request_id", F.col("kp_user_id").alias("user_id"), "rl_seq", "rl_limit", "rl_allowed",
                    "rl_remaining", "rl_reset")


@register("e5_route_decisions")
def e5_route_decisions(spark, sf):
    d = decided(spark, sf)
    return d.select("request_id", "outcome", "status_code", "routed_to", "anonymized", "applied_strategy",
                    "strategy_mode", "ner_ran", F.array_join("pii_types", ",").alias("pii_types"),
                    "pii_matches", "has_secret")


@register("e12_request_log")
def e12_request_log(spark, sf):
    d = decided(spark, sf)
    return PO.log_rows(d).withColumn("pii_types", F.array_join("pii_types", ","))


@register("g17_usage_rollup")
def g17_usage_rollup(spark, sf):
    """Requests, anonymized share, PII, tokens and latency per day/tier/strategy/provider (rollup)."""
    logs = PO.log_rows(decided(spark, sf))
    return (logs.rollup("log_date", "tier", "pii_strategy", "provider")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("anonymized").cast("int")).alias("anonymized"),
                 F.sum("pii_matches").alias("pii_matches"), F.sum("tokens_in").alias("tokens_in"),
                 F.sum("tokens_out").alias("tokens_out"), F.sum("latency_ms").alias("latency_ms_sum"),
                 F.max("latency_ms").alias("latency_ms_max"))
            .withColumn("log_date", F.col("log_date").cast("string")))


@register("g17_compliance_events")
def g17_compliance_events(spark, sf):
    """Logged requests per day, tier and kind of personal data."""
    logs = PO.log_rows(decided(spark, sf))
    return (logs.select(F.col("log_date").cast("string").alias("log_date"), "tier", F.explode("pii_types").alias("type"), "anonymized")
            .groupBy("log_date", "tier", "type")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("anonymized").cast("int")).alias("anonymized")))


@register("a7_latest_logs")
def a7_latest_logs(spark, sf):
    """Newest N = min(limit or 100, 500) log rows, total order (ts desc, request_id desc)."""
    newest = LG.latest_logs(PO.log_rows(decided(spark, sf)))
    return newest.select("request_id", "ts", "user_id", "status_code", F.array_join("pii_types", ",").alias("pii_types"))


# ------------------------------------------------------------------ D: masking
_D4_SQL = O.token_rows_sql("SELECT doc_id, text FROM documents", ["doc_id"])
_D7_SQL = f"SELECT type, count(DISTINCT doc_id) AS docs, count(*) AS tokens FROM ({_D4_SQL}) GROUP BY type"
_D2_SQL = O.token_rows_sql(O.PLANTED_CONVERSATIONS_SQL, ["conv_id", "turn"], conv_keys=["conv_id"], order_keys=["turn"])


@register("d4_token_map_documents", _D4_SQL)
def d4_token_map_documents(spark, sf):
    m = MK.mask_texts(documents(spark, sf), "text", ["doc_id"])
    return MK.token_map(m, ["doc_id"])


@register("d7_token_counts_documents", _D7_SQL)
def d7_token_counts_documents(spark, sf):
    m = MK.mask_texts(documents(spark, sf), "text", ["doc_id"])
    return (MK.token_type_counts(m, ["doc_id"]).groupBy("type")
            .agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))


def planted_conversations(spark, sf, c=None):
    """conversations + derived personal data per turn (the driver text has none)."""
    c = table(spark, sf, "conversations") if c is None else c
    ns = P_SPARK_NS()
    k = F.col("conv_id") * 1000 + F.col("turn")
    extra = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" Escríbeme a c"), F.col("conv_id").cast("string"),
                                                     F.lit("t"), F.col("turn").cast("string"), F.lit("@example.org.")))
             .otherwise(F.lit("")))
    extra2 = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0,
                    F.concat(F.lit(" Mi DNI es "), F.col("conv_id").cast("string"), F.lit(" y tel 6"),
                             F.lpad((k % 100000000).cast("string"), 8, "0"), F.lit("."))).otherwise(F.lit(""))
    extra3 = F.when(F.col("turn") == 1, F.concat(F.lit(" Otra vez: c"), F.col("conv_id").cast("string"),
                                                 F.lit("t0@example.org"))).otherwise(F.lit(""))
    del ns
    return c.select("conv_id", "turn", "role",
                    F.concat(F.coalesce("text", F.lit("")), extra, extra2, extra3).alias("text"))


def P_SPARK_NS():
    from shroud.functions import pools
    return pools.spark_ns()


@register("d2_conversation_token_map", _D2_SQL)
def d2_conversation_token_map(spark, sf):
    m = MK.anonymize(planted_conversations(spark, sf))
    return MK.token_map(m, ["conv_id"])


@register("d9_roundtrip", """
SELECT count(*) AS messages, count(*) AS restored_exactly FROM conversations""")
def d9_roundtrip(spark, sf):
    src = planted_conversations(spark, sf)
    m = MK.anonymize(src)
    tm = MK.token_map(m, ["conv_id"])
    resp = m.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("resp_id"), F.col("masked").alias("text"))
    back = MK.restore(resp, tm)
    orig = src.select(F.concat_ws(":", "conv_id", "turn").alias("resp_id"), F.col("text").alias("orig"))
    j = back.join(orig, "resp_id")
    return j.agg(F.count(F.lit(1)).alias("messages"),
                 F.sum((F.col("restored") == F.col("orig")).cast("long")).alias("restored_exactly"))


@register("d8_leak_check", "SELECT 0 AS leaks")
def d8_leak_check(spark, sf):
    m = MK.anonymize(planted_conversations(spark, sf))
    return MK.leak_rows(m).agg(F.count(F.lit(1)).alias("leaks"))


# ------------------------------------------------------------------ F/G: regex evaluation
def scored(spark, sf):
    return EV.score_entities(EV.masked_cases(customer_corpus(spark, sf)))


def fps(spark, sf):
    return EV.false_positives(EV.masked_cases(customer_corpus(spark, sf)))


@register("f2_scored_entities")
def f2_scored_entities(spark, sf):
    return scored(spark, sf).select("case_id", "ord", "type", "value", "detected", "partial")


@register("g1_recall_by_type")
def g1_recall_by_type(spark, sf):
    return EV.recall_by_type(scored(spark, sf))


@register("g2_recall_breakdown")
def g2_recall_breakdown(spark, sf):
    return EV.recall_breakdown(scored(spark, sf))


@register("g3_false_negatives")
def g3_false_negatives(spark, sf):
    return EV.false_negatives(scored(spark, sf))


@register("f6_regex_false_positives")
def f6_regex_false_positives(spark, sf):
    return fps(spark, sf).select("case_id", "type", "value")


@register("g5_fp_by_type")
def g5_fp_by_type(spark, sf):
    return EV.fp_by_type(fps(spark, sf))


@register("g6_precision_by_type")
def g6_precision_by_type(spark, sf):
    m = EV.masked_cases(customer_corpus(spark, sf))
    return EV.precision_by_type(EV.score_entities(m), EV.false_positives(m))


@register("g7_gap_mismatches")
def g7_gap_mismatches(spark, sf):
    return EV.gap_mismatches(scored(spark, sf))


@register("g4_regex_totals")
def g4_regex_totals(spark, sf):
    return EV.totals(EV.masked_cases(customer_corpus(spark, sf)))


# ------------------------------------------------------------------ C3-C8 / F4-F5 / G8-G14: NER evaluation
def case_ner(spark, sf):
    return D.case_ner(spark, customer_corpus(spark, sf))


@register("c3_case_ner_replies")
def c3_case_ner_replies(spark, sf):
    return case_ner(spark, sf).select("case_id", "model", "status", "latency_ms",
                                      F.size(F.coalesce("ents", F.array())).alias("returned"))


def ner_scored(spark, sf, model="ner-large"):
    c = customer_corpus(spark, sf)
    return EV.ner_scored(c, D.case_ner(spark, c), model)


@register("g8_ner_recall")
def g8_ner_recall(spark, sf):
    return EV.ner_recall(ner_scored(spark, sf)).withColumn("type", F.coalesce("type", F.lit("ALL")))


@register("f5_ner_false_positives")
def f5_ner_false_positives(spark, sf):
    return ner_scored(spark, sf).select("case_id", F.inline("false_pos"))


@register("g12_ner_summary")
def g12_ner_summary(spark, sf):
    return EV.ner_summary(ner_scored(spark, sf))


@register("g14_model_comparison")
def g14_model_comparison(spark, sf):
    c = customer_corpus(spark, sf)
    return EV.model_comparison(EV.ner_scored(c, D.case_ner(spark, c)))


@register("g13_combined_recall")
def g13_combined_recall(spark, sf):
    c = customer_corpus(spark, sf)
    reg = EV.totals(EV.masked_cases(c))
    ner_sum = EV.ner_summary(EV.ner_scored(c, D.case_ner(spark, c), "ner-large"))
    labels = c.select(F.explode("entities").alias("e")).where(~F.col("e.ner_scope")).agg(F.count(F.lit(1)).alias("n"))
    return EV.combined_recall(reg, ner_sum, labels)


# ------------------------------------------------------------------ B24: identifier validity
@register("b24_id_validity")
def b24_id_validity(spark, sf):
    e = corpus.eval_entities(customer_corpus(spark, sf))
    ok = (F.when(F.col("value").rlike(r"^[XYZ]"), _G.nie_check_ok(F.col("value")))
          .when(F.col("type") == "CIF", _G.cif_check_ok(F.col("value")))
          .otherwise(_G.nif_check_ok(F.col("value"))))
    return (e.where(F.col("type").isin("DNI", "CIF")).withColumn("valid", ok)
            .groupBy("type").agg(F.count(F.lit(1)).alias("labels"),
                                 F.count_if(F.col("valid")).alias("valid"),
                                 F.count_if(F.col("valid").isNull()).alias("unchecked")))


# ------------------------------------------------------------------ H: streaming
from shroud.streaming import stream as ST  # noqa: E402

_STREAM_SEQ = [0]


def _sink(stem: str) -> str:
    _STREAM_SEQ[0] += 1
    return f"shroud_{stem}_{_STREAM_SEQ[0]}"


@register("h1_detect_stream", _D7_SQL)
def h1_detect_stream(spark, sf):
    """H1: documents as a stream, masked per row; token counts per type (= d7)."""
    s = ST.detect_stream(ST.table_stream(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    out = ST.run_to_table(s.select("doc_id", "tokens"), _sink("h1"))
    return (MK.token_type_counts(out, ["doc_id"]).groupBy("type")
            .agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))


@register("h2_conversation_mask_stream", _D2_SQL)
def h2_conversation_mask_stream(spark, sf):
    """H2: conversation-wide numbering continued across arriving turns (= d2)."""
    s = planted_conversations(spark, sf, ST.table_stream(spark, sf, "conversations"))
    out = ST.run_to_table(ST.conversation_mask_stream(s), _sink("h2"))
    return MK.token_map(out, ["conv_id"])


@register("h3_rate_limit_stream", f"""
WITH kp AS ({KP_SQL}), rq AS ({RQ_SQL}),
j AS (SELECT rq.request_id, rq.ts, kp.user_id, kp.tier FROM rq
      JOIN kp ON rq.api_key = kp.api_key AND starts_with(rq.api_key, 'key_live_')),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, request_id) AS seq,
        CASE tier WHEN 'pro' THEN {_LIM['pro']} WHEN 'enterprise' THEN {_LIM['enterprise']} ELSE {_LIM['free']} END AS lim
      FROM j)
SELECT request_id, user_id, seq AS rl_seq, seq <= lim AS rl_allowed, FALSE AS late FROM n""")
def h3_rate_limit_stream(spark, sf):
    """H3: daily quota on the request stream (= e3's ordinals)."""
    ev = ST.table_stream(spark, sf, "events")
    reqs = D.requests(spark, ev)
    auth = PO.authorize(reqs, key_policy(spark, sf)).where("authorized")
    out = ST.run_to_table(ST.rate_limit_stream(auth, REPLAY_DAILY_LIMITS), _sink("h3"))
    return out.select("request_id", "user_id", "rl_seq", "rl_allowed", "late")


@register("h5_usage_windows", """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, sum(value) AS value_sum
FROM events GROUP BY 1, 2""")
def h5_usage_windows(spark, sf):
    # update mode: the batch-equivalent table, including windows the watermark has not closed yet
    return ST.run_to_table(ST.usage_windows(ST.table_stream(spark, sf, "events")), _sink("h5"), ["window_start", "event_type"])


def seven_characters(text):
    """A text cut into chunks of seven characters, an empty one into one; in one pass, as ``substr`` counts from the start for each chunk."""
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,7}"), F.lit(0)))


@register("h6_chunked_restore", """
SELECT count(*) AS messages, count(*) AS restored_exactly FROM conversations""")
def h6_chunked_restore(spark, sf):
    """H6: masked replies cut into 7-character chunks (tokens split across chunks),
    reassembled per response as they arrive, then restored; all must equal the originals."""
    src = planted_conversations(spark, sf)
    m = MK.anonymize(src)
    tm = MK.token_map(m, ["conv_id"])
    resp = m.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("resp_id"), F.col("masked").alias("text"))
    chunks = resp.select("resp_id", "conv_id", F.posexplode(seven_characters("text")).alias("chunk_no", "text"),
                         F.greatest(F.ceil(F.length("text") / 7.0), F.lit(1)).alias("chunks"))
    # Hashed to files by chunk, so a response's chunks arrive over several micro-batches in no order.
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_sink('h6')}-{uuid.uuid4().hex}"
    (chunks.withColumn("is_last", F.col("chunk_no") == F.col("chunks") - 1).repartition("resp_id", "chunk_no")
     .write.parquet(path))
    arriving = spark.read.parquet(path).schema
    stream = spark.readStream.schema(arriving).option("maxFilesPerTrigger", max(1, len(spark.read.parquet(path).inputFiles()) // 3)).parquet(path)
    whole = ST.run_to_table(ST.reassemble_stream(stream), _sink("h6")).where("complete")
    back = MK.restore(whole, tm)
    orig = src.select(F.concat_ws(":", "conv_id", "turn").alias("resp_id"), F.col("text").alias("orig"))
    return back.join(orig, "resp_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum((F.coalesce("restored", F.lit("")) == F.col("orig")).cast("long")).alias("restored_exactly"))


# ------------------------------------------------------------------ A1/A2, C2, C9, A11
from shroud.sources import messages as MS  # noqa: E402


def request_bodies(spark, sf):
    """JSON bodies built from the requests (some malformed: not JSON / non-array messages)."""
    r = requests(spark, sf)
    good = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
                              .alias("messages"), "model", F.col("body_strategy").alias("pii_strategy")))
    body = (F.when(~F.col("body_ok"), F.lit("not json {"))
            .when(F.col("request_id") % 59 == 0, F.lit('{"messages": "nope"}')).otherwise(good))
    return r.select("request_id", body.alias("body"))


@register("a1_read_messages")
def a1_read_messages(spark, sf):
    return MS.read_messages(request_bodies(spark, sf))


@register("a2_flatten_segments", """
WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS content FROM conversations)
SELECT conv_id, turn, content,
  CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  sum(length(content) + 1) OVER (PARTITION BY conv_id) - 1 AS total_length
FROM m""")
def a2_flatten_segments(spark, sf):
    return MS.flatten_segments(table(spark, sf, "conversations"))


@register("c2_secret_types", f"""
WITH rq AS ({RQ_SQL})
SELECT request_id, 'SECRET_CLOUD_KEY' AS secret_types FROM rq WHERE regexp_matches(text, 'AKIA[0-9A-Z]{{16}}')""")
def c2_secret_types(spark, sf):
    r = requests(spark, sf).select("request_id", F.array_join(detect.secret_types("text"), ",").alias("secret_types"))
    return r.where(F.col("secret_types") != "")


@register("c9_detect_report")
def c9_detect_report(spark, sf):
    """C9 (/v1/detect): per authorized request types, counts, secrets, masked text, NER flags."""
    r = PO.authorize(D.with_request_ner(spark, requests(spark, sf)), key_policy(spark, sf)).where("authorized")
    return detect.detect_report(spread(r, request_tasks(spark, sf)), dealt=True)


# ------------------------------------------------------------------ NER oracles (DuckDB)
def _ner_base_sql() -> str:
    cases = corpus.oracle_cases_sql("customer", "c_custkey")
    ents = corpus.oracle_entities_sql("customer", "c_custkey")
    rep, er = D.case_ner_sql("cases", "ents")
    return f"""
WITH cases AS ({cases}),
ents AS ({ents}),
rep AS ({rep}),
er AS ({er}),
ex AS (SELECT case_id, ord, type, value, lower(value) AS norm FROM ents WHERE ner_scope),
verb AS (SELECT er.case_id, er.model, er.type, er.value, lower(er.value) AS norm
         FROM er JOIN cases c ON c.case_id = er.case_id
         JOIN rep r ON r.case_id = er.case_id AND r.model = er.model
         WHERE r.status <> 'error' AND er.value IS NOT NULL AND length(er.value) > 0
           AND instr(lower(c.text), lower(er.value)) > 0)"""


_NER_BASE = _ner_base_sql()

_C3_SQL = _NER_BASE + """
SELECT r.case_id, r.model, r.status, r.latency_ms, coalesce(n.cnt, 0) AS returned
FROM rep r LEFT JOIN (SELECT case_id, model, count(*) AS cnt FROM er GROUP BY case_id, model) n
  ON n.case_id = r.case_id AND n.model = r.model"""

_G8_SQL = _NER_BASE + """,
hits AS (SELECT ex.type, CASE WHEN r.status <> 'error' AND EXISTS (
            SELECT 1 FROM verb v WHERE v.case_id = ex.case_id AND v.model = r.model AND v.type = ex.type
              AND (instr(v.norm, ex.norm) > 0 OR instr(ex.norm, v.norm) > 0)) THEN 1 ELSE 0 END AS hit
         FROM ex JOIN rep r ON r.case_id = ex.case_id AND r.model = 'ner-large')
SELECT coalesce(type, 'ALL') AS type, count(*) AS expected, sum(hit) AS found,
       CASE WHEN count(*) > 0 THEN round(100.0 * sum(hit) / count(*), 1) END AS pct
FROM hits GROUP BY ROLLUP (type)"""

_F5_SQL = _NER_BASE + """
SELECT v.case_id, v.type, v.value FROM verb v
WHERE v.model = 'ner-large' AND NOT EXISTS (
  SELECT 1 FROM ex WHERE ex.case_id = v.case_id AND ex.type = v.type
    AND (instr(v.norm, ex.norm) > 0 OR instr(ex.norm, v.norm) > 0))"""

_G14_SQL = _NER_BASE + """,
per AS (
  SELECT r.case_id, r.model, r.status, r.latency_ms,
    (SELECT count(*) FROM ex WHERE ex.case_id = r.case_id) AS expected_n,
    (SELECT count(*) FROM ex WHERE ex.case_id = r.case_id AND EXISTS (
        SELECT 1 FROM verb v WHERE v.case_id = ex.case_id AND v.model = r.model
          AND (instr(v.norm, ex.norm) > 0 OR instr(ex.norm, v.norm) > 0))) AS found_n,
    (SELECT count(*) FROM er WHERE er.case_id = r.case_id AND er.model = r.model) AS returned_n,
    (SELECT count(*) FROM verb v WHERE v.case_id = r.case_id AND v.model = r.model) AS verbatim_n
  FROM rep r)
SELECT model,
  sum(CASE WHEN status <> 'error' THEN found_n ELSE 0 END) AS found,
  sum(CASE WHEN status <> 'error' THEN expected_n ELSE 0 END) AS expected,
  sum(CASE WHEN status <> 'error' THEN returned_n - verbatim_n ELSE 0 END) AS paraphrased,
  count(*) FILTER (WHERE status = 'error') AS errors,
  CAST(round(avg(CASE WHEN status <> 'error' THEN latency_ms END)) AS BIGINT) AS avg_latency_ms,
  CASE WHEN sum(CASE WHEN status <> 'error' THEN expected_n ELSE 0 END) > 0 THEN
    round(100.0 * sum(CASE WHEN status <> 'error' THEN found_n ELSE 0 END)
          / sum(CASE WHEN status <> 'error' THEN expected_n ELSE 0 END), 1) END AS pct
FROM per GROUP BY model"""

for _name, _sql in [("c3_case_ner_replies", _C3_SQL), ("g8_ner_recall", _G8_SQL),
                    ("f5_ner_false_positives", _F5_SQL), ("g14_model_comparison", _G14_SQL)]:
    REGISTRY[_name] = (REGISTRY[_name][0], _sql)


# ------------------------------------------------------------------ E5 oracle (DuckDB)
def _e5_sql(final: str | None = None) -> str:
    from shroud.functions.patterns import pii_patterns
    from shroud.functions.patterns import re2_form as _re2
    from shroud.functions.patterns import secret_patterns
    types_in_order = []
    for p in pii_patterns():
        if p.type not in types_in_order and p.type != "ROUTING":
            types_in_order.append(p.type)
    cnt_cols = ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS c_{t}" for t in types_in_order)
    type_list = "list_filter([" + ", ".join(f"CASE WHEN c_{t} > 0 THEN '{t}' END" for t in types_in_order) + \
        "], lambda x: x IS NOT NULL)"
    secret_any = " OR ".join(f"regexp_matches(text, {O.q(_re2(p.family, p.idx).pattern)})" for p in secret_patterns())
    el = REPLAY_EDGE_LIMITS
    dl = REPLAY_DAILY_LIMITS
    return f"""
WITH kp AS ({KP_SQL}), rq AS ({RQ_SQL}),
rn AS ({D.request_ner_sql('rq')}),
pm AS ({O.pattern_matches_sql('rq', 'request_id', 'text')}),
pc AS (SELECT k, count(*) AS regex_matches, {cnt_cols} FROM pm GROUP BY k),
j AS (
  SELECT rq.*, kp.user_id AS kp_user_id, kp.tier AS kp_tier, kp.pii_strategy AS kp_pii_strategy,
         kp.edge_limit AS kp_edge_limit, (kp.api_key IS NOT NULL) AS authorized,
         kp.api_key_id AS kp_api_key_id, kp.api_key_name AS kp_api_key_name, kp.edge_model AS kp_edge_model,
         kp.provider_mode AS kp_provider_mode, kp.provider AS kp_provider, kp.cloud_model AS kp_cloud_model,
         coalesce(pc.regex_matches, 0) AS regex_matches,
         CASE WHEN pc.k IS NULL THEN [] ELSE {type_list} END AS regex_types,
         ({secret_any}) AS has_secret, rn.ner_status, rn.person
  FROM rq LEFT JOIN kp ON rq.api_key = kp.api_key AND starts_with(rq.api_key, 'key_live_')
  LEFT JOIN pc ON pc.k = rq.request_id LEFT JOIN rn ON rn.request_id = rq.request_id),
pr AS ({D.provider_reply_sql('rq')}),
q AS (
  SELECT *, CASE WHEN authorized THEN row_number() OVER (PARTITION BY authorized, kp_user_id, CAST(ts AS DATE)
                                                         ORDER BY ts, request_id) END AS rl_seq
  FROM j),
s AS (
  SELECT *,
    CASE WHEN NOT authorized THEN TRUE
         ELSE rl_seq <= CASE kp_tier WHEN 'pro' THEN {dl['pro']} WHEN 'enterprise' THEN {dl['enterprise']} ELSE {dl['free']} END
    END AS rl_allowed,
    coalesce(kp_pii_strategy, 'anonymize') AS mode,
    kp_tier IN ('pro', 'enterprise') AS ran
  FROM q),
t AS (
  SELECT *,
    CASE WHEN mode = 'custom' THEN CASE WHEN body_strategy IN ('edge', 'anonymize') THEN body_strategy ELSE 'anonymize' END
         ELSE mode END AS applied,
    CASE WHEN NOT ran THEN 'not_run' ELSE coalesce(ner_status, 'clean') END AS st
  FROM s),
u AS (
  SELECT *, CASE WHEN ran AND st <> 'error' AND person IS NOT NULL THEN 1 ELSE 0 END AS n_ents FROM t),
v AS (
  SELECT *,
    CASE WHEN NOT authorized THEN 'unauthorized'
         WHEN NOT rl_allowed THEN 'rate_limited'
         WHEN NOT body_ok THEN 'invalid_json'
         WHEN mode <> 'custom' AND body_strategy IS NOT NULL AND body_strategy <> '' AND body_strategy <> mode
              THEN 'strategy_mismatch'
         WHEN ran AND st = 'error' AND applied = 'anonymize' THEN 'ner_unavailable'
         WHEN NOT (len(regex_types) > 0 OR n_ents > 0 OR has_secret) THEN 'passthrough'
         WHEN applied = 'edge' THEN 'edge'
         ELSE 'anonymized' END AS pre,
    list_concat(regex_types, CASE WHEN n_ents > 0 AND NOT list_contains(regex_types, 'PERSON') THEN ['PERSON'] ELSE [] END,
                CASE WHEN has_secret THEN ['SECRET'] ELSE [] END) AS types
  FROM u),
w AS (
  SELECT *, CASE WHEN pre = 'edge' THEN row_number() OVER (PARTITION BY pre = 'edge', kp_user_id, CAST(ts AS DATE)
                                                        ORDER BY ts, request_id) END AS edge_seq,
    coalesce(kp_edge_limit, CASE kp_tier WHEN 'free' THEN {el['free']} WHEN 'pro' THEN {el['pro']}
                                          WHEN 'enterprise' THEN {el['enterprise']} END, 50) AS edge_lim
  FROM v),
x AS (SELECT *, CASE WHEN pre = 'edge' AND edge_seq > edge_lim THEN 'edge_rate_limited' ELSE pre END AS outcome FROM w),
y AS (SELECT *, CASE WHEN pre = 'ner_unavailable' AND NOT list_contains(types, 'NER_ERROR')
                     THEN list_append(types, 'NER_ERROR') ELSE types END AS types_final FROM x)
""" + (final or """SELECT request_id, outcome,
  CASE outcome WHEN 'unauthorized' THEN 401 WHEN 'rate_limited' THEN 429 WHEN 'invalid_json' THEN 400
       WHEN 'strategy_mismatch' THEN 400 WHEN 'ner_unavailable' THEN 503 WHEN 'edge_rate_limited' THEN 429
       ELSE 200 END AS status_code,
  CASE WHEN outcome IN ('passthrough', 'anonymized') THEN 'cloud' WHEN outcome = 'edge' THEN 'edge' END AS routed_to,
  outcome = 'anonymized' AS anonymized, applied AS applied_strategy, mode AS strategy_mode,
  CASE WHEN seen THEN ran END AS ner_ran, CASE WHEN seen THEN array_to_string(types_final, ',') END AS pii_types,
  CASE WHEN seen THEN regex_matches + n_ents END AS pii_matches, CASE WHEN seen THEN has_secret END AS has_secret
FROM (SELECT *, outcome NOT IN ('unauthorized', 'rate_limited', 'invalid_json', 'strategy_mismatch') AS seen FROM y)""")


REGISTRY["e5_route_decisions"] = (REGISTRY["e5_route_decisions"][0], _e5_sql())

_DEFAULT_EDGE = PO.DEFAULT_EDGE_MODEL
_DEPRECATED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PO.DEPRECATED_EDGE_MODELS.items())
_E12_FINAL = f"""
SELECT request_id, ts, CAST(ts AS DATE) AS log_date, kp_user_id AS user_id,
  CASE WHEN kp_api_key_id <> '' THEN kp_api_key_id END AS api_key_id,
  CASE WHEN kp_api_key_name <> '' THEN kp_api_key_name END AS api_key_name,
  outcome = 'anonymized' AS anonymized,
  CASE WHEN outcome = 'passthrough' THEN '' ELSE array_to_string(types_final, ',') END AS pii_types,
  CASE WHEN outcome = 'passthrough' THEN 0 ELSE regex_matches + n_ents END AS pii_matches,
  CASE outcome WHEN 'ner_unavailable' THEN 503 ELSE 200 END AS status_code,
  coalesce(applied, 'anonymize') AS pii_strategy,
  CASE WHEN outcome = 'edge' THEN
    coalesce(CASE coalesce(kp_edge_model, '{_DEFAULT_EDGE}') {_DEPRECATED} END, coalesce(kp_edge_model, '{_DEFAULT_EDGE}'))
  END AS edge_model,
  CASE WHEN outcome IN ('passthrough', 'anonymized', 'ner_unavailable') THEN coalesce(kp_provider_mode, 'managed') END
    AS provider_mode,
  CASE WHEN outcome IN ('passthrough', 'anonymized', 'ner_unavailable') THEN coalesce(kp_provider, 'openai') END AS provider,
  CASE WHEN outcome IN ('passthrough', 'anonymized') THEN coalesce(model, kp_cloud_model) END AS cloud_model,
  (outcome IN ('anonymized', 'ner_unavailable') AND has_secret) AS has_secret, kp_tier AS tier,
  CASE WHEN outcome IN ('passthrough', 'anonymized') THEN pr.tokens_in END AS tokens_in,
  CASE WHEN outcome IN ('passthrough', 'anonymized') THEN pr.tokens_out END AS tokens_out,
  CASE WHEN outcome IN ('passthrough', 'anonymized') THEN pr.finish_reason END AS finish_reason,
  CASE WHEN outcome IN ('passthrough', 'anonymized') THEN pr.provider_request_id END AS provider_request_id,
  pr.latency_ms, pr.cf_node, pr.request_country, pr.request_city
FROM y JOIN pr USING (request_id) WHERE outcome IN ('ner_unavailable', 'passthrough', 'edge', 'anonymized')"""
REGISTRY["e12_request_log"] = (REGISTRY["e12_request_log"][0], _e5_sql(_E12_FINAL))


# ------------------------------------------------------------------ B24 oracle (DuckDB)
def _b24_sql() -> str:
    ents = corpus.oracle_entities_sql("customer", "c_custkey")
    letters = "'TRWAGMYFPDXBNJZSQVHLCKE'"
    dig = [f"CAST(substr(v, {2 + i}, 1) AS INTEGER)" for i in range(7)]
    odd = " + ".join(f"(CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END)" for d in (dig[0], dig[2], dig[4], dig[6]))
    last = f"(({odd}) + {dig[1]} + {dig[3]} + {dig[5]}) % 10"
    chk = f"(CASE WHEN {last} = 0 THEN 0 ELSE 10 - {last} END)"
    cif_ok = (f"substr(v, 9, 1) = CASE WHEN substr(v, 1, 1) IN ('P', 'Q', 'S', 'K', 'W', 'N') "
              f"THEN substr('JABCDEFGHI', {chk} + 1, 1) ELSE CAST({chk} AS VARCHAR) END")
    nie_ok = (f"substr(v, 9, 1) = substr({letters}, CAST(((CASE substr(v, 1, 1) WHEN 'X' THEN 0 WHEN 'Y' THEN 1 ELSE 2 END)"
              f" * 10000000 + CAST(substr(v, 2, 7) AS BIGINT)) % 23 AS INTEGER) + 1, 1)")
    nif_ok = f"substr(v, 9, 1) = substr({letters}, CAST(CAST(substr(v, 1, 8) AS BIGINT) % 23 AS INTEGER) + 1, 1)"
    return f"""
WITH e AS ({ents}),
x AS (SELECT type, value, regexp_replace(upper(value), '[^0-9A-Z]', '', 'g') AS v FROM e WHERE type IN ('DNI', 'CIF')),
y AS (SELECT type,
  CASE WHEN regexp_matches(value, '^[XYZ]') THEN (CASE WHEN regexp_matches(v, '^[XYZ][0-9]{{7}}[A-Z]$') THEN {nie_ok} END)
       WHEN type = 'CIF' THEN (CASE WHEN regexp_matches(v, '^[A-Z][0-9]{{7}}[0-9A-J]$') THEN {cif_ok} END)
       ELSE (CASE WHEN regexp_matches(v, '^[0-9]{{8}}[A-Z]$') THEN {nif_ok} END) END AS ok
  FROM x)
SELECT type, count(*) AS labels, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE ok IS NULL) AS unchecked
FROM y GROUP BY type"""


REGISTRY["b24_id_validity"] = (REGISTRY["b24_id_validity"][0], _b24_sql())


REGISTRY["g17_usage_rollup"] = (REGISTRY["g17_usage_rollup"][0], _e5_sql(f"""
SELECT CAST(log_date AS VARCHAR) AS log_date, tier, pii_strategy, provider, count(*) AS requests,
       sum(CAST(anonymized AS INTEGER)) AS anonymized, sum(pii_matches) AS pii_matches, sum(tokens_in) AS tokens_in,
       sum(tokens_out) AS tokens_out, sum(latency_ms) AS latency_ms_sum, max(latency_ms) AS latency_ms_max
FROM ({_E12_FINAL}) GROUP BY ROLLUP (log_date, tier, pii_strategy, provider)"""))
REGISTRY["g17_compliance_events"] = (REGISTRY["g17_compliance_events"][0], _e5_sql(f"""
SELECT CAST(log_date AS VARCHAR) AS log_date, tier, type, count(*) AS requests, sum(CAST(anonymized AS INTEGER)) AS anonymized
FROM (SELECT *, unnest(string_split(pii_types, ',')) AS type FROM ({_E12_FINAL}) WHERE pii_types <> '') GROUP BY ALL"""))
REGISTRY["a7_latest_logs"] = (REGISTRY["a7_latest_logs"][0], _e5_sql(f"""
SELECT request_id, ts, user_id, status_code, pii_types
FROM ({_E12_FINAL}) ORDER BY ts DESC, request_id DESC LIMIT 100"""))
REGISTRY["a1_read_messages"] = (REGISTRY["a1_read_messages"][0], f"""
WITH rq AS ({RQ_SQL})
SELECT request_id, CAST(0 AS INTEGER) AS turn, 'user' AS role, text AS content
FROM rq WHERE body_ok AND request_id % 59 <> 0""")

REGISTRY["g12_ner_summary"] = (REGISTRY["g12_ner_summary"][0], _NER_BASE + """,
per AS (
  SELECT r.case_id, r.status, r.latency_ms,
    (SELECT count(*) FROM ex WHERE ex.case_id = r.case_id) AS expected_n,
    CASE WHEN r.status = 'error' THEN 0 ELSE (SELECT count(*) FROM ex WHERE ex.case_id = r.case_id AND EXISTS (
        SELECT 1 FROM verb v WHERE v.case_id = ex.case_id AND v.model = r.model AND v.type = ex.type
          AND (instr(v.norm, ex.norm) > 0 OR instr(ex.norm, v.norm) > 0))) END AS found_n,
    CASE WHEN r.status = 'error' THEN 0 ELSE
      (SELECT count(*) FROM er WHERE er.case_id = r.case_id AND er.model = r.model) END AS returned_n,
    (SELECT count(*) FROM verb v WHERE v.case_id = r.case_id AND v.model = r.model) AS verbatim_n,
    (SELECT count(*) FROM verb v WHERE v.case_id = r.case_id AND v.model = r.model AND NOT EXISTS (
        SELECT 1 FROM ex WHERE ex.case_id = v.case_id AND ex.type = v.type
          AND (instr(v.norm, ex.norm) > 0 OR instr(ex.norm, v.norm) > 0))) AS fp_n
  FROM rep r WHERE r.model = 'ner-large'),
lat AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n
        FROM per WHERE status <> 'error' AND latency_ms IS NOT NULL)
SELECT sum(found_n) AS found, sum(expected_n) AS expected, sum(returned_n) AS returned, sum(verbatim_n) AS verbatim,
  sum(returned_n - verbatim_n) AS paraphrased, sum(fp_n) AS false_positives,
  sum(CASE WHEN expected_n = 0 THEN fp_n ELSE 0 END) AS fp_on_clean_cases,
  count(*) FILTER (WHERE status = 'error') AS errors, count(*) AS cases,
  CAST(round(avg(CASE WHEN status <> 'error' THEN latency_ms END)) AS BIGINT) AS avg_latency_ms,
  (SELECT latency_ms FROM lat WHERE i = least(n - 1, floor(n * 0.5))) AS p50_ms,
  (SELECT latency_ms FROM lat WHERE i = least(n - 1, floor(n * 0.95))) AS p95_ms,
  CASE WHEN sum(expected_n) > 0 THEN round(100.0 * sum(found_n) / sum(expected_n), 1) END AS pct
FROM per""")


# ------------------------------------------------------------------ regex evaluation oracles (DuckDB)
def _regex_eval_base() -> str:
    cases = corpus.oracle_cases_sql("customer", "c_custkey")
    ents = corpus.oracle_entities_sql("customer", "c_custkey")
    seq = O.sequential_mask_sql("SELECT case_id, text FROM cases")
    return f"""
WITH cases AS ({cases}),
ents AS ({ents}),
mv AS (SELECT case_id, vals FROM ({seq})),
vv AS (SELECT mv.case_id, v.type AS type, v.value AS value
       FROM mv, unnest(mv.vals) AS u(v)),
sc AS (
  SELECT e.case_id, c.domain, c.kind, c.category, c.source, c.notes, e.ord, e.type, e.value, e.expected_match,
    EXISTS (SELECT 1 FROM vv WHERE vv.case_id = e.case_id AND vv.value = e.value) AS detected,
    NOT EXISTS (SELECT 1 FROM vv WHERE vv.case_id = e.case_id AND vv.value = e.value)
      AND EXISTS (SELECT 1 FROM vv WHERE vv.case_id = e.case_id AND instr(e.value, vv.value) > 0
                  AND length(vv.value) < length(e.value)) AS partial
  FROM ents e JOIN cases c ON c.case_id = e.case_id WHERE NOT e.ner_scope),
fp AS (
  SELECT vv.case_id, vv.type, vv.value FROM vv
  WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.case_id = vv.case_id AND e.value = vv.value)
    AND NOT EXISTS (SELECT 1 FROM ents e WHERE e.case_id = vv.case_id AND instr(e.value, vv.value) > 0
                    AND length(vv.value) < length(e.value)))"""


_RB = _regex_eval_base()
_PCT = "CASE WHEN {d} > 0 THEN round(100.0 * {n} / {d}, 1) END"
_REGEX_ORACLES = {
    "f2_scored_entities": "SELECT case_id, ord, type, value, detected, partial FROM sc",
    "g1_recall_by_type": "SELECT type, count(*) AS expected, sum(CAST(detected AS INTEGER)) AS found, "
                         + _PCT.format(n="sum(CAST(detected AS INTEGER))", d="count(*)") + " AS pct FROM sc GROUP BY type",
    "g2_recall_breakdown": "SELECT CASE WHEN GROUPING(domain) = 1 THEN 'source' WHEN GROUPING(source) = 1 THEN 'domain' "
                           "ELSE 'domain/source' END AS breakdown, domain, source, count(*) AS expected, "
                           "sum(CAST(detected AS INTEGER)) AS found, "
                           + _PCT.format(n="sum(CAST(detected AS INTEGER))", d="count(*)")
                           + " AS pct FROM sc GROUP BY GROUPING SETS ((source), (domain), (domain, source))",
    "g3_false_negatives": "SELECT case_id, domain, category, source, type, value, expected_match, "
                          "partial AS partially_matched, notes FROM sc WHERE NOT detected",
    "f6_regex_false_positives": "SELECT case_id, type, value FROM fp",
    "g5_fp_by_type": "SELECT type, count(*) AS fp FROM fp GROUP BY type",
    "g6_precision_by_type": "SELECT coalesce(a.type, b.type) AS type, coalesce(a.tp, 0) AS tp, coalesce(b.fp, 0) AS fp, "
                            + _PCT.format(n="coalesce(a.tp, 0)", d="(coalesce(a.tp, 0) + coalesce(b.fp, 0))")
                            + " AS pct FROM (SELECT type, sum(CAST(detected AS INTEGER)) AS tp FROM sc GROUP BY type) a "
                            "FULL OUTER JOIN (SELECT type, count(*) AS fp FROM fp GROUP BY type) b ON a.type = b.type",
    "g7_gap_mismatches": "SELECT case_id, type, value, notes FROM sc WHERE expected_match = FALSE AND detected",
    "g4_regex_totals": "SELECT count(*) AS expected, sum(CAST(detected AS INTEGER)) AS found, "
                       "count(*) FILTER (WHERE NOT detected AND partial) AS partial_misses, "
                       "(SELECT count(*) FROM ents WHERE ner_scope) AS ner_scope_labels, "
                       + _PCT.format(n="sum(CAST(detected AS INTEGER))", d="count(*)") + " AS pct FROM sc",
}
for _name, _sql in _REGEX_ORACLES.items():
    REGISTRY[_name] = (REGISTRY[_name][0], _RB + "\n" + _sql)


def _c9_sql() -> str:
    from shroud.functions.patterns import re2_form as _re2
    from shroud.functions.patterns import secret_patterns
    secret_any = " OR ".join(f"regexp_matches(rq.text, {O.q(_re2(p.family, p.idx).pattern)})" for p in secret_patterns())
    seq = O.sequential_mask_sql("SELECT request_id, text FROM rq", key="request_id", numbered=True)
    return f"""
WITH kp AS ({KP_SQL}), rq AS ({RQ_SQL}), rn AS ({D.request_ner_sql('rq')}),
mv AS (SELECT request_id, vals, t AS masked FROM ({seq})),
b AS (SELECT rq.request_id, ({secret_any}) AS has_secret, coalesce(kp.tier IN ('pro', 'enterprise'), FALSE) AS ner_ran,
        coalesce(kp.tier IN ('pro', 'enterprise'), FALSE) AND rn.ner_status = 'error' AS ner_error,
        list_transform(mv.vals, lambda x: x.type) AS kinds, mv.masked, rn.person
      FROM rq JOIN kp ON rq.api_key = kp.api_key AND starts_with(rq.api_key, 'key_live_')
      JOIN rn ON rn.request_id = rq.request_id JOIN mv ON mv.request_id = rq.request_id),
c AS (SELECT *, ner_ran AND NOT ner_error AND person IS NOT NULL AND instr(masked, person) > 0 AS named FROM b),
d AS (SELECT * EXCLUDE (kinds), CASE WHEN named THEN list_append(kinds, 'PERSON') ELSE kinds END AS kinds FROM c)
SELECT request_id, array_to_string(list_sort(list_distinct(kinds)), ',') AS pii_types,
  array_to_string(list_transform(list_sort(list_distinct(kinds)),
    lambda k: k || ':' || CAST(len(list_filter(kinds, lambda x: x = k)) AS VARCHAR)), ',') AS pii_type_counts,
  len(kinds) AS pii_count, has_secret, CASE WHEN named THEN replace(masked, person, '[PERSON_1]') ELSE masked END AS sanitized,
  ner_ran, ner_error
FROM d"""


REGISTRY["c9_detect_report"] = (REGISTRY["c9_detect_report"][0], _c9_sql())


def _g13_sql() -> str:
    rep, er = D.case_ner_sql("cases", "ents")
    return _RB + f""",
rep AS ({rep}),
er AS ({er}),
ex AS (SELECT case_id, ord, type, value, lower(value) AS norm FROM ents WHERE ner_scope),
verb AS (SELECT er.case_id, er.model, er.type, er.value, lower(er.value) AS norm
         FROM er JOIN cases c ON c.case_id = er.case_id
         JOIN rep r ON r.case_id = er.case_id AND r.model = er.model
         WHERE r.status <> 'error' AND er.value IS NOT NULL AND length(er.value) > 0
           AND instr(lower(c.text), lower(er.value)) > 0),
hits AS (SELECT CASE WHEN r.status <> 'error' AND EXISTS (
            SELECT 1 FROM verb v WHERE v.case_id = ex.case_id AND v.model = r.model AND v.type = ex.type
              AND (instr(v.norm, ex.norm) > 0 OR instr(ex.norm, v.norm) > 0)) THEN 1 ELSE 0 END AS hit
         FROM ex JOIN rep r ON r.case_id = ex.case_id AND r.model = 'ner-large'),
t AS (SELECT (SELECT sum(CAST(detected AS INTEGER)) FROM sc) AS rf, (SELECT count(*) FROM sc) AS re,
             (SELECT sum(hit) FROM hits) AS nf, (SELECT count(*) FROM hits) AS ne,
             (SELECT count(*) FROM ents WHERE NOT ner_scope) AS labels_now)
SELECT rf AS regex_found, re AS regex_expected, nf AS ner_found, ne AS ner_expected,
  CASE WHEN re = labels_now THEN rf + nf END AS combined_found,
  CASE WHEN re = labels_now THEN re + ne END AS combined_expected,
  CASE WHEN re = labels_now AND re + ne > 0 THEN round(100.0 * (rf + nf) / (re + ne), 1) END AS combined_pct,
  CASE WHEN re <> labels_now THEN 'regex run scored ' || CAST(re AS VARCHAR) || ' labels but the corpus has '
       || CAST(labels_now AS VARCHAR) END AS skip_reason
FROM t"""


REGISTRY["g13_combined_recall"] = (REGISTRY["g13_combined_recall"][0], _g13_sql())


# ------------------------------------------------------------------ A11: regex-only baseline
@register("a11_regex_only_baseline", f"""
WITH pm AS ({O.pattern_matches_sql('documents', 'doc_id', 'text')}),
pc AS (SELECT k, string_agg(type, ',' ORDER BY rank) AS types
       FROM (SELECT k, type, min(rank) AS rank FROM pm GROUP BY k, type) GROUP BY k),
pn AS (SELECT k, count(*) AS matches FROM pm GROUP BY k),
mv AS (SELECT doc_id, list_transform(vals, lambda x: x.type) AS kinds, t AS sanitized
       FROM ({O.sequential_mask_sql("SELECT doc_id, coalesce(text, '') AS text FROM documents", key='doc_id', numbered=True)}))
SELECT mv.doc_id, coalesce(pn.matches, 0) AS matches, coalesce(pc.types, '') AS types,
  array_to_string(list_transform(list_sort(list_distinct(kinds)),
    lambda k: k || ':' || CAST(len(list_filter(kinds, lambda x: x = k)) AS VARCHAR)), ',') AS token_counts, sanitized
FROM mv LEFT JOIN pc ON pc.k = mv.doc_id LEFT JOIN pn ON pn.k = mv.doc_id""")
def a11_regex_only_baseline(spark, sf):
    """Every document's C1 match count and types, its D1 token counts and masked text, with
    no NER input (the free tier's view); one pass over the texts."""
    m = MK.mask_texts(documents(spark, sf), "text", ["doc_id"], verdict=True)
    return m.select("doc_id", "matches", F.array_join("types", ",").alias("types"),
                    MK.type_counts_text(F.col("tokens")).alias("token_counts"), F.col("masked").alias("sanitized"))


# The remaining proxy steps register themselves.
from shroud.plans import dialogue, planted, steps  # noqa: E402,F401
