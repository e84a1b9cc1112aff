"""Request-policy replay over request history.

The proxy's per-request decisions become columns over ``requests JOIN
key_policy`` so a policy can be audited or simulated on history. Everything is
native column logic except the per-(user, day) arrival ordinal, which uses a
two-level ranking that stays parallel when one user dominates a day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.operators import ner as N
from shroud.session import materialize

# --------------------------------------------------------------------------
# The proxy's policy constants.
# --------------------------------------------------------------------------
KEY_PREFIX = "key_live_"
DAILY_LIMITS = {"free": 1000, "pro": 10000, "enterprise": 1000000}          # unknown tier -> free
EDGE_LIMITS = {"free": 50, "pro": 2000, "enterprise": 50000}                # unknown tier -> 50
EDGE_FALLBACK_LIMIT = 50
DEFAULT_EDGE_MODEL = "@cf/meta/llama-3.3-70b-instruct-fp8-fast"
DEPRECATED_EDGE_MODELS = {
    "@cf/meta/llama-3.1-8b-instruct": "@cf/meta/llama-4-scout-17b-16e-instruct",
    "@cf/meta/llama-3.1-8b-instruct-fp8": "@cf/meta/llama-4-scout-17b-16e-instruct",
}
DEFAULT_PROVIDER = "openai"
DEFAULT_PROVIDER_MODE = "managed"
DEFAULT_STRATEGY = "anonymize"
EDGE_MAX_TOKENS = 1024
EDGE_TEMPERATURE = 0.7


def _map(d: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# ------------------------------------------------------------------ A3/A4/F1
def authorize(requests: DataFrame, key_policy: DataFrame, key_col: str = "api_key", spread_by: str = "request_id") -> DataFrame:
    """A3/F1: left join on the key, only keys with the live prefix can match.

    Rows without such a key can't match; where the join is shuffled they are dealt out by
    ``spread_by`` (if they have it) instead of meeting in the task of the null key. Drop
    wide columns (texts) before: all columns of ``requests`` go along.

    ``key_policy`` is a dimension (one row per issued key). It is joined by
    key equality; Spark broadcasts it only when its measured size is under
    ``autoBroadcastJoinThreshold`` (AQE re-plans at run time), otherwise it
    is a shuffle join - no unconditional broadcast hint.
    """
    kp = key_policy.select([F.col(c).alias(f"kp_{c}") if c != key_col else F.col(c).alias("_kp_key")
                            for c in key_policy.columns])
    live = F.coalesce(F.col(key_col).startswith(KEY_PREFIX), F.lit(False))
    other = F.concat(F.lit("\0"), F.xxhash64(spread_by).cast("string")) if spread_by in requests.columns else F.lit(None).cast("string")
    asked = requests.withColumn("_asked", F.when(live, F.col(key_col)).otherwise(other))
    kp = kp.where(F.col("_kp_key").startswith(KEY_PREFIX))
    return asked.join(kp, F.col("_asked") == F.col("_kp_key"), "left").withColumn("authorized", F.col("_kp_key").isNotNull()).drop("_kp_key", "_asked")


def key_info(key_policy: DataFrame) -> DataFrame:
    """A4: public projection with defaults."""
    return key_policy.select(
        "api_key", F.coalesce("provider", F.lit(DEFAULT_PROVIDER)).alias("provider"),
        F.coalesce("provider_mode", F.lit(DEFAULT_PROVIDER_MODE)).alias("provider_mode"),
        F.col("cloud_model").alias("cloud_model"))


# ------------------------------------------------------------------ E1/E2
def strategy_mode(key_strategy: Column, env_default: str | None = None) -> Column:
    return F.coalesce(key_strategy, F.lit(env_default), F.lit(DEFAULT_STRATEGY))


def resolve_strategy(mode: Column, body_strategy: Column) -> Column:
    """Custom -> the request's edge/anonymize, else anonymize; fixed -> mode."""
    return F.when(mode == "custom",
                  F.when(body_strategy.isin("edge", "anonymize"), body_strategy).otherwise(F.lit("anonymize"))
                  ).otherwise(mode)


def strategy_mismatch(mode: Column, body_strategy: Column) -> Column:
    """Fixed key + a different explicit strategy in the body (-> 400)."""
    return (mode != "custom") & body_strategy.isNotNull() & (body_strategy != "") & (body_strategy != mode)


# ------------------------------------------------------------------ E3/E4
def in_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows sorted into ranges of ``keys``, with their range and their place in it; written once, so both stay."""
    placed = df.repartitionByRange(*(F.col(k) for k in keys)).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return materialize(placed.select("*", F.spark_partition_id().alias("_range"), at.alias("_at")))


def arrival_ordinal(df: DataFrame, part: Sequence[str], ts: str, tiebreak: str, out: str) -> DataFrame:
    """1-based arrival number within ``part`` ordered by (ts, tiebreak).

    Ranges of (part, ts, tiebreak) are cut by the rows' own quantiles, so one user's single
    minute spans as many tasks as it has rows for; the number is the place in the range
    plus the group's rows in earlier ranges. The only window sees one row for each
    range that a group touches. ``part`` must not be null.
    """
    part = list(part)
    placed = in_ranges(df, [*part, ts, tiebreak])
    counts = placed.groupBy(*part, "_range").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*part, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low") + 1).alias("_shift"))
    return placed.join(counts, [*part, "_range"]).withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).drop("_range", "_at", "_shift")


def tier_limit(tier: Column, limits: Mapping[str, int]) -> Column:
    return F.coalesce(_map(limits)[tier], F.lit(limits["free"]))


def daily_quota(df: DataFrame, limits: Mapping[str, int] = DAILY_LIMITS, user: str = "kp_user_id",
                tier: str = "kp_tier", ts: str = "ts", rid: str = "request_id") -> DataFrame:
    """Per user per UTC day, first ``limit`` requests pass; denied ones do not consume.

    Adds ``rl_limit, rl_seq, rl_allowed, rl_remaining, rl_reset``.
    """
    day = F.to_date(F.col(ts))
    d = df.withColumn("rl_day", day)
    d = arrival_ordinal(d, [user, "rl_day"], ts, rid, "rl_seq")
    lim = tier_limit(F.col(tier), limits)
    return (d.withColumn("rl_limit", lim)
            .withColumn("rl_allowed", F.col("rl_seq") <= lim)
            .withColumn("rl_remaining", F.greatest(lim - F.col("rl_seq"), F.lit(0)).cast("long"))
            .withColumn("rl_reset", F.concat(F.date_format("rl_day", "yyyy-MM-dd"), F.lit("T23:59:59Z"))))


def edge_limit(tier: Column, key_override: Column, limits: Mapping[str, int] = EDGE_LIMITS) -> Column:
    """Key override ?? tier default ?? 50."""
    return F.coalesce(key_override, _map(limits)[tier], F.lit(EDGE_FALLBACK_LIMIT))


# ------------------------------------------------------------------ E6-E11
def resolve_model(body_model: Column, key_model: Column) -> Column:
    """A non-empty request model wins, else the key's, else none."""
    return F.coalesce(F.when(body_model != "", body_model), key_model)


def prefix_model(model: Column, prefix: Column) -> Column:
    """``prefix/model`` unless no prefix, no model, or already containing '/'."""
    return F.when(prefix.isNull() | (prefix == "") | model.isNull() | model.contains("/"), model) \
        .otherwise(F.concat(prefix, F.lit("/"), model))


def edge_model(key_model: Column, env_model: str | None = None) -> Column:
    """Key ?? env ?? default, then the deprecation map."""
    raw = F.coalesce(key_model, F.lit(env_model), F.lit(DEFAULT_EDGE_MODEL))
    return F.coalesce(_map(DEPRECATED_EDGE_MODELS)[raw], raw)


def edge_messages(messages: Column, system_text: str) -> Column:
    """Prepend a system message when none is present (text is ours)."""
    sysmsg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content")))
    return F.when(F.exists(messages, lambda m: m["role"] == "system"), messages) \
        .otherwise(F.concat(sysmsg, messages))


# ------------------------------------------------------------------ E5/E12
OUTCOME_STATUS = {
    "unauthorized": 401, "rate_limited": 429, "invalid_json": 400, "strategy_mismatch": 400,
    "ner_unavailable": 503, "passthrough": 200, "edge_rate_limited": 429, "edge": 200, "anonymized": 200,
}

REJECTED_UNSCANNED = ("unauthorized", "rate_limited", "invalid_json", "strategy_mismatch")


def may_be_scanned(authorized: Column, body_ok: Column, mode: Column, body_strategy: Column) -> Column:
    """False where the row alone (not the quota) already tells that a request is rejected before detection."""
    return authorized & body_ok & ~F.coalesce(strategy_mismatch(mode, body_strategy), F.lit(False))


def _ner_seen() -> tuple[Column, Column, Column]:
    """Whether the NER step ran, its gated status, and the entities that count."""
    ran = N.ner_ran(F.col("kp_tier"))
    status = N.gated_status(F.col("kp_tier"), F.coalesce(F.col("ner_status"), F.lit("clean")))
    return ran, status, F.when(ran & (status != "error"), F.col("ner_entities")).otherwise(F.array().cast(N.ENTITY_ARRAY))


def path_before_edge(rl_allowed: Column) -> Column:
    """E5 up to the edge counter: what becomes of a request, given whether the daily quota lets it pass."""
    mode = strategy_mode(F.col("kp_pii_strategy"))
    applied = resolve_strategy(mode, F.col("body_strategy"))
    ran, status, ents = _ner_seen()
    detected = F.col("regex_detected") | (F.size(ents) > 0)
    return (F.when(~F.col("authorized"), "unauthorized")
            .when(~rl_allowed, "rate_limited")
            .when(~F.col("body_ok"), "invalid_json")
            .when(strategy_mismatch(mode, F.col("body_strategy")), "strategy_mismatch")
            .when(ran & N.fail_closed(status, applied), "ner_unavailable")
            .when(~(detected | F.col("has_secret")), "passthrough")
            .when(applied == "edge", "edge")
            .otherwise("anonymized"))


def route(df: DataFrame, edge_limits: Mapping[str, int] = EDGE_LIMITS) -> DataFrame:
    """E5: the decision cascade, then the edge counter over the edge-bound subset.

    Needs: ``authorized, rl_allowed, body_ok, kp_pii_strategy, body_strategy,
    kp_tier, regex_detected, regex_types, regex_matches, has_secret,
    ner_status, ner_entities``. Requests rejected before detection (401, 429,
    400) have null ``ner_ran, pii_types, pii_matches, has_secret``.
    """
    mode = strategy_mode(F.col("kp_pii_strategy"))
    applied = resolve_strategy(mode, F.col("body_strategy"))
    ran, status, ents = _ner_seen()
    types = N.merge_types(F.col("regex_types"), ents, F.col("has_secret"))
    pre = path_before_edge(F.col("rl_allowed"))
    scanned = ~pre.isin(*REJECTED_UNSCANNED)
    d = df.select("*", mode.alias("strategy_mode"), applied.alias("applied_strategy"),
                  F.when(scanned, ran).alias("ner_ran"),
                  F.when(ran, status).otherwise("not_run").alias("ner_status_eff"),
                  F.when(scanned, F.when(pre == "ner_unavailable", N.add_ner_error(types)).otherwise(types)).alias("pii_types"),
                  F.when(scanned, N.merge_matches(F.col("regex_matches"), ents)).alias("pii_matches"),
                  pre.alias("_pre"))
    d = d.withColumn("has_secret", F.when(~F.col("_pre").isin(*REJECTED_UNSCANNED), F.col("has_secret")))
    # Only requests that reach the edge path consume the edge counter
    limit = edge_limit(F.col("kp_tier"), F.col("kp_edge_limit"), edge_limits)
    edge = d.where(F.col("_pre") == "edge").withColumn("_day", F.to_date("ts"))
    edge = arrival_ordinal(edge, ["kp_user_id", "_day"], "ts", "request_id", "edge_seq").drop("_day").withColumn("edge_limit", limit)
    d = edge.unionByName(d.where(F.col("_pre") != "edge").withColumn("edge_seq", F.lit(None).cast("long"))
                         .withColumn("edge_limit", F.lit(None).cast("int")))
    outcome = F.when((F.col("_pre") == "edge") & (F.col("edge_seq") > F.col("edge_limit")), "edge_rate_limited") \
        .otherwise(F.col("_pre"))
    return (d.withColumn("outcome", outcome).drop("_pre")
            .withColumn("status_code", _map(OUTCOME_STATUS)[F.col("outcome")])
            .withColumn("routed_to", F.when(F.col("outcome").isin("passthrough", "anonymized"), "cloud")
                        .when(F.col("outcome") == "edge", "edge"))
            .withColumn("anonymized", F.col("outcome") == "anonymized"))


def log_rows(decided: DataFrame) -> DataFrame:
    """E12 -> A5 rows: one audit row per decided request, null rules per path.

    Requests rejected before detection (401/429/400) are not logged, as in the
    proxy; pass-through rows carry no PII fields; edge rows carry the edge model
    and no provider; token counts, finish reason and the provider's request id
    are null on edge and blocked rows. ``tokens_in, tokens_out, latency_ms,
    finish_reason, provider_request_id, cf_node, request_country, request_city``
    are taken from the input where it has them, else null. Adds ``has_secret``
    (SURVEY §7.4 #10) and the key's ``tier``.
    """
    o = F.col("outcome")

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in decided.columns else F.lit(None).cast(kind)

    logged = decided.where(o.isin("ner_unavailable", "passthrough", "edge", "anonymized"))
    cloud = o.isin("passthrough", "anonymized", "ner_unavailable")
    model = F.coalesce(F.col("model"), F.col("kp_cloud_model"))   # logged as sent: '' is kept
    return logged.select(
        "request_id", "ts", F.to_date("ts").alias("log_date"),
        F.col("kp_user_id").alias("user_id"),
        F.when(F.col("kp_api_key_id") != "", F.col("kp_api_key_id")).alias("api_key_id"),
        F.when(F.col("kp_api_key_name") != "", F.col("kp_api_key_name")).alias("api_key_name"),
        F.col("anonymized"),
        F.when(o == "passthrough", F.array().cast("array<string>")).otherwise(F.col("pii_types")).alias("pii_types"),
        F.when(o == "passthrough", F.lit(0)).otherwise(F.col("pii_matches")).alias("pii_matches"),
        F.col("status_code"),
        F.coalesce(F.col("applied_strategy"), F.lit(DEFAULT_STRATEGY)).alias("pii_strategy"),
        F.when(o == "edge", edge_model(F.col("kp_edge_model"))).alias("edge_model"),
        F.when(cloud, F.coalesce("kp_provider_mode", F.lit(DEFAULT_PROVIDER_MODE))).alias("provider_mode"),
        F.when(cloud, F.coalesce("kp_provider", F.lit(DEFAULT_PROVIDER))).alias("provider"),
        F.when(o.isin("passthrough", "anonymized"), model).alias("cloud_model"),
        (o.isin("anonymized", "ner_unavailable") & F.col("has_secret")).alias("has_secret"),
        F.col("kp_tier").alias("tier"),
        *(F.when(o.isin("passthrough", "anonymized"), given(c, t)).alias(c) for c, t in
          [("tokens_in", "int"), ("tokens_out", "int"), ("finish_reason", "string"), ("provider_request_id", "string")]),
        *(given(c, t).alias(c) for c, t in
          [("latency_ms", "int"), ("cf_node", "string"), ("request_country", "string"), ("request_city", "string")]))


def classify_outcome(status_code: Column, code: Column) -> Column:
    """Client-side error class from a status code and an error ``code``."""
    return (F.when(status_code == 401, "authentication")
            .when(status_code == 429, "rate_limit")
            .when((status_code == 400) & (code == "strategy_mismatch"), "strategy_mismatch")
            .when((status_code == 503) & (code == "ner_unavailable"), "ner_unavailable")
            .when(status_code >= 400, "api_error"))


def edge_payload(messages: Column, system_text: str, max_tokens: Column, temperature: Column) -> Column:
    """Messages with a system message, ``max_tokens`` and ``temperature`` with the edge path's defaults."""
    return F.struct(edge_messages(messages, system_text).alias("messages"),
                    F.coalesce(max_tokens, F.lit(EDGE_MAX_TOKENS)).alias("max_tokens"),
                    F.coalesce(temperature, F.lit(EDGE_TEMPERATURE)).alias("temperature"))


def outbound_body(df: DataFrame, prefix: Column | None = None, messages: Column | None = None) -> Column:
    """E6-E8 + E11: the body sent upstream.

    Model: request's non-empty model, else the key's (E6), provider-prefixed
    unless already qualified (E7); ``max_tokens`` renamed to
    ``max_completion_tokens`` (E8); the policy field ``pii_strategy`` is not
    carried (E11); ``messages`` are the masked ones where given.
    """
    model = resolve_model(F.col("model"), F.col("kp_cloud_model"))
    if prefix is not None:
        model = prefix_model(model, prefix)
    fields = [model.alias("model"), F.col("temperature").alias("temperature"),
              F.col("max_tokens").alias("max_completion_tokens")]
    return F.struct(*([messages.alias("messages")] if messages is not None else []), *fields)


RESPONSE_SCHEMA = ("struct<id:string, object:string, model:string, routed_to:string, anonymized:boolean, "
                   "pii_matches:int, latency_ms:int, ner_ran:boolean, ner_entities:array<string>, "
                   "applied_strategy:string, strategy_mode:string, "
                   "choices:array<struct<index:int, message:struct<role:string, content:string>, finish_reason:string>>>")


def parse_response(body: Column) -> Column:
    """provider/proxy response JSON -> typed struct with the client's defaults."""
    r = F.from_json(body, RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})
    return F.struct(
        F.coalesce(r["id"], F.lit("")).alias("id"), F.coalesce(r["model"], F.lit("")).alias("model"),
        F.coalesce(r["routed_to"], F.lit("cloud")).alias("routed_to"),
        F.coalesce(r["anonymized"], F.lit(False)).alias("anonymized"),
        F.coalesce(r["pii_matches"], F.lit(0)).alias("pii_matches"),
        F.coalesce(r["latency_ms"], F.lit(0)).alias("latency_ms"),
        F.coalesce(r["ner_ran"], F.lit(False)).alias("ner_ran"),
        F.coalesce(r["ner_entities"], F.array().cast("array<string>")).alias("ner_entities"),
        r["applied_strategy"].alias("applied_strategy"), r["strategy_mode"].alias("strategy_mode"),
        F.coalesce(r["choices"], F.array().cast(
            "array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>"))
        .alias("choices"))
