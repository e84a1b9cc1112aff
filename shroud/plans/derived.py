"""Inputs derived from the driver tables (SURVEY §5: 'derived inputs').

The driver tables hold TPC-H-like rows and prose without Spanish identifiers,
keys, requests or NER replies. These views build them from the tables' own
integer keys with arithmetic that Spark and DuckDB evaluate identically, so
the same SQL text serves the query (Spark, over temp views) and the oracle
(DuckDB, over CTEs), and each view grows with its source table:

* ``key_policy``  - one issued key per ``customer`` row (tiers, strategies, limits);
* ``requests``    - one chat request per ``events`` row, text with planted
  personal data and secrets;
* ``request_ner`` - the NER model's reply per request (a stand-in for the model);
* ``case_ner``    - NER replies per labelled case and model, with misses,
  paraphrases, case changes, false positives, empty values and errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shroud.functions import pools as P

_NS = P.SQL


def _name(key: str, slot: int) -> str:
    # full name pick in plain CASE SQL (valid in both engines)
    from shroud.functions import idgen as G
    return str(G.full_name(_NS, _NS.key(key), slot))


KEY_POLICY_SQL = """
SELECT
  CASE WHEN c_custkey % 50 = 0 THEN 'key_test_' ELSE 'key_live_' END || CAST(c_custkey AS STRING) AS api_key,
  'user-' || CAST(c_custkey AS STRING) AS user_id,
  CASE WHEN c_custkey % 10 < 6 THEN 'free' WHEN c_custkey % 10 < 8 THEN 'pro'
       WHEN c_custkey % 10 = 8 THEN 'enterprise' ELSE 'trial' END AS tier,
  CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'key-' || CAST(c_custkey AS STRING) END AS api_key_id,
  c_name AS api_key_name,
  CASE c_custkey % 4 WHEN 0 THEN 'anonymize' WHEN 1 THEN 'edge' WHEN 2 THEN 'custom' ELSE NULL END AS pii_strategy,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '@cf/meta/llama-3.1-8b-instruct'
       ELSE '@cf/meta/llama-3.3-70b-instruct-fp8-fast' END AS edge_model,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(1 AS INT) ELSE CAST(NULL AS INT) END AS edge_limit,
  CASE c_custkey % 7 WHEN 0 THEN 'byok' WHEN 1 THEN NULL ELSE 'managed' END AS provider_mode,
  CASE c_custkey % 6 WHEN 0 THEN 'anthropic' WHEN 1 THEN NULL WHEN 2 THEN 'google' ELSE 'openai' END AS provider,
  CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 0 THEN 'claude-haiku' ELSE 'gpt-4o-mini' END AS cloud_model,
  CASE WHEN c_custkey % 7 = 0 THEN 'alias-' || CAST(c_custkey AS STRING) ELSE NULL END AS byok_alias
FROM {customer}
"""


def requests_sql(events: str) -> str:
    name = _name("event_id", 1)
    return f"""
SELECT
  event_id AS request_id, ts, user_id AS account,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'key_live_' || CAST(user_id AS STRING) END AS api_key,
  'Resumen del evento ' || event_type || ' número ' || CAST(event_id AS STRING) || '.'
    || CASE WHEN event_id % 5 = 0 THEN ' Contacto: user' || CAST(user_id AS STRING) || '@mail'
              || CAST(event_id % 9 AS STRING) || '.example.com.' ELSE '' END
    || CASE WHEN event_id % 7 = 0 THEN ' Móvil 6' || lpad(CAST(event_id % 100000000 AS STRING), 8, '0') || '.' ELSE '' END
    || CASE WHEN event_id % 11 = 0 THEN ' Clave AKIA' || lpad(CAST(event_id AS STRING), 16, '0') || '.' ELSE '' END
    || CASE WHEN event_id % 13 = 0 THEN ' Paciente: ' || {name} || '.' ELSE '' END
    || CASE WHEN event_id % 19 = 0 THEN ' Tarjeta 4' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') || ' 1234 5678 9012.' ELSE '' END
    AS text,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'gpt-4o' END AS model,
  CASE event_id % 8 WHEN 0 THEN 'edge' WHEN 1 THEN 'anonymize' WHEN 2 THEN 'bogus' ELSE NULL END AS body_strategy,
  CASE WHEN event_id % 53 = 0 THEN FALSE ELSE TRUE END AS body_ok,
  CASE WHEN event_id % 2 = 0 THEN CAST(256 AS INT) ELSE CAST(NULL AS INT) END AS max_tokens,
  CAST(value / 50.0 AS DOUBLE) AS temperature
FROM {events}
"""


def request_ner_sql(requests: str) -> str:
    """Model reply per request: error every 31st; the planted patient name when present."""
    name = _name("request_id", 1)
    return f"""
SELECT request_id,
  CASE WHEN request_id % 31 = 0 THEN 'error'
       WHEN request_id % 13 = 0 THEN 'found' ELSE 'clean' END AS ner_status,
  CASE WHEN request_id % 31 <> 0 AND request_id % 13 = 0 THEN {name} END AS person
FROM {requests}
"""


def provider_reply_sql(requests: str) -> str:
    """What the provider and the network said about each request: tokens, latency, place."""
    return f"""
SELECT request_id, CAST(40 + request_id % 211 AS INT) AS tokens_in,
  CASE WHEN request_id % 23 = 0 THEN CAST(NULL AS INT) ELSE CAST(10 + request_id % 97 AS INT) END AS tokens_out,
  CAST(120 + (request_id * 7919) % 1800 AS INT) AS latency_ms,
  CASE WHEN request_id % 23 = 0 THEN NULL WHEN request_id % 10 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN request_id % 23 <> 0 THEN 'req-' || CAST(request_id AS STRING) END AS provider_request_id,
  CASE request_id % 4 WHEN 0 THEN 'MAD' WHEN 1 THEN 'CDG' WHEN 2 THEN 'FRA' ELSE NULL END AS cf_node,
  CASE request_id % 3 WHEN 0 THEN 'ES' WHEN 1 THEN 'FR' ELSE NULL END AS request_country,
  CASE request_id % 3 WHEN 0 THEN 'Madrid' WHEN 1 THEN 'Lyon' ELSE NULL END AS request_city
FROM {requests}
"""


def with_provider_reply(spark: SparkSession, reqs: DataFrame) -> DataFrame:
    """``reqs`` + the reply columns, computed in-row."""
    v = _view(reqs, "reqs_reply")
    return spark.sql("SELECT *," + provider_reply_sql(v).strip()[len("SELECT request_id,"):])


NER_MODELS = [("ner-large", 29, 300, 1200), ("ner-small", 7, 150, 600)]  # (model, error every n, latency base, span)


def case_ner_sql(cases: str, entities: str) -> tuple[str, str]:
    """Per labelled case and model: status, latency and returned entities (rows).

    Returns two SQL statements: replies ``(case_id, model, status, latency_ms)``
    and entity rows ``(case_id, model, rord, type, value)``; one branch per
    model (a fixed list), unioned.
    """
    hc = "CAST(substr(c.case_id, 6) AS BIGINT)"
    he = "CAST(substr(e.case_id, 6) AS BIGINT)"
    rep, ent = [], []
    for mi, (m, err, base, span) in enumerate(NER_MODELS):
        rep.append(f"""
SELECT c.case_id, '{m}' AS model,
  CASE WHEN ({hc} + {mi}) % {err} = 0 THEN 'error' ELSE 'ok' END AS status,
  CAST({base} + (({hc} * 7919 + {mi * 104729}) % {span}) AS INT) AS latency_ms
FROM {cases} c""")
        miss = f" AND ({he} + e.ord) % 4 <> 0" if mi == 1 else ""
        upper = f"CASE WHEN ({he} + e.ord) % 9 = 0 THEN upper(e.value) ELSE e.value END" if mi == 0 else "e.value"
        ent.append(f"""
SELECT e.case_id, '{m}' AS model, e.ord AS rord, e.type, {upper} AS value
FROM {entities} e WHERE e.ner_scope{miss}
UNION ALL
SELECT e.case_id, '{m}' AS model, 100 AS rord, e.type, 'la entidad ' || e.value AS value
FROM {entities} e WHERE e.ner_scope AND e.ord = 1 AND ({he} + {mi}) % {11 - 6 * mi} = 0
UNION ALL
SELECT c.case_id, '{m}' AS model, 101 AS rord, 'ORG' AS type, substr(c.text, 1, 7) AS value
FROM {cases} c WHERE ({hc} + {mi}) % 13 = 0
UNION ALL
SELECT c.case_id, '{m}' AS model, 102 AS rord, 'PERSON' AS type, '' AS value
FROM {cases} c WHERE ({hc} + {mi}) % 17 = 0""")
    return "\nUNION ALL\n".join(rep), "\nUNION ALL\n".join(ent)


# ------------------------------------------------------------------ Spark side
_SEQ = [0]


def _view(df: DataFrame, stem: str) -> str:
    _SEQ[0] += 1
    name = f"_shroud_{stem}_{_SEQ[0]}"
    df.createOrReplaceTempView(name)
    return name


def key_policy(spark: SparkSession, customer: DataFrame) -> DataFrame:
    v = _view(customer.select("c_custkey", "c_name"), "customer")
    return spark.sql(KEY_POLICY_SQL.format(customer=v))


def requests(spark: SparkSession, events: DataFrame) -> DataFrame:
    v = _view(events.select("event_id", "ts", "user_id", "event_type", "value"), "events")
    return spark.sql(requests_sql(v))


def request_ner(spark: SparkSession, reqs: DataFrame) -> DataFrame:
    """``request_id, ner_status, ner_entities`` (PERSON entity when one was returned)."""
    from pyspark.sql import functions as F
    v = _view(reqs.select("request_id"), "reqs")
    r = spark.sql(request_ner_sql(v))
    ents = F.when(F.col("person").isNotNull(), F.array(F.struct(F.lit("PERSON").alias("type"),
                                                                F.col("person").alias("value")))) \
        .otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    return r.select("request_id", "ner_status", ents.alias("ner_entities"))


def case_ner(spark: SparkSession, corpus: DataFrame) -> DataFrame:
    """``case_id, model, status, latency_ms, ents array<struct<type,value>>`` (one row per case x model)."""
    from pyspark.sql import functions as F
    cv = _view(corpus.select("case_id", "text"), "cases")
    ev = _view(corpus.select("case_id", F.inline("entities")), "ents")
    rep_sql, ent_sql = case_ner_sql(cv, ev)
    replies = spark.sql(rep_sql)
    rows = spark.sql(ent_sql)
    # the reply of one request: bounded by what a model returns for one text
    lists = rows.groupBy("case_id", "model").agg(
        F.sort_array(F.collect_list(F.struct("rord", "type", "value"))).alias("_l"))
    lists = lists.select("case_id", "model", F.transform("_l", lambda x: F.struct(
        x["type"].alias("type"), x["value"].alias("value"))).alias("ents"))
    return replies.join(lists, ["case_id", "model"], "left")


def with_request_ner(spark: SparkSession, reqs: DataFrame) -> DataFrame:
    """``reqs`` + ``ner_status, ner_entities`` computed in-row (the reply depends only on the
    request), so no join and no shuffle of request texts."""
    from pyspark.sql import functions as F
    v = _view(reqs, "reqs_all")
    body = request_ner_sql(v).strip()
    assert body.startswith("SELECT request_id,")
    r = spark.sql("SELECT *," + body[len("SELECT request_id,"):])
    ents = F.when(F.col("person").isNotNull(), F.array(F.struct(F.lit("PERSON").alias("type"),
                                                                F.col("person").alias("value")))) \
        .otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    return r.withColumn("ner_entities", ents).drop("person")
