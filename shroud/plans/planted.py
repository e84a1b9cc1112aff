"""Registered queries over texts with one planted value of every pattern, and with patterns given as a table.

The driver's tables hold few of the catalogue's patterns. Here each order has a
sentence with one value, built from the order's key by SQL that both engines run; the
oracle states the value's type and place from that SQL and applies no pattern.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shroud.functions import patterns as PT
from shroud.operators import detect
from shroud.plans import catalog as C
from shroud.plans import derived as D
from shroud.plans import oracle as O
from shroud.sources.tables import table

register = C.register


def _digits(n: int, times: int, plus: int = 0) -> str:
    """``n`` digits that depend on the key."""
    return f"lpad(CAST((k * {times} + {plus}) % {10 ** n} AS VARCHAR), {n}, '0')"


_HEX = "md5(CAST(k AS VARCHAR))"
#: (type, value as SQL, words before it): in the catalogue's order.
SECRETS = [
    ("SECRET_CLOUD_KEY", f"'AKIA' || upper(substr({_HEX}, 1, 16))", "key"),
    ("SECRET_DB_URI", f"'postgres://app:' || {_HEX} || '@db.example.org/main'", "at"),
    ("SECRET_DB_URI", f"'mongodb+srv://app:' || {_HEX} || '@m.example.org'", "at"),
    ("SECRET_DB_URI", f"'redis://:' || {_HEX} || '@r.example.org'", "at"),
    ("SECRET_JWT", f"'eyJ' || {_HEX} || '.eyJ' || {_HEX} || '.' || {_HEX}", "bearer"),
    ("SECRET_API_KEY", f"'sk-' || {_HEX}", "key"),
    ("SECRET_API_KEY", f"'api_key = ' || {_HEX}", "with"),
]
PII = [
    ("EMAIL", "'k' || CAST(k AS VARCHAR) || '@example.org'", "write to"),
    ("SSN", f"{_digits(3, 7)} || '-' || {_digits(2, 3)} || '-' || {_digits(4, 11)}", "social security"),
    ("DNI", f"{_digits(8, 7919)} || 'Z'", "identity"),
    ("CIF", f"'B' || {_digits(7, 7919)} || 'J'", "company"),
    ("NIG", f"{_digits(6, 31)} || 'C' || {_digits(6, 17)} || '/2024'", "court file"),
    ("PASSPORT", f"'XDA' || {_digits(6, 31)}", "passport"),
    ("IBAN", f"'ES' || {_digits(2, 3)} || ' ' || {_digits(4, 7)} || ' ' || {_digits(4, 11)} || ' ' || {_digits(4, 13)} || ' ' || {_digits(4, 17)} || ' ' || {_digits(4, 19)}", "account"),
    ("CARD", f"'4' || {_digits(3, 7)} || '-' || {_digits(4, 11)} || '-' || {_digits(4, 13)} || '-' || {_digits(4, 17)}", "card"),
    ("ROUTING", f"'1' || {_digits(8, 7919)}", "routing number"),
    ("TAX_ID", f"{_digits(2, 3)} || '-' || {_digits(7, 7919)}", "tax"),
    ("PHONE", f"'2' || {_digits(2, 3)} || '-' || {_digits(3, 7)} || '-' || {_digits(4, 11)}", "call"),
    ("PHONE", f"'6' || {_digits(8, 7919)}", "call"),
    ("DATE", "'1' || CAST(k % 10 AS VARCHAR) || '/0' || CAST(1 + k % 9 AS VARCHAR) || '/2024'", "on"),
    ("DATE", "'2024-0' || CAST(1 + k % 9 AS VARCHAR) || '-1' || CAST(k % 10 AS VARCHAR)", "on"),
    ("MRN", f"'mrn ' || {_digits(6, 31)}", "record"),
    ("NHC", f"'NHC-2024-' || {_digits(6, 31)}", "history"),
    ("EMP_ID", f"'emp ' || {_digits(6, 31)}", "staff"),
    ("LAWYER_ID", f"'ICAM nº ' || {_digits(5, 31)}", "bar"),
    ("SSN_ES", f"{_digits(2, 3)} || ' ' || {_digits(10, 104729)} || ' ' || {_digits(2, 7)}", "affiliation"),
    ("CATASTRAL", f"{_digits(7, 31)} || 'VK' || {_digits(4, 17)} || 'S' || {_digits(4, 13)} || 'WX'", "plot"),
    ("ID", f"'#BK-Q' || {_digits(5, 31)}", "booking"),
]


def planted_sql(values: list[tuple[str, str, str]], orders: str) -> str:
    """(k, place in the list, type, before, value): one value per order, the order's key picks which."""
    pick = f"(o_orderkey - {len(values)} * CAST(floor(o_orderkey / {len(values)}) AS BIGINT))"
    whens = lambda xs: "CASE i " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    return (f"SELECT k, {whens(O.q(t) for t, _, _ in values)} AS type, "
            f"'Note ' || {whens(O.q(before + ' ') for _, _, before in values)} AS before, {whens(v for _, v, _ in values)} AS value "
            f"FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, {pick} AS i FROM {orders})")


def planted(spark, sf, values):
    """(k, text): the planted value in its sentence."""
    table(spark, sf, "orders", "o_orderkey").createOrReplaceTempView("_orders")
    sql = planted_sql(values, "_orders").replace("VARCHAR", "STRING")
    return spark.sql(f"SELECT k, concat(before, value, ' was left here.') AS text FROM ({sql})")


@register("c1_planted_spans", f"""
SELECT k, type, value, CAST(length(before) AS INTEGER) AS "start", CAST(length(before) + length(value) AS INTEGER) AS "end"
FROM ({planted_sql(PII, 'orders')})""")
def c1_planted_spans(spark, sf):
    """C1 with every pattern: the spans found in texts that hold one value each, and nothing beside it."""
    return detect.pii_spans(planted(spark, sf, PII), "text", ["k"]).drop("rank")


@register("c2_planted_secrets", f"SELECT k, type AS types FROM ({planted_sql(SECRETS, 'orders')})")
def c2_planted_secrets(spark, sf):
    """C2 with every secret pattern."""
    return planted(spark, sf, SECRETS).select("k", F.array_join(detect.secret_types("text"), ",").alias("types"))


#: A pattern of the user's own, in the catalogue's syntax (rank: after all others).
EVENT_NUMBER = (1000, "pii", 100, "EVENT_NO", r"número \d+", False)


@register("c1_added_pattern", f"""
WITH rq AS ({D.requests_sql('events')}),
m AS ({O.pattern_matches_sql('rq', 'request_id', 'text')} UNION ALL
      SELECT request_id AS k, 'EVENT_NO' AS type, 1000 AS rank, unnest(regexp_extract_all(text, 'número [0-9]+')) AS value FROM rq)
SELECT k AS request_id, type, value FROM m""")
def c1_added_pattern(spark, sf):
    """C1 with the catalogue read from a table to which a pattern was added."""
    rows = spark.createDataFrame([*PT.patterns_rows(), EVENT_NUMBER], PT.ROWS)
    events = D.requests(spark, table(spark, sf, "events"))
    return detect.pii_spans(events, "text", ["request_id"], patterns=rows).select("request_id", "type", "value")
