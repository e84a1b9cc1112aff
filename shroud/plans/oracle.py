"""DuckDB SQL fragments shared by the oracle queries (test scaffolding only)."""

from __future__ import annotations

from shroud.functions.patterns import pii_patterns, re2_form, secret_patterns


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern_matches_sql(table: str, key: str, text: str, family: str = "pii") -> str:
    """Rows ``(key, type, rank, value)``: each pattern's matches, extracted independently.

    Equals the overlap-folded C1 spans when no two patterns hit overlapping text
    (true of the driver's ``documents``). ROUTING (variable lookbehind) is
    emulated with capture groups; Spanish PHONE with a consumed boundary.
    """
    pats = pii_patterns() if family == "pii" else secret_patterns()
    parts = []
    for p in pats:
        if p.type == "ROUTING":
            for rx in (r"(?i)\brouting\b[^0-9]{0,20}([0-9]{9})\b", r"(?i)\b([0-9]{9})\b[^0-9]{0,20}\brouting\b"):
                parts.append(f"SELECT {key} AS k, '{p.type}' AS type, {p.rank} AS rank, "
                             f"unnest(regexp_extract_all({text}, {q(rx)}, 1)) AS value FROM {table}")
            continue
        f = re2_form(p.family, p.idx)
        sel = (f"SELECT {key} AS k, '{p.type}' AS type, {p.rank} AS rank, "
               f"unnest(regexp_extract_all({text}, {q(f.pattern)}, {f.group})) AS value FROM {table}")
        if f.exclude:
            sel = f"SELECT * FROM ({sel}) WHERE NOT regexp_matches(value, {q(f.exclude)})"
        parts.append(sel)
    return "\nUNION ALL\n".join(parts)


def token_rows_sql(source: str, keys: list[str], text: str = "text", conv_keys: list[str] | None = None,
                   order_keys: list[str] | None = None) -> str:
    """DuckDB token map ``keys.., token_ord, token, type, n, value`` from per-pattern extraction.

    Secrets then PII, in catalogue order, each pattern's matches in text order.
    Numbering is per ``conv_keys`` (default: all keys) ordered by
    ``order_keys`` (e.g. the turn), pattern rank, match position. Equals the
    sequential masking when no pattern's match overlaps an earlier one's.
    """
    from shroud.functions.patterns import catalogue
    conv_keys = conv_keys or keys
    order_keys = order_keys or []
    kcols = ", ".join(keys)
    parts = []
    for p in catalogue():
        if p.type == "ROUTING":
            continue
        f = re2_form(p.family, p.idx)
        ex = f"list_filter(regexp_extract_all({text}, {q(f.pattern)}, {f.group}), lambda x: NOT regexp_matches(x, {q(f.exclude)}))" \
            if f.exclude else f"regexp_extract_all({text}, {q(f.pattern)}, {f.group})"
        parts.append(f"SELECT {kcols}, '{p.type}' AS type, {p.rank} AS rank, {ex} AS vals FROM src")
    union = "\nUNION ALL\n".join(parts)
    part = ", ".join(conv_keys)
    order = ", ".join(order_keys + ["rank", "pos"])
    return f"""
WITH src AS ({source}),
m AS ({union}),
u AS (SELECT {kcols}, type, rank, unnest(vals) AS value, generate_subscripts(vals, 1) AS pos FROM m WHERE len(vals) > 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY {part}, type ORDER BY {order}) AS n,
              row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS token_ord FROM u)
SELECT {', '.join(conv_keys)}, CAST(token_ord AS INTEGER) AS token_ord, '[' || type || '_' || CAST(n AS VARCHAR) || ']' AS token,
       type, CAST(n AS INTEGER) AS n, value FROM nn"""


PLANTED_CONVERSATIONS_SQL = """
SELECT conv_id, turn, role, coalesce(text, '')
  || CASE WHEN turn % 3 = 0 THEN ' Escríbeme a c' || CAST(conv_id AS VARCHAR) || 't' || CAST(turn AS VARCHAR) || '@example.org.' ELSE '' END
  || CASE WHEN (conv_id + turn) % 4 = 0 THEN ' Mi DNI es ' || CAST(conv_id AS VARCHAR) || ' y tel 6'
          || lpad(CAST((conv_id * 1000 + turn) % 100000000 AS VARCHAR), 8, '0') || '.' ELSE '' END
  || CASE WHEN turn = 1 THEN ' Otra vez: c' || CAST(conv_id AS VARCHAR) || 't0@example.org' ELSE '' END AS text
FROM conversations"""


def sequential_mask_sql(source: str, key: str = "case_id", text: str = "text", numbered: bool = False) -> str:
    """DuckDB replay of the sequential masking: ``key, vals list<struct<type, value>>, t`` (the masked text).

    In ``t`` every token has number 0, or with ``numbered`` its number by place.

    Each pattern extracts from, then replaces in, the text left by the
    previous ones (token placeholders keep later patterns' context).
    Lookahead exclusions become temporary sentinel characters that stop the
    excluded candidates from matching; the Spanish phone's digit lookarounds
    become a captured non-digit boundary, applied twice so that candidates
    separated by one character are both found. ROUTING is not replayed.
    """
    from shroud.functions.patterns import catalogue, translate
    sent = "chr(1)"
    stages = [f"s0 AS (SELECT {key}, {text} AS t, [] AS vals FROM ({source}))"]
    i = 0

    def add(expr_t: str, vals: str | None = None):
        nonlocal i
        i += 1
        v = f"list_concat(vals, {vals})" if vals else "vals"
        stages.append(f"s{i} AS (SELECT {key}, {expr_t} AS t, {v} AS vals FROM s{i - 1})")

    for p in catalogue():
        if p.type == "ROUTING":
            continue
        tok = q(f"[{p.type}_0]")
        tag = lambda rx, g=0, typ=p.type: (
            f"list_transform(regexp_extract_all(t, {q(rx)}, {g}), lambda x: {{'type': '{typ}', 'value': x}})")
        if p.type == "PASSPORT":
            mark = translate(r"\b(APP|BC|ID|BK|ACC|REF|TXN|ACCT|CASE|CLT)([-#\s]?[0-9])", "re2")
            add(f"regexp_replace(t, {q(mark)}, '\\1' || {sent} || '\\2', 'g')")
            rx = translate(r"\b[A-Z]{1,3}[-\s]?\d{6,9}\b", "re2")
            add(f"regexp_replace(t, {q(rx)}, {tok}, 'g')", tag(rx))
            add(f"replace(t, {sent}, '')")
        elif p.type == "ID":
            add(f"regexp_replace(t, '\\b(MRN|EMP)-', '\\1' || {sent} || '-', 'g')")
            rx = re2_form(p.family, p.idx).pattern
            add(f"regexp_replace(t, {q(rx)}, {tok}, 'g')", tag(rx))
            add(f"replace(t, {sent}, '')")
        elif p.type == "PHONE" and p.source.startswith("(?<!"):
            rx = re2_form(p.family, p.idx).pattern
            rx3 = rx[:-len("(?:[^0-9]|$)")] + "([^0-9]|$)"
            rx3 = "(^|[^0-9])" + rx3[len("(?:^|[^0-9])"):]
            for _ in range(2):
                add(f"regexp_replace(t, {q(rx3)}, '\\1' || {tok} || '\\3', 'g')", tag(rx3, 2))
        else:
            rx = re2_form(p.family, p.idx).pattern
            add(f"regexp_replace(t, {q(rx)}, {tok}, 'g')", tag(rx))
    for typ in dict.fromkeys(p.type for p in catalogue() if numbered):
        i += 1
        parts = f"string_split(t, '[{typ}_0]')"
        stages.append(f"s{i} AS MATERIALIZED (SELECT {key}, CASE WHEN contains(t, '[{typ}_0]') THEN array_to_string(list_transform("
                      f"{parts}, lambda x, i: CASE WHEN i = 1 THEN x ELSE '[{typ}_' || CAST(i - 1 AS VARCHAR) || ']' || x END), '') "
                      f"ELSE t END AS t, vals FROM s{i - 1})")
    return "WITH " + ",\n".join(stages) + f"\nSELECT {key}, vals, t FROM s{i}"
