"""Labelled corpus generation.

One labelled case per key row (e.g. ``customer.c_custkey``), so the corpus grows
with the table. ``kind = key mod 10``: kinds 0-6 are the seven synthetic
templates (clinical report, ER note, referral, lawsuit, contract,
consultation, disciplinary file); 7-9 are adversarial cases (malformed
identifiers, noisy layout, negatives). Every fifth of kind 9 stays a negative, the
others are templates 10-13, in the form of documents that other templates make:
indirect references, ambiguous values, hard names, and labels said to be out of the
detector's reach.

A case is a list of fragments; labelled fragments become entities whose
offsets are running lengths of the fragments before them (B1) - computed
in-row with ``aggregate``, never by searching the text. Values come from
per-row seeded picks (B10) that are pure SQL arithmetic, so the same
expressions serve the DuckDB oracle (:func:`oracle_sql`).

Template wording is our own; labelled slots follow the reference's set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions import idgen as G
from shroud.functions import pools as P
from shroud.functions.pools import pick, rbool, rint
from shroud.session import materialize

K = "k"  # key column name


@dataclass(frozen=True)
class Frag:
    val: object                     # Column (Spark) or Sql (oracle): literal or generated value
    type: str | None = None         # label type, None for plain text
    ner: bool = False               # PERSON / ORG / ADDRESS: NER scope
    expected: bool | None = None    # adversarial cases: should the regex layer match?


@dataclass(frozen=True)
class Template:
    kind_id: int
    domain: object       # Column or Sql
    kind: str
    source: str
    category: str | None
    notes: str | None
    frags: list[Frag]


_REASONS = ["mareo al levantarse", "tos seca de tres semanas", "esguince de tobillo", "migraña con aura",
            "erupción en ambos antebrazos", "control de tiroides"]
_ROLES = ["la parte que alquila", "el tutor", "la persona acompañante", "quien firma por la empresa"]
_STOCK = ["QT", "ZX", "LM", "KR"]
_HARD_NAMES = ["Rosa Prado", "Ángel Mayo", "Consuelo Rey", "Cruz Romero", "Luz Blanco", "Santos Campo"]
_SEASONS = ["primavera", "verano", "otoño", "invierno"]


def templates(ns, only: int | None = None) -> list[Template]:
    """The case templates (or just kind ``only``), built in namespace ``ns``."""
    k = ns.key(K)
    nl = "\n"

    def t(text: str) -> Frag:
        return Frag(ns.lit(text))

    def tv(v) -> Frag:
        return Frag(ns.let(v, 6))

    def e(type_: str, v, ner: bool = False, expected: bool | None = None) -> Frag:
        return Frag(ns.let(v, 6), type_, ner, expected)

    def num(slot, lo, hi):
        return ns.str(rint(ns, k, slot, lo, hi))

    def pk(slot, pool):
        return pick(ns, k, slot, pool)

    cp0, city0 = G.city(ns, k, 90)
    legal_or_health = ns.when(k % 2 == 0, ns.lit("legal"), ns.lit("sanidad"))
    thunks = [
        lambda: Template(0, ns.lit("sanidad"), "informe-alta", "synthetic", None, None, [
            t(f"Resumen de estancia{nl}Centro: "), e("ORG", pk(25, P.HOSPITALS), True), t(" · Firma: "),
            e("PERSON", G.full_name(ns, k, 26), True), t(f"{nl}Persona atendida: "), e("PERSON", G.full_name(ns, k, 1), True),
            t(" ("), tv(num(5, 18, 92)), t(f" años){nl}Contacto: "), e("PHONE", G.phone(ns, k, 20)), t(" | Vive en "),
            e("ADDRESS", G.address(ns, k, 12), True), t(", "), tv(cp0), t(" "), tv(city0), t(f"{nl}Números de registro: hospital "),
            e("NHC", G.nhc(ns, k, 6)), t("; identidad "), e("DNI", G.nif(ns, k, 8)), t("; afiliación "), e("SSN_ES", G.ssn_es(ns, k, 9)),
            t("; póliza de "), e("ORG", pk(24, P.INSURERS), True), t(f"{nl}Acudió por "), tv(pk(30, _REASONS)),
            t(f" y se marchó caminando.{nl}"),
        ]),
        lambda: Template(1, ns.lit("sanidad"), "nota-urgencias", "synthetic", None, None, [
            t("Entrada "), tv(num(1, 0, 23)), t("."), tv(P.pad(ns, rint(ns, k, 2, 0, 59), 2)), t(" en "),
            e("ORG", pk(21, P.HOSPITALS), True), t(f"{nl}Recibe "), e("PERSON", G.full_name(ns, k, 17), True),
            t(f"{nl}Ingresa "), e("PERSON", G.full_name(ns, k, 3), True), t(", documento "),
            e("DNI", ns.when(rbool(ns, k, 7), G.nie(ns, k, 8), G.nif(ns, k, 10))), t(" y expediente "), e("NHC", G.nhc(ns, k, 11)),
            t(f"{nl}Se ha avisado a su casa en el "), e("PHONE", G.phone(ns, k, 13)), t(f".{nl}Color de pulsera: verde.{nl}"),
        ]),
        lambda: Template(2, ns.lit("sanidad"), "interconsulta", "synthetic", None, None, [
            t("Para "), e("PERSON", G.full_name(ns, k, 16), True), t(": ¿podrías ver a "), e("PERSON", G.full_name(ns, k, 1), True),
            t("? Tarjeta "), e("CARD_HEALTH", G.health_card(ns, k, 8)), t(", carpeta "), e("NHC", G.nhc(ns, k, 5)),
            t(f".{nl}Lo pide "), e("PERSON", G.full_name(ns, k, 12), True), t(" desde "), e("ORG", pk(7, P.HOSPITALS), True),
            t(f"; no corre prisa, basta antes del mes que viene.{nl}"),
        ]),
        lambda: Template(3, ns.lit("legal"), "demanda", "synthetic", None, None, [
            t("Asunto "), e("NIG", G.nig(ns, k, 28)), t(" ante "), e("ORG", pk(1, P.COURTS), True), t(f"{nl}Pide: "),
            e("PERSON", G.full_name(ns, k, 9), True), t(" (identidad "), e("DNI", G.nif(ns, k, 13)), t(", casa en "),
            e("ADDRESS", G.address(ns, k, 14), True), t(", "), tv(cp0), t(" "), tv(city0), t(f").{nl}Frente a: "),
            e("PERSON", G.full_name(ns, k, 20), True), t(f".{nl}Escribe por quien pide: "), e("PERSON", G.full_name(ns, k, 2), True),
            t(", "), e("LAWYER_ID", G.bar_number(ns, k, 6)), t(", "), e("ORG", pk(8, P.LAW_FIRMS), True), t(f"{nl}Deuda de "),
            tv(num(24, 1000, 95000)), t(" euros desde el año "), tv(num(27, 2022, 2025)), t(f", sin respuesta a dos cartas.{nl}"),
        ]),
        lambda: Template(4, ns.lit("legal"), "contrato", "synthetic", None, None, [
            t("Acuerdo del "), tv(pk(2, _SEASONS)), t(" de "), tv(num(3, 2023, 2026)), t(f"{nl}1. Quien presta: "),
            e("ORG", pk(16, P.LAW_FIRMS), True), t(", fiscal "), e("CIF", G.cif(ns, k, 17)), t(", en su nombre "),
            e("PERSON", G.full_name(ns, k, 19), True), t(f"{nl}2. Quien encarga: "), e("PERSON", G.full_name(ns, k, 4), True),
            t(", identidad "), e("DNI", G.nif(ns, k, 8)), t(", "), e("ADDRESS", G.address(ns, k, 9), True), t(", "),
            tv(cp0), t(" "), tv(city0), t(f"{nl}3. Se abonan "), tv(num(23, 500, 50000)), t(" euros en "),
            e("IBAN", G.iban(ns, k, 24)), t(f" al terminar la tarea.{nl}"),
        ]),
        lambda: Template(5, ns.lit("legal"), "consulta", "synthetic", None, None, [
            t("Llamada atendida por "), e("PERSON", G.full_name(ns, k, 10), True), t(", "), e("LAWYER_ID", G.bar_number(ns, k, 14)),
            t(", de "), e("ORG", pk(16, P.LAW_FIRMS), True), t(f"{nl}Pregunta "), e("PERSON", G.full_name(ns, k, 1), True),
            t(", identidad "), e("DNI", G.nif(ns, k, 5)), t(", devolver la llamada al "), e("PHONE", G.phone(ns, k, 6)),
            t(f".{nl}Quiere saber si puede cambiar la fecha de una entrega.{nl}"),
        ]),
        lambda: Template(6, ns.lit("legal"), "disciplinario", "synthetic", None, None, [
            t("Hoja de incidencias "), e("CASE_ID", G.case_ref(ns, k, 1)), t(" de "), e("ORG", pk(8, P.LAW_FIRMS), True),
            t(f"{nl}Sobre: "), e("PERSON", G.full_name(ns, k, 3), True), t(", identidad "), e("DNI", G.nif(ns, k, 7)),
            t(", paga en "), e("IBAN", G.iban(ns, k, 13)), t(f"{nl}Anota: "), e("PERSON", G.full_name(ns, k, 9), True),
            t(f"{nl}Faltó "), tv(num(19, 2, 6)), t(f" mañanas sin avisar.{nl}"),
        ]),
        # ---- adversarial (B21-B23): mutated identifiers, noisy layout, negatives
        lambda: Template(7, legal_or_health, "mutated", "adversarial", "malformed-format",
                 "values typed in a hurry", [
            t("Copio lo que dejó en el contestador: "), e("PHONE_MALFORMED", G.short_phone(ns, k, 4, 8), expected=False),
            t(" o quizá "), e("PHONE_MALFORMED", G.mixed_sep_phone(ns, k, 6), expected=True),
            t(" (el de casa, "), e("PHONE_MALFORMED", G.short_phone(ns, k, 5, 10), expected=False),
            t("); plástico "), e("CARD", G.dotted_card(ns, G.health_card(ns, k, 13)), expected=True),
            t("; banco "), e("IBAN", G.hyphen_iban(ns, G.iban(ns, k, 7)), expected=True),
            t("; papeles "), e("DNI", G.dotted_nif(ns, G.nif(ns, k, 1)), expected=True), t(" / "),
            e("DNI_MALFORMED", G.spaced_nie(ns, G.nie(ns, k, 17)), expected=False), t(" / "),
            e("DNI_MALFORMED_DBLSPACE", G.spaced_nie(ns, G.nie(ns, k, 2), double=True), expected=True), t("\n"),
        ]),
        lambda: Template(8, legal_or_health, "csv-row", "adversarial", "noisy-context",
                 "table cells and brackets", [
            t("fila|quien|papel|aviso\n"), tv(ns.str(k)), t("|"), e("PERSON", G.full_name(ns, k, 1), True),
            t("|"), e("DNI", G.nif(ns, k, 5)), t("|"), e("PHONE", G.phone(ns, k, 6)),
            t("\n[parcela "), e("CATASTRAL_UNCOVERED", G.cadastral(ns, k, 40), expected=True),
            t("] [sociedad "), e("CIF", G.cif(ns, k, 10)), t("]\n"),
        ]),
        lambda: Template(9, legal_or_health, "negative", "adversarial", "negative",
                 "nothing personal: prices, shelves, opening times", [
            t("El almacén abre a las "), tv(num(3, 8, 19)), t(" y media; la estantería "), tv(num(2, 1, 99)),
            t(" guarda cajas de "), tv(num(1, 100, 999)), t(" piezas a precio de saldo.\n"),
        ]),
        lambda: Template(10, ns.lit("sanidad"), "nota-urgencias", "adversarial", "indirect-reference",
                 "someone is meant, nobody is named", [
            t("Quien ocupa la cama "), tv(num(3, 1, 60)), t(" pregunta por su hermana mayor; "),
            tv(pk(5, _ROLES)), t(" prefiere esperar a que vuelva la otra parte.\n"),
        ]),
        lambda: Template(11, ns.lit("legal"), "contrato", "adversarial", "ambiguous",
                 "stock numbers, bar codes and releases that look like identifiers", [
            t("Pedido "), tv(pk(4, _STOCK)), t("-"), tv(P.pad(ns, rint(ns, k, 2, 0, 999999), 6)),
            t(" con código de barras 84"), tv(P.pad(ns, rint(ns, k, 7, 0, 99999999999), 11)),
            t(", lote "), tv(num(1, 10000000, 99999999)), t(", hoja revisada el "), tv(num(5, 2015, 2025)), t("-0"), tv(num(6, 1, 9)),
            t("-1"), tv(num(8, 0, 9)), t(".\n"),
        ]),
        lambda: Template(12, ns.lit("legal"), "consulta", "adversarial", "hard-name",
                 "names that are also ordinary words", [
            e("PERSON", pk(3, _HARD_NAMES), True), t(" llegó la víspera de la fiesta del pueblo y dejó las llaves a "),
            e("PERSON", pk(4, _HARD_NAMES), True), t(", como cada abril.\n"),
        ]),
        lambda: Template(13, ns.lit("legal"), "demanda", "adversarial", "malformed-format",
                 "labelled as values without a pattern", [
            t("Carpeta "), e("NHC_UNCOVERED", ns.concat("NHC ", num(1, 2010, 2025), " ", num(2, 1000, 9999)), expected=False),
            t("; firma "), e("LAWYER_ID_UNCOVERED", ns.concat("ICAM nº ", num(4, 10000, 99999)), expected=False),
            t("; identidad "), e("DNI_MALFORMED", ns.concat(num(5, 10000000, 99999999), "q"), expected=False), t(".\n"),
        ]),
    ]
    return [thunks[only]()] if only is not None else [th() for th in thunks]


N_KINDS = 14


def kind_sql(div: str) -> str:
    """The case kind of a key; ``div``: the engine's operator for whole-number division."""
    return f"CASE WHEN {K} % 10 = 9 THEN 9 + ({K} {div} 10) % 5 ELSE {K} % 10 END"


_FRAG = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("ner_scope", T.BooleanType()),
    T.StructField("expected_match", T.BooleanType()),
])


def _frag_sql(f: Frag) -> str:
    typ = f"'{f.type}'" if f.type else "CAST(NULL AS STRING)"
    exp = "CAST(NULL AS BOOLEAN)" if f.expected is None else ("TRUE" if f.expected else "FALSE")
    return (f"named_struct('text', CAST({f.val} AS STRING), 'type', {typ}, "
            f"'ner_scope', {'TRUE' if f.ner else 'FALSE'}, 'expected_match', {exp})")


_TAIL = [
    f"concat('case-', CAST({K} AS STRING)) AS case_id",
    "domain", "kind", "category", "source", "notes",
    "array_join(transform(_frags, f -> f.text), '') AS text",
    # B1: start = running length of the fragments before; entities keep label order
    """transform(
         filter(transform(_frags, (f, i) -> named_struct(
                  'type', f.type, 'value', f.text,
                  'start', aggregate(slice(transform(_frags, g -> length(g.text)), 1, i), 0, (a, x) -> a + x),
                  'ner_scope', f.ner_scope, 'expected_match', f.expected_match)),
                e -> e.type IS NOT NULL),
         (e, i) -> named_struct('ord', i + 1, 'type', e.type, 'value', e.value,
                                'start', CAST(e.start AS INT), 'end', CAST(e.start + length(e.value) AS INT),
                                'ner_scope', e.ner_scope, 'expected_match', e.expected_match)) AS entities""",
]


def _kind_sql(src: str, tp: Template, ns) -> str:
    q = f"SELECT {K}, {', '.join(ns.base_exprs(K))} FROM {src} WHERE _kind = {tp.kind_id}"
    for level in sorted(ns.lets):
        q = f"SELECT *, {', '.join(ns.lets[level])} FROM ({q})"
    cat = f"'{tp.category}'" if tp.category else "CAST(NULL AS STRING)"
    notes = f"'{tp.notes}'" if tp.notes else "CAST(NULL AS STRING)"
    frags = "array(" + ", ".join(_frag_sql(f) for f in tp.frags) + ")"
    return (f"SELECT {K}, {tp.domain} AS domain, '{tp.kind}' AS kind, {cat} AS category, "
            f"'{tp.source}' AS source, {notes} AS notes, {frags} AS _frags FROM ({q})")


_VIEW_SEQ = [0]


def generate(keys: DataFrame, key_col: str) -> DataFrame:
    """``case_id, domain, kind, category, source, notes, text, entities``.

    No shuffle: one narrow branch per template kind over the key column, each
    staged so every expression stays short, unioned, then one shared
    projection for text and entity offsets (all kinds in one projection would pass the
    64 KB limit of generated code, so each has its own). Expressed as one SQL statement so
    planning is a single parse. ``entities`` is
    ``array<struct<ord, type, value, start, end, ner_scope, expected_match>>``.
    """
    _VIEW_SEQ[0] += 1
    view = f"_shroud_keys_{_VIEW_SEQ[0]}"
    (keys.select(F.col(key_col).cast("long").alias(K))
         .withColumn("_kind", F.expr(kind_sql("div")).cast("int"))
         .createOrReplaceTempView(view))
    branches = []
    for kind_id in range(N_KINDS):
        ns = P.spark_ns()
        branches.append(_kind_sql(view, templates(ns, kind_id)[0], ns))
    body = "\nUNION ALL\n".join(f"({b})" for b in branches)
    out = keys.sparkSession.sql(f"SELECT {', '.join(_TAIL)} FROM ({body})")
    # The corpus is an input table: write it once to the shared checkpoint
    # folder. Besides reuse, this keeps later filters from being pushed into
    # (and inlining) the generator expressions.
    return materialize(out)


def eval_cases(corpus: DataFrame) -> DataFrame:
    return corpus.drop("entities")


def eval_entities(corpus: DataFrame) -> DataFrame:
    return corpus.select("case_id", F.inline("entities"))


# ---------------------------------------------------------------- oracle SQL
def oracle_cases_sql(table: str, key_col: str) -> str:
    """DuckDB: one SELECT per kind (filtered), text as a plain concatenation."""
    parts = []
    for tp in templates(P.SQL):
        cols = ", ".join(f"{f.val} AS f{i}" for i, f in enumerate(tp.frags))
        text = " || ".join(f"f{i}" for i in range(len(tp.frags)))
        cat = P.SQL.lit(tp.category) if tp.category else "CAST(NULL AS VARCHAR)"
        notes = P.SQL.lit(tp.notes) if tp.notes else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT 'case-' || CAST({K} AS VARCHAR) AS case_id, {tp.domain} AS domain, "
            f"'{tp.kind}' AS kind, {cat} AS category, '{tp.source}' AS source, {notes} AS notes, {text} AS text "
            f"FROM (SELECT {K}, {cols} FROM (SELECT CAST({key_col} AS BIGINT) AS {K} FROM {table}) "
            f"WHERE {kind_sql('//')} = {tp.kind_id})")
    return "\nUNION ALL\n".join(parts)


def oracle_entities_sql(table: str, key_col: str) -> str:
    parts = []
    for tp in templates(P.SQL):
        cols = ", ".join(f"{f.val} AS f{i}" for i, f in enumerate(tp.frags))
        sel, ordn = [], 0
        for i, f in enumerate(tp.frags):
            if f.type is None:
                continue
            ordn += 1
            start = " + ".join(f"length(f{j})" for j in range(i)) if i else "0"
            exp = "CAST(NULL AS BOOLEAN)" if f.expected is None else ("TRUE" if f.expected else "FALSE")
            sel.append(
                f"SELECT 'case-' || CAST({K} AS VARCHAR) AS case_id, {ordn} AS ord, '{f.type}' AS type, "
                f"f{i} AS value, CAST({start} AS INTEGER) AS start, CAST({start} + length(f{i}) AS INTEGER) AS \"end\", "
                f"{'TRUE' if f.ner else 'FALSE'} AS ner_scope, {exp} AS expected_match FROM w{tp.kind_id}")
        if sel:
            parts.append((tp.kind_id, cols, sel))
    ctes = ",\n".join(
        f"w{kid} AS (SELECT {K}, {cols} FROM (SELECT CAST({key_col} AS BIGINT) AS {K} FROM {table}) WHERE {kind_sql('//')} = {kid})"
        for kid, cols, _ in parts)
    body = "\nUNION ALL\n".join(x for _, _, sel in parts for x in sel)
    return f"WITH {ctes}\n{body}"
