"""Detector evaluation against labelled cases.

Scoring is per case and needs only that case's labels and that case's tokens.
Both are arrays in the *same row* (labels come with the generated case, tokens
come out of the masking kernel keyed by the case), so exact / partial /
false-positive tests are ``exists`` over two small arrays in one row: no join,
no shuffle, no pair explosion across rows. Only the per-type aggregates shuffle,
and they are partially aggregated first.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.operators import mask
from shroud.session import materialize


def masked_cases(corpus: DataFrame) -> DataFrame:
    """Cases + regex-only masking (D1 with no NER), entities carried alongside."""
    return mask.mask_texts(corpus, "text", ["case_id", "domain", "kind", "category", "source", "notes", "entities"])


def _exact(tokens: Column, value: Column) -> Column:
    return F.exists(tokens, lambda t: t["value"] == value)


def _partial_of(value: Column, tokens: Column) -> Column:
    """Some masked value is a strict substring of ``value``."""
    return F.exists(tokens, lambda t: (F.instr(value, t["value"]) > 0) & (F.length(t["value"]) < F.length(value)))


def score_entities(masked: DataFrame) -> DataFrame:
    """one row per regex-scope label with ``detected`` and ``partial``.

    An entity is detected when some token replaced exactly its value (type not
    compared); partial when not detected but a token value is a strict
    substring of it (the remainder leaks).
    """
    scored = F.transform(
        F.filter("entities", lambda e: ~e["ner_scope"]),
        lambda e: F.struct(e["ord"].alias("ord"), e["type"].alias("type"), e["value"].alias("value"),
                           e["expected_match"].alias("expected_match"),
                           _exact(F.col("tokens"), e["value"]).alias("detected"),
                           (~_exact(F.col("tokens"), e["value"]) & _partial_of(e["value"], F.col("tokens"))).alias("partial")))
    return (masked.select("case_id", "domain", "kind", "category", "source", "notes", F.inline(scored)))


def false_positives(masked: DataFrame) -> DataFrame:
    """tokens whose value equals no label (any scope) and is part of no longer label."""
    fp = F.filter("tokens", lambda t: ~F.exists("entities", lambda e: e["value"] == t["value"])
                  & ~F.exists("entities", lambda e: (F.instr(e["value"], t["value"]) > 0)
                              & (F.length(t["value"]) < F.length(e["value"]))))
    return masked.select("case_id", "domain", "category", "source", "notes",
                         F.explode(fp).alias("t")).select(
        "case_id", "domain", "category", "source", "notes",
        F.col("t.type").alias("type"), F.col("t.value").alias("value"))


def pct(num: Column, den: Column) -> Column:
    """round(100 * num / den, 1), null when den = 0."""
    return F.when(den > 0, F.round(F.lit(100.0) * num / den, 1))


def recall_by_type(scored: DataFrame) -> DataFrame:
    """G1."""
    return (scored.groupBy("type")
            .agg(F.count(F.lit(1)).alias("expected"), F.sum(F.col("detected").cast("int")).alias("found"))
            .withColumn("pct", pct(F.col("found"), F.col("expected"))))


def recall_breakdown(scored: DataFrame) -> DataFrame:
    """By source, by domain, by domain x source - one grouping-sets aggregate."""
    agg = (scored.groupingSets([["source"], ["domain"], ["domain", "source"]], "domain", "source")
           .agg(F.count(F.lit(1)).alias("expected"), F.sum(F.col("detected").cast("int")).alias("found"),
                F.grouping_id().alias("gid")))
    level = (F.when(F.col("gid") == 2, "source").when(F.col("gid") == 1, "domain").otherwise("domain/source"))
    return agg.select(level.alias("breakdown"), "domain", "source", "expected", "found",
                      pct(F.col("found"), F.col("expected")).alias("pct"))


def false_negatives(scored: DataFrame) -> DataFrame:
    """G3."""
    return scored.where(~F.col("detected")).select(
        "case_id", "domain", "category", "source", "type", "value", "expected_match",
        F.col("partial").alias("partially_matched"), "notes")


def fp_by_type(fps: DataFrame) -> DataFrame:
    """G5."""
    return fps.groupBy("type").agg(F.count(F.lit(1)).alias("fp"))


def precision_by_type(scored: DataFrame, fps: DataFrame) -> DataFrame:
    """Full outer join of true positives (recall found) and false positives by type."""
    tp = scored.groupBy("type").agg(F.sum(F.col("detected").cast("int")).alias("tp"))
    fp = fp_by_type(fps)
    j = tp.join(fp, "type", "full_outer")
    tpc, fpc = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    return j.select("type", tpc.alias("tp"), fpc.alias("fp"), pct(tpc, tpc + fpc).alias("pct"))


def gap_mismatches(scored: DataFrame) -> DataFrame:
    """Labels documented as not matchable that were detected anyway."""
    return scored.where((F.col("expected_match") == F.lit(False)) & F.col("detected")).select(
        "case_id", "type", "value", "notes")


def totals(masked: DataFrame) -> DataFrame:
    """G4 + G16 + headline: expected, found, pct, partial misses, NER-scope labels.

    Per-case counts from the two in-row arrays, then one global aggregate.
    """
    reg = F.filter("entities", lambda e: ~e["ner_scope"])
    found = F.filter(reg, lambda e: _exact(F.col("tokens"), e["value"]))
    part = F.filter(reg, lambda e: ~_exact(F.col("tokens"), e["value"]) & _partial_of(e["value"], F.col("tokens")))
    per = masked.select(F.size(reg).alias("e"), F.size(found).alias("f"), F.size(part).alias("p"),
                        F.size(F.filter("entities", lambda e: e["ner_scope"])).alias("n"))
    return (per.agg(F.sum("e").alias("expected"), F.sum("f").alias("found"), F.sum("p").alias("partial_misses"),
                    F.sum("n").alias("ner_scope_labels"))
            .withColumn("pct", pct(F.col("found"), F.col("expected"))))


# ------------------------------------------------------------------ NER side
@F.pandas_udf(T.StringType())
def nfc_lower(s: pd.Series) -> pd.Series:
    """lower(NFC(s)) - Spark has no Unicode normalization built in."""
    import unicodedata
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).lower())


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfc_lower_all(s: pd.Series) -> pd.Series:
    """Element-wise lower(NFC(x)) over an array column."""
    import unicodedata
    return s.map(lambda xs: None if xs is None else
                 [None if x is None else unicodedata.normalize("NFC", x).lower() for x in xs])


def ner_scored(corpus: DataFrame, ner_out: DataFrame, model: str | None = None) -> DataFrame:
    """F4/F5/G9/G10 per case: one row per (case, model) with arrays of results.

    ``ner_out``: ``case_id, model, status ('ok'|'error'), latency_ms, ents
    array<struct<type, value>>`` - one row per case and model, i.e. the model
    reply for one request (bounded by the reply size).
    """
    n = ner_out if model is None else ner_out.where(F.col("model") == model)
    cases = corpus.select("case_id", "domain", "kind", "source", "text",
                          F.filter("entities", lambda e: e["ner_scope"]).alias("expected"))
    j = n.join(cases, "case_id")   # one-to-one per case; both sides keyed by case
    # normalise once per row: text, expected values, returned values
    ents = F.coalesce("ents", F.array().cast("array<struct<type:string,value:string>>"))
    j = (j.withColumn("_text", nfc_lower(F.col("text")))
         .withColumn("_en", nfc_lower_all(F.transform("expected", lambda e: e["value"])))
         .withColumn("_rn", nfc_lower_all(F.transform(ents, lambda r: r["value"])))
         .withColumn("_exp", F.transform("expected", lambda e, i: F.struct(
             e["type"].alias("type"), e["value"].alias("value"), F.element_at("_en", i + 1).alias("norm"))))
         .withColumn("_ret", F.transform(ents, lambda r, i: F.struct(
             r["type"].alias("type"), r["value"].alias("value"), F.element_at("_rn", i + 1).alias("norm")))))
    ok = F.col("status") != "error"
    verbatim = F.filter("_ret", lambda r: r["value"].isNotNull() & (F.length(r["value"]) > 0)
                        & (F.instr(F.col("_text"), r["norm"]) > 0))

    def either(a, b):
        return (F.instr(a["norm"], b["norm"]) > 0) | (F.instr(b["norm"], a["norm"]) > 0)

    j = j.withColumn("_verb", F.when(ok, verbatim).otherwise(F.array().cast(
        "array<struct<type:string,value:string,norm:string>>")))
    found = F.filter("_exp", lambda x: ok & F.exists("_verb", lambda r: (r["type"] == x["type"]) & either(r, x)))
    missed = F.filter("_exp", lambda x: ~(ok & F.exists("_verb", lambda r: (r["type"] == x["type"]) & either(r, x))))
    fps = F.filter("_verb", lambda r: ~F.exists("_exp", lambda x: (x["type"] == r["type"]) & either(r, x)))
    untyped = F.filter("_exp", lambda x: ok & F.exists("_verb", lambda r: either(r, x)))
    return j.select(
        "case_id", "model", "domain", "kind", "source", "status", "latency_ms",
        F.size("expected").alias("expected_n"),
        F.when(ok, F.size("_ret")).otherwise(0).alias("returned_n"),
        F.size("_verb").alias("verbatim_n"),
        F.when(ok, F.size("_ret") - F.size("_verb")).otherwise(0).alias("paraphrased_n"),
        F.transform(found, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("found"),
        F.transform(missed, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("missed"),
        F.transform(fps, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("false_pos"),
        F.size(untyped).alias("found_untyped_n"))


def ner_recall(ns: DataFrame) -> DataFrame:
    """G8 + G9: recall overall (type NULL) and by type; error cases count as missed."""
    rows = ns.select(F.explode(F.concat(
        F.transform("found", lambda x: F.struct(x["type"].alias("type"), F.lit(1).alias("hit"))),
        F.transform("missed", lambda x: F.struct(x["type"].alias("type"), F.lit(0).alias("hit"))))).alias("r"))
    agg = (rows.rollup(F.col("r.type").alias("type"))
           .agg(F.count(F.lit(1)).alias("expected"), F.sum("r.hit").alias("found")))
    return agg.withColumn("pct", pct(F.col("found"), F.col("expected")))


def values_at(counts: DataFrame, value: str, count: str, ranks: list[int], bits: int = 12) -> list[int | None]:
    """The values at some ranks (from 0) of whole numbers given as (value, how often), by radix selection.

    Each round counts the values of one range by ``2 ** bits`` sub-ranges and goes on in the
    one that holds the rank: no sort, no window, and at most ``2 ** bits`` rows for the driver.
    """
    low, high = counts.where(F.col(count) > 0).agg(F.min(value), F.max(value)).first()
    out: list[int | None] = []
    for rank in ranks:
        if low is None or rank < 0:
            out.append(None)
            continue
        base, left, shift = low, rank, 0
        while (high - low) >> (shift + bits):
            shift += bits
        while shift >= 0:
            inside = counts.where((F.col(count) > 0) & (F.col(value) >= base) & (F.col(value) - base < F.lit(1 << (shift + bits))))
            part = F.shiftright(F.col(value).cast("long") - F.lit(base).cast("long"), shift)
            for digit, n in sorted(tuple(r) for r in inside.groupBy(part.alias("d")).agg(F.sum(count)).collect()):
                if left < n:
                    base += digit << shift
                    break
                left -= n
            shift -= bits
        out.append(base)
    return out


def ner_summary(ns: DataFrame) -> DataFrame:
    """G8/G10/G11/G12 headline in one aggregation chain (no joins).

    Latency percentiles follow the index rule sorted[min(n-1, floor(n*p))] over
    non-error cases, exactly and without a sort: rows are pre-aggregated by latency
    value, and ``values_at`` selects the ranks.
    """
    ok = F.col("status") != "error"
    by_lat = materialize(ns.groupBy(F.col("latency_ms").alias("v")).agg(
        F.count_if(ok & F.col("latency_ms").isNotNull()).alias("c_ok"),
        F.sum(F.when(ok, F.col("latency_ms"))).alias("lat_sum"),
        F.sum(F.size("found")).alias("found"),
        F.sum(F.size("found") + F.size("missed")).alias("expected"),
        F.sum("returned_n").alias("returned"), F.sum("verbatim_n").alias("verbatim"),
        F.sum("paraphrased_n").alias("paraphrased"), F.sum(F.size("false_pos")).alias("false_positives"),
        F.sum(F.when(F.col("expected_n") == 0, F.size("false_pos")).otherwise(0)).alias("fp_on_clean_cases"),
        F.count_if(~ok).alias("errors"), F.count(F.lit(1)).alias("cases")))
    n = by_lat.agg(F.sum("c_ok")).first()[0] or 0
    p50, p95 = values_at(by_lat, "v", "c_ok", [min(n - 1, math.floor(n * p)) for p in (0.5, 0.95)])
    sums = ["found", "expected", "returned", "verbatim", "paraphrased", "false_positives",
            "fp_on_clean_cases", "errors", "cases"]
    kind = by_lat.schema["v"].dataType
    out = by_lat.agg(*[F.sum(c).alias(c) for c in sums],
                     F.round(F.sum("lat_sum") / F.sum("c_ok")).cast("long").alias("avg_latency_ms"),
                     F.lit(p50).cast(kind).alias("p50_ms"), F.lit(p95).cast(kind).alias("p95_ms"))
    return out.withColumn("pct", pct(F.col("found"), F.col("expected")))


def combined_recall(regex_totals: DataFrame, ner_sum: DataFrame, regex_scope_labels: DataFrame) -> DataFrame:
    """Regex + NER only when both scored the same ground truth, else a reason.

    The three one-row inputs are unioned and collapsed with ``max`` (no join).
    """
    cols = ["regex_found", "regex_expected", "ner_found", "ner_expected", "labels_now"]

    def row(df, mapping):
        return df.select(*[(F.col(mapping[c]) if c in mapping else F.lit(None)).cast("long").alias(c) for c in cols])

    u = (row(regex_totals, {"regex_found": "found", "regex_expected": "expected"})
         .unionByName(row(ner_sum, {"ner_found": "found", "ner_expected": "expected"}))
         .unionByName(row(regex_scope_labels, {"labels_now": "n"})))
    j = u.agg(*[F.max(c).alias(c) for c in cols])
    same = F.col("regex_expected") == F.col("labels_now")
    return j.select(
        "regex_found", "regex_expected", "ner_found", "ner_expected",
        F.when(same, F.col("regex_found") + F.col("ner_found")).alias("combined_found"),
        F.when(same, F.col("regex_expected") + F.col("ner_expected")).alias("combined_expected"),
        F.when(same, pct(F.col("regex_found") + F.col("ner_found"),
                         F.col("regex_expected") + F.col("ner_expected"))).alias("combined_pct"),
        F.when(~same, F.concat(F.lit("regex run scored "), F.col("regex_expected").cast("string"),
                               F.lit(" labels but the corpus has "), F.col("labels_now").cast("string")))
        .alias("skip_reason"))


def model_comparison(ns: DataFrame) -> DataFrame:
    """G14 per model: untyped recall (F7), paraphrased, errors, mean latency of non-error cases."""
    ok = F.col("status") != "error"
    return (ns.groupBy("model").agg(
        F.sum(F.when(ok, F.col("found_untyped_n")).otherwise(0)).alias("found"),
        F.sum(F.when(ok, F.col("expected_n")).otherwise(0)).alias("expected"),
        F.sum("paraphrased_n").alias("paraphrased"),
        F.count_if(~ok).alias("errors"),
        F.round(F.avg(F.when(ok, F.col("latency_ms")))).cast("long").alias("avg_latency_ms"))
        .withColumn("pct", pct(F.col("found"), F.col("expected"))))
