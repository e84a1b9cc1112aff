"""Named-entity step around an external model.

The model itself is not run here: its replies (or entities) are an input
DataFrame. These operators parse replies, keep verbatim survivors, skip texts
with a recent clean verdict, gate by tier and merge with the regex layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions.patterns import NER_TYPES

ENTITY_ARRAY = "array<struct<type:string,value:string>>"
_REPLY_SCHEMA = f"struct<entities:{ENTITY_ARRAY}>"
PAID_TIERS = ("pro", "enterprise")


def parse_reply(reply: Column) -> Column:
    """First ``{`` .. last ``}`` (greedy) parsed as JSON.

    Returns ``struct<ok boolean, entities array>``: no braces at all parses as
    ``{}`` (ok, no entities); malformed JSON is not ok (error); a non-array
    ``entities`` yields an empty list.
    """
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    js = F.when(body == "", F.lit("{}")).otherwise(body)
    parsed = F.from_json(js, _REPLY_SCHEMA, {"mode": "PERMISSIVE"})
    valid = F.get_json_object(js, "$").isNotNull()
    ents = F.coalesce(parsed["entities"], F.array().cast(ENTITY_ARRAY))
    return F.struct(valid.alias("ok"), F.when(valid, ents).otherwise(F.array().cast(ENTITY_ARRAY)).alias("entities"))


def verbatim(entities: Column, text: Column) -> Column:
    """C4: keep entities with a type and a non-empty value found (case-insensitively) in the text."""
    low = F.lower(text)
    return F.filter(entities, lambda e: e["type"].isNotNull() & (F.length(e["type"]) > 0)
                    & e["value"].isNotNull() & (F.length(e["value"]) > 0)
                    & (F.instr(low, F.lower(e["value"])) > 0))


def ner_verdicts(replies: DataFrame, text_col: str = "text", reply_col: str = "reply") -> DataFrame:
    """C3 + C4 per text: ``ner_status`` (found / clean / error) and verbatim ``ner_entities``."""
    p = parse_reply(F.col(reply_col))
    ents = verbatim(p["entities"], F.col(text_col))
    status = (F.when(F.col(reply_col).isNull() | ~p["ok"], "error")
              .when(F.size(ents) > 0, "found").otherwise("clean"))
    return replies.withColumn("ner_entities", F.when(status == "error", F.array().cast(ENTITY_ARRAY)).otherwise(ents)) \
                  .withColumn("ner_status", status)


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def needs_ner(texts: DataFrame, cache: DataFrame, as_of: Column, ttl_seconds: int = 3600,
              text_col: str = "text") -> DataFrame:
    """Texts without a clean verdict younger than ``ttl`` - one row per distinct text.

    Deduplicate by hash first so each distinct text is scored once, then anti
    join the fresh cache entries (``hash, cached_at``).
    """
    h = texts.select(text_hash(F.col(text_col)).alias("hash"), F.col(text_col).alias("text")) \
             .dropDuplicates(["hash"])
    fresh = cache.where(F.col("cached_at") > as_of - F.expr(f"INTERVAL {ttl_seconds} SECONDS")).select("hash")
    return h.join(fresh, "hash", "left_anti")


def cache_updates(verdicts: DataFrame, as_of: Column, text_col: str = "text") -> DataFrame:
    """Only clean, non-error verdicts are cached (never positives, never errors)."""
    return (verdicts.where(F.col("ner_status") == "clean")
            .select(text_hash(F.col(text_col)).alias("hash"), as_of.alias("cached_at"))
            .dropDuplicates(["hash"]))


def ner_ran(tier: Column) -> Column:
    """NER runs for paid tiers only."""
    return tier.isin(*PAID_TIERS)


def gated_status(tier: Column, status: Column) -> Column:
    """``not_run`` for unpaid tiers - never collapsed into 'clean'."""
    return F.when(~ner_ran(tier), F.lit("not_run")).otherwise(status)


def merge_types(regex_types: Column, ner_entities: Column, has_secret: Column) -> Column:
    """Distinct regex types then NER types (first-seen order), plus SECRET."""
    base = F.array_distinct(F.concat(regex_types, F.transform(ner_entities, lambda e: e["type"])))
    return F.when(has_secret, F.concat(base, F.array(F.lit("SECRET")))).otherwise(base)


def merge_matches(regex_matches: Column, ner_entities: Column) -> Column:
    """Regex matches + NER entity count."""
    return regex_matches + F.size(ner_entities)


def fail_closed(status: Column, strategy: Column) -> Column:
    """An errored NER under the anonymize strategy blocks the request."""
    return (status == "error") & (strategy == "anonymize")


def add_ner_error(types: Column) -> Column:
    """Add NER_ERROR (once) to the reported types."""
    return F.array_distinct(F.concat(types, F.array(F.lit("NER_ERROR"))))


__all__ = ["NER_TYPES", "parse_reply", "verbatim", "ner_verdicts", "needs_ner", "cache_updates",
           "ner_ran", "gated_status", "merge_types", "merge_matches", "fail_closed", "add_ner_error"]
