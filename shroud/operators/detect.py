"""Detection operators.

* :func:`pii_spans` (C1 candidates + overlap fold) - one Arrow pass, no shuffle.
* :func:`detect_pii` (C1 verdict) - per row ``detected / matches / types``.
* :func:`detect_secrets` (C2) - fully native ``rlike``; stays in codegen.
* :func:`pii_type_counts` (flagship) - which personal data is in a corpus.
* :func:`detect_report` (C9) - per request types, counts, secrets, masked text, NER flags.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions import kernel
from shroud.operators import mask as MK
from shroud.operators import ner as NR
from shroud.functions.patterns import from_rows, secret_patterns

#: Every text is searched for every pattern, so a catalogue is small; more rows than this are an error.
MOST_PATTERNS = 1000

SPAN_FIELDS = [
    T.StructField("rank", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("value", T.StringType()),
]

VERDICT = T.StructType([
    T.StructField("detected", T.BooleanType()),
    T.StructField("matches", T.IntegerType()),
    T.StructField("types", T.ArrayType(T.StringType())),
])


def pii_spans(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("doc_id",), patterns: DataFrame | None = None) -> DataFrame:
    """Accepted C1 spans, one row per span: ``keys + (rank, type, start, end, value)``.

    ``patterns``: a catalogue as a table (``functions.patterns.ROWS``), at most ``MOST_PATTERNS``
    rows; a rule that can't be compiled is an error here, not in a task. Default: the library's.

    Runs as ``mapInArrow`` over the input partitions: no shuffle, text never
    leaves its partition, only spans (small) come out.
    """
    keys = list(keys)
    src = df.select(*keys, text_col)
    rules = None
    if patterns is not None:
        rules = from_rows(patterns.limit(MOST_PATTERNS + 1).collect())
        if len(rules) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} patterns")
        kernel.compiled(rules)
    out_schema = T.StructType([src.schema[k] for k in keys] + SPAN_FIELDS)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            spans = [(i, *span) for i, text in enumerate(texts) for span in kernel.pii_spans(text, rules)]
            # Typed arrays, so that a batch without a finding has the same schema as any other.
            row, rank, kind, start, end, value = zip(*spans, strict=True) if spans else ((),) * 6
            held = [batch.column(k).take(pa.array(row, pa.int32())) for k in keys]
            found = [pa.array(rank, pa.int32()), pa.array(kind, pa.string()), pa.array(start, pa.int32()),
                     pa.array(end, pa.int32()), pa.array(value, pa.string())]
            yield pa.RecordBatch.from_arrays(held + found, names=[*keys, "rank", "type", "start", "end", "value"])

    return src.mapInArrow(run, out_schema)


@F.arrow_udf(VERDICT)
def _verdict(texts: pa.Array) -> pa.Array:
    det, cnt, types, ends = [], [], [], [0]
    for text in texts.to_pylist():
        spans = kernel.pii_spans(text)
        last = None
        for r, t, *_ in spans:          # spans come grouped by pattern rank
            if r != last:
                types.append(t)
                last = r
        det.append(bool(spans))
        cnt.append(len(spans))
        ends.append(len(types))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(types, pa.string()))
    return pa.StructArray.from_arrays([pa.array(det, pa.bool_()), pa.array(cnt, pa.int32()), lists], ["detected", "matches", "types"])


def detect_pii(text: Column | str) -> Column:
    """C1 verdict column ``struct<detected, matches, types>`` (types in pattern order)."""
    return _verdict(F.col(text) if isinstance(text, str) else text)


def _may_hold(source: str, c: Column) -> Column:
    """Whether a text holds what every match of a secret's pattern needs: cheaper than the pattern, which is tried at every place."""
    for part, word in (("AKIA", "AKIA"), ("\\/\\/", "://"), ("eyJ", "eyJ"), ("sk-", "sk-")):
        if part in source:
            return c.contains(word)
    low = F.lower(c)
    return (c.contains("=") | c.contains(":")) & (low.contains("secret") | low.contains("key") | low.contains("token"))


def secret_types(text: Column | str) -> Column:
    """Secret types present, first-seen (catalogue) order, no counts. Native."""
    c = F.col(text) if isinstance(text, str) else text
    hits = [F.when(_may_hold(p.source, c) & c.rlike(p.java), F.lit(p.type)) for p in secret_patterns()]
    return F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def detect_secrets(text: Column | str) -> Column:
    """C2 verdict ``struct<detected, types>``."""
    types = secret_types(text)
    return F.struct((F.size(types) > 0).alias("detected"), types.alias("types"))


def pii_type_counts(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Flagship: per detector type, how many documents and matches.

    Partial aggregation happens map-side right after the scan; only one row per
    (partition, type, doc) is shuffled.
    """
    spans = pii_spans(docs, text_col, [key])
    return (spans.groupBy("type")
            .agg(F.countDistinct(key).alias("docs"), F.count(F.lit(1)).alias("matches")))


def detect_report(requests: DataFrame, key: str = "request_id", text_col: str = "text", tier_col: str = "kp_tier", dealt: bool = False) -> DataFrame:
    """What was found in each request, without sending it anywhere.

    Needs ``ner_status`` and ``ner_entities`` (the model's verbatim entities), used for paid
    tiers only. Types and counts come from the masking tokens. ``ner_error`` tells that the
    model failed, so that no entities must not be read as a clean text. No shuffle: one
    masking pass, the rest is column logic on its rows. ``dealt`` as in ``mask_texts``.
    """
    ran = F.coalesce(NR.ner_ran(F.col(tier_col)), F.lit(False))
    error = ran & (F.coalesce("ner_status", F.lit("clean")) == "error")
    none = F.array().cast(NR.ENTITY_ARRAY)
    src = requests.select(
        F.col(key), F.col(text_col), ran.alias("ner_ran"), error.alias("ner_error"),
        (F.size(secret_types(text_col)) > 0).alias("has_secret"),
        F.when(ran & ~error, F.coalesce("ner_entities", none)).otherwise(none).alias("_ner"))
    m = MK.mask_texts(src, text_col, [key, "ner_ran", "ner_error", "has_secret"], "_ner", dealt=dealt)
    kinds = F.array_sort(F.array_distinct(F.transform("tokens", lambda t: t["type"])))
    return m.select(key, F.array_join(kinds, ",").alias("pii_types"), MK.type_counts_text(F.col("tokens")).alias("pii_type_counts"),
                    F.size("tokens").cast("long").alias("pii_count"), "has_secret", F.col("masked").alias("sanitized"),
                    "ner_ran", "ner_error")
