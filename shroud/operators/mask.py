"""Redaction and restoration.

Masking a conversation has one ordering dependency: token numbers are shared
by all messages of the conversation (``[EMAIL_3]`` in turn 2 follows two
emails in turn 0-1). We never gather a conversation in one place for that:

1. every message is masked on its own in an Arrow pass with *local* numbers
   (no shuffle; text stays in its partition);
2. per (conversation, turn, type) token counts - a few bytes per message -
   get an exclusive running total over turns (two-level, skew-safe);
3. only messages that produced tokens are joined to their offsets and have
   their own tokens renumbered.

Result: the same text and numbering as masking the whole request in order,
with work bounded per message (see README "numbering" for the two edge cases).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions import kernel
from shroud.functions.windows import exclusive_running_total, spread
from shroud.session import materialize

TOKEN = T.StructType([
    T.StructField("ord", T.IntegerType()),     # creation order within the text / conversation
    T.StructField("type", T.StringType()),
    T.StructField("n", T.IntegerType()),       # number in [TYPE_n]
    T.StructField("token", T.StringType()),
    T.StructField("value", T.StringType()),    # replaced substring (may hold earlier tokens)
])
TOKENS = T.ArrayType(TOKEN)
TOKEN_REGEX = r"\[([A-Z_]+)_(\d+)\]"


_TOKEN_ARROW = [pa.field("ord", pa.int32()), pa.field("type", pa.string()), pa.field("n", pa.int32()), pa.field("token", pa.string()), pa.field("value", pa.string())]
ROWS_AT_ONCE = 1000          # of a batch, so that a task's Python memory doesn't grow with the batches


def _mask_batches(keys: list[str], text_col: str, ner_col: str | None, verdict: bool = False):
    """Key columns stay Arrow; only texts (and model entities) become Python values, so many rows at once."""
    def columns(part):
        masked, coll, offsets, tokens = [], [], [0], []
        texts = part.column(text_col).to_pylist()
        ners = part.column(ner_col).to_pylist() if ner_col else [None] * len(texts)
        for text, ner in zip(texts, ners, strict=True):
            ents = [(e["type"], e["value"]) for e in ner] if ner is not None else None
            m, found = kernel.mask_text(text, ents)
            masked.append(m)
            tokens += [(i + 1, t, n, f"[{t}_{n}]", v) for i, (t, n, v) in enumerate(found)]
            offsets.append(len(tokens))
            coll.append(bool(text) and kernel.TOKEN_RE.search(text) is not None)
        fields = zip(*tokens, strict=True) if tokens else ((),) * len(_TOKEN_ARROW)
        rows = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, _TOKEN_ARROW, strict=True)], fields=_TOKEN_ARROW)
        yield from (part.column(k) for k in keys)
        yield from (pa.array(masked, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(coll, pa.bool_()))
        if verdict:
            spans = [kernel.pii_spans(text) for text in texts]
            yield pa.array([len(s) for s in spans], pa.int64())
            yield pa.array([list(dict.fromkeys(t for _, t, *_ in s)) for s in spans], pa.list_(pa.string()))

    names = [*keys, "masked", "tokens", "token_collision", *(["matches", "types"] if verdict else [])]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays(list(columns(batch.slice(at, ROWS_AT_ONCE))), names=names)
    return run


def mask_texts(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("doc_id",),
               ner_col: str | None = None, verdict: bool = False, dealt: bool = False) -> DataFrame:
    """D1 on independent texts (documents): ``keys, masked, tokens, token_collision``.

    Each row is its own request, so local numbering is final. No shuffle except
    :func:`spread` when the scan has fewer partitions than cores; ``dealt``: the caller has
    dealt the rows out already (counting the partitions of a join would run it). With ``verdict``
    the same pass also gives the C1 ``matches`` and distinct ``types``.
    """
    keys = list(keys)
    cols = keys + [text_col] + ([ner_col] if ner_col else [])
    src = df.select(*cols) if dealt else spread(df.select(*cols))
    schema = T.StructType([src.schema[k] for k in keys] + [
        T.StructField("masked", T.StringType()),
        T.StructField("tokens", TOKENS),
        T.StructField("token_collision", T.BooleanType()),
    ] + ([T.StructField("matches", T.LongType()), T.StructField("types", T.ArrayType(T.StringType()))] if verdict else []))
    return src.mapInArrow(_mask_batches(keys, text_col, ner_col, verdict), schema)


def _renumber_batches(keys: list[str]):
    def run(batches):
        for pdf in batches:
            masked, toks = [], []
            for text, tokens, offs, cnts, ord_off in zip(
                    pdf["masked"].tolist(), pdf["tokens"].tolist(), pdf["offsets"].tolist(),
                    pdf["counts"].tolist(), pdf["ord_off"].tolist()):
                offs = dict(offs or {})
                cnts = dict(cnts or {})

                def sub(m, offs=offs, cnts=cnts):
                    t, k = m.group(1), int(m.group(2))
                    if t in cnts and 1 <= k <= cnts[t]:
                        return f"[{t}_{k + offs.get(t, 0)}]"
                    return m.group(0)

                masked.append(kernel.TOKEN_RE.sub(sub, text) if text else text)
                new = []
                for tk in tokens:
                    n = int(tk["n"]) + int(offs.get(tk["type"], 0))
                    v = tk["value"]
                    if v and "[" in v:
                        v = kernel.TOKEN_RE.sub(sub, v)
                    new.append({"ord": int(tk["ord"]) + int(ord_off), "type": tk["type"], "n": n,
                                "token": f"[{tk['type']}_{n}]", "value": v})
                toks.append(new)
            out = pdf[keys].copy()
            out["masked"] = masked
            out["tokens"] = toks
            out["token_collision"] = pdf["token_collision"]
            yield out
    return run


def anonymize(messages: DataFrame, ner: DataFrame | None = None, conv: str = "conv_id",
              turn: str = "turn", text_col: str = "text", extra: Sequence[str] = ("role",)) -> DataFrame:
    """D1 + D2 over message rows: conversation-wide ``[TYPE_n]`` numbering.

    ``ner`` (optional) holds ``conv, ord, type, value`` rows already filtered to
    verbatim survivors (C4); they are applied to every message of their
    conversation in ``ord`` order. Output: ``conv, turn, extra..., masked,
    tokens, token_collision`` where ``tokens.ord`` is the conversation-wide
    creation order and ``tokens.n`` the conversation-wide number.
    """
    keys = [conv, turn, *extra]
    msgs = messages.select(*keys, text_col)
    ner_col = None
    if ner is not None:
        # one short list per conversation: bounded by what the model returns for one request
        lists = (ner.where(F.col("value").isNotNull() & (F.length("value") > 0))
                 .groupBy(conv)
                 .agg(F.sort_array(F.collect_list(F.struct("ord", "type", "value"))).alias("_ner")))
        msgs = msgs.join(lists, conv, "left")
        ner_col = "_ner"
    local = materialize(mask_texts(msgs, text_col, keys, ner_col))   # read three times; survives lost executors

    per = (local.where(F.size("tokens") > 0)
           .select(conv, turn, F.explode("tokens").alias("t"))
           .groupBy(conv, turn, F.col("t.type").alias("type"))
           .agg(F.count(F.lit(1)).alias("cnt")))
    per = exclusive_running_total(per, [conv, "type"], turn, "cnt", "off")
    msg_tot = (per.groupBy(conv, turn)
               .agg(F.sum("cnt").alias("n_tok"),
                    F.map_from_entries(F.collect_list(F.struct("type", "off"))).alias("offsets"),
                    F.map_from_entries(F.collect_list(F.struct("type", "cnt"))).alias("counts")))
    msg_tot = exclusive_running_total(msg_tot, [conv], turn, "n_tok", "ord_off")

    with_tok = local.where(F.size("tokens") > 0).join(msg_tot.drop("n_tok"), [conv, turn])
    schema = local.schema
    renum = with_tok.mapInPandas(_renumber_batches(keys), schema)
    return local.where(F.size("tokens") == 0).unionByName(renum)


def token_map(masked: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """``keys, token_ord, token, type, n, value`` in creation order."""
    return (masked.select(*keys, F.explode("tokens").alias("t"))
            .select(*keys, F.col("t.ord").alias("token_ord"), F.col("t.token").alias("token"),
                    F.col("t.type").alias("type"), F.col("t.n").alias("n"), F.col("t.value").alias("value")))


def token_type_counts(masked: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Tokens per (keys, type), from the token map (not by parsing text)."""
    return (masked.select(*keys, F.explode("tokens.type").alias("type"))
            .groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("tokens")))


def restore(responses: DataFrame, tmap: DataFrame, key: str = "conv_id", resp_key: str = "resp_id",
            text_col: str = "text") -> DataFrame:
    """Put originals back into response text.

    Only the tokens a response actually contains are looked up: the response's
    tokens are extracted, equi-joined to the token map, gathered per response
    (bounded by that response's own length) and applied newest-first. A value can
    hold earlier tokens (a secret inside a DB URI); they are looked up in turn, as
    deep as they go: a nested token is always older, so this ends.
    """
    tokens = F.regexp_extract_all(text_col, F.lit(TOKEN_REGEX), 0)
    wanted = responses.select(resp_key, key, F.explode(F.array_distinct(tokens)).alias("token"))
    lookup = tmap.select(key, "token", "token_ord", "value")
    found = last = materialize(wanted.join(lookup, [key, "token"]))
    while True:
        inner = last.where(F.col("value").rlike(TOKEN_REGEX)).select(
            resp_key, key, F.explode(F.regexp_extract_all("value", F.lit(TOKEN_REGEX), 0)).alias("token")).distinct()
        if inner.isEmpty():
            break
        last = materialize(inner.join(lookup, [key, "token"]).join(found.select(resp_key, "token"), [resp_key, "token"], "left_anti"))
        found = found.unionByName(last)
    entries = (found.dropDuplicates([resp_key, "token"])
               .groupBy(resp_key)
               .agg(F.sort_array(F.collect_list(F.struct("token_ord", "token", "value")), asc=False).alias("_e")))
    out = responses.join(entries, resp_key, "left")
    restored = F.aggregate(F.coalesce(F.col("_e"), F.array().cast("array<struct<token_ord:int,token:string,value:string>>")),
                           F.col(text_col), lambda acc, e: F.replace(acc, e["token"], e["value"]))
    return out.withColumn("restored", restored).drop("_e")


def type_counts_text(tokens: Column) -> Column:
    """G15 per row: ``TYPE:count`` of a row's tokens, by type, joined by commas."""
    kinds = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: t["type"])))
    return F.array_join(F.transform(kinds, lambda k: F.concat_ws(
        ":", k, F.size(F.filter(tokens, lambda t: t["type"] == k)).cast("string"))), ",")


def leak_rows(masked: DataFrame, keys: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """Tokens whose original value still appears in the sanitized text (should be empty)."""
    t = masked.select(*keys, "masked", F.explode("tokens").alias("t"))
    return (t.where(F.instr("masked", F.col("t.value")) > 0)
            .select(*keys, F.col("t.type").alias("type"), F.col("t.value").alias("value")))


def restore_choices(responses: DataFrame, tmap: DataFrame, key: str = "conv_id", resp_key: str = "resp_id",
                    choices_col: str = "choices") -> DataFrame:
    """Restore every choice's content; choices without content stay untouched.

    Choices are exploded with their position, restored with :func:`restore`,
    and gathered back per response (bounded by that response's choices).
    """
    ch = responses.select(resp_key, key, F.posexplode(choices_col).alias("_pos", "_c"))
    ch = ch.select(resp_key, key, "_pos", "_c", F.concat_ws("#", F.col(resp_key), F.col("_pos")).alias("_cid"),
                   F.col("_c.message.content").alias("text"))
    r = restore(ch, tmap, key=key, resp_key="_cid")
    fixed = F.when(F.col("_c.message.content").isNull(), F.col("_c")).otherwise(
        F.col("_c").withField("message.content", F.col("restored")))
    back = (r.select(resp_key, "_pos", fixed.alias("_c"))
            .groupBy(resp_key).agg(F.sort_array(F.collect_list(F.struct("_pos", "_c"))).alias("_l")))
    out = back.select(resp_key, F.transform("_l", lambda x: x["_c"]).alias(choices_col))
    return responses.drop(choices_col).join(out, resp_key, "left")
