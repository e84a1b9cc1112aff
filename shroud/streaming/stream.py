"""Structured Streaming versions of the per-request work.

The batch column logic is reused as is; only the parts that depend on
arrival order keep state:

* H1 ``detect_stream``       - stateless masking per message row (``mapInPandas``);
* H2 ``conversation_mask_stream`` - token counters continue across turns as they
  arrive (``applyInPandasWithState`` keyed by conversation; state = counters, removed
  when the conversation has been idle for long);
* H3 ``rate_limit_stream``   - per (user, UTC day) quota in arrival order; state =
  the counts of the user's last days; rows of days that are closed for the user are
  labelled ``late``, never dropped (so no watermark is used);
* H4 ``clean_cache_stream``  - drop texts already seen clean within the hour (what the cache
  stores); ``clean_cache_skips`` - which requests the cache answers and which are asked;
* H5 ``usage_windows``       - tumbling event-time windows with a watermark;
* H6 ``reassemble_stream``   - buffer response chunks, in whatever order they arrive,
  until all are there, so a token cut across chunks is restored whole; ``piece_stream`` -
  give out what has come so far, but for a token that is still open.

Results go to Parquet in the cluster's shared folder, a folder per micro-batch.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from shroud.functions import kernel
from shroud.operators import mask as MK
from shroud.operators import ner as N
from shroud.session import ensure_checkpoint_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A driver table (one parquet file) as a file stream source."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path[:-1] + "*"))  # glob: the stream source needs a directory or a pattern


def new_run(spark: SparkSession, name: str) -> str:
    """A folder for a stream's state and rows in the cluster's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, keys: list[str] | None = None, base: str | None = None) -> DataFrame:
    """Run ``stream`` over everything available now; return what it wrote.

    Each micro-batch overwrites its own folder, so one that is run again after a failure
    leaves no second copy. With ``keys`` the stream runs in update mode and the last
    row written for each key counts. ``base`` (see ``new_run``) goes on with an earlier run:
    its state, and the rows it wrote.
    """
    spark = stream.sparkSession
    base = base or new_run(spark, name)
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{base}/rows/batch=-1")    # there may be no batch at all

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    # Batches without rows would follow for ever, looking for keys whose time is over.
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        q = (stream.writeStream.foreachBatch(write).outputMode("update" if keys else "append")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/rows")
    if not keys:
        return out.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*").select(*stream.columns)


# ------------------------------------------------------------------ many keys with little state
BUCKETS = 2048               # groups that the keys of a stream share
_BUCKET_STATE = T.StructType([T.StructField("held", T.StringType())])


def _bucket_factory(key: str, take, gone, idle_ms: int):
    def run(_, frames, state):
        now = state.getCurrentProcessingTimeMs()
        entries = json.loads(state.get[0]) if state.exists else []
        held, seen = {k: v for k, _, v in entries}, {k: t for k, t, _ in entries}
        if not state.hasTimedOut:
            frame = pd.concat(list(frames), ignore_index=True)
            yield from take(frame, held)
            seen.update(dict.fromkeys(frame[key].tolist(), now))
        for k in [k for k, t in seen.items() if t + idle_ms <= now]:
            del seen[k]
            yield from gone(k, held.pop(k))
        if not held:
            state.remove()
            return
        state.update((json.dumps([[k, seen[k], v] for k, v in held.items()]),))
        state.setTimeoutDuration(max(min(seen.values()) + idle_ms - now, 1))
    return run


def by_bucket(rows: DataFrame, key: str, schema: T.StructType, take, gone, idle_ms: int) -> DataFrame:
    """State by ``key`` where keys are many and their states small.

    A call of ``applyInPandasWithState`` costs milliseconds, however few rows its group has,
    so keys share ``BUCKETS`` groups by their hash. ``take(frame, held)`` gets a micro-batch's rows
    of one group and what is held of each key (plain lists and dicts), brings that up to date
    and gives frames out; it must leave an entry for each of the frame's keys. A key without rows
    for ``idle_ms`` is left out of ``held``; ``gone(key, entry)`` gives out what it still owes.
    """
    return (rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket")
            .applyInPandasWithState(_bucket_factory(key, take, gone, idle_ms), schema, _BUCKET_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout))


def _whole(values) -> pd.Series:
    """Whole numbers or None, without a detour over floats."""
    return pd.array(values, "Int64")


# ------------------------------------------------------------------ H1
def detect_stream(messages: DataFrame, keys=("conv_id", "turn"), text_col: str = "text") -> DataFrame:
    """H1: per-row masking on a stream (numbering per row)."""
    return MK.mask_texts(messages, text_col, list(keys))


# ------------------------------------------------------------------ H2
_H2_OUT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("masked", T.StringType()), T.StructField("tokens", MK.TOKENS),
])
_H2_STATE = T.StructType([T.StructField("counters", T.StringType()), T.StructField("next_ord", T.LongType())])
IDLE_MS = 7 * 86_400_000     # state of a key without new rows is kept so long


def _h2(key, pdfs, state):
    if state.hasTimedOut:
        state.remove()
        return
    counters, next_ord = {}, 0
    if state.exists:
        c, next_ord = state.get
        counters = json.loads(c)
    out = []
    for pdf in pdfs:
        for turn, text in sorted(zip(pdf["turn"].tolist(), pdf["text"].tolist()), key=lambda x: x[0]):
            masked, toks = kernel.mask_text(text, None, counters)
            rows = []
            for t, n, v in toks:
                next_ord += 1
                rows.append({"ord": next_ord, "type": t, "n": n, "token": f"[{t}_{n}]", "value": v})
            out.append({"conv_id": key[0], "turn": turn, "masked": masked, "tokens": rows})
    state.update((json.dumps(counters), next_ord))
    state.setTimeoutDuration(IDLE_MS)
    if out:
        yield pd.DataFrame(out)


def conversation_mask_stream(messages: DataFrame) -> DataFrame:
    """H2: conversation-wide ``[TYPE_n]`` numbering that continues as turns arrive.

    A conversation that goes on after a week without turns starts its numbers again.
    """
    return (messages.select("conv_id", "turn", "text").groupBy("conv_id")
            .applyInPandasWithState(_h2, _H2_OUT, _H2_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout))


# ------------------------------------------------------------------ H3
def rate_limit_stream(authorized: DataFrame, limits: dict, grace: int = 1) -> DataFrame:
    """H3: E3 on a stream of authorized requests (``request_id, ts, kp_user_id, kp_tier``).

    A request counts for its user's UTC day, whatever the tier; the tier it came with
    sets the limit. Days more than ``grace`` before the user's newest day in an earlier
    micro-batch are closed: their requests are ``late``, without a number and not
    allowed. Rows without a user or time are not authorized requests and must be filtered before.
    """
    rows = authorized.select("request_id", "ts", "kp_user_id", "kp_tier", F.lit(None).cast("int").alias("kp_edge_limit"), F.lit(False).alias("wants_edge"))
    return quota_stream(rows, limits, {"free": 0}, 0, grace).select("request_id", "user_id", "rl_seq", "rl_allowed", "late")


_QUOTA_OUT = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("user_id", T.StringType()),
    T.StructField("rl_seq", T.LongType()), T.StructField("rl_allowed", T.BooleanType()),
    T.StructField("edge_seq", T.LongType()), T.StructField("edge_allowed", T.BooleanType()), T.StructField("late", T.BooleanType()),
])
DAY_MICROS = 86_400_000_000
NO_TIME = -(1 << 62)          # rows without a time are a day of their own, before all others


def count_quota(at, limit, wants, edge_limit, counts: dict[int, list[int]], grace: int):
    """Numbers of a user's requests in time order: (rl_seq, edge_seq, late), 0 where there is none.

    ``counts`` holds requests and edge requests by day and is brought up to date. Only a
    request that the daily limit lets pass and that wants the edge path takes a number there.
    """
    day = at // DAY_MICROS
    oldest = max(counts) - grace if counts else None
    late = day < oldest if oldest is not None else np.zeros(len(at), bool)
    seq, edge = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for d in np.unique(day[~late]).tolist():
        mine = np.flatnonzero((day == d) & ~late)
        n, e = counts.get(d, [0, 0])
        seq[mine] = n + 1 + np.arange(len(mine))
        to_edge = mine[(seq[mine] <= limit[mine]) & wants[mine]]
        edge[to_edge] = e + 1 + np.arange(len(to_edge))
        counts[d] = [n + len(mine), e + len(to_edge)]
    for d in [d for d in counts if d < max(counts) - grace]:
        del counts[d]
    return seq, edge, late


def _quota_factory(grace: int):
    names = ["request_id", "no_id", "at", "daily_limit", "edge_limit", "wants_edge"]

    def take(frame, held):
        who, users = pd.factorize(frame["user_id"], use_na_sentinel=False)
        users = np.array([None if pd.isna(u) else u for u in users], object)
        ids, no_id, at, limit, edge_limit, wants = (frame[c].to_numpy() for c in names)
        order = np.lexsort((ids, at, who))
        who, ids, no_id, at, limit, edge_limit, wants = (x[order] for x in (who, ids, no_id, at, limit, edge_limit, wants.astype(bool)))
        ends = np.searchsorted(who, np.arange(len(users)), "right")
        parts = []
        for user, a, b in zip(users, [0, *ends[:-1]], ends, strict=True):
            counts = {d: [n, e] for d, n, e in held.get(user, [])}
            parts.append(count_quota(at[a:b], limit[a:b], wants[a:b], edge_limit[a:b], counts, grace))
            held[user] = [[d, n, e] for d, (n, e) in counts.items()]
        seq, edge, late = (np.concatenate(p) for p in zip(*parts, strict=True))
        for a in range(0, len(ids), 10_000):
            b = slice(a, a + 10_000)
            on_edge = edge[b] > 0
            yield pd.DataFrame({"request_id": pd.Series(ids[b], dtype="Int64").mask(no_id[b].astype(bool)), "user_id": users[who[b]], "rl_seq": pd.array(seq[b], "Int64"), "rl_allowed": ~late[b] & (seq[b] <= limit[b]),
                                "edge_seq": pd.array(edge[b], "Int64"), "edge_allowed": pd.array(edge[b] <= edge_limit[b], "boolean"), "late": late[b]}).assign(
                rl_seq=lambda x: x["rl_seq"].mask(x["late"]), edge_seq=lambda x: x["edge_seq"].mask(~on_edge), edge_allowed=lambda x: x["edge_allowed"].mask(~on_edge))
    return take


def quota_stream(requests: DataFrame, daily: dict, edge: dict, edge_fallback: int, grace: int = 1) -> DataFrame:
    """H3 with E4: both counters of a user's day in one state.

    ``requests``: request_id, ts, kp_user_id, kp_tier, kp_edge_limit, wants_edge (whether the
    request takes the edge path if the quota lets it pass). ``edge_seq`` and
    ``edge_allowed`` are null for requests that don't reach the edge. Late rows as in
    ``rate_limit_stream``. Limits are looked up before the shuffle, so a call holds five
    numbers a request of one bucket of users (see ``by_bucket``) and micro-batch, and gives
    rows out in slices.
    """
    tier = F.col("kp_tier")
    table = lambda limits: F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    rid = F.col("request_id").cast("long")
    s = requests.select(F.coalesce(rid, F.lit((1 << 63) - 1)).alias("request_id"), rid.isNull().alias("no_id"), F.col("kp_user_id").alias("user_id"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NO_TIME)).alias("at"),
                        F.coalesce(table(daily)[tier], F.lit(daily["free"])).cast("long").alias("daily_limit"),
                        F.coalesce("kp_edge_limit", table(edge)[tier], F.lit(edge_fallback)).cast("long").alias("edge_limit"), F.coalesce("wants_edge", F.lit(False)).alias("wants_edge"))
    return by_bucket(s, "user_id", _QUOTA_OUT, _quota_factory(grace), lambda user, counts: (), IDLE_MS)


# ------------------------------------------------------------------ H4
def clean_cache_stream(verdicts: DataFrame, ttl: str = "1 hour", text_col: str = "text") -> DataFrame:
    """H4: clean verdicts deduplicated by text hash within the TTL (cache entries to write)."""
    return (verdicts.where(F.col("ner_status") == "clean").withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("hash", N.text_hash(F.col(text_col)))
            .withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["hash"])
            .select("hash", F.col("ts").alias("cached_at")))


_H4_OUT = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("hash", T.StringType()),
    T.StructField("asked", T.BooleanType()), T.StructField("ner_status", T.StringType()),
])
CACHE_SECONDS = 3600         # fixed value: a clean verdict holds for an hour


def cached_until(ts, clean, until: int, ttl: int):
    """Which of the requests for one text, in time order, are asked, and until when the cache then holds.

    ``ts`` (numbers) is sorted; ``clean`` tells what the model answers. An answer from the
    cache doesn't renew it. Costs a search for each request that is asked.
    """
    asked, i = np.zeros(len(ts), bool), 0
    while i < len(ts):
        if ts[i] < until:
            i = int(np.searchsorted(ts, until, "left"))
            continue
        asked[i] = True
        if clean[i]:
            until = int(ts[i]) + ttl
        i += 1
    return asked, until


def _h4_factory(ttl: int):
    def take(frame, held):
        which, hashes = pd.factorize(frame["hash"])
        ids, ts, status = (frame[c].to_numpy() for c in ("request_id", "at", "ner_status"))
        order = np.lexsort((ids, ts, which))
        which, ids, ts, status = which[order], ids[order], ts[order], status[order]
        asked, clean = np.zeros(len(ts), bool), status == "clean"
        ends = np.searchsorted(which, np.arange(len(hashes)), "right")
        for h, a, b in zip(hashes, [0, *ends[:-1]], ends, strict=True):
            asked[a:b], held[h] = cached_until(ts[a:b], clean[a:b], held.get(h, -(1 << 62)), ttl)
        for a in range(0, len(ids), 10_000):
            b = slice(a, a + 10_000)
            yield pd.DataFrame({"request_id": ids[b], "ts": pd.to_datetime(ts[b], unit="us"), "hash": np.asarray(hashes, object)[which[b]], "asked": asked[b],
                                "ner_status": np.where(asked[b], status[b], "clean")})
    return take


def clean_cache_skips(requests: DataFrame, ttl_seconds: int = CACHE_SECONDS, text_col: str = "text") -> DataFrame:
    """H4, C5 on a stream: request_id, ts, hash, asked, ner_status.

    Needs request_id, ts, ner_status (what the model answers if it is asked) and a text.
    A text judged clean less than ``ttl_seconds`` ago is not asked again; found and failed
    verdicts are never kept. The state of a text is one time, removed when the text has not
    come for long. Texts are hashed before the shuffle, so a text that many requests share
    costs its task three small columns a request of the micro-batch. Within a micro-batch
    requests go by (ts, request_id); one that arrives in a later micro-batch than a newer
    verdict finds that verdict. A null text counts as empty; rows without ts or request_id are left out.
    """
    rows = requests.where(F.col("ts").isNotNull() & F.col("request_id").isNotNull())
    small = rows.select(N.text_hash(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col("request_id").cast("long").alias("request_id"),
                        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("ner_status", F.lit("error")).alias("ner_status"))
    return by_bucket(small, "hash", _H4_OUT, _h4_factory(ttl_seconds * 1_000_000), lambda text, until: (), max(2000 * ttl_seconds, 1000))


# ------------------------------------------------------------------ H5
def usage_windows(logs: DataFrame, size: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """H5: G17 on tumbling event-time windows."""
    return (logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
            .groupBy(F.window("ts", size).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events",
                    "value_sum"))


# ------------------------------------------------------------------ H6
def reassemble_chunks(chunks: DataFrame) -> DataFrame:
    """H6 (batch form): chunks of one response concatenated in chunk order.

    One response is gathered at a time (bounded by that response's length),
    then restored with :func:`shroud.operators.mask.restore`.
    """
    return (chunks.groupBy("resp_id", "conv_id")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))),
                                          lambda c: c["text"]), "").alias("text")))


_H6_OUT = T.StructType([T.StructField("resp_id", T.StringType()), T.StructField("conv_id", T.LongType()),
                        T.StructField("text", T.StringType()), T.StructField("complete", T.BooleanType())])
WAIT_MS = 3_600_000          # an incomplete response is given up after so long without a chunk


_CHUNK = ["resp_id", "conv_id", "chunk_no", "text", "is_last"]


def _chunks(chunks: DataFrame) -> DataFrame:
    """``conv_id`` goes as text: next to a null, pandas would make a float of it."""
    return chunks.select("resp_id", F.col("conv_id").cast("string").alias("conv_id"), "chunk_no", "text", "is_last")


def _arrived(frame):
    """(resp_id, conv_id, chunk_no, text, is_last) of a frame's chunks; the number is text, as in the state."""
    for resp, conv, no, text, end in zip(*(frame[c].tolist() for c in _CHUNK), strict=True):
        yield resp, None if conv is None else int(conv), str(int(no)), text or "", bool(end)


def _joined(rows, complete: bool) -> pd.DataFrame:
    texts = ["".join(parts[i] for i in sorted(parts, key=int)) for _, (_, _, _, parts) in rows]
    return pd.DataFrame({"resp_id": [k for k, _ in rows], "conv_id": _whole([v[0] for _, v in rows]), "text": texts, "complete": complete})


def _h6(frame, held):
    """Entry of a response: conv_id, number of the last chunk, whether it was given out, chunks by number."""
    touched = {}
    for resp, conv, no, text, end in _arrived(frame):
        v = touched.get(resp)
        if v is None:
            v = touched[resp] = held.setdefault(resp, [None, None, False, {}])
        v[0] = conv
        v[3][no] = text
        if end:
            v[1] = int(no)
    whole = [(k, v) for k, v in touched.items() if not v[2] and v[1] is not None and len(v[3]) > v[1] and all(str(i) in v[3] for i in range(v[1] + 1))]
    if whole:
        yield _joined(whole, True)
    for _, v in whole:
        v[2] = True
    for v in touched.values():
        if v[2]:                                             # chunks that are sent again are known until the timeout
            v[3] = {}


def _h6_gone(resp, entry):
    if not entry[2]:
        yield _joined([(resp, entry)], False)


def reassemble_stream(chunks: DataFrame) -> DataFrame:
    """H6 (stream form): a response once its last chunk and all before it arrived, in any order.

    ``chunks``: resp_id, conv_id, chunk_no (from 0), text, is_last. A response is emitted
    once; one that stays incomplete for an hour is emitted as far as it came, with
    ``complete`` false. Responses share groups, see ``by_bucket``.
    """
    return by_bucket(_chunks(chunks), "resp_id", _H6_OUT, _h6, _h6_gone, WAIT_MS)


_PIECE_OUT = T.StructType([T.StructField("resp_id", T.StringType()), T.StructField("conv_id", T.LongType()), T.StructField("piece_no", T.LongType()),
                           T.StructField("text", T.StringType()), T.StructField("end", T.StringType())])
#: What can still become a token: the longest names have 16 letters, numbers fit 19 digits.
_OPEN = re.compile(r"\[(?:[A-Z_]{0,32}|[A-Z_]{1,32}_[0-9]{1,19})\Z")


def closed_part(text: str) -> int:
    """How much of a text can be given out: all but a token that its end may have cut."""
    m = _OPEN.search(text, max(0, len(text) - 54))
    return m.start() if m else len(text)


def _piece_rows(rows) -> pd.DataFrame:
    resp, conv, no, text, end = zip(*rows, strict=True)
    return pd.DataFrame({"resp_id": resp, "conv_id": _whole(conv), "piece_no": no, "text": text, "end": end})


def _pieces(frame, held):
    """Entry of a response: conv_id, next chunk, number of the last one, pieces given out, open token, chunks by number."""
    touched, out = {}, []
    for resp, conv, no, text, end in _arrived(frame):
        v = touched.get(resp)
        if v is None:
            v = touched[resp] = held.setdefault(resp, [None, 0, None, 0, "", {}])
            done = v[2] is not None and v[1] > v[2]
            touched[resp] = v = [*v, done]
        v[0] = conv
        if int(no) >= v[1]:                                  # else it was sent again
            v[5][no] = text
        if end:
            v[2] = int(no)
    for resp, (conv, following, last, pieces, open_, waiting, done) in touched.items():
        if done:
            waiting = {}
        parts = [open_]
        while str(following) in waiting and (last is None or following <= last):
            parts.append(waiting.pop(str(following)))
            following += 1
        now = "".join(parts)
        if not done and last is not None and following > last:
            out.append((resp, conv, pieces, now, "last"))
            now, waiting = "", {}
        elif not done and (cut := closed_part(now)):
            out.append((resp, conv, pieces, now[:cut], "more"))
            now, pieces = now[cut:], pieces + 1
        held[resp] = [conv, following, last, pieces, now, waiting]
    if out:
        yield _piece_rows(out)


def _pieces_gone(resp, entry):
    conv, following, last, pieces, open_, waiting = entry
    if last is None or following <= last:
        yield _piece_rows([(resp, conv, pieces, open_ + "".join(waiting[i] for i in sorted(waiting, key=int)), "cut")])


def piece_stream(chunks: DataFrame) -> DataFrame:
    """H6, without waiting for the end: resp_id, conv_id, piece_no, text, end.

    Every micro-batch gives out what has come in order so far, without a token that the
    next chunk may complete, so each piece can be restored on its own and the pieces put
    together are the restored response. ``end`` is ``more``, ``last``, or ``cut`` for what
    was left after an hour without a chunk. State: the open token (at most 54
    characters) and the chunks that came before their turn. Chunks sent again are left
    out; null texts count as empty; chunks after the last one don't count.
    """
    return by_bucket(_chunks(chunks), "resp_id", _PIECE_OUT, _pieces, _pieces_gone, WAIT_MS)
