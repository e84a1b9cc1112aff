"""WARC archives: writing with segmentation, and reassembly (operator 1).

Writing: every page becomes a response (or a revisit of the page with an equal
payload). The block holds an HTTP header and the payload in chunked transfer framing;
blocks over ``segment_bytes`` are cut into a first record and continuation records.
Archives are written with Spark's text sink (a record ends in a line feed, which the
sink adds), gzip-compressed, so any store that Spark writes to will do.

Reading: archives come back as lines, which carry any bytes; a parser puts records
together by Content-Length in bounded memory (gzip files are not split, so a task sees
whole files). Segmented records are grouped by origin identifier, ordered by segment
number and checked against the total length before the chunked framing is decoded;
unsegmented records need no shuffle.

Defined results: null html is an empty payload; of equal payloads of ``least_bytes``
or more the row of the largest page_id (repeated rows of it: each) is the
response, the last of those rows the one that revisits name; a page without url has its id for one; a record that lacks a segment, has a wrong length or broken framing comes
back with ``complete`` false and no payload; an empty table gives no records.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4096
LEAST_BYTES = 1000
EMIT_BYTES = 4 << 20


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds row, payload_bytes, payload_digest, and for revisits first and first_row: the response's page_id and row.

    ``row`` numbers the input's rows: give a stored table, which every reading deals out alike.
    Only payloads that occur twice are looked up, by a join whose other side Spark
    broadcasts if it measures small and else joins by sorting, splitting hot payloads.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.monotonically_increasing_id().alias("row"),
                        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    groups = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("_digest"))
              .agg(F.max(F.struct("page_id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    named = ~F.col("top.page_id").eqNullSafe(F.col("page_id"))
    return (rows.join(groups, F.col("payload_digest") == F.col("_digest"), "left")
            .withColumn("first", F.when(named, F.col("top.page_id"))).withColumn("first_row", F.when(named, F.col("top.row"))).drop("_digest", "n", "top"))


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{page_id}:{row}>"


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked transfer framing; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            if not body.endswith(b"\r\n", at):
                raise ValueError("no end of the last chunk")
            return b"".join(out)
        out.append(body[at:at + size])
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


def _record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def page_records(page: dict, segment_bytes: int, chunk_bytes: int, date: str):
    """The records of one page, whole; ``date`` is when they were written (WARC-Date)."""
    name = record_id(page["page_id"], page["row"])
    url = "".join(c for c in page["url"] or "" if c.isprintable() and c != " ") or None
    headers = [("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Target-URI", url or f"urn:page:{page['page_id']}"), ("X-Page-ID", page["page_id"]),
               ("WARC-Payload-Digest", f"sha1:{page['payload_digest']}")]
    if page["first"] is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(page["first"], page["first_row"]))]
        yield _record("revisit", headers, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % page["payload_bytes"])
        return
    body = chunked(page["html"].encode("utf-8", "surrogatepass"), chunk_bytes)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    if len(block) <= segment_bytes:
        yield _record("response", headers, block)
        return
    starts = range(0, len(block), segment_bytes)
    for n, at in enumerate(starts, 1):
        more = headers if n == 1 else [("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", date), ("WARC-Target-URI", url or f"urn:page:{page['page_id']}"), ("WARC-Segment-Origin-ID", name)]
        total = len(block) if n == len(starts) else None
        yield _record("response" if n == 1 else "continuation", [*more, ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], block[at:at + segment_bytes])


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, date: str | None = None) -> None:
    """Writes (page_id, url, html) as gzip WARC files under ``path``; every record bears ``date`` (default: now)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for page in batch.to_pylist():
                for record in page_records(page, segment_bytes, chunk_bytes, date):
                    out.append(record[:-1])                  # the sink ends the line
                    size += len(record)
                    if size > EMIT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = with_types(pages, least_bytes).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


RECORD = "record_id string, record_type string, page_id long, refers_to string, digest string, origin_id string, segment int, total_length long, block binary"


def _parsed(lines):
    """Records from an iterator of lines (without their line feed)."""
    lines = iter(lines)
    for line in lines:
        if line.rstrip(b"\r") == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        for line in lines:
            if line == b"\r":
                break
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        need, parts, size = int(head["content-length"]) + 4, [], 0
        while size < need:
            part = next(lines, None)
            if part is None:
                break
            parts += [part, b"\n"]
            size += len(part) + 1
        block = b"".join(parts)[:need - 4]
        number = head.get("warc-segment-number")
        page = head.get("x-page-id")
        total = head.get("warc-segment-total-length")
        yield (head.get("warc-record-id"), head.get("warc-type"), int(page) if page else None, head.get("warc-refers-to"), (head.get("warc-payload-digest") or "").removeprefix("sha1:"),
               head.get("warc-segment-origin-id") or head.get("warc-record-id"), int(number) if number else None, int(total) if total else None, block)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All WARC records under ``path``, continuation records included."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [f.split(" ")[0] for f in RECORD.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        rows, size = [], 0
        for row in _parsed(line for b in batches for line in b.column(0).to_pylist()):
            rows.append(row)
            size += len(row[-1]) + 200
            if size > EMIT_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: record_id, record_type, page_id, refers_to, digest, payload_bytes, payload, complete.

    A revisit has no payload; its payload_bytes and digest are those it names.
    """
    heads = ["record_id", "record_type", "page_id", "refers_to", "digest"]
    whole = records.where("segment IS NULL").select(*heads, F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"), F.lit(None).cast("long").alias("total_length"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = (records.where("segment IS NOT NULL").groupBy("origin_id")
               .agg(*(first(c) for c in heads), F.collect_list(F.struct("segment", "block")).alias("parts"), F.max("total_length").alias("total_length"), F.lit(True).alias("segmented")).drop("origin_id"))
    both = whole.withColumn("segmented", F.lit(False)).unionByName(grouped)

    def run(batches):
        for batch in batches:
            sizes, payloads, complete = [], [], []
            kinds, all_parts, totals, cut = (batch.column(c).to_pylist() for c in ("record_type", "parts", "total_length", "segmented"))
            for kind, parts, total, segmented in zip(kinds, all_parts, totals, cut, strict=True):
                parts.sort(key=lambda p: p["segment"])
                block = b"".join(p["block"] for p in parts)
                size = payload = None
                ok = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and (not segmented or total == len(block))
                if ok:
                    head, _, body = block.partition(b"\r\n\r\n")
                    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
                    try:
                        if kind == "revisit":
                            size = int(fields[b"Content-Length"])
                        else:
                            payload = unchunked(body) if fields.get(b"Transfer-Encoding") == b"chunked" else body
                            size = len(payload)
                    except (ValueError, KeyError):
                        ok = False
                sizes.append(size)
                payloads.append(payload)
                complete.append(ok)
            cols = [*(batch.column(c) for c in heads), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(complete)]
            yield pa.RecordBatch.from_arrays(cols, [*heads, "payload_bytes", "payload", "complete"])

    return both.mapInArrow(run, "record_id string, record_type string, page_id long, refers_to string, digest string, payload_bytes long, payload binary, complete boolean")


def checked(back: DataFrame) -> DataFrame:
    """Adds ``verified``: whole, and for a revisit, with a whole response of its own size and digest under the id it names.

    ``back``: record_id, record_type, refers_to, payload_bytes, payload_digest, digest, complete, read more than
    once. Only references that fail come back to the rows, so a much-revisited response is no hot key.
    """
    sound = F.col("complete") & F.col("payload_digest").eqNullSafe(F.col("digest"))
    named = back.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    held = back.where(F.col("record_type") == "response").where(sound).select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes")
    wrong = named.join(held, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")
    wrong = wrong.select(F.col("refers_to").alias("_to"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), F.lit(True).alias("_wrong"))
    same = (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    return back.join(wrong, same, "left").withColumn("verified", sound & F.col("_wrong").isNull()).drop("_to", "_digest", "_bytes", "_wrong")
