"""Documents in blocks, and compact exchanges of hash keys between blocks.

Documents are dealt into blocks of bounded size by a hash of their id (of their text, if
they have none) and travel as compressed Arrow messages. A block's task can then tell the others which keys it has:
sorted keys, cut by shard and delta-coded, take about three bytes each. The shards'
tasks answer each block; the answers meet the block's documents again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.kernel import U
from shroud.llm.memory import lean

BLOCK_BYTES = 8 << 20
SHARD_KEYS = 2 << 20
KEY_BITS = 40


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sizes(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Numbers of blocks and shards for the documents: both grow with the bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    p = partitions(docs)
    return max(2 * p, math.ceil(total / block_bytes)), max(p, math.ceil(total / 5 / SHARD_KEYS))


def block_of(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(blocks)).cast("int")


def deal(docs: DataFrame, blocks: int, hold: int = 16 << 20) -> DataFrame:
    """(block, docs): the rows of ``docs`` as messages to the block of their doc_id; rows without one are dealt by text."""
    rows = docs.withColumn("_block", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text", F.lit(19)), F.lit(blocks)).cast("int")).otherwise(block_of(F.col("doc_id"), blocks)))
    names = docs.columns

    def messages(held):
        t = pa.Table.from_batches(held)
        block = t.column("_block").to_numpy()
        order = np.argsort(block, kind="stable")
        t, block = t.select(names).take(pa.array(order)).combine_chunks(), block[order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(pa.Table.from_batches(t.slice(a, b - a).to_batches()))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[cuts].astype(np.int32)), pa.array(out, pa.binary())], ["block", "docs"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > hold:
                yield messages(held)
                held, size = [], 0
        if held:
            yield messages(held)

    return rows.mapInArrow(run, "block int, docs binary")


def dealt(table: pa.Table) -> pa.Table | None:
    """The documents of a block from its messages (None: there are none)."""
    parts = [pa.ipc.open_stream(m.as_buffer()).read_all() for m in table.column("docs") if m.is_valid]
    return pa.concat_tables(parts).combine_chunks() if parts else None


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers; a null counts as larger than any other."""
    return column.cast(pa.int64()).fill_null((1 << 63) - 1).to_numpy()


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys, as compressed planes of their differences."""
    d = np.diff(keys.astype("<u8"), prepend=U(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=U)


def by_shard(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's keys begin among sorted ``bits``-bit keys (and the end)."""
    edges = [min((s << bits) // shards + (1 if (s << bits) % shards else 0), (1 << 64) - 1) for s in range(shards)]
    return np.append(np.searchsorted(keys, np.array(edges, U)), len(keys))


def requests(block: int, keys: np.ndarray, shards: int, bits: int = KEY_BITS + 1) -> pa.Table:
    """Messages (shard, block, keys) with sorted keys."""
    cuts = by_shard(keys, bits, shards)
    some = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
    return pa.table({"shard": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.int32()),
                     "keys": pa.array([squeeze(keys[cuts[s]:cuts[s + 1]]) for s in some], pa.binary())})


REQUESTS = "shard int, block int, keys binary"


def flagged(hashes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Distinct sorted request keys of 64-bit hashes: their leading bits and, last, whether any has the flag."""
    keys = np.sort(((hashes >> U(64 - KEY_BITS)) << U(1)) | flags.astype(U))
    return keys[np.append((keys[1:] >> U(1)) != (keys[:-1] >> U(1)), True)] if len(keys) else keys


def shared(asked: DataFrame) -> DataFrame:
    """Answers (block, keys): of each block's keys those that another block has too, one of them with the flag."""

    def run(table):
        blocks = table.column("block").to_numpy()
        lists = [unsqueeze(k.as_py()) for k in table.column("keys")]
        every = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.append(True, (every[1:] >> U(1)) != (every[:-1] >> U(1)))) if len(every) else np.zeros(0, int)
        n = np.diff(np.append(first, len(every)))
        flag = np.maximum.reduceat(every & U(1), first) > 0 if len(first) else np.zeros(0, bool)
        keep = np.repeat((n > 1) & flag, n)
        every, owner = every[keep] >> U(1), owner[keep]
        by_owner = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_owner], np.arange(len(lists) + 1))
        some = [i for i in range(len(lists)) if cuts[i] < cuts[i + 1]]
        out = [squeeze(every[by_owner[cuts[i]:cuts[i + 1]]]) for i in some]
        return pa.table({"block": pa.array(blocks[some].astype(np.int32)), "keys": pa.array(out, pa.binary())})

    return asked.groupBy("shard").applyInArrow(lean(run), "block int, keys binary")


def answered(table: pa.Table) -> np.ndarray:
    """All keys of a block's answers, sorted."""
    parts = [unsqueeze(k.as_py()) for k in table.column("keys") if k.is_valid]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, U)


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values
