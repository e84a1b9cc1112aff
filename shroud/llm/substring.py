"""Removal of passages that repeat across documents (operator 6): fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``anchor`` words; all
its rolling windows of that length are probes. Any repeat of ``window`` words holds a
whole reference block of the other document, as ``2 * anchor - 1 <= window``, so a
probe hits it. Hits are extended on both sides to all windows of ``window`` words
around them, on the probing and on the reference side; a window is removed where the
smallest doc_id that has it is smaller than the document's own, and overlapping
windows make up the maximal repeats.

Probes travel as compact keys (see ``exchange``); only windows near hits travel in
full, one per block and window, with the smallest doc_id. A passage that thousands of
documents share is one row per block of documents, never a pair of documents.

Equality of windows is that of 96 bits of two hashes over their words' 64-bit hashes, so
no better than 64 bits for a single word. Defined results: null text has no words;
rows that share a doc_id don't remove each other's words; a null doc_id counts as
larger than all others; texts shorter than a window keep all words; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.llm import exchange as X
from shroud.llm.kernel import BYTE_VALUES, U, Words, chunks
from shroud.llm.memory import lean

ANCHOR = 7
WINDOW = 13
BLOCK_BYTES = 4 << 20                                            # a task holds some ten times that in arrays


def _texts(docs: pa.Table):
    """(first row, Words) of consecutive parts of a block."""
    texts = docs.column("text").to_pylist()
    for i, j in chunks(texts):
        yield i, Words(texts[i:j], BYTE_VALUES)


def _probe_keys(docs: pa.Table, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and whether it is a reference block, of all rolling windows."""
    found = []
    for low, words in _texts(docs):
        h, at = words.windows(anchor)
        row = words.doc[at]
        found.append((h, row + low, (at - words.first[row]) % anchor == 0))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _locally_shared(keys: np.ndarray, owner: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Which entries have a key that another document of the block has too, one of them as a reference block."""
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    n = np.diff(np.append(first, len(k)))
    more = (np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)) & np.maximum.reduceat(flag[order], first)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(more, n)
    return out


def _hit_probes(docs: pa.Table, owner: np.ndarray, hits: np.ndarray, anchor: int) -> np.ndarray:
    """Of all rolling windows, in order, which are hits."""
    keys, row, flag = _probe_keys(docs, anchor)
    keys >>= U(64 - X.KEY_BITS)
    return X.among(keys, hits) | _locally_shared(keys, owner[row], flag) if len(keys) else np.zeros(0, bool)


def _near_hits(docs: pa.Table, hits: np.ndarray, anchor: int, window: int):
    """(two hashes, doc_id) of the windows that hold a hit probe, each once with its smallest doc_id."""
    owner = X.ids(docs.column("doc_id"))
    hit = _hit_probes(docs, owner, hits, anchor)
    if not len(hit):
        return None
    found, low_probe = [], 0
    for low, words in _texts(docs):
        _, at_probe = words.windows(anchor)
        mine = hit[low_probe:low_probe + len(at_probe)]
        low_probe += len(at_probe)
        marked = np.zeros(len(words.hashes) + window + 1, np.int64)
        marked[at_probe[mine] + 1] = 1
        marked = np.cumsum(marked)
        one, at = words.windows(window)
        near = marked[at + window - anchor + 1] > marked[at]
        two, _ = words.windows(window, salt=99)
        found.append((one[near], (two[near] >> U(32)).astype(np.uint32), owner[words.doc[at[near]] + low]))
    one, two, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    return _smallest(one, two, doc)


def _groups(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both hashes, and where equal ones begin in it."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


def _smallest(one, two, doc):
    if not len(one):
        return None
    order, first = _groups(one, two)
    return one[order[first]], two[order[first]], np.minimum.reduceat(doc[order], first)


def remove_repeats(docs: DataFrame, anchor: int = ANCHOR, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text, n_words, n_removed, kept (words joined by one space), removed, row.

    ``removed`` lists the maximal runs of removed words as (first, words); ``row`` holds
    the other columns of ``docs``, if there are any.
    """
    if 2 * anchor - 1 > window:
        raise ValueError("a window must hold a whole reference block wherever it lies")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("long"), "text", *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")] if others else []))
    blocks, shards = X.sizes(docs, block_bytes=BLOCK_BYTES)
    placed = X.deal(docs, blocks)

    def ask(key, table):
        keys, _, flag = _probe_keys(X.dealt(table), anchor)
        return X.requests(key[0].as_py(), X.flagged(keys, flag), shards)

    hits = X.shared(placed.groupBy("block").applyInArrow(lean(ask), X.REQUESTS))
    extended = "shard int, block int, keys binary, checks binary, docs binary"

    def extend(key, table, answers):
        docs = X.dealt(table)
        got = docs and _near_hits(docs, X.answered(answers), anchor, window)
        if not got:
            got = (np.zeros(0, U), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        one, two, doc = got
        cuts = X.by_shard(one, 64, shards)
        some = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
        part = lambda x, s: x[cuts[s]:cuts[s + 1]]
        shuffled = lambda x: _planes(x)
        return pa.table({"shard": pa.array(some, pa.int32()), "block": pa.array([key[0].as_py()] * len(some), pa.int32()),
                         "keys": pa.array([X.squeeze(part(one, s)) for s in some], pa.binary()),
                         "checks": pa.array([part(two, s).tobytes() for s in some], pa.binary()),
                         "docs": pa.array([shuffled(part(doc, s)) for s in some], pa.binary())})

    near = placed.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(lean(extend), extended)

    def settle(table):
        blocks = table.column("block").to_numpy()
        ones = [X.unsqueeze(k.as_py()) for k in table.column("keys")]
        one = np.concatenate(ones)
        two = np.concatenate([np.frombuffer(k.as_py(), np.uint32) for k in table.column("checks")])
        doc = np.concatenate([_unplanes(k.as_py()) for k in table.column("docs")])
        owner = np.repeat(np.arange(len(ones)), [len(x) for x in ones])
        order, first = _groups(one, two)
        least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
        late = order[doc[order] > least]
        late = late[np.lexsort((two[late], one[late], owner[late]))]
        cuts = np.searchsorted(owner[late], np.arange(len(ones) + 1))
        some = [i for i in range(len(ones)) if cuts[i] < cuts[i + 1]]
        part = lambda x, i: x[late[cuts[i]:cuts[i + 1]]]
        return pa.table({"block": pa.array(blocks[some].astype(np.int32)), "keys": pa.array([X.squeeze(part(one, i)) for i in some], pa.binary()),
                         "checks": pa.array([part(two, i).tobytes() for i in some], pa.binary())})

    known = near.groupBy("shard").applyInArrow(lean(settle), "block int, keys binary, checks binary")

    def cut(table, answers):
        docs = X.dealt(table)
        if docs is None:                                     # answers only go to blocks with documents
            raise ValueError("a block lost its documents")
        found = _removed(docs, answers, window)
        for c in docs.column_names[1:]:
            found = found.append_column(c, docs.column(c))
        return found.select(names)

    names = ["doc_id", *docs.columns[1:], "n_words", "n_removed", "kept", "removed"]
    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())]))
    kinds = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept": T.StringType(), "removed": spans}
    out = T.StructType([T.StructField("doc_id", T.LongType()), *docs.schema.fields[1:], *(T.StructField(n, t) for n, t in kinds.items())])
    return placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lean(cut), out)


def _planes(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unplanes(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))


def _gone(docs: pa.Table, answers: pa.Table, parts: list[tuple[int, Words]], window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words that windows start at, part by part, and which of these windows are removed."""
    owner = X.ids(docs.column("doc_id"))
    at, one, two, doc = [], [], [], []
    for low, words in parts:
        h, first = words.windows(window)
        at.append(first.astype(np.int32))
        one.append(h)
        two.append((words.windows(window, salt=99)[0] >> U(32)).astype(np.uint32))
        doc.append((words.doc[first] + low).astype(np.int32))
        words.hashes = words.doc = None                          # as large as the rest of the words
    one, two, doc = np.concatenate(one), np.concatenate(two), owner[np.concatenate(doc)]
    gone = np.zeros(len(one), bool)
    if not len(one):
        return at, gone
    order, first = _groups(one, two)
    late = doc[order]
    gone[order] = late > np.repeat(np.minimum.reduceat(late, first), np.diff(np.append(first, len(order))))
    del order, first, late
    valid = [i for i, k in enumerate(answers.column("keys")) if k.is_valid]
    if valid:
        keys = np.concatenate([X.unsqueeze(answers.column("keys")[i].as_py()) for i in valid])
        checks = np.concatenate([np.frombuffer(answers.column("checks")[i].as_py(), np.uint32) for i in valid])
        order = np.argsort(keys, kind="stable")
        keys, checks = keys[order], checks[order]
        rest = np.flatnonzero(X.among(one, keys))
        begin = np.searchsorted(keys, one[rest], "left")
        step = 0
        while len(rest):                                         # equal first hashes lie together; more than one is all but impossible
            k = begin + step
            inside = k < len(keys)
            rest, begin, k = rest[inside], begin[inside], k[inside]
            same = keys[k] == one[rest]
            rest, begin, k = rest[same], begin[same], k[same]
            gone[rest] |= checks[k] == two[rest]
            step += 1
    return at, gone


def _removed(docs: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    parts = list(_texts(docs))
    places, gone = _gone(docs, answers, parts, window)
    n_words, n_removed, kept, spans, low = [], [], [], [], 0
    for at in places:
        words = parts.pop(0)[1]
        mine = at[gone[low:low + len(at)]]
        low += len(at)
        cover = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(cover, mine, 1)
        np.add.at(cover, mine + window, -1)
        out = np.cumsum(cover)[:-1] > 0
        n = np.diff(words.first)
        n_words.append(n)
        total = np.concatenate(([0], np.cumsum(out)))
        n_removed.append(total[words.first[1:]] - total[words.first[:-1]])
        # Kept words with the byte after each, which is white space or the end
        edge = np.zeros(len(words.data) + 2, np.int8)
        edge[words.starts[~out]] += 1
        edge[words.ends[~out] + 1] -= 1
        mask = np.cumsum(edge[:-2], dtype=np.int8) > 0
        sym = np.frombuffer(words.data, np.uint8).copy()
        sym[words.ends[words.ends < len(sym)]] = 32
        data = sym[mask].tobytes()
        length = np.concatenate(([0], np.cumsum(np.where(out, 0, words.ends - words.starts + 1))))
        a, b = length[words.first[:-1]], length[words.first[1:]]
        kept += [data[x:max(x, y - 1)].decode("utf-8", "surrogatepass") for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        spans += _spans(out, words.first)
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(np.concatenate(n_words), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed), pa.int64()),
                     "kept": pa.array(kept, pa.string()), "removed": pa.array(spans, SPANS)})


def _spans(out: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Runs of removed words of each text."""
    lists: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    start = out.copy()
    start[1:] &= ~out[:-1] | np.isin(np.arange(1, len(out)), first)
    at = np.flatnonzero(start)
    stop = out.copy()
    stop[:-1] &= ~out[1:] | np.isin(np.arange(1, len(out)), first)
    for s, e, d in zip(at.tolist(), np.flatnonzero(stop).tolist(), (np.searchsorted(first, at, "right") - 1).tolist(), strict=True):
        lists[d].append({"first": s - int(first[d]), "words": e - s + 1})
    return lists
