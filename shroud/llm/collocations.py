"""Phrase collocations (operator 13): direct-address tiling of pair counts.

1. ``read_words``: blocks of texts of one language become distinct words with counts and
   a sequence of word numbers. Nothing but words and counts is shuffled.
2. Words that occur often enough get ids by frequency rank; blocks are told the ids of
   theirs (a join on the word, one row per block and word).
3. ``count_pairs``: pairs of ids fall into square tiles. Low ids are frequent, so tiles near
   the origin are full: each is counted by a dense bincount over its cells. The other
   pairs become sorted coordinate lists. Blocks send their tiles to shards, which
   add them up in a tree with a bounded fan-in: no task holds more than ``FAN`` messages.
4. Frequent pairs are ranked by frequency in turn, the answers go back down the same
   tree, and the pair's id takes the place of the first id: the next round counts
   (pair, word) tiles, and so on up to ``max_words``. A phrase can only be frequent if
   both phrases it is made of are, so nothing is lost.
5. Scores, containment and the report are joins and aggregates over frequent phrases.

Counts are exact at every size; ids are bounded by 2^33 phrases and 2^31 words a language.
Defined results: null text has no words; null lang counts as ``und``; repeated rows
count each; a word may be of any length; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm import exchange as X
from shroud.llm.kernel import LOWER_VALUES, U, chunks, mix, span_hashes
from shroud.llm.ranks import ranked
from shroud.llm.storage import stored

BLOCK_CHARS = 4 << 20
SHARD_WORDS = 2 << 20
FAN = 64
TILE = 8                                                         # bits of an id within a tile
GRID = 64                                                        # tiles that are counted densely lie in the first GRID rows and columns
FULL = 1 << 12                                                   # pairs that make a tile dense
WORD_BITS = 31
STOPS = b".,;:!?\n\x0b\x0c\r"                                    # end a piece (fixed values)
BLANKS = b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(STOPS)] = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SECOND_VALUES = mix(LOWER_VALUES + U(77))


def pack(numbers: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(kind).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def words_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (A-Z lower-cased) by falling count, their counts, and all words in order: numbers, -1 between pieces."""
    one, two, breaks, where, parts, low = [], [], [], [], [], 0
    for i, j in chunks(texts):
        data = b"\n".join([*((t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]), b""])
        sym = np.frombuffer(data, np.uint8)
        kind = _KIND[sym]
        edge = np.diff((kind == 0).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        one.append(span_hashes(sym, starts, ends, LOWER_VALUES))
        two.append(span_hashes(sym, starts, ends, SECOND_VALUES))
        piece = np.cumsum(kind == 2)[starts]
        breaks.append(np.append(True, piece[1:] != piece[:-1])[:len(starts)])
        where.append(np.stack((np.full(len(starts), len(parts)), starts, ends)))
        parts.append(data)
        low += len(starts)
    if not low:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int32)
    one, two, breaks, where = np.concatenate(one), np.concatenate(two), np.concatenate(breaks), np.concatenate(where, 1)
    _, first, back, n = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    if (two != two[first][back]).any():                          # equal first hashes of different words
        _, first, back, n = np.unique(np.stack((one, two)), axis=1, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    at = where[:, first[order]].T.tolist()
    words = [parts[p][a:b].translate(_LOWER).decode("utf-8", "surrogatepass") for p, a, b in at]
    return words, n[order], np.insert(number[back], np.flatnonzero(breaks), -1).astype(np.int32)


BLOCKS = "block long, lang string, total long, words array<string>, n array<long>, tokens binary"


def read_words(docs: DataFrame, limit: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of texts and language: distinct words, their counts, the sequence of words."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

    def rows(number, held):
        for lang, texts in held.items():
            words, n, tokens = words_of(texts)
            if words:
                row = [[number], [lang], [int(n.sum())], [words], [n.tolist()], [pack(tokens, "<i4")]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], ["block", "lang", "total", "words", "n", "tokens"])

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text or "")
                if size > limit:
                    yield from rows(number, held)
                    number, held, size = number + 1, {}, 0
        yield from rows(number, held)

    return docs.select("text", F.coalesce(F.col("lang"), F.lit("und")).alias("lang")).mapInArrow(run, BLOCKS)


def tiled(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (a, b) and the sums of ``n`` (None: ones) over equal pairs."""
    if not len(a):
        return np.zeros(0, U), np.zeros(0, np.int64)
    ta, tb = a >> TILE, b >> TILE
    head = np.flatnonzero((ta < GRID) & (tb < GRID))
    tile = (ta[head] * GRID + tb[head]).astype(np.uint16)
    size = np.bincount(tile, minlength=GRID * GRID)
    dense = size >= FULL
    keys, sums = [], []
    rest = np.ones(len(a), bool)
    if dense.any():
        mine = dense[tile]
        rest[head[mine]] = False
        head, tile = head[mine], tile[mine]
        order = head[np.argsort(tile, kind="stable")]
        cuts = np.concatenate(([0], np.cumsum(size[dense])))
        low = (1 << TILE) - 1
        for t, i, j in zip(np.flatnonzero(dense).tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[i:j]
            cell = ((a[own] & low) << TILE) | (b[own] & low)
            total = np.bincount(cell, minlength=1 << 2 * TILE) if n is None else _weighted(cell, n[own])
            some = np.flatnonzero(total)
            keys.append((((t // GRID << TILE) | some >> TILE).astype(U) << U(WORD_BITS)) | ((t % GRID << TILE) | some & low).astype(U))
            sums.append(total[some])
    if rest.any():                                               # sorted coordinates
        key = (a[rest].astype(U) << U(WORD_BITS)) | b[rest].astype(U)
        if n is None:
            key, total = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key, w = key[order], n[rest][order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, total = key[first], np.add.reduceat(w, first)
        keys.append(key)
        sums.append(total)
    keys, sums = np.concatenate(keys), np.concatenate(sums).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], sums[order]


def _weighted(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums by cell in whole numbers (floats would round above 2^53)."""
    out = np.zeros(1 << 2 * TILE, np.int64)
    np.add.at(out, cell, n)
    return out


def split_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> U(WORD_BITS)).astype(np.int64), (keys & U((1 << WORD_BITS) - 1)).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """All pairs of a tile go to one shard."""
    a, b = split_key(keys)
    return (mix(((a >> TILE).astype(U) << U(32)) | (b >> TILE).astype(U)) % U(shards)).astype(np.int32)


MESSAGE = "lang string, shard int, node long, keys binary, sums binary"


def messages(lang: str, node: int, keys: np.ndarray, sums: np.ndarray, shards: int) -> pa.Table:
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    keys, sums, shard = keys[order], sums[order], shard[order]
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    part = lambda x, s: x[cuts[s]:cuts[s + 1]]
    return pa.table({"lang": pa.array([lang] * len(some), pa.string()), "shard": pa.array(some, pa.int32()), "node": pa.array([node] * len(some), pa.int64()),
                     "keys": pa.array([X.squeeze(part(keys, s)) for s in some], pa.binary()), "sums": pa.array([pack(part(sums, s), "<i8") for s in some], pa.binary())})


def added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a few messages."""
    keys = np.concatenate([X.unsqueeze(k.as_py()) for k in table.column("keys")])
    sums = np.concatenate([unpack(s.as_py(), "<i8") for s in table.column("sums")])
    return tiled(*split_key(keys), sums)


class Tree:
    """Sums of messages from blocks, level by level, and answers on the same way back."""

    def __init__(self, leaves: DataFrame, blocks: int, least: int, name: str):
        self.levels, self.name = [leaves], name
        widths = [math.ceil(blocks / FAN)]
        while widths[-1] > 1:
            widths.append(math.ceil(widths[-1] / FAN))
        self.parents = [F.pmod(F.xxhash64("node") if k == 0 else F.col("node"), F.lit(w)).cast("long") for k, w in enumerate(widths)]

        def up(key, table):
            keys, sums = added(table)
            return pa.table({"lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int32()), "node": pa.array([key[2].as_py()], pa.int64()),
                             "keys": pa.array([X.squeeze(keys)], pa.binary()), "sums": pa.array([pack(sums, "<i8")], pa.binary())})

        def top(key, table):
            keys, sums = added(table)
            a, b = split_key(keys[sums >= least])
            n = sums[sums >= least]
            return pa.table({"lang": pa.array([key[0].as_py()] * len(n), pa.string()), "shard": pa.array([key[1].as_py()] * len(n), pa.int32()), "a": pa.array(a), "b": pa.array(b), "f": pa.array(n)})

        for parent in self.parents[:-1]:
            placed = self.levels[-1].withColumn("node", parent)
            self.levels.append(stored(placed.groupBy("lang", "shard", "node").applyInArrow(up, MESSAGE), f"{name}-sums"))
        placed = self.levels[-1].withColumn("node", self.parents[-1])
        self.frequent = stored(placed.groupBy("lang", "shard", "node").applyInArrow(top, "lang string, shard int, a long, b long, f long"), f"{name}-frequent")

    def answers(self, ids: DataFrame) -> DataFrame:
        """(lang, shard, node, keys, ids): for each block which of its pairs are frequent, from (lang, shard, a, b, id)."""
        kind = "lang string, shard int, node long, keys binary, sums binary"

        def first(key, table):
            k = (table.column("a").to_numpy().astype(U) << U(WORD_BITS)) | table.column("b").to_numpy().astype(U)
            order = np.argsort(k)
            return pa.table({"lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int32()), "node": pa.array([0], pa.int64()),
                             "keys": pa.array([X.squeeze(k[order])], pa.binary()), "sums": pa.array([pack(table.column("id").to_numpy()[order], "<i8")], pa.binary())})

        def down(key, children, parent):
            if not (children.num_rows and parent.num_rows):
                return pa.table({n: pa.array([], t) for n, t in zip(("lang", "shard", "node", "keys", "sums"), (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)})
            known, given = X.unsqueeze(parent.column("keys")[0].as_py()), unpack(parent.column("sums")[0].as_py(), "<i8")
            nodes, keys, ids = [], [], []
            for node, k in zip(children.column("child").to_pylist(), children.column("keys"), strict=True):
                k = X.unsqueeze(k.as_py())
                k = k[X.among(k, known)]
                if len(k):
                    nodes.append(node)
                    keys.append(X.squeeze(k))
                    ids.append(pack(given[np.searchsorted(known, k)], "<i8"))
            return pa.table({"lang": pa.array([key[0].as_py()] * len(nodes), pa.string()), "shard": pa.array([key[1].as_py()] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int64()),
                             "keys": pa.array(keys, pa.binary()), "sums": pa.array(ids, pa.binary())})

        out = ids.groupBy("lang", "shard").applyInArrow(first, kind)
        for level, parent in zip(self.levels[::-1], self.parents[::-1], strict=True):
            children = level.select("lang", "shard", F.col("node").alias("child"), parent.alias("node"), "keys").groupBy("lang", "shard", "node")
            out = children.cogroup(out.groupBy("lang", "shard", "node")).applyInArrow(down, kind)
            if level is not self.levels[0]:
                out = stored(out, f"{self.name}-answers")
        return out


STATE = "block long, lang string, words binary, heads binary"


def _shown(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return unpack(table.column(name)[0].as_py(), kind)


def with_ids(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(block, lang, words, heads): word ids in order; -1 between pieces and for words without an id."""
    asked = blocks.select(F.col("block").alias("asker"), F.col("lang").alias("tongue"), F.posexplode("words").alias("at", "asked"))
    told = asked.join(vocabulary, (F.col("tongue") == F.col("lang")) & (F.col("asked") == F.col("word"))).select("asker", "tongue", "at", "id")

    def run(key, tokens, told):
        ids = np.full(tokens.column("size")[0].as_py() + 1, -1, np.int64)     # the last one is for -1
        ids[told.column("at").to_numpy()] = told.column("id").to_numpy()
        out = ids[_shown(tokens, "tokens", "<i4")]
        out = out[np.append(True, (out[1:] >= 0) | (out[:-1] >= 0))[:len(out)]]
        return pa.table({"block": tokens.column("block"), "lang": tokens.column("lang"), "words": pa.array([pack(out, "<i4")], pa.binary()), "heads": pa.array([pack(out, "<i8")], pa.binary())})

    tokens = blocks.select("block", "lang", "tokens", F.size("words").alias("size"))
    return tokens.groupBy("block", "lang").cogroup(told.groupBy("asker", "tongue")).applyInArrow(run, STATE)


def pairs_of(words: np.ndarray, heads: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, head, last word) of the phrases of k words whose two parts of k - 1 words are frequent."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((heads[:n] >= 0) & (heads[1:n + 1] >= 0))
    return at, heads[at], words[at + k - 1].astype(np.int64)


def count_pairs(state: DataFrame, k: int, shards: int) -> DataFrame:
    """Messages with each block's pair counts."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, a, b = pairs_of(_shown(row, "words", "<i4"), _shown(row, "heads", "<i8"), k)
                keys, sums = tiled(a, b)
                yield from messages(row.column("lang")[0].as_py(), row.column("block")[0].as_py(), keys, sums, shards).to_batches()

    return state.mapInArrow(run, MESSAGE)


def next_heads(state: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """The state with the ids of frequent phrases of k words as heads."""
    def run(key, state, answers):
        if not state.num_rows:
            raise ValueError("answers without a block")
        words, heads = _shown(state, "words", "<i4"), _shown(state, "heads", "<i8")
        at, a, b = pairs_of(words, heads, k)
        out = np.full(len(words), -1, np.int64)
        if answers.num_rows:
            keys = np.concatenate([X.unsqueeze(x.as_py()) for x in answers.column("keys")])
            ids = np.concatenate([unpack(x.as_py(), "<i8") for x in answers.column("sums")])
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            mine = (a.astype(U) << U(WORD_BITS)) | b.astype(U)
            hit = X.among(mine, keys)
            out[at[hit]] = ids[np.searchsorted(keys, mine[hit])]
        return pa.table({"block": state.column("block"), "lang": state.column("lang"), "words": state.column("words"), "heads": pa.array([pack(out, "<i8")], pa.binary())})

    answers = answers.withColumnRenamed("node", "block")
    return state.groupBy("block", "lang").cogroup(answers.groupBy("block", "lang")).applyInArrow(run, STATE)


def frequent_phrases(docs: DataFrame, least: int = 10, max_words: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of up to ``max_words`` words with f >= least, and (lang, n): all words of a language."""
    blocks = stored(read_words(docs), "blocks")
    totals = blocks.groupBy("lang").agg(F.sum("total").alias("n"))
    r = blocks.agg(F.count_distinct("block").alias("blocks"), F.sum("total").alias("total")).first()
    shards = max(X.partitions(docs), math.ceil((r.total or 0) / SHARD_WORDS))
    counted = blocks.select("lang", F.explode(F.arrays_zip("words", "n")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.n").alias("f"))
    vocabulary = ranked(stored(counted.where(F.col("f") >= least), "words"), "lang", [F.col("f").desc(), F.col("word")], "vocabulary")
    vocabulary = vocabulary.select("lang", "word", "f", F.col("rank").alias("id"))
    last = vocabulary.select("lang", "id", F.array("word").alias("words"), "f")
    found = [last]
    state = stored(with_ids(blocks, vocabulary), "ids")
    word = vocabulary.select("lang", F.col("id").alias("b"), "word")
    for k in range(2, max_words + 1):
        tree = Tree(stored(count_pairs(state, k, shards), f"pairs-{k}"), max(1, r.blocks), least, f"tree-{k}")
        ids = ranked(tree.frequent, "lang", [F.col("f").desc(), F.col("a"), F.col("b")], f"ranked-{k}").withColumnRenamed("rank", "id").drop("total")
        parts = last.select("lang", F.col("id").alias("a"), "words")
        last = ids.join(parts, ["lang", "a"]).join(word, ["lang", "b"]).select("lang", "id", F.concat("words", F.array("word")).alias("words"), "f")
        last = stored(last, f"phrases-{k}")
        found.append(last)
        if k < max_words:
            state = stored(next_heads(state, tree.answers(ids.select("lang", "shard", "a", "b", "id")), k), f"heads-{k}")
    return reduce(DataFrame.unionByName, [p.select("lang", "words", "f") for p in found]), totals


def scored(phrases: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two and more words, at their lowest-scoring cut.

    ``scale * a * a`` has up to 36 digits for counts of 15 digits; decimals hold it exactly.
    """
    text = F.array_join("words", " ")
    known = phrases.select("lang", text.alias("part"), "f")
    cuts = phrases.where(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("array_join(slice(words, 1, k), ' ')").alias("left"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("right"))
    both = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    both = both.join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    score = F.expr(f"(CAST({scale} AS DECIMAL(7, 0)) * ({whole('a')} * {whole('a')})) div ({whole('l')} * {whole('r')})")
    best = both.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    return best.select("lang", text.alias("phrase"), "words", "a", "s.l", "s.r", "s.score")


def contained(candidates: DataFrame, percent: int = 50) -> DataFrame:
    """(lang, phrase) of candidates that lie inside a longer one with at least ``percent`` of their count."""
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("f"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return candidates.join(most, ["lang", "phrase"]).where(100 * F.col("f") >= percent * F.col("a")).select("lang", "phrase")


def mine(docs: DataFrame, least: int = 10, max_words: int = 3, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, least, max_words)
    candidates = stored(scored(phrases), "candidates")
    kept = candidates.join(contained(candidates), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(X.partitions(docs)))
    few = kept.withColumn("_salt", salt).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
