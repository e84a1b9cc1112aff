"""Byte-level BPE encoding and decoding (operator 4): speculate and verify.

A greedy longest match proposes the tokens of every distinct pre-token. The
proposal is the BPE encoding exactly if every token is what BPE makes of its own
bytes and every adjacent pair of tokens would stay apart; the pairs of a batch
are tested together with numpy. Only pre-tokens that fail are merged exactly.

Defined results: null text encodes like the empty one (no ids); equal texts give
equal ids; rows and extra columns pass through; names that clash with the output
columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shroud.llm.kernel import ragged
from shroud.llm.wordpieces import Encoder, split_bytes, unassigned


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Vocabulary and merges of a byte-level ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.bytes_of = raw | {i: t.encode() for t, i in self.specials.items()}
        self.id_of = {b: i for i, b in raw.items()}
        self.reach: dict[bytes, int] = {}
        for token in self.id_of:
            self.reach[token[:3]] = max(self.reach.get(token[:3], 2), len(token))
        size = max(self.bytes_of) + 1
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)])
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        order = np.full(size, -1, np.int64)                  # -1: a byte, else the rank of the merge that makes it
        left, right = np.arange(size), np.arange(size)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = (self.id_of[bytes(letters[c] for c in t)] for t in (a, b))
            made = self.id_of[self.bytes_of[x] + self.bytes_of[y]]
            self.rank[x, y] = rank
            self.made.append(made)
            if order[made] < 0 and len(self.bytes_of[made]) > 1:
                order[made], left[made], right[made] = rank, x, y
        self.order, self.left, self.right = order, left, right
        self.size = size
        keys = np.array([x * size + y for x, y in self.rank], np.int64)
        ranks = np.fromiter(self.rank.values(), np.int64, len(self.rank))
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[by_key], ranks[by_key]
        self.sound: dict[int, bool] = {}
        flat = b"".join(self.bytes_of.get(i, b"") for i in range(size))
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)])
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(flat, np.uint8)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; three bytes tell how long a token that begins so can be."""
        out, at, n, get, reach = [], 0, len(word), self.id_of.get, self.reach.get
        while at < n:
            end = at + reach(word[at:at + 3], 2)
            while (got := get(word[at:end])) is None:
                end -= 1
            out.append(got)
            at += len(word[at:end])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the merge of least rank, the leftmost of equals."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        return self._merge_short(ids) if len(ids) <= 64 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none, made = self.rank.get, 1 << 40, self.made
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i:i + 2] = [made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue                                     # made of symbols that have merged meanwhile
            ids[i], ids[j] = self.made[rank[a, b]], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in rank:
                heapq.heappush(heap, (rank[p], before[i], *p))
        return [i for i in ids if i >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; very large if there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], 1 << 40)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each pair of adjacent tokens apart, all pairs at once.

        Undoes both tokens' merges from the last one on. The symbols that then meet at
        the border must not have a merge that comes before the merge undone last, which
        would have taken one of them: earlier rank, or equal rank and further left.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        bound = np.full(len(a), 1 << 41)                     # 2 * rank, plus 1 where the left side's merge wins ties
        while len(live):
            x, y = a[live], b[live]
            clash = 2 * self._ranks(x, y) < bound[live]
            ok[live[clash]] = False
            live, x, y = live[~clash], x[~clash], y[~clash]
            rx, ry = self.order[x], self.order[y]
            going = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[going], x[going], y[going], rx[going], ry[going]
            undo_left = rx > ry                              # of equal ranks the right one was merged last
            bound[live] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok

    def _sound(self, token: int) -> bool:
        if (got := self.sound.get(token)) is None:
            got = self.sound[token] = self.merge(self.bytes_of[token]) == [token]
        return got

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = [self.propose(w) for w in raw]
        flat = np.array([i for ids in found for i in ids], np.int64)
        word = np.repeat(np.arange(len(found)), [len(ids) for ids in found])
        failed = set(word[~np.isin(flat, [t for t in np.unique(flat).tolist() if self._sound(t)])].tolist())
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        ok = self.apart(pairs // self.size, pairs % self.size)[back]
        failed |= set(word[inner[~ok]].tolist())
        for i in failed:
            found[i] = self.merge(raw[i])
        return found

    def decode(self, ids: np.ndarray) -> str:
        data = self.flat[ragged(self.offsets[ids], self.lengths[ids])]
        return data.tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _model(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    from tokenizers import pre_tokenizers

    model = _model(path)
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def whole(text: str) -> list[int]:                       # code points newer than Python's tables: the library finds the pre-tokens
        return [i for ids in model.encode_words([text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)]) for i in ids]

    return Encoder(split_bytes, model.encode_words, whole, unassigned, model.specials)


def _replaced(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _add(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], [*(batch.schema.names[i] for i in keep), name])


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out`` array<int>: the ids of ``text`` under the byte-level ``tokenizer.json`` at ``path``."""

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            yield _add(batch, out, lists(encoder.encode(batch.column(text).to_pylist())))

    return df.mapInArrow(run, _replaced(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` string: the text of ``ids`` (null: empty); bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        model = _model(path)
        for batch in batches:
            col = batch.column(ids)
            texts = [model.decode(np.asarray(col[i].values if col[i].is_valid else [], np.int64)) for i in range(len(col))]
            yield _add(batch, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _replaced(df, out, T.StringType()))
