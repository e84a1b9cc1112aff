"""Byte BPE and packing against the tokenizers library."""
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shroud.llm import bpe, packing

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "'S", "'ll", "'LL", "''s", "é", "É", "1", "12", "²", "中", "文字", " ", "!", "%%%", "<|endoftext|>", "<|startoftext|>", "\U0001F600",
         "\x00", "\x1c", "\x85", "͸", "'", "t", "m", "Z", " 'd", "aaaaaaaaaaaaaaaa", "ǅ", "İ", "Σ", "é", "ŉ", "ß", "　"]


def texts(n):
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(n)] + ["", "ab" * 2000, " " * 900]


def test_encoders_equal_the_library():
    for path, encoder in ((BYTES, bpe._encoder(BYTES)), (WORDS, packing._encoder(WORDS))):
        some = texts(3000)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(some)] == want


def test_speculation_is_verified_and_failures_are_merged():
    model = bpe._model(BYTES)
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghinorstu") for _ in range(r.randrange(1, 16))) for _ in range(2000)]
    exact = [model.merge(w.encode()) for w in words]
    greedy = [model.propose(w.encode()) for w in words]
    assert 0 < sum(g == e for g, e in zip(greedy, exact, strict=True)) < len(words)
    assert model.encode_words(words) == exact
    assert model._merge_long([int(model.byte_id[b]) for b in b"abcd" * 50]) == model._merge_short([int(model.byte_id[b]) for b in b"abcd" * 50])


def test_round_trip(docs, nothing):
    t = Tokenizer.from_file(BYTES)
    got = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert set(got.columns) == {*docs.columns, "decoded"} and got.count() == docs.count()
    for r in got.collect():
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe.encode(nothing, BYTES).count() == 0


def test_packing(docs, nothing):
    t = Tokenizer.from_file(WORDS)
    rows = packing.pack(packing.pieces(docs, WORDS, capacity=64), capacity=64).collect()
    want = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, s, len(ids[s:s + 64]), zlib.crc32(np.array(ids[s:s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:], strict=False)) and sum(n for _, n in b) <= 64
    assert packing.pack(packing.pieces(nothing, WORDS)).count() == 0


def best(counts, capacity):
    """Fewest bins by exhaustive search."""
    items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    low = [len(items)]

    def put(i, bins):
        if len(bins) >= low[0]:
            return
        if i == len(items):
            low[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                put(i + 1, [*rest, room - items[i]])
        put(i + 1, [*bins, capacity - items[i]])

    put(0, [])
    return low[0]


def test_dominance_keeps_the_optimum():
    r = random.Random(3)
    for _ in range(150):
        counts = {}
        for _ in range(r.randrange(1, 9)):
            n = r.randrange(1, 21)
            counts[n] = counts.get(n, 0) + 1
        left = packing.Instance(dict(counts))
        fixed = packing.reduce_instance(left, 20)
        assert all(sum(sizes) <= 20 for sizes, _ in fixed)
        assert sum(times for _, times in fixed) + best(left.count, 20) == best(counts, 20), counts


def test_plan_is_bounded_by_lengths():
    """Slots don't grow with the pieces, and every piece has one place."""
    for n in (1, 7, 50_000):
        slots, used = packing.plan({2100: n, 1100: n, 850: n})
        assert used == n and len(slots) <= 9
    r = random.Random(5)
    counts = {r.randrange(1, 4097): r.randrange(1, 2000) for _ in range(300)}
    slots, used = packing.plan(counts)
    many, _ = packing.plan({k: 50 * v for k, v in counts.items()})
    assert len(many) < 4 * len(slots) and used >= -(-sum(k * v for k, v in counts.items()) // 4096)
