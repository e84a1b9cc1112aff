"""Token ids of whole texts from a per-worker cache of encoded pre-tokens.

Both tokenizer files split a text into pre-tokens that are encoded on their own.
The split is done here with numpy over code points; a pre-token is looked up by a
64-bit hash, and only unseen ones are encoded (by the function given). The cache
is bounded: when full it starts anew, so memory does not grow with the corpus.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np

from shroud.llm.kernel import U, chunks, mix, ragged, span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White space as the tokenizers' patterns see it (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the patterns take as one pre-token after an apostrophe (fixed values).
SHORT, LONG = "stmd", ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


@functools.cache
def unassigned() -> np.ndarray:
    """Code points that this Python's character tables do not know; newer tables may class them."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


@functools.cache
def beyond_latin() -> np.ndarray:
    """Code points whose normalisation or lower-casing is left to the library: all past Latin Extended-B."""
    out = np.ones(0x110000, bool)
    out[:0x250] = False
    out[0x130] = True
    return out


@functools.cache
def code_values() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=U) + U(0xA5A5))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed-like sentinel (0), and each text's start."""
    joined = "\0".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([0, *(len(t) + 1 for t in texts)])


def _apostrophes(codes: np.ndarray, cls: np.ndarray, start: np.ndarray, alone: np.ndarray) -> None:
    """Joins an apostrophe that begins a run with s, t, m, d, re, ve or ll after it."""
    n = len(codes)
    at = np.flatnonzero((codes == 39) & start & alone)
    at = at[at + 1 < n]
    if not len(at):
        return
    nxt = codes[at + 1]
    short = np.isin(nxt, [ord(c) for c in SHORT])
    third = codes[np.minimum(at + 2, n - 1)]
    long = np.zeros(len(at), bool)
    for a, b in LONG:
        long |= (nxt == ord(a)) & (third == ord(b))
    for pos, size in ((at[short], 2), (at[long & ~short], 3)):
        start[pos + 1] = False
        end = pos + size
        end = end[end < n]
        start[end[cls[end] == LETTER]] = True


def split_bytes(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-level pattern: runs of letters, numbers or others, each with one blank before; white space."""
    cls = classes()[codes].copy()
    cls[first[1:] - 1] = 9                                    # sentinels
    start = np.ones(len(codes), bool)
    start[1:] = cls[1:] != cls[:-1]
    last = np.zeros(len(codes), bool)                        # last white character before something else
    last[:-1] = (cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != 9)
    start[last] = True
    blank = np.flatnonzero(last & (codes == 32))
    start[blank + 1] = False
    before = np.ones(len(codes), bool)
    before[1:] = ~(last & (codes == 32))[:-1]
    _apostrophes(codes, cls, start, before)
    return _spans(cls, start)


def split_words(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word pattern: runs of letters or others and single numbers; white space is dropped."""
    cls = classes()[codes].copy()
    cls[first[1:] - 1] = 9
    start = np.ones(len(codes), bool)
    start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == NUMBER)
    upper = (codes >= 65) & (codes <= 90)                    # the pattern sees lower-cased text
    _apostrophes(np.where(upper, codes + 32, codes), cls, start, np.ones(len(codes), bool))
    starts, ends = _spans(cls, start)
    keep = cls[starts] != SPACE
    return starts[keep], ends[keep]


def _spans(cls, start):
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(start))
    keep = cls[starts] != 9
    return starts[keep], ends[keep]


class Grown:
    """Array that grows by doubling."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(max(len(more), len(self.data)), self.data.dtype)))
        self.data[self.n:self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """Token ids of texts, pre-token by pre-token.

    ``split`` finds pre-tokens in plain texts; ``encode_words`` encodes unseen ones;
    ``encode_text`` takes whole texts that hold a code point of ``exotic``;
    ``specials`` are cut out first and stand for their own id.
    """

    def __init__(self, split: Callable, encode_words: Callable[[list[str]], list], encode_text: Callable[[str], list],
                 exotic: Callable[[], np.ndarray], specials: dict[str, int], limit: int = 1_000_000):
        self.split, self.encode_words, self.encode_text = split, encode_words, encode_text
        self.exotic, self.specials, self.limit = exotic(), specials, limit
        self.cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        self._reset()

    def _reset(self):
        self.old, self.old_slot = np.zeros(0, U), np.zeros(0, np.int64)   # sorted keys and their entries
        self.new: dict[int, int] = {}                                     # later entries, folded in now and then
        self.starts, self.lengths, self.flat = Grown(np.int64), Grown(np.int32), Grown(np.int32)

    def _slots(self, keys: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Cache entry of every (sorted, distinct) key; ``words`` gives the pre-tokens at some positions."""
        if self.starts.n + len(keys) > self.limit:
            self._reset()
        out = np.full(len(keys), -1, np.int64)
        if len(self.old):
            at = np.minimum(np.searchsorted(self.old, keys), len(self.old) - 1)
            hit = self.old[at] == keys
            out[hit] = self.old_slot[at[hit]]
        rest = np.flatnonzero(out < 0)
        get = self.new.get
        out[rest] = [get(k, -1) for k in keys[rest].tolist()]
        rest = np.flatnonzero(out < 0)
        if len(rest):
            got = self.encode_words(words(rest))
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            out[rest] = np.arange(self.starts.n, self.starts.n + len(rest))
            self.starts.add(self.flat.n + np.concatenate(([0], np.cumsum(lengths)[:-1])))
            self.lengths.add(lengths)
            self.flat.add(np.fromiter((i for ids in got for i in ids), np.int32, int(lengths.sum())))
            self.new.update(zip(keys[rest].tolist(), out[rest].tolist(), strict=True))
            if len(self.new) > 30_000 + len(self.old) // 16:
                keys = np.concatenate((self.old, np.fromiter(self.new, U, len(self.new))))
                slots = np.concatenate((self.old_slot, np.fromiter(self.new.values(), np.int64, len(self.new))))
                order = np.argsort(keys)
                self.old, self.old_slot, self.new = keys[order], slots[order], {}
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        codes, first = code_points(texts)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(first, np.flatnonzero(self.exotic[codes]), "right") - 1] = True
        starts, ends = self.split(codes, first)
        hashes = span_hashes(codes, starts, ends, code_values())
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        joined = "\0".join([*texts, ""])

        def words(which: np.ndarray) -> list[str]:
            at = where[which]
            return [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

        slots = self._slots(unique, words)[back]
        lengths = self.lengths.data[slots]
        ids = self.flat.data[ragged(self.starts.data[slots], lengths)]
        bounds = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, first)].tolist()
        return [np.asarray(self.encode_text(t), np.int32) if odd[i] else ids[bounds[i]:bounds[i + 1]] for i, t in enumerate(texts)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; None counts as empty."""
        out: list[np.ndarray] = []
        for i, j in chunks(texts):
            some = [t or "" for t in texts[i:j]]
            if not any(s in t for t in some for s in self.specials):
                out += self._plain(some)
                continue
            parts = [self.cut.split(t) for t in some]
            plain = iter(self._plain([p for ps in parts for p in ps[::2]]))
            for ps in parts:
                out.append(np.concatenate([np.asarray([self.specials[p]], np.int32) if k % 2 else next(plain) for k, p in enumerate(ps)]))
        return out
