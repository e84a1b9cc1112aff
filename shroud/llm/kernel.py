"""Vectorised text kernels used inside Arrow batches.

Everything here works on flat numpy arrays made of many texts at once, so a
batch costs a fixed number of numpy calls whatever the number of words in it.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = U(0x9E3779B97F4A7C15)                       # odd: has an inverse modulo 2^64
_P_INV = U(pow(int(_P), -1, 1 << 64))
_Q = U(0xC2B2AE3D27D4EB4F)
CHUNK_CHARS = 1 << 18
_powers = {"p": np.ones(1, U), "q": np.ones(1, U)}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        have = np.full(max(n, 2 * len(have)), base, U)
        have[0] = U(1)
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK_CHARS:
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix style)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of ``symbols[start:end]`` for every span; ``values`` maps a symbol to 64 bits."""
    n = len(symbols)
    total = np.zeros(n + 1, U)
    np.cumsum(values[symbols] * _power("p", _P, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power("q", _P_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(U) * _Q)


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries (``len - size + 1`` of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    m = mix(words + U(salt))
    out = np.zeros(n, U)
    weight = 1
    for j in range(size):
        out += m[j:j + n] * U(weight)
        weight = weight * int(_P) % (1 << 64)
    return mix(out + U(size))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=U) + U(seed))


BYTE_VALUES = _byte_values(0x51ED270B)
LOWER_VALUES = BYTE_VALUES.copy()                # A-Z hash as a-z
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a list of texts (None: no words).

    ``starts``/``ends`` are byte offsets into ``data``; the words of text ``i``
    are ``first[i]:first[i + 1]``.
    """

    def __init__(self, texts: list[str | None], values: np.ndarray = BYTE_VALUES):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join([*raw, b""])
        sym = np.frombuffer(self.data, np.uint8)
        inside = ~_SPACE[sym]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.starts, at)
        self.hashes = span_hashes(sym, self.starts, self.ends, values)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows that lie in one text, and the word each starts at."""
        h = window_hashes(self.hashes, size, salt)
        if not len(h):
            return h, np.zeros(0, np.int64)
        ok = np.flatnonzero(self.doc[:len(h)] == self.doc[size - 1:])
        return h[ok], ok


def chunks(texts: list, limit: int = CHUNK_CHARS):
    """Index ranges of consecutive texts with about ``limit`` characters (one text at least)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= limit):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start+1, .. start+length-1`` of every span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return jump + np.arange(total)
