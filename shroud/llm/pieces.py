"""SentencePiece BPE encoding and decoding (operator 11): vectorised merge rounds.

All distinct words of a chunk of texts lie in one flat array of symbols. A round finds
the least pair rank of every word (a segmented minimum), merges that pair at its
leftmost places in all words at once, and compacts the array; words without a pair
leave it. Rounds go on until no word is left. Within a word a round merges all
occurrences of its least pair, from the left and without overlaps, up to the first one
whose new neighbours make a pair that would come before the next occurrence; so the
order is exactly that of one merge at a time, best score first and leftmost of equals.

A word here is a stretch that merges cannot leave: texts are cut between characters
that stand side by side in no piece, long stretches wherever no occurrence of a piece
lies across, and runs of blanks behind each longest blank piece. Ids of words are kept
in a cache of bounded size in every worker. Characters without a piece become bytes.

Defined results: null text encodes like the empty one (the end id alone, if asked for);
equal texts give equal ids; rows and extra columns pass through; names that clash with
the output columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shroud.llm.bpe import _add, _replaced, lists
from shroud.llm.kernel import ragged, span_hashes
from shroud.llm.wordpieces import Encoder, code_values

BLANK = "▁"
LONG = 48
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2          # types of pieces, and of models (fixed values)
NONE = 1 << 30
codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class PieceBpe:
    """Pieces, scores and pairs of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != BPE or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("a model that only marks blanks is needed")
        if {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.n = len(spec.pieces)
        self.end_id = next(i for i, p in enumerate(spec.pieces) if p.type == CONTROL and p.piece == (spec.trainer_spec.eos_piece or "</s>"))
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.byte_ids = np.array([i for i, p in enumerate(spec.pieces) if p.type == BYTE])
        self._pairs(normal, np.array([p.score for p in spec.pieces]))
        self._borders(normal)
        self._surfaces(spec)

    def _pairs(self, normal: dict[str, int], scores: np.ndarray) -> None:
        """Symbols are piece ids; ``n + c`` stands for a character c without a piece."""
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.n
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.span = self.n + 0x110000
        of = lambda s: int(self.symbol[ord(s)]) if len(s) == 1 else normal.get(s, -1)
        better = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        found = [(a * self.span + b, better[scores[i]], i) for piece, i in normal.items() for k in range(1, len(piece))
                 if (a := of(piece[:k])) >= 0 and (b := of(piece[k:])) >= 0]
        keys, rank, made = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True))
        self.keys, self.rank, self.made = keys, np.append(rank, NONE), np.append(made, -1)

    def _borders(self, normal: dict[str, int]) -> None:
        """What tells where a merge can never reach."""
        used = sorted({c for p in normal if len(p) > 1 for c in p})
        self.column = np.zeros(0x110000, np.int64)               # 0: in no piece of several characters
        self.column[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        beside = np.zeros(self.width * self.width, bool)
        for p in normal:
            if len(p) > 1:
                at = self.column[[ord(c) for c in p]]
                beside[at[:-1] * self.width + at[1:]] = True
        self.beside = np.packbits(beside)
        longer = [p for p in normal if len(p) > 1]
        self.sizes = sorted({len(p) for p in longer})
        codes = np.frombuffer("".join(longer).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in longer])
        self.hashes = np.sort(span_hashes(codes, ends - [len(p) for p in longer], ends, code_values()))
        blanks = [p for p in normal if not p.strip(BLANK)]
        self.blanks = max(map(len, blanks), default=0)
        worst = self.rank[:-1].max()
        ok = not any(BLANK * 2 in p and p.strip(BLANK) for p in normal)
        ok &= all(self.rank[np.flatnonzero(self.made == normal[p])[0]] == worst for p in blanks if len(p) > 1)
        k = self.blanks
        if k > 1 and not (ok and all(self.encode_words([BLANK * m])[0] == [normal[BLANK * k], *self.encode_words([BLANK * (m - k)])[0]] for m in range(k + 1, 3 * k))):
            self.blanks = 0                                      # other models: such runs stay whole

    def _surfaces(self, spec) -> None:
        texts = []
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                texts.append(bytes([int(np.flatnonzero(self.byte_ids == i)[0])]))
            elif p.type == NORMAL:
                texts.append(p.piece.replace(BLANK, " ").encode())
            else:
                texts.append(spec.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else b"")
        self.control = np.array([p.type == CONTROL for p in spec.pieces])
        self.opens = np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in spec.pieces])
        self.lengths = np.array([len(t) for t in texts])
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def split(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word in texts that each end with a sentinel."""
        start = np.ones(len(codes), bool)
        at = self.column[codes]
        pair = at[:-1] * self.width + at[1:]
        start[1:] = (self.beside[pair >> 3] >> (7 - (pair & 7))) & 1 == 0
        last = first[1:] - 1                                     # sentinels
        start[last] = True
        start[first[1:-1]] = True
        if self.blanks:
            blank = codes == ord(BLANK)
            runs = np.flatnonzero(blank & np.append(True, ~blank[:-1] | start[1:]))
            if len(runs):
                nth = np.arange(len(codes)) - runs[np.maximum(np.searchsorted(runs, np.arange(len(codes)), "right") - 1, 0)]
                start[blank & (nth % self.blanks == 0)] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(codes))
        for k in np.flatnonzero(ends - starts > LONG).tolist():
            a, b = int(starts[k]), int(ends[k])
            start[a + 1:b] = self._uncovered(codes[a:b])
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(codes))
        keep = np.ones(len(starts), bool)
        keep[np.searchsorted(starts, last)] = False
        return starts[keep], ends[keep]

    def _uncovered(self, codes: np.ndarray) -> np.ndarray:
        """For each place between two characters, whether no occurrence of a piece lies across it."""
        cover = np.zeros(len(codes) + 1, np.int64)
        for size in self.sizes:
            if size > len(codes):
                break
            at = np.arange(len(codes) - size + 1)
            h = span_hashes(codes, at, at + size, code_values())
            at = at[self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h]
            cover[at + 1] += 1                                   # at most once for each size
            cover[at + size] -= 1
        return np.cumsum(cover)[1:len(codes)] == 0

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair of symbols; the last one stands for none."""
        key = a * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words; words are numbered in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(sym), len(self.keys))                 # of each symbol with the next one of its word
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self._lookup(sym[inner], sym[inner + 1])
        while len(sym):
            rank = self.rank[pair]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)             # segmented minimum
            over = least == NONE
            if over.any():                                       # compaction: words without a pair leave
                gone = np.repeat(over, size)
                done.append((sym[gone], word[gone]))
                sym, word, pair, rank = sym[~gone], word[~gone], pair[~gone], rank[~gone]
                least, size = least[~over], size[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[self._every_other(at)]
            made = self.made[pair[at]]
            at, made = self._in_order(sym, word, rank, at, made)
            sym[at] = made
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, pair = sym[stay], word[stay], pair[stay]
            new = at - np.arange(len(at))
            touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
            pair[touched] = len(self.keys)
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            pair[touched] = self._lookup(sym[touched], sym[touched + 1])
        sym, word = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    @staticmethod
    def _every_other(at: np.ndarray) -> np.ndarray:
        """Of places side by side the first, third, ..."""
        head = np.append(True, np.diff(at) != 1)
        return (np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))) % 2 == 0

    def _in_order(self, sym, word, rank, at, made) -> tuple[np.ndarray, np.ndarray]:
        """Of each word's merges those up to the first whose new neighbours pair before the next merge."""
        n, own, limit = len(sym), word[at], rank[at]
        more = np.append(own[1:] == own[:-1], False)             # only then the order matters
        if not more.any():
            return at, made
        left = np.where((at > 0) & (word[at - 1] == own), at - 1, -1)
        before = sym[left]
        joined = np.append(False, (at[1:] - at[:-1] == 2) & (own[1:] == own[:-1]))
        before[joined] = made[np.flatnonzero(joined) - 1]
        right = np.minimum(at + 2, n - 1)
        ahead = (at + 2 < n) & (word[right] == own)
        soon = (left >= 0) & (self.rank[self._lookup(before, made)] <= limit)
        soon |= ahead & (self.rank[self._lookup(made, sym[right])] <= limit)
        count = np.cumsum(soon) - soon
        head = np.append(True, own[1:] != own[:-1])
        keep = count == count[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        return at[keep], made[keep]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word = self.rounds(self.symbol[codes], np.repeat(np.arange(len(words)), [len(w) for w in words]))
        raw = {c: self.byte_ids[list(chr(c - self.n).encode("utf-8", "surrogatepass"))] for c in np.unique(sym[sym >= self.n]).tolist()}
        if raw:                                                  # characters without a piece: their bytes
            size = np.ones(len(sym), np.int64)
            size[sym >= self.n] = [len(raw[c]) for c in sym[sym >= self.n].tolist()]
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            out = np.repeat(sym, size)
            for k in np.flatnonzero(sym >= self.n).tolist():
                out[at[k]:at[k] + size[k]] = raw[int(sym[k])]
            sym, word = out, np.repeat(word, size)
        ids, cuts = sym.tolist(), np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        control = self.control[ids]
        told = ids[~control]
        data = self.flat[ragged(self.offsets[told], self.lengths[told])].tobytes()
        skip = int(len(told) > 0 and self.opens[told[0]])        # the blank put before every text
        inner = np.flatnonzero(control)[:-1] if len(ids) and control[-1] else np.flatnonzero(control)
        if not len(inner):
            return data[skip:].decode("utf-8", "one_byte")
        size = np.concatenate(([0], np.cumsum(np.where(control, 0, self.lengths[ids]))))
        cuts = [skip, *(max(skip, int(c)) for c in size[inner]), len(data)]   # bytes on both sides of a control id don't join
        return "".join(data[a:b].decode("utf-8", "one_byte") for a, b in zip(cuts, cuts[1:], strict=False))


@functools.lru_cache(maxsize=2)
def _model(path: str) -> PieceBpe:
    return PieceBpe(path)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    model = _model(path)
    return Encoder(model.split, model.encode_words, lambda text: [], lambda: np.zeros(0x110000, bool), {})


def marked(text: str | None) -> str:
    """A text as pieces see it: blanks shown, one put before."""
    return (BLANK + text.replace(" ", BLANK)) if text else ""


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", end: bool = True) -> DataFrame:
    """Adds ``out`` array<int>: the ids of ``text`` under the model at ``path``, with its end id if asked for."""

    def run(batches):
        encoder, model = _encoder(path), _model(path)
        tail = np.array([model.end_id] * end, np.int32)
        for batch in batches:
            ids = encoder.encode([marked(t) for t in batch.column(text).to_pylist()])
            yield _add(batch, out, lists([np.append(x, tail) for x in ids]))

    return df.mapInArrow(run, _replaced(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` string: the text of ``ids`` (null: empty); bytes that are no UTF-8 become U+FFFD."""
    import pyarrow as pa

    def run(batches):
        model = _model(path)
        for batch in batches:
            col = batch.column(ids)
            texts = [model.decode(np.asarray(col[i].values if col[i].is_valid else [], np.int64)) for i in range(len(col))]
            yield _add(batch, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _replaced(df, out, T.StringType()))
