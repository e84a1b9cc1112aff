"""Language identification by error-correcting output codes (operator 7).

Every language has a codeword; one binary n-gram classifier predicts each bit. The
classifiers' log-odds come from hashed letter 1- to 3-gram counts over all training
documents (summed inside tasks, then by Spark), so the model has
``bits * BUCKETS`` numbers however large the corpus. Decoding adds up each bit's
logistic loss, weighted by how far apart the bit's two sides are, and takes the
nearest codeword; near ties are flagged as ambiguous.

Defined results: ``und`` with score 0 where the text is null or has no letter, or
nothing could be learned; equal texts get equal predictions; equal distances go to
the language that sorts first; rows without doc_id are predicted, never learned from.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.llm.kernel import U, chunks, mix
from shroud.llm.wordpieces import LETTER, classes, code_points

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
MOST_LETTERS = 40      # a long text's evidence counts as that of so many letters
UNSURE = 0.6
UNDETERMINED = "und"


@functools.cache
def _folded() -> np.ndarray:
    """Lower-case letter of every code point, 0 for all that are no letters."""
    letter = classes() == LETTER
    out = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def _grams(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every letter of the texts, which text it is in, and the buckets of the 1-, 2- and 3-gram around it."""
    codes, first = code_points([t or "" for t in texts])
    m = _folded()[codes]
    at = np.flatnonzero(m)
    doc = np.searchsorted(first, at, "right") - 1
    pad = np.concatenate(([0], m, [0])).astype(np.uint32)
    here, before, after = pad[at + 1], pad[at], pad[at + 2]
    shift = np.uint32(32 - BUCKET_BITS)
    one = here * np.uint32(0x9E3779B1)
    two = (one ^ (after * np.uint32(0x85EBCA6B) + np.uint32(1))) * np.uint32(0xC2B2AE35)
    three = (two ^ (before * np.uint32(0x27D4EB2F) + np.uint32(7))) * np.uint32(0x165667B1)
    return doc, [(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for x in (one, two, three)]


def train_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: a doc_id whose checksum is not the held-out one, and a language."""
    return docs.where(F.col("lang").isNotNull() & ~held_out())


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is 2 modulo 4 (null ids: true here, so that they are not learned from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text)."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                doc, grams = _grams(texts[i:j])
                names, code = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    mine = (code == k)[doc]
                    have = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                    for g in grams:
                        have += np.bincount(g[mine], minlength=BUCKETS)
        for name, have in total.items():
            used = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(have[used])], ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(languages: int) -> np.ndarray:
    """+1/-1 matrix, one row per language: all splits in two for few languages, else well-spread fixed ones."""
    if languages <= 6:
        rows = [(1, *rest) for rest in itertools.product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(rows, np.int8).reshape(-1, languages).T
    bits = 12 * math.ceil(math.log2(languages))
    draw = mix(np.arange(bits * languages, dtype=U) + U(77)).reshape(bits, languages)
    half = np.argsort(draw, axis=1).argsort(axis=1) < languages // 2
    return np.where(half, 1, -1).astype(np.int8).T


class Model:
    """Log-odds per bit and bucket, codewords and bit weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.words = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 0), np.int8)
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
        self.odds, apart = np.zeros((self.words.shape[1], BUCKETS), np.float32), []
        for b in range(self.words.shape[1]):
            yes, no = (share[self.words[:, b] == s].mean(0) for s in (1, -1))
            self.odds[b] = np.log(yes / no)
            apart.append(float(((yes - no) * self.odds[b]).sum()))
        self.weights = np.array(apart) / (np.mean(apart) or 1) if apart else np.zeros(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of every text."""
        doc, grams = _grams(texts)
        letters = np.bincount(doc, minlength=len(texts))
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), letters > 0
        evidence = np.zeros((len(texts), len(self.weights)))
        has = np.flatnonzero(letters)
        if len(has):
            edges = np.searchsorted(doc, has)
            for b, odds in enumerate(self.odds):
                evidence[has, b] = np.add.reduceat(odds[grams[0]] + odds[grams[1]] + odds[grams[2]], edges, dtype=np.float64)
        evidence *= (np.minimum(letters, MOST_LETTERS) / np.maximum(letters, 1))[:, None]
        loss = np.logaddexp(0, -evidence[:, None, :] * self.words[None]) * self.weights
        near = np.exp(-(d := loss.sum(2)) + d.min(1, keepdims=True))
        best, score = d.argmin(1), near.max(1) / near.sum(1)
        score[letters == 0] = 0
        return [self.languages[k] if n else UNDETERMINED for k, n in zip(best, letters, strict=True)], score, score < UNSURE


def fit(docs: DataFrame) -> Model:
    """Model from all rows of (lang, text) with a language; languages * BUCKETS counts come to the driver."""
    rows = gram_counts(docs.where(F.col("lang").isNotNull())).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in rows["lang"]] if len(rows) < 1000 else rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(), rows["bucket"].to_numpy()] = rows["n"]
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` with lang_pred, score and ambiguous added; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bits * BUCKETS numbers
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    docs = docs.select(*kept)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores, flags = [], [], []
            for i, j in chunks(texts):
                n, s, f = shared.value.predict(texts[i:j])
                names += n
                scores.append(s)
                flags.append(f)
            scores, flags = np.concatenate([*scores, np.zeros(0)]), np.concatenate([*flags, np.zeros(0, bool)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(flags)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(run, out)
