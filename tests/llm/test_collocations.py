"""Collocations against a plain count."""
import random
import re
from collections import Counter, defaultdict

import numpy as np

from shroud.llm import collocations as C
from shroud.llm.kernel import U


def lower(t):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")


def plain(rows, least, most, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by the contract's words."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        c = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in c.items():
            score, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in c.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, left, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, r, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_tiles_add_up():
    r = np.random.default_rng(3)
    a = np.concatenate((r.integers(0, 600, 40_000), r.zipf(1.3, 20_000) % 100_000, [2 ** 33 - 1] * 3))
    b = np.concatenate((r.integers(0, 100, 40_000), r.zipf(1.3, 20_000) % 100_000, [2 ** 31 - 1] * 3))
    want = Counter(zip(a.tolist(), b.tolist(), strict=True))
    keys, sums = C.tiled(a, b)
    assert (np.diff(keys.astype(object)) > 0).all()
    x, y = C.split_key(keys)
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), sums.tolist(), strict=True)) == want
    n = r.integers(1, 1 << 48, len(a))
    keys, sums = C.tiled(a, b, n)
    total = Counter()
    for p, q, w in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        total[p, q] += w
    x, y = C.split_key(keys)
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), sums.tolist(), strict=True)) == total
    assert len(C.tiled(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0
    assert len(set(C.shard_of((np.arange(256, dtype=U) << U(31)) | U(7), 50).tolist())) == 1


def test_words():
    words, n, tokens = C.words_of(["A b\tb. B,c", None, "", " \n", "É é a b \u0085"])
    assert dict(zip(words, n.tolist(), strict=True)) == {"a": 1, "b": 3, "c": 1, "É": 1, "é": 1, "a b": 1, "\u0085": 1}
    shown = ["|" if t < 0 else words[t] for t in tokens.tolist()]
    assert shown == ["|", "a", "b", "b", "|", "b", "|", "c", "|", "É", "é", "a b", "\u0085"]
    assert C.words_of([None, "", ". ."])[0] == []


def corpus(n=400):
    r = random.Random(7)
    pool = ["New", "york", "city", "of", "the", "a", "É", "x" * 300, "Hot", "dog", "stand", "中文"]
    texts = ["".join(r.choice(pool) + r.choice([" ", " ", " ", "\t", ". ", "\n", ", "]) for _ in range(r.randrange(60))) for _ in range(n)]
    texts += ["the city of new york. The City of New York"] * 30 + [None, "", " ", "a " * 5000, "aa aa aa"] * 3
    return [(t, r.choice(["en", "en", "de", None, "und"])) for t in texts]


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 3)                             # a tree of several levels
    rows = corpus()
    df = spark.createDataFrame([(*r, "w", 1, "k") for r in rows], "text string, lang string, words string, n int, keys string").repartition(5)
    read = C.read_words
    monkeypatch.setattr(C, "read_words", lambda docs: read(docs, 2000))
    assert got(C.mine(df, least=3)) == plain(rows, 3, 3)
    assert got(C.mine(df, least=10, top=5)) == plain(rows, 10, 3, 5)


def test_longer_phrases(spark):
    rows = corpus(60)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert got(C.mine(df, least=4, max_words=5)) == plain(rows, 4, 5)


def test_scores_past_64_bits(spark):
    big = [("en", ["a"], 10 ** 12), ("en", ["b"], 10 ** 12 - 1), ("en", ["a", "b"], 10 ** 12 - 7)]
    r = C.scored(spark.createDataFrame(big, "lang string, words array<string>, f long")).first()
    assert r.score == 1000000 * (10 ** 12 - 7) ** 2 // (10 ** 12 * (10 ** 12 - 1))


def test_nothing(spark):
    assert C.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.mine(spark.createDataFrame([(None, "en"), ("", None)], "text string, lang string")).count() == 0
