"""Quality classifier by an interpolated modified Kneser-Ney n-gram model (operator 2).

The model is of characters (white space as one blank, numbers as one digit), order 4,
trained on the trusted documents but every fifth one; those fifths, held out, give
each language's quantiles of the whole text's perplexity and of that of its worst
window of ``WINDOW`` characters. A document over either limit is rejected: a few
strange words, which a long text's mean hides, are in a window of their own.

Counts are summed per block of documents and then by Spark; all tables of the model
are sharded by n-gram. For scoring, each block sends every distinct n-gram that it has
once to the n-gram's shard, the distinct n-grams are joined with the model's counts
and contexts, and the log probabilities go back to the blocks that asked. Neither the
model nor the texts pass through the driver or one task; the driver gets the
counts-of-counts (at most 16 numbers) and one threshold per language.

Defined results: null text counts as empty; empty texts have no perplexity and are
kept; documents without a language, or with one that has under ``FEW`` held-out
trusted documents, are judged by the quantile over all languages; without any trusted
text everything is kept; repeated rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm import exchange as X
from shroud.llm.kernel import U, chunks, mix
from shroud.llm.memory import lean
from shroud.llm.storage import stored
from shroud.llm.wordpieces import NUMBER, SPACE, classes

ORDER = 4
START = 1
QUANTILE = 0.995
SLACK = 1.05       # a threshold is so many times the quantile: a held-out part is only a sample
SHRINK = 60        # short texts: so many characters at the language's mean are added
FEW = 20
WINDOW = 8
WINDOW_SLACK = 1.15  # the same for worst windows, whose tail a sample bounds less well


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of all texts (16 bits a character, oldest first) and the text each is in."""
    lead = chr(START) * (ORDER - 1)
    texts = [t or "" for t in texts]
    codes = np.frombuffer("".join(lead + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = classes()[codes]
    s = (codes & 0xFFFF).astype(U)
    s[s <= START] = 2
    s[cls == SPACE] = 32
    s[cls == NUMBER] = 48
    n = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(n + ORDER - 1) - n - (ORDER - 1)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) + (doc + 1) * (ORDER - 1)
    for j in range(ORDER - 1):
        s[begin + j] = START
    return (s[at - 3] << U(48)) | (s[at - 2] << U(32)) | (s[at - 1] << U(16)) | s[at], doc


def _parts(docs: pa.Table):
    texts = docs.column("text").to_pylist()
    for i, j in chunks(texts):
        yield i, _grams(texts[i:j])


def _merged(parts) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, n, len(keys)).astype(np.int64)


def trained_counts(placed: DataFrame, trusted: DataFrame, blocks: int) -> DataFrame:
    """(gram, n) of the trusted documents; ``placed``: documents in blocks."""
    ids = trusted.select(X.block_of(F.col("doc_id"), blocks).alias("block"), "doc_id")

    def count(table, ids):
        docs = X.dealt(table)
        if docs is None or not ids.num_rows:
            return pa.table({"gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        mine = np.isin(X.ids(docs.column("doc_id")), X.ids(ids.column("doc_id")))
        docs = docs.filter(pa.array(mine))
        found = [np.unique(g, return_counts=True) for _, (g, _) in _parts(docs)]
        keys, n = _merged(found) if found else (np.zeros(0, U), np.zeros(0, np.int64))
        return pa.table({"gram": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    return placed.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(lean(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, size: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (16 * size)) - 1))


def count_tables(counts: DataFrame) -> dict[int, DataFrame]:
    """By order, (gram, n): the counts for the highest, for the others how many characters precede the gram."""
    tables = {ORDER: stored(counts, "grams4")}
    for size in range(ORDER - 1, 0, -1):
        lower = tables[size + 1].groupBy(_suffix(F.col("gram"), size).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables[size] = stored(lower, f"grams{size}")
    return tables


def discounts(tables: dict[int, DataFrame]) -> dict[int, list[float]]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, by order."""
    out = {}
    for size, t in tables.items():
        c = {r["n"]: r["k"] for r in t.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}  # at most 4 rows
        c = [max(c.get(i, 0), 1) for i in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1])
        out[size] = [min(max(i + 1 - (i + 2) * y * c[i + 1] / c[i], 0.05), i + 0.95) for i in range(3)]
    return out


def log_probabilities(asked: DataFrame, tables: dict[int, DataFrame], cut: dict[int, list[float]]) -> DataFrame:
    """Adds ``p``, the natural log of the interpolated probability, to rows with a distinct ``gram``."""
    p: Column | None = None
    top = tables[1].agg(F.sum("n"), F.count(F.lit(1))).first()
    total, letters = top[0] or 0, top[1]
    for size in range(1, ORDER + 1):
        d = cut[size]
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        t = tables[size].select(F.col("gram").alias("_g"), (F.col("n") - less).alias("_a"), "n")
        asked = asked.join(t.select("_g", F.col("_a").alias(f"_a{size}")), _suffix(F.col("gram"), size) == F.col("_g") if size < ORDER else F.col("gram") == F.col("_g"), "left").drop("_g")
        held = F.sum(F.col("n") - F.col("_a"))
        if size == 1:
            left = float(t.agg(held).first()[0] or 0)
            base = (left / total if total else 1.0) / (letters + 1)
            p = F.coalesce(F.col("_a1") / max(total, 1), F.lit(0.0)) + base
            continue
        context = F.shiftrightunsigned("_g", 16)
        s = t.groupBy(context.alias("_h")).agg(F.sum("n").alias(f"_t{size}"), held.alias(f"_w{size}"))
        mine = _suffix(F.shiftrightunsigned("gram", 16), size - 1)
        asked = asked.join(s, mine == F.col("_h"), "left").drop("_h")
        p = F.when(F.col(f"_t{size}").isNull(), p).otherwise((F.coalesce(f"_a{size}", F.lit(0.0)) + F.col(f"_w{size}") * p) / F.col(f"_t{size}"))
    return asked.withColumn("p", F.log(p)).select("shard", "gram", "p")


def scores(placed: DataFrame, tables: dict[int, DataFrame], shards: int) -> DataFrame:
    """(doc_id, lang, n, nll, worst): characters, negative log probability and worst window's mean of every document (null: too short)."""
    cut = discounts(tables)

    def ask(key, table):
        keys = np.unique(np.concatenate([np.unique(g) for _, (g, _) in _parts(X.dealt(table))]))
        shard = (mix(keys) % U(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        keys, shard = keys[order], shard[order]
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        parts = [X.squeeze(k) for k in np.split(keys, first[1:])] if len(keys) else []
        return pa.table({"shard": pa.array(shard[first]), "block": pa.array([key[0].as_py()] * len(first), pa.int32()), "keys": pa.array(parts, pa.binary())})

    asked = placed.groupBy("block").applyInArrow(lean(ask), X.REQUESTS)

    def distinct(key, table):
        keys = np.unique(np.concatenate([X.unsqueeze(k.as_py()) for k in table.column("keys")]))
        return pa.table({"shard": pa.array(np.full(len(keys), key[0].as_py(), np.int32)), "gram": pa.array(keys.view(np.int64))})

    known = log_probabilities(asked.groupBy("shard").applyInArrow(lean(distinct), "shard int, gram long"), tables, cut)

    def answer(requests, known):
        grams, p = known.column("gram").to_numpy().view(U), known.column("p").to_numpy()
        order = np.argsort(grams)
        grams, p = grams[order], p[order].astype("<f4")
        pack = zstandard.ZstdCompressor(level=1).compress
        values = [pack(p[np.searchsorted(grams, X.unsqueeze(k.as_py()))].tobytes()) for k in requests.column("keys")]
        return pa.table({"block": requests.column("block"), "keys": requests.column("keys"), "p": pa.array(values, pa.binary())})

    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(lean(answer), "block int, keys binary, p binary")

    def score(table, answers):
        docs = X.dealt(table)
        if docs is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "nll": pa.array([], pa.float64()), "worst": pa.array([], pa.float64()), "text_hash": pa.array([], pa.int64())})
        unpack = zstandard.ZstdDecompressor().decompress
        keys = np.concatenate([*(X.unsqueeze(k.as_py()) for k in answers.column("keys") if k.is_valid), np.zeros(0, U)])
        p = np.concatenate([*(np.frombuffer(unpack(k.as_py()), "<f4") for k in answers.column("p") if k.is_valid), np.zeros(0, "<f4")])
        order = np.argsort(keys)
        keys, p = keys[order], p[order]
        n, nll, worst = [], [], []
        for low, (g, doc) in _parts(docs):
            size = int(doc.max()) + 1 if len(doc) else 0
            n.append((low, np.bincount(doc, minlength=size)))
            each = -p[np.searchsorted(keys, g)].astype(np.float64)
            nll.append((low, np.bincount(doc, each, size)))
            sums = np.concatenate((np.zeros(1), np.cumsum(each)))
            inside = np.flatnonzero(doc[WINDOW - 1:] == doc[:max(0, len(doc) - WINDOW + 1)])
            most = np.full(size, np.nan)
            np.fmax.at(most, doc[inside], (sums[inside + WINDOW] - sums[inside]) / WINDOW)
            worst.append((low, most))
        out = [np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows), np.full(docs.num_rows, np.nan)]
        for k, parts in enumerate((n, nll, worst)):
            for low, x in parts:
                out[k][low:low + len(x)] = x
        return pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n": pa.array(out[0]), "nll": pa.array(out[1]), "worst": pa.array(out[2], from_pandas=True), "text_hash": docs.column("text_hash")})

    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(score), "doc_id long, lang string, n long, nll double, worst double, text_hash long")


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(5)) == 0


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per row of (doc_id, text, lang): doc_id, lang, n_chars, perplexity, limit, worst (window's perplexity), worst_limit, keep,
    text_hash (with doc_id and lang it tells rows of one doc_id apart).

    Trusted are the documents that ``labels`` (doc_id, quality, toxic) calls good and not toxic.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang", F.xxhash64("text").alias("text_hash"))
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long")).distinct()
    blocks, shards = X.sizes(docs)
    shards = max(X.partitions(docs), shards // 16)
    placed = X.deal(docs, blocks)
    tables = count_tables(trained_counts(placed, trusted.where(~_held_out(F.col("doc_id"))), blocks))
    scored = stored(scores(placed, tables, shards), "scores")
    sample = scored.join(trusted.where(_held_out(F.col("doc_id"))), "doc_id", "left_semi").where("n > 0")
    means = {r["lang"]: (r["nll"] / r["n"], r["k"]) for r in sample.groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}  # one row a language
    every = sample.agg(F.sum("nll"), F.sum("n")).first()
    if not every[1]:
        return scored.select("doc_id", "lang", F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))).alias("perplexity"), F.lit(None).cast("double").alias("limit"), F.exp("worst").alias("worst"), F.lit(None).cast("double").alias("worst_limit"), F.lit(True).alias("keep"), "text_hash")
    usual = every[0] / every[1]
    known = {k: m for k, (m, n) in means.items() if k is not None and n >= FEW}
    spark = docs.sparkSession

    def judged(df, own):
        mean = F.coalesce(own["_mean"], F.lit(usual))
        return (F.col("nll") + SHRINK * mean) / (F.col("n") + SHRINK)

    rows = spark.createDataFrame([(k, m) for k, m in known.items()], "lang string, _mean double")
    adjusted = lambda df: (j := df.join(F.broadcast(rows), "lang", "left")).withColumn("_x", judged(j, j))  # noqa: E731  one row a language
    over = adjusted(sample)
    quantiles = [F.percentile_approx(c, quantile, 10_000).alias(q) for c, q in (("_x", "_q"), ("worst", "_w"))]
    limits = over.where("_mean IS NOT NULL").groupBy("lang").agg(*quantiles).collect()
    pooled = over.agg(*quantiles).first()
    table = spark.createDataFrame([tuple(r) for r in limits], "lang string, _q double, _w double")
    out = adjusted(scored).join(F.broadcast(table), "lang", "left")
    limit = F.coalesce("_q", F.lit(pooled["_q"])) * SLACK
    worst = F.coalesce("_w", F.lit(pooled["_w"]).cast("double")) * WINDOW_SLACK
    return out.select("doc_id", "lang", F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))).alias("perplexity"), F.exp(limit).alias("limit"),
                      F.exp("worst").alias("worst"), F.exp(worst).alias("worst_limit"), ((F.col("_x") <= limit) & F.coalesce(F.col("worst") <= worst, F.lit(True))).alias("keep"), "text_hash")
