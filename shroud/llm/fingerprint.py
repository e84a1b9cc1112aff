"""Order MinHash fingerprints in DataFrame functions only (operator 3).

The symbols are the text's runs without white space. Runs of more than 16 characters
(unspaced scripts, encoded data) are cut by their content, before every UTF-16 unit
that divides by 4 and after 16 units without one, so that an inserted character moves
the cuts only up to the next such unit. A k-mer is ``K`` consecutive symbols, numbered
by occurrence. Every numbered k-mer falls into one
of ``SKETCHES`` sketches by its hash; of each sketch the ``TUPLE`` smallest are kept,
put back into text order and hashed together. Two texts agree in a sketch if they have
the same smallest numbered k-mers in the same order, which small edits leave alone and
moved passages do not; likeness is the share of agreeing sketches.

All steps work on one row's arrays: packed longs (hash and position) are sorted by
the built-in sort, so no k-mer is ever a row.

Defined results: null counts as empty; an empty text has no sketches and is like
another empty text only; a text with fewer than ``K`` symbols is one k-mer; equal
texts have equal fingerprints; rows that share a doc_id follow each other by text; a
null doc_id comes after all others; the only document's next one is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
SKETCHES = 32
TUPLE = 2
POS_BITS = 27
HASH_BITS = 36
RANK_BITS = 31
SPARE = 6               # smallest k-mers looked at first, times what is needed
LONG = 16               # characters of a run that is one symbol
#: A unit and up to 15 that don't divide by 4, in hexadecimal digits
PIECE = rf"[0-9A-F]{{4}}(?:[0-9A-F]{{3}}[^048C]){{0,{LONG - 1}}}"


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _pack(h: Column, at: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)), POS_BITS).bitwiseOR(at.cast("long"))


def _gram(x: Column) -> Column:
    return F.shiftright(x, POS_BITS)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POS_BITS) - 1))


def _symbols(text: Column) -> Column:
    """Hashes of a text's symbols."""
    every = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    hashes = lambda parts: F.transform(parts, lambda t: F.xxhash64(t))
    cut = lambda run: F.when(F.char_length(run) <= LONG, F.array(F.xxhash64(run))).otherwise(hashes(every(F.hex(F.encode(run, "UTF-16BE")), PIECE)))
    # No run of at most 16 bytes has more characters: most texts need no second look
    return let(every(text, r"\S+"), lambda runs: F.when(F.exists(runs, lambda t: F.octet_length(t) > LONG), F.flatten(F.transform(runs, cut))).otherwise(hashes(runs)))


def _grams(text: Column, k: int) -> Column:
    """Sorted (k-mer hash, position) of a text."""
    symbols = _symbols(F.coalesce(text, F.lit("")))
    return F.sort_array(let(symbols, lambda h: F.when(
        F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: _pack(F.xxhash64(*(F.get(h, i + j) for j in range(k))), i)),
    ).when(F.size(h) > 0, F.array(_pack(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))))


def _occurrence(s: Column, x: Column, i: Column, steps: Column) -> Column:
    """How many equal k-mers stand before index ``i`` of the sorted array, found by halving steps."""
    same = lambda at: _gram(F.get(s, at)) == _gram(x)
    far = F.aggregate(steps, F.lit(0), lambda d, step: F.when(same(i - d - step), d + step).otherwise(d))
    return F.when((i > 0) & same(i - 1), far).otherwise(F.lit(0))


def _numbered(s: Column, sketches: int) -> Column:
    """(sketch, rank, position) packed, of every numbered k-mer."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(F.size(s), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))
    shift = 64 - RANK_BITS

    def one(x, i, steps):
        return let(F.xxhash64(_gram(x), _occurrence(s, x, i, steps)), lambda p: F.shiftleft(F.pmod(p, F.lit(sketches)), RANK_BITS + POS_BITS)
                   .bitwiseOR(F.shiftleft(F.shiftrightunsigned(p, shift), POS_BITS)).bitwiseOR(_position(x)))

    return let(steps, lambda st: F.transform(s, lambda x, i: one(x, i, st)))


def _rank(x: Column) -> Column:
    return F.shiftright(x, POS_BITS).bitwiseAND(F.lit((1 << RANK_BITS) - 1))


def _sketch(x: Column) -> Column:
    return F.shiftright(x, RANK_BITS + POS_BITS)


def _least(keys: Column, each: int) -> Column:
    """The ``each`` smallest keys of every sketch."""
    return let(F.sort_array(keys), lambda s: F.filter(s, lambda x, i: F.coalesce(_sketch(F.get(s, i - each)) != _sketch(x), F.lit(True))))


def _tuple_hash(members: Column) -> Column:
    """Hash of a sketch's k-mers in text order; null if it has none."""
    by_position = F.sort_array(F.transform(members, lambda x: F.shiftleft(_position(x), RANK_BITS).bitwiseOR(_rank(x))))
    return F.when(F.size(members) > 0, F.xxhash64(F.transform(by_position, lambda x: x.bitwiseAND(F.lit((1 << RANK_BITS) - 1)))).bitwiseAND(F.lit(0xFFFFFFFF)))


def sketches(text: Column, k: int = K, count: int = SKETCHES, each: int = TUPLE) -> Column:
    """array<long> with one tuple hash per sketch, null where the text has too few k-mers for any."""
    bound = lambda s: F.lit(float(1 << RANK_BITS)) * SPARE * count * each / F.greatest(F.size(s), F.lit(1))

    def chosen(keys):
        few = let(bound(keys), lambda b: _least(F.filter(keys, lambda x: _rank(x) < b), each))
        return let(few, lambda f: F.when(F.size(f) == count * each, f).otherwise(_least(keys, each)))

    kept = let(let(_grams(text, k), lambda s: _numbered(s, count)), chosen)
    return let(kept, lambda m: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: _tuple_hash(F.filter(m, lambda x: _sketch(x) == b))))


def printed(sketch: Column) -> Column:
    """Fingerprint string: eight hex digits a sketch, dashes for none."""
    return F.concat_ws("", F.transform(sketch, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 8, "0")), F.lit("--------"))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches that agree, of those that either text has; 1 for two empty texts."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda v: v.isNotNull()))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: F.coalesce(v, F.lit(False))))
    return F.when(either > 0, equal.cast("double") / either).otherwise(F.lit(1.0))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds next_text and next_sketches: those of the next document by descending doc_id, after the last the first's.

    Documents are dealt into ranges of doc_id by quantiles (``ranges`` numbers), so one
    range is one task's sort. Each range also gets a copy of the first document of the
    range below it; those are one document per range.
    """
    spark = docs.sparkSession
    ranges = ranges or min(8192, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []))
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + wide] for i in range(0, len(cuts), wide)] or [[]]
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col("doc_id")))
    tops = F.array(*(F.lit(g[-1]).cast("long") for g in groups if g)) if cuts else F.array().cast("array<bigint>")
    inner = F.array(*(F.array(*(F.lit(c).cast("long") for c in g)) for g in groups)) if cuts else F.array(F.array().cast("array<bigint>"))
    coarse = below(tops)
    spot = F.coalesce(coarse * wide + F.coalesce(below(F.get(inner, coarse)), F.lit(0)), F.lit(-1))
    placed = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(spot))
    heads = [(r["_range"], r["first"]) for r in placed.groupBy("_range").agg(F.max("doc_id").alias("first")).collect()]  # one row per range
    heads.sort()
    there = [h for h in heads if h[1] is not None]
    copies = [(heads[i][0], there_first) for i in range(len(heads)) for there_first in [heads[i - 1][1] if i and heads[i - 1][1] is not None else None] if there_first is not None]
    if there:
        copies.append((heads[0][0], there[-1][1]))           # after the last document the first
        if heads[0][1] is None and len(heads) > 1:
            copies = [c for c in copies if c[0] != heads[1][0]]
    ghosts = spark.createDataFrame([(a, b) for a, b in copies], "_to int, _id long")
    copy = placed.join(F.broadcast(ghosts), F.col("doc_id") == F.col("_id")).withColumn("_range", F.col("_to")).drop("_to", "_id").withColumn("_copy", F.lit(True))
    if heads and heads[0][1] is None:                        # after the smallest doc_id the first row without one
        to = heads[min(1, len(heads) - 1)][0]
        copy = copy.unionByName(placed.where("doc_id IS NULL").orderBy("text").limit(1).withColumn("_range", F.lit(to)).withColumn("_copy", F.lit(True)))
    every = placed.withColumn("_copy", F.lit(False)).unionByName(copy)
    order = Window.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), "text")
    return (every.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketches", F.lead("sketches").over(order))
            .where("NOT _copy").drop("_range", "_copy"))


def with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text) and of each text with its second half replaced by the start of the next one."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketches", sketches(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    following = F.coalesce("next_text", F.lit(""))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(following, F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketches", sketches(F.col("edited")))
    none = F.coalesce("next_sketches", F.array_repeat(F.lit(None).cast("long"), SKETCHES))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "edited", printed(F.col("sketches")).alias("fingerprint"), printed(F.col("edited_sketches")).alias("edited_fingerprint"),
                       likeness(F.col("sketches"), F.col("edited_sketches")).alias("near_edited"), likeness(F.col("sketches"), none).alias("near_next"))
