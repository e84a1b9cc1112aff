"""Similarity join of word-shingle sets by PartEnum signatures (operator 10).

Sets are grouped into bands of near-equal size. With a Jaccard similarity of 0.8 or
more, two sets of a band differ in at most ``k`` features. The feature domain is split
into ``n1`` parts, each into three cells; some part holds at most one difference, so
the features of three of its four cells are equal in both sets: those subsets, hashed,
are the signatures. Subsets without features say nothing and are left out; ``n1`` is
raised so that a similar pair also agrees on a subset with features, unless both sets
have unusually many empty ones, and such sets send the empty ones too. No link is lost:
``n1 - k // 2`` parts at least hold one difference or none, whatever the pair. For the
same reason a set that shares signatures in fewer parts than that (less its parts with
empty subsets) has no similar set, and its signatures are dropped.

Equal sets are one node from the start. Signatures that only one block of documents
has are dropped by a compact key exchange (see ``exchange``). Candidates of a signature
are compared with one of them first (a star, not all pairs); what links is joined to
components. Pairs that share a signature and still are in different components are
compared at the end. Where a signature has many such sets (a subset that is only a
common passage), they are compared if they share one of their rarest features, each in
few of those sets; a pair that shares none must be similar by its frequent features
alone, and sets with enough of them are compared block against block.
A pair's parity bitmaps (two to four bits per feature) give a lower bound of its
difference, so whole sets travel only for pairs that may be similar. Every comparison
is exact on 64-bit shingle hashes.

Defined results: null text, or text without words, is an empty set, linked with
nothing; fewer words than a shingle are one shingle; rows that share a doc_id count
as one document that has the links of all its rows; rows with a null doc_id take no
part and are their own component (null); an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm import exchange as X
from shroud.llm.components import components
from shroud.llm.kernel import LOWER_VALUES, U, Words, chunks, mix, ragged, window_hashes
from shroud.llm.memory import lean
from shroud.llm.storage import stored

SHINGLE = 5
PERCENT = 80
BAND = 1.25
CELLS = 4
SPARE = 0.25        # further parts beyond those that the differences need
CROWD = 4096          # a signature with more sets in different components is compared by rare features and in blocks


def shingle_sets(texts: list[str | None], size: int = SHINGLE):
    """Sorted distinct shingle hashes of every text, one after another."""
    for i, j in chunks(texts):
        words = Words(texts[i:j], LOWER_VALUES)
        h, at = words.windows(size)
        n = np.diff(words.first)
        cuts = np.searchsorted(words.doc[at], np.arange(j - i + 1))
        for d in range(j - i):
            if 0 < n[d] < size:                              # the whole sequence as one shingle
                yield window_hashes(words.hashes[words.first[d]:words.first[d + 1]], int(n[d]))
            else:
                mine = np.sort(h[cuts[d]:cuts[d + 1]])
                yield mine[np.append(True, mine[1:] != mine[:-1])] if len(mine) else mine


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All features of the sets, one set after another, and where each set begins (and the end)."""
    return np.concatenate([*sets, np.zeros(0, U)]), np.cumsum([0, *map(len, sets)])


def set_hashes(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """64-bit hash of every set."""
    flat, at = joined(sets)
    total = np.zeros(len(flat) + 1, U)
    np.cumsum(mix(flat ^ U(salt)), out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


FIRST, SECOND = 0x1234567, 0x7654321    # salts of a set's two hashes


@functools.cache
def bands(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of every band, until ``limit`` is covered."""
    low, high = [1], [1]
    while high[-1] < limit:
        low.append(high[-1] + 1)
        high.append(max(low[-1], math.floor(low[-1] * BAND)))
    return np.array(low), np.array(high)


@functools.cache
def parts(high: int) -> tuple[int, int]:
    """(k, n1) for the band whose largest size is ``high``."""
    k = 2 * high * (100 - PERCENT) // (100 + PERCENT)
    need = k // 2 + 1
    return k, need + (0 if k < 8 else math.ceil(SPARE * need) + 1)


@functools.cache
def places(n1: int, seed: int) -> np.ndarray:
    return mix(np.arange(n1 * CELLS, dtype=U) + U(seed)).reshape(n1, CELLS)


def signatures(sets: list[np.ndarray]):
    """By band the signatures of the sets in it and of those that may have a larger partner in it.

    Yields (members, sig, sent, least): the sets' numbers; an array of sets x parts x
    subsets; which of them are sent; in how many parts a similar set shares one that
    is sent at least.
    """
    flat, at = joined(sets)
    n = np.diff(at)
    low, high = bands(1 << max(8, int(2 * n.max(initial=0)).bit_length()))
    own = np.searchsorted(high, n)
    upper = n * 100 // PERCENT >= low[own + 1]
    for band in np.union1d(own, own[upper] + 1).tolist():
        k, n1 = parts(int(high[band]))
        if not k:
            continue                                         # only equal sets are similar enough
        members = np.flatnonzero((own == band) | ((own + 1 == band) & upper))
        seed = mix(np.array([band + 1], U))
        v = mix(flat[ragged(at[:-1][members], n[members])] ^ seed)
        size = n1 * CELLS
        cell = np.repeat(np.arange(len(members)) * size, n[members]) + (((v >> U(32)) * U(size)) >> U(32)).astype(np.int64)
        cells, shape = size * len(members), (len(members), n1, CELLS)
        count = np.bincount(cell, minlength=cells).reshape(shape)
        w = mix(v)
        half = [np.bincount(cell, x.astype(np.float64), cells).astype(U) for x in (w & U(0xFFFFFFFF), w >> U(32))]
        total = (half[0] + (half[1] << U(32))).reshape(shape)
        sig = mix(total.sum(2, dtype=U)[:, :, None] - total + places(n1, int(seed[0])))
        sent = (count.sum(2)[:, :, None] - count) > 0
        least = n1 - k // 2 - (~sent.all(2)).sum(1)
        sent[least < 1] = True                               # too many empty subsets: they are sent as well
        yield members, sig, sent, np.maximum(least, 1)


def _flat(found: list, chosen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The chosen signatures of all bands and the numbers of their sets."""
    sigs = [sig[c] for (_, sig, _, _), c in zip(found, chosen, strict=True)]
    owner = [np.repeat(f[0], c.sum((1, 2))) for f, c in zip(found, chosen, strict=True)]
    return np.concatenate([*sigs, np.zeros(0, U)]), np.concatenate([*owner, np.zeros(0, np.int64)])


def parity(s: np.ndarray) -> bytes:
    """Bitmap of a power of two of bits, two per feature at least: whether a cell has an odd number of features."""
    bits = max(64, 2 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s ^ U(0xBEEF)) & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the number of features that only one of two sets has; the longer bitmap is folded."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def document_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, h1, h2): size and hash of every document's set."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text").to_pylist(), size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_hashes(sets, FIRST)), pa.array(set_hashes(sets, SECOND))], ["doc_id", "n_shingles", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def _members(docs: pa.Table | None, info: pa.Table, size: int):
    """(node, set) of the block's documents that stand for their set."""
    kinds = info.column("kind").to_pylist()
    wanted = {}
    for kind, node, h1 in zip(kinds, info.column("node").to_pylist(), info.column("h1").to_pylist(), strict=True):
        if not kind:
            wanted[node, h1] = True
    if docs is None or not wanted:
        return
    names = {n for n, _ in wanted}
    rows = [i for i, d in enumerate(docs.column("doc_id").to_pylist()) if d in names]
    docs = docs.take(pa.array(rows, pa.int64()))
    owner = docs.column("doc_id").to_pylist()
    sets = list(shingle_sets(docs.column("text").to_pylist(), size))
    for doc_id, s, h in zip(owner, sets, set_hashes(sets, FIRST).tolist(), strict=True):
        if wanted.pop((doc_id, h), False):
            yield doc_id, s


CANDIDATES = "node long, n int, parity binary, shingles binary, sigs array<long>"


def candidates(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Sets that share a signature with another set: node, n, parity, shingles, shared signatures.

    ``nodes``: (node, h1), the doc_id that stands for each distinct set, and its hash.
    """
    docs = docs.where("doc_id IS NOT NULL")                  # the others are no nodes
    blocks, shards = X.sizes(docs)
    placed = X.deal(docs, blocks)
    info = nodes.select(X.block_of(F.col("node"), blocks).alias("block"), F.lit(0).alias("kind"), "node", "h1", F.lit(None).cast("binary").alias("keys"))

    def ask(key, table, info):
        found = list(signatures([s for _, s in _members(X.dealt(table), info, size)]))
        every, _ = _flat(found, [sent for _, _, sent, _ in found])
        return X.requests((key[0]).as_py(), X.flagged(every, np.ones(len(every), bool)), shards)

    asked = placed.groupBy("block").cogroup(info.groupBy("block")).applyInArrow(lean(ask), X.REQUESTS)
    answers = X.shared(asked).select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("h1"), "keys")

    def collect(table, info):
        members = list(_members(X.dealt(table), info, size))
        found = list(signatures([s for _, s in members]))
        every, owner = _flat(found, [sent for _, _, sent, _ in found])
        keys = every >> U(64 - X.KEY_BITS)
        keep = X.among(keys, X.answered(info))
        if len(keys):
            order = np.lexsort((owner, keys))
            k, o = keys[order], owner[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            more = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
            keep[order] |= np.repeat(more, np.diff(np.append(first, len(k))))
        chosen, low = [], 0
        for _, _, sent, least in found:
            mine = np.zeros_like(sent)
            mine[sent] = keep[low:low + (n := int(sent.sum()))]
            low += n
            chosen.append(mine & (mine.any(2).sum(1) >= least)[:, None, None])
        sigs, owner = _flat(found, chosen)
        sigs = sigs[np.argsort(owner, kind="stable")].view(np.int64)
        times = np.bincount(owner, minlength=len(members))
        rows = [(node, len(s), parity(s), s.tobytes()) for (node, s), t in zip(members, times.tolist(), strict=True) if t]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *times[times > 0]]), pa.int32()), pa.array(sigs))
        return pa.table({"node": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int32()), "parity": pa.array(cols[2], pa.binary()), "shingles": pa.array(cols[3], pa.binary()), "sigs": lists})

    both = info.unionByName(answers)
    return placed.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(lean(collect), CANDIDATES)


def _sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Adds the columns of both sets of each pair (a, b), with suffixes."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def plausible(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, ...) that sizes and parity bitmaps don't rule out."""
    kept = pairs.columns

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            least = np.array([least_difference(x, y) for x, y in zip(batch.column("parity_a").to_pylist(), batch.column("parity_b").to_pylist(), strict=True)], np.int64)
            # |A and B| = (n + m - d) / 2 at most, |A or B| = (n + m + d) / 2 at least
            yield batch.select(kept).filter(pa.array(100 * (n + m - least) >= percent * (n + m + least)))

    near = _sides(pairs, sets, "n", "parity").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return near.mapInArrow(run, pairs.schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their whole sets."""

    def run(batches):
        for batch in batches:
            good = []
            for s, t in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                common = int(X.among(x, y).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _sides(pairs.select("a", "b"), sets, "shingles").mapInArrow(run, "a long, b long")


def rare_features(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(feature, node) of the sets' rarest features, each in ``CROWD`` sets at most; (node, frequent): how many others a set has.

    Similar sets share one of their ``n - least common + 1`` rarest features each. If
    either has so many rare ones, that is a rare one; else both send all they have.
    """

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("shingles")]
            owner = np.repeat(batch.column("node").to_numpy(), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), pa.array(owner, pa.int64())], ["feature", "node"])

    every = sets.select("node", "shingles").mapInArrow(run, "feature long, node long")
    rare = every.groupBy("feature").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") <= CROWD)
    held = stored(every.join(rare, "feature").join(sets.select("node", "n"), "node"), "rare")
    order = Window.partitionBy("node").orderBy("times", "feature")
    sent = held.withColumn("at", F.row_number().over(order)).where(f"times > 1 AND at <= n - ceil({percent} * n / 100) + 1").select("feature", "node")
    per = held.groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
    return sent, sets.join(per, "node", "left").select("node", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("frequent"))


def blocked(crowd: DataFrame, ids: DataFrame, frequent: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(sig, second, node, component): crowded sets that may be similar by frequent features alone, by size, two blocks at a time.

    The sets of such a pair have ``percent`` of each one's size as frequent features, and
    one of them (dense) so many that a partner of its own size needs no others.
    """
    rows = crowd.join(frequent, "node").where(f"100 * frequent >= {percent} * n").join(ids, "node", "left")
    rows = rows.select("node", F.coalesce("component", "node").alias("component"), F.expr(f"{100 + percent} * frequent >= {2 * percent} * n").alias("dense"), F.floor(F.log("n") / math.log(100 / percent)).alias("size"))
    rows = stored(rows.withColumn("sig", F.explode(F.array("size", F.col("size") + 1))).drop("size"), "frequent")
    kept, dense = F.count(F.lit(1)), F.count_if("dense")
    blocks = lambda n: F.ceil(2 * n / CROWD).alias
    spans = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), blocks(kept)("wide"), blocks(dense)("high")).where("lo <> hi AND high > 0")
    rows = rows.join(spans.drop("lo", "hi"), "sig")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(29)), F.col(n))
    every = rows.withColumn("x", place("wide")).withColumn("y", F.explode(F.expr("sequence(0L, high - 1L)")))
    sides = rows.where("dense").withColumn("x", F.explode(F.expr("sequence(0L, wide - 1L)"))).withColumn("y", place("high"))
    return every.unionByName(sides).select("sig", F.expr("-2L - (y * wide + x)").alias("second"), "node", "component").distinct()


def linked(found: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the nodes with links, ``known`` links (a, b) included."""
    sigs = stored(found.select("node", F.explode("sigs").alias("sig")), "signatures")

    def relabel(label: DataFrame, links: DataFrame) -> DataFrame:
        name = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        edges = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        roots = components(edges)                            # of components that links join, and of nodes without label
        moved = label.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        return stored(moved.unionByName(roots.join(label, "node", "left_anti").select("node", "component")), "labels")

    def labelled(label: DataFrame) -> DataFrame:
        """Signatures of which sets are in different components."""
        now = sigs.join(label, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        spans = now.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("sig", "members")
        return now.join(spans, "sig")

    label = components(known)
    for turn in range(2):
        # One set of a signature is the centre; the others are compared with it. First each
        # only with the centre it shares most signatures with, then with all that are left.
        live = labelled(label)
        key = F.col("node") if not turn else F.xxhash64("node", F.lit(turn))
        centre = live.groupBy("sig").agg(F.min(F.struct(key.alias("k"), "node", "component")).alias("m")).select("sig", F.col("m.node").alias("b"), F.col("m.component").alias("c"))
        pairs = live.join(centre, "sig").where("component <> c").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("times"))
        near = plausible(pairs, found, percent)
        if not turn:
            near = near.groupBy("a").agg(F.max_by("b", F.struct("times", F.col("b"))).alias("b"))
        label = relabel(label, stored(verified(near, found, percent), "links"))
    live = stored(labelled(label), "live")
    few = live.where(F.col("members") <= CROWD).select("sig", F.lit(0).cast("long").alias("second"), "node", "component")
    many = live.where(F.col("members") > CROWD)
    crowd = stored(found.join(many.select("node").distinct(), "node", "left_semi").select("node", "n", "shingles"), "crowd")
    sent, frequent = rare_features(crowd, percent)
    ids = label.select("node", "component")
    sent = sent.join(ids, "node", "left").select(F.col("feature").alias("sig"), F.lit(-1).cast("long").alias("second"), "node", F.coalesce("component", "node").alias("component"))
    spans = sent.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    parts = few.unionByName(sent.join(spans, "sig")).unionByName(blocked(crowd.select("node", "n"), ids, frequent, percent))
    rest = within(parts, found, percent).distinct()
    return relabel(label, stored(verified(rest, found, percent), "links"))


def within(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of a signature's sets in different components that sizes and bitmaps don't rule out.

    ``members``: sig, second, node, component; a signature or a rare feature has up to
    ``CROWD`` rows, two blocks about as many. Signatures with the same sets are tested
    once, and pairs in place, not as rows.
    """
    lists = members.groupBy("sig", "second").agg(F.sort_array(F.collect_list(F.struct("node", "component"))).alias("m")).select("m").distinct()
    each = lists.select(F.xxhash64("m").alias("id"), F.explode("m").alias("m")).select("id", "m.node", "m.component").distinct()
    buckets = each.join(sets.select("node", "n", "parity"), "node").groupBy("id").agg(F.collect_list(F.struct("node", "component", "n", "parity")).alias("m"))

    def run(batches):
        for batch in batches:
            found = []
            for sets in batch.column("m"):
                sets = sets.values
                node, component, n = (sets.field(i).to_numpy().astype(np.int64) for i in range(3))
                maps = [np.frombuffer(v, np.uint64) for v in sets.field(3).to_pylist()]
                width = min(map(len, maps))
                bits = np.empty((len(maps), width), U)
                for i, m in enumerate(maps):
                    bits[i] = np.bitwise_xor.reduce(m.reshape(-1, width))
                for i in range(len(maps) - 1):
                    least = np.bitwise_count(bits[i + 1:] ^ bits[i]).sum(1, dtype=np.int64)
                    total = n[i + 1:] + n[i]
                    ok = np.flatnonzero((100 * (total - least) >= percent * (total + least)) & (component[i + 1:] != component[i]) & (100 * np.minimum(n[i + 1:], n[i]) >= percent * np.maximum(n[i + 1:], n[i])))
                    found += [(min(x, node[i]), max(x, node[i])) for x in node[i + 1 + ok]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in sorted(set(found))], pa.int64()) for k in range(2)], ["a", "b"])

    return buckets.select("m").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = stored(document_sets(docs, size), "sets")
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    member = stored(full.join(classes, ["h1", "h2"]).select("doc_id", "node", "h1").distinct(), "members")
    # A doc_id with several sets ties them together.
    per = Window.partitionBy("doc_id")
    known = member.withColumn("b", F.min("node").over(per)).select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    found = stored(candidates(docs, member.select("node", "h1").distinct(), size), "candidates")
    label = linked(found, known, percent)
    node = member.groupBy("doc_id").agg(F.min("node").alias("node"))
    owner = node.join(label, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    out = sets.select("doc_id", "n_shingles").join(owner, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
