"""Merkle manifest of a dataset (operator 12): subtrees in van Emde Boas layout.

Per source the leaves, by ascending doc_id, are ranked and dealt to aligned blocks of
``FAN ** STEPS`` entries. A block is one subtree, kept as one buffer: the top half of its
levels first, then the subtrees below it one after another, each laid out the same way.
``address`` finds a node by recursion over half heights, without tables; building the
subtree and reading siblings both go through it. Block roots are the entries of the
next blocks, until a source has one; the sources' roots make the last tree. Paths then
go down from the root, one row per block, and each leaf's siblings are read from its
block's buffer and its block's path.

No task holds more than a block and the paths of its entries. Defined results: nulls
are written as ``-``, so a null text differs from an empty one; a null doc_id sorts before all others
and is never tampered with; rows with one doc_id sort by their digest; repeated rows
are leaves each, with proofs of their own places; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.ranks import ranked
from shroud.llm.storage import stored

FAN = 16
STEPS = 3
BLOCK = FAN ** STEPS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def nodes(levels: int) -> int:
    """Nodes of a full tree with so many levels."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (0: the root) in the layout of a tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    under = FAN ** (depth - top)
    return nodes(top) + index // under * nodes(levels - top) + address(levels - top, depth - top, index % under)


def h(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def steps_of(total: int) -> int:
    """Levels above the entries of a block of a tree with ``total`` entries: all STEPS unless the tree ends in it."""
    steps = 0
    while steps < STEPS and FAN ** steps < total:
        steps += 1
    return steps


class Subtree:
    """A block's nodes: ``n`` entries and ``levels - 1`` levels above them."""

    def __init__(self, buffer: np.ndarray, n: int, levels: int):
        self.buffer, self.levels, self.n = buffer, levels, n

    @classmethod
    def build(cls, digests: np.ndarray, levels: int) -> Subtree:
        out = cls(np.zeros((nodes(levels), 32), np.uint8), len(digests), levels)
        out.buffer[address(levels, levels - 1, np.arange(len(digests)))] = digests
        for depth in range(levels - 2, -1, -1):
            below = out.text(depth + 1)
            made = b"".join(h(below[a:a + 64 * FAN]) for a in range(0, len(below), 64 * FAN))
            out.buffer[address(levels, depth, np.arange(out.count(depth)))] = np.frombuffer(made, np.uint8).reshape(-1, 32)
        return out

    def count(self, depth: int) -> int:
        return -(-self.n // FAN ** (self.levels - 1 - depth))

    def text(self, depth: int) -> bytes:
        """The digests of a level, left to right, as hex text."""
        return self.buffer[address(self.levels, depth, np.arange(self.count(depth)))].tobytes().hex().encode()

    def paths(self):
        """Of every entry the siblings (before, after) level by level."""
        texts = [self.text(d) for d in range(self.levels)]
        above: list[list] = [[]]                                 # paths of the nodes of the level before
        for depth in range(1, self.levels):
            here = []
            for i in range(self.count(depth)):
                low, at = i // FAN * FAN, i
                run = texts[depth][64 * low:64 * (low + FAN)]
                here.append([(run[:64 * (at - low)], run[64 * (at - low + 1):]), *above[i // FAN]])
            above = here
        return above


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, source, doc_id, digest, tampered): the leaf of each row, and of its tampered row where there is one."""
    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    rest = [field(F.col(c)) for c in FIELDS[:-1]]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    digest = lambda text: F.unhex(F.sha2(F.concat(*rest, field(text)).cast("binary"), 256))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # sorts as the sources do, null first
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"),
                       F.when(hit, digest(lower)).alias("tampered"), F.monotonically_increasing_id().alias("row"))


def level(entries: DataFrame, carry: dict[str, str], name: str) -> DataFrame:
    """Blocks of one level from entries (tree, rank, total, digest, *carry): tree, block, total, n, nodes, root, *carry as lists."""
    def build(key, table):
        order = np.argsort(table.column("rank").to_numpy())
        table = table.take(pa.array(order)).combine_chunks()
        total = table.column("total")[0].as_py()
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        made = Subtree.build(digests, steps_of(total) + 1)
        root = made.buffer[0].tobytes()                          # the root comes first in the layout
        cols = {"tree": [key[0].as_py()], "block": [key[1].as_py()], "total": [total], "n": [len(order)], "nodes": [made.buffer.tobytes()], "root": [root]}
        out = pa.table({k: pa.array(v, t) for (k, v), t in zip(cols.items(), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})
        for c in carry:
            out = out.append_column(c, pa.array([table.column(c).to_pylist()], pa.list_(table.column(c).type)))
        return out

    placed = entries.select("tree", F.expr(f"rank div {BLOCK}").alias("block"), "rank", "total", "digest", *carry)
    schema = "tree string, block long, total long, n int, nodes binary, root binary" + "".join(f", {c} array<{t}>" for c, t in carry.items())
    return stored(placed.groupBy("tree", "block").applyInArrow(build, schema), name)


def grow(entries: DataFrame, carry: dict[str, str], name: str) -> list[DataFrame]:
    """The levels of blocks over ranked entries, from the entries up, until every tree has one block."""
    out = [level(entries, carry, name)]
    while not (more := out[-1].where(f"total > {BLOCK}")).isEmpty():
        above = more.select("tree", F.col("block").alias("rank"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("root").alias("digest"))
        out.append(level(above, {}, name))
    return out


def rows_of(batch: pa.RecordBatch):
    """A batch's rows one by one: a block with its nodes is large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


PATH = "array<struct<before:binary,after:binary>>"


def descend(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, block, path, subroot, root) of the blocks below, from (tree, block, path, subroot, root) of these."""
    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                made = Subtree(np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32), r["n"], steps_of(r["total"]) + 1)
                up = [(s["before"], s["after"]) for s in r["path"]]
                rows = [{"tree": r["tree"], "block": r["block"] * BLOCK + i, "path": [{"before": b, "after": a} for b, a in [*inner, *up]], "subroot": r["subroot"], "root": r["root_"]}
                        for i, inner in enumerate(made.paths())]
                for k in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_pylist(rows[k:k + 512], schema)

    step = pa.struct([("before", pa.binary()), ("after", pa.binary())])
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(step)), ("subroot", pa.binary()), ("root", pa.binary())])
    both = blocks.select("tree", "block", "total", "n", "nodes").join(paths.withColumnRenamed("root", "root_"), ["tree", "block"])
    return both.mapInArrow(run, f"tree string, block long, path {PATH}, subroot binary, root binary")


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source and the leaf's place in it."""
    first = stored(leaves(docs), "leaves")
    entries = ranked(first, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")], "ranked")
    forest = grow(entries, {"doc_id": "bigint", "tampered": "binary"}, "blocks")
    tops = [b.where(f"total <= {BLOCK}") for b in forest]        # where a source ends in one block
    subroots = None
    for t in tops:
        some = t.select(F.col("tree").alias("source"), F.col("root").alias("digest"))
        subroots = some if subroots is None else subroots.unionByName(some)
    last = ranked(subroots.withColumn("tree", F.lit("")), "tree", [F.col("source")], "sources")
    crown = grow(last, {"source": "string"}, "crown")
    whole = crown[-1].select("tree", F.lit(0).cast("long").alias("block"), F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), "root")
    paths = whole.withColumn("path", F.array().cast(PATH))
    for blocks in crown[:0:-1]:
        paths = descend(blocks, paths)
    paths = stored(_named(crown[0], paths), "source-paths")      # of each source's root
    down = None
    for blocks, top in zip(forest[::-1], tops[::-1], strict=True):
        here = top.select("tree", "block").join(paths, "tree")
        down = here if down is None else down.unionByName(here)
        if blocks is not forest[0]:
            down = stored(descend(blocks, down), "paths")
    return proofs(forest[0], down)


def _named(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, path, subroot, root) of the sources that are the entries of these blocks."""
    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                made = Subtree(np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32), r["n"], steps_of(r["total"]) + 1)
                up = [(s["before"], s["after"]) for s in r["path"]]
                own = made.text(made.levels - 1)
                rows = [{"tree": name, "path": [{"before": b, "after": a} for b, a in [*inner, *up]], "subroot": bytes.fromhex(own[64 * i:64 * i + 64].decode()), "root": r["root_"]}
                        for i, (name, inner) in enumerate(zip(r["source"], made.paths(), strict=True))]
                for k in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_pylist(rows[k:k + 512], schema)

    step = pa.struct([("before", pa.binary()), ("after", pa.binary())])
    schema = pa.schema([("tree", pa.string()), ("path", pa.list_(step)), ("subroot", pa.binary()), ("root", pa.binary())])
    both = blocks.drop("root").join(paths.select("tree", "block", "path", F.col("root").alias("root_")), ["tree", "block"])
    return both.mapInArrow(run, f"tree string, path {PATH}, subroot binary, root binary")


def fold(digest: bytes, path: list[tuple[bytes, bytes]], known: dict) -> bytes:
    """The root that a leaf and the siblings on its way make; ``known`` keeps what leaves of one run share."""
    for k, (before, after) in enumerate(path):
        text = b"".join((before, digest.hex().encode(), after))
        if k == 0:
            digest = h(text)
        elif (got := known.get(text)) is None:
            digest = known[text] = h(text)
        else:
            digest = got
    return digest


def proofs(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of the manifest from the lowest blocks (with doc_id and tampered lists) and the paths of their roots."""
    names = ["doc_id", "source", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                made = Subtree(np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32), r["n"], steps_of(r["total"]) + 1)
                up = [(s["before"], s["after"]) for s in r["path"]]
                tail = b"".join(b + a for b, a in up)
                own, root, subroot, known = made.text(made.levels - 1), r["root_"], r["subroot"].hex(), {}
                rows = []
                for i, inner in enumerate(made.paths()):
                    leaf = own[64 * i:64 * i + 64].decode()
                    back = fold(r["tampered"][i] or bytes.fromhex(leaf), [*inner, *up], known)
                    proof = hashlib.sha256(b"".join([*(x for step in inner for x in step), tail])).hexdigest()
                    rows.append((r["doc_id"][i], r["tree"][1:] if r["tree"] else None, r["block"] * BLOCK + i, leaf, subroot, root.hex(), proof, back.hex(), back == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    both = blocks.drop("root").join(paths.withColumnRenamed("root", "root_"), ["tree", "block"])
    return both.mapInArrow(run, "doc_id long, source string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
