"""Best-fit packing of tokenised documents into sequences (operator 5).

1. ``pieces``: every document's ids plus an end id, cut only where it is longer
   than a sequence. Runs in Arrow batches, no shuffle.
2. ``plan``: the instance is the count of pieces of every length, at most
   ``capacity`` numbers however large the table, so it is planned on the driver.
   Martello-Toth dominance first fixes small sets of pieces that provably dominate
   every alternative, and shrinks the instance; best-fit decreasing takes the rest.
   Both work on lengths with multiplicities.
3. ``pack``: pieces of one length are numbered (in salted groups, so that a hot
   length is split) and looked up in the plan, which is as small as the counts.

Defined results: null text counts as empty and gives one piece that holds only the
end id; repeated rows are packed one by one; an empty table gives an empty table;
a text of any length is tokenised whole.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.bpe import byte_alphabet, lists
from shroud.llm.kernel import chunks
from shroud.llm.wordpieces import Encoder, beyond_latin, split_words

CAPACITY = 4096
END_ID = 1


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    shown = {b: c for c, b in byte_alphabet().items()}
    model = t.model

    def words(some: list[str]) -> list[list[int]]:           # plain pre-tokens: lower-cased, byte letters, merges
        return [[k.id for k in model.tokenize(w.lower().encode().decode("latin-1").translate(shown))] for w in some]

    def whole(text: str) -> list[int]:
        return t.encode(text, add_special_tokens=False).ids

    specials = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
    return Encoder(split_words, words, whole, beyond_latin, specials)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                rows, parts = [], []
                for doc_id, ids in zip(doc_ids[i:j], encoder.encode(texts[i:j]), strict=True):
                    ids = np.append(ids, np.int32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at:at + capacity]
                        rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
                        parts.append(part)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, lists(parts)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Instance:
    """Counts of pieces by length, with the sorted lengths that are left."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def at_most(self, limit: int, without: int | None = None) -> int | None:
        """Largest length up to the limit, one piece of length ``without`` set aside."""
        i = bisect.bisect_right(self.sizes, limit) - 1
        if i >= 0 and self.sizes[i] == without and self.count[without] == 1:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def least(self, n: int, without: int) -> int:
        """Sum of the n smallest pieces, one of length ``without`` set aside; a large number if there are fewer."""
        total = 0
        for size in self.sizes[:n + 1]:
            k = min(n, self.count[size] - (size == without))
            total, n = total + k * size, n - k
            if not n:
                return total
        return 1 << 60


def dominant(left: Instance, size: int, capacity: int) -> list[int] | None:
    """Pieces that go with one of length ``size`` in some best packing, if one of the tests proves it.

    A set dominates another if the other's pieces can be grouped so that each group
    fits under a different piece of the set.
    """
    room = capacity - size
    best = left.at_most(room, size)
    if best is None:
        return []                                            # nothing fits beside it
    if best == room or left.least(2, size) > room:
        return [best]                                        # it fills up, or only one more piece fits
    if left.least(3, size) > room:                           # two more fit at most: pairs x >= y, x + y <= room
        second = left.at_most(min(best, room - best), size)
        half = left.at_most(room // 2, size)                 # no pair's smaller piece is longer than that
        if second is not None and half is not None and second >= half and (second != best or left.count[best] - (best == size) >= 2):
            return [best, second]
    return None


def reduce_instance(left: Instance, capacity: int) -> list[tuple[list[int], int]]:
    """Fixes dominating sets, as (lengths, how many times), until no test applies."""
    fixed, again = [], True
    while again:
        again = False
        for size in sorted(left.sizes, reverse=True):
            while size in left.count and (others := dominant(left, size, capacity)) is not None:
                need = defaultdict(int, {size: 1})
                for o in others:
                    need[o] += 1
                times = min(left.count[n] // k for n, k in need.items())
                if not times:
                    break
                # The test holds for every one of them: until a length runs out, the largest pieces that
                # fit stay the same, and with fewer pieces left the sums of the smallest only grow.
                for n, k in need.items():
                    left.take(n, k * times)
                fixed.append(([size, *others], times))
                again = True
    return fixed


def best_fit(left: Instance, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on counts: bins with equal content are one class with a multiplicity."""
    open_bins: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, content: tuple, times: int) -> None:
        if not times:
            return
        if room not in open_bins:
            bisect.insort(rooms, room)
        open_bins.setdefault(room, []).append((content, times))

    for size in sorted(left.sizes, reverse=True):
        todo = left.count[size]
        while todo:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                content, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
                copies = min(room // size, todo)
                used = min(times, todo // copies)
            else:
                room, content = capacity, ()
                copies = min(room // size, todo)
                used = times = todo // copies
            put(room, content, times - used)
            put(room - copies * size, (content, size, copies), used)
            todo -= copies * used
    out = []
    for classes in open_bins.values():
        for content, times in classes:
            slots = []
            while content:
                content, size, copies = content
                slots.append((size, copies))
            out.append((slots[::-1], times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, copies, first sequence, offset), sorted, and the number of sequences."""
    left = Instance(counts)
    classes = []
    for sizes, times in reduce_instance(left, capacity):
        per = defaultdict(int)
        for n in sizes:
            per[n] += 1
        classes.append((list(per.items()), times))
    classes += best_fit(left, capacity)
    slots, used, sequence = [], defaultdict(int), 0
    for content, times in classes:
        offset = 0
        for size, copies in content:
            slots.append((size, used[size], copies, sequence, offset))
            used[size] += copies * times
            offset += copies * size
        sequence += times
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequence


def ranked(items: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank`` from 0 among the pieces of each length; a length's pieces are numbered in ``salts`` groups."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(sizes, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_at")).drop("_salt", "_before", "_at")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    ``items`` is read three times; give a table that is cheap to read again.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(slots)             # bounded by the number of lengths, not of pieces
    salts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)

    def place(batches):
        size, first, copies, sequence, offset = shared.value.T
        key = size * (1 << 44) + first
        for batch in batches:
            if not batch.num_rows:
                continue
            n, r = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, n * (1 << 44) + r, "right") - 1
            k = r - first[at]
            keep = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            cols = [*(batch.column(i) for i in keep), pa.array(sequence[at] + k // copies[at]), pa.array(offset[at] + k % copies[at] * n)]
            yield pa.RecordBatch.from_arrays(cols, [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    numbered = ranked(items, salts)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != "rank")
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")
