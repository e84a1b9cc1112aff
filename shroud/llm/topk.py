"""Exact top-k inner products by term-at-a-time accumulation (operator 8).

Rows are dealt into blocks of bounded size. A task gets one block of queries and one
of candidates, turns the candidates into postings (dimension -> candidates and
weights) and adds every query's weighted postings to dense score arrays; a partition
selection keeps each query's k best of the block, and Spark merges the blocks.
Every query meets every candidate: nothing is pruned.

Defined results: vectors that are null or hold a null or non-finite component take
no part; missing trailing components count as zero; components must stay under 2^31
after scaling; rows that share the query's vec_id are its own; further rows with one
vec_id are candidates of their own; ties go to the smaller vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 4096
SCRATCH = 1 << 19      # scores held at a time


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, weights): floor(factor * x) of every component of the vectors that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v.cast("double") * factor).cast("long")).alias("weights"))


def _postings(ids: np.ndarray, vectors: pa.ListArray):
    """Sorts rows by id; per dimension the rows with a weight and the weights."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), lengths)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    used = flat != 0
    return ids[order], place[row[used]], dim[used], flat[used]


def block_scores(query_ids, query_vectors, ids, vectors, k: int):
    """(query_id, vec_id, score) of each query's k best candidates of one block."""
    ids, row, dim, weight = _postings(ids, vectors)
    by_dim = np.argsort(dim, kind="stable")
    row, weight, dim = row[by_dim], weight[by_dim], dim[by_dim]
    query_ids, q_row, q_dim, q_weight = _postings(query_ids, query_vectors)
    step = max(1, SCRATCH // max(1, len(ids)))
    out = []
    for low in range(0, len(query_ids), step):
        some = query_ids[low:low + step]
        scores = np.zeros((len(some), len(ids)), np.int64)
        mine = (q_row >= low) & (q_row < low + step)
        r, d, w = q_row[mine] - low, q_dim[mine], q_weight[mine]
        for term in np.unique(d):                            # one term at a time
            a, b = np.searchsorted(dim, [term, term + 1])
            if a < b:
                at = d == term
                dense = np.zeros(len(ids), np.int64)
                dense[row[a:b]] = weight[a:b]
                scores[r[at]] += w[at][:, None] * dense
        own = ids[None, :] == some[:, None]
        scores[own] = np.iinfo(np.int64).min
        n = min(k, len(ids))
        cut = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
        for i in range(len(some)):
            at = np.flatnonzero((scores[i] >= cut[i]) & ~own[i])
            at = at[np.lexsort((ids[at], -scores[i, at]))][:n]
            out.append((np.full(len(at), some[i]), ids[at], scores[i, at]))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, candidate_block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """Each query's k candidates of highest score: query_id, rank, vec_id, score.

    Both inputs: (vec_id long, weights array<long>).
    """
    n_c, n_q = candidates.count(), queries.count()
    c_blocks, q_blocks = math.ceil(n_c / candidate_block) or 1, math.ceil(n_q / query_block) or 1
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q", deal(q_blocks, 1)).withColumn("c", every(c_blocks))
    right = candidates.withColumn("c", deal(c_blocks, 2)).withColumn("q", every(q_blocks))

    def run(key, some, others):
        one = lambda t: (t.column("vec_id").to_numpy(), t.column("weights").combine_chunks())
        if not some.num_rows or not others.num_rows:
            cols = [np.zeros(0, np.int64)] * 3
        else:
            cols = block_scores(*one(some), *one(others), k)
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    best = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(run, "query_id long, vec_id long, score long")
    # A query's rows here: k from each block. Repeated query rows would bring theirs again.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
