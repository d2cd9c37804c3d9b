"""Exact top-k search by inner product, dimension block by dimension block.

Vectors are integers. Queries and candidates are cut into blocks by a hash of
the row; every pair of a query block and a candidate block is one group of
bounded size. Inside a group candidates lie dimension by dimension. Scores
grow block of dimensions by block; what the remaining dimensions can still add
is bounded by the product of the remaining norms (Cauchy-Schwarz), and
candidates whose best case is below the k-th best worst case leave before the
next block. Bounds keep ties, so the result is exact.

Each candidate row is sent once per query block and each query row once per
candidate block; per query and candidate block at most k rows come back.

Defined cases: vectors that are NULL or hold NULL or non-finite components
take no part; every row is a candidate, also where its id repeats, so an id may
be found more than once; a query never finds rows of its own id; a query id with
several vectors asks once for each, equal ones once; missing trailing components
count as zero; equal scores rank by smaller id; fewer candidates than k are all
returned; empty tables give an empty result; other columns are ignored. Scores are exact while they
fit 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage_derived

QUERY_ROWS, CANDIDATE_ROWS, BLOCK_DIMS, AT_ONCE = 1024, 8192, 16, 32


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; NULL where a component is NULL or not finite."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    """Rows as integers, padded with zeros."""
    lists = table["vec"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _tails(blocks: list[np.ndarray]) -> np.ndarray:
    """Norm of what follows each block of dimensions, per row."""
    squares = np.array([(b.astype(float) ** 2).sum(axis=1) for b in blocks])
    after = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack([after[1:], np.zeros(after.shape[1])]))


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, names=None):
    """(query id, or its name, vector id, score) of each query's k best among the vectors."""
    names = query_ids if names is None else names
    dims = queries.shape[1]
    if float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, dims) >= 2**50:
        for i, (q, own) in enumerate(zip(queries, query_ids)):
            yield from _best(names[i], ids, vectors @ q, ids != own, k)
        return
    # dimensions of most mass first, so that bounds shrink early
    order = np.argsort(-((queries.astype(float) ** 2).sum(axis=0) + (vectors.astype(float) ** 2).sum(axis=0)), kind="stable")
    cuts = [order[i : i + BLOCK_DIMS] for i in range(0, dims, BLOCK_DIMS)] or [order]
    q_blocks = [queries[:, c].astype(float) for c in cuts]
    upright = [np.ascontiguousarray(vectors[:, c].T.astype(float)) for c in cuts]
    q_tail, v_tail = _tails(q_blocks), _tails([b.T for b in upright])
    for start in range(0, len(queries), AT_ONCE):
        first = q_blocks[0][start : start + AT_ONCE] @ upright[0]
        for i, partial in enumerate(first, start):
            alive = np.nonzero(ids != query_ids[i])[0]
            partial = partial[alive]
            for b in range(len(cuts)):
                if b:
                    partial = partial + q_blocks[b][i] @ upright[b][:, alive]
                if len(alive) > k:
                    rest = q_tail[b, i] * v_tail[b, alive] * (1 + 1e-15 * (dims + 4))  # never below the exact bound
                    worst = np.partition(partial - rest, len(alive) - k)[len(alive) - k]
                    keep = partial + rest >= worst - 0.5  # whole scores; half covers rounding
                    if not keep.all():
                        alive, partial = alive[keep], partial[keep]
            yield from _best(names[i], ids[alive], np.rint(partial).astype(np.int64), slice(None), k)


def _best(name, ids: np.ndarray, scores: np.ndarray, mask, k: int):
    ids, scores = ids[mask], scores[mask]
    for j in np.lexsort((ids, -scores))[:k]:
        yield name, ids[j], scores[j]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k best vectors.

    Both inputs have ``vec_id`` and an integer array ``vec``.
    """

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            dims = max(1, max(max((len(v) for v in t["vec"]), default=0) for t in (left, right)))
            ids, asked = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            found = list(search_block(_matrix(right, dims), asked, _matrix(left, dims), ids, k, range(len(asked))))
        columns = list(zip(*found)) if found else [[], [], []]
        asked_by = right.take(pa.array(list(columns[0]), pa.int64())) if right.num_rows else right
        return pa.table({
            "query_id": asked_by["vec_id"], "ask": asked_by["ask"],
            "vec_id": pa.array(list(map(int, columns[1])), pa.int64()), "score": pa.array(list(map(int, columns[2])), pa.int64()),
        })

    def blocked(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
        count = max(1, math.ceil(rows.count() / size))
        # an int like the other side's number of the block: equal numbers of two types are dealt to different tasks
        return rows.withColumn("at", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(count)).cast("int")), count

    def prepared(rows: DataFrame) -> DataFrame:
        return rows.filter("vec is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vec")

    left, lefts = blocked(stage_derived(prepared(vectors)), CANDIDATE_ROWS)
    right, rights = blocked(stage_derived(prepared(queries).distinct()), QUERY_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("vec_id", "vec", F.col("at").alias("c")).withColumn("q", every(rights))
    right = right.select("vec_id", "vec", F.xxhash64("vec").alias("ask"), F.col("at").alias("q")).withColumn("c", every(lefts))
    pairs = left.groupBy("q", "c").cogroup(right.groupBy("q", "c"))
    found = pairs.applyInArrow(work, "query_id long, ask long, vec_id long, score long")
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
