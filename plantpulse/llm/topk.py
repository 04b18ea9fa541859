"""Exact top-k by inner product with a pivot table.

Vectors become integers, floor(scale * x). With M the largest norm, a vector c gets one more coordinate,
sqrt(M^2 - |c|^2), and a query q gets 0 there; then |q - c|^2 = |q|^2 + M^2 - 2 q.c, so that the largest
inner products are the smallest distances. Distances of all candidates to a few pivots are a table made
once. For a query the largest difference |d(q, p) - d(c, p)| over all pivots is a lower bound of
d(q, c), hence an upper bound of the inner product. Candidates are taken in the order of their bounds, a
few at a time, and the search stops when no bound left reaches the k-th best score found. Bounds are
widened by more than their rounding errors, and scores are sums of integers, so results are exact.

Queries come in blocks of at most ``BLOCK`` rows; each block meets all candidates, task by task, and the
best k of each task are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.shared import written

SCALE = 256
PIVOTS = 24
#: Queries of a block (each BLOCK * dimensions * 8 bytes); candidates of a batch; candidates evaluated between two tests.
BLOCK = 4096
BATCH = 16_384
STEP = 64


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of bigint): floor(scale * x) of every component, of each different usable row once.

    Vectors that are null, empty or hold null, NaN or infinite components, and rows without an id, are left out.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return usable.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()


def pivots_of(rows: DataFrame, dim: int, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` vectors far from each other, chosen among 50 times as many rows of the smallest hashes."""
    some = rows.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(50 * count).collect()
    pool = np.array([x["v"] for x in some], float).reshape(-1, dim)
    chosen = [int(np.argmax((pool**2).sum(1)))]
    far = ((pool - pool[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(pool)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def distances(vectors: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each vector, ``last`` being its further coordinate, to each pivot (whose further coordinate is 0)."""
    square = (vectors**2).sum(1)[:, None] + (last**2)[:, None] + (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def pivot_table(rows: DataFrame, pivots: np.ndarray, norm: float) -> DataFrame:
    """``rows`` (vec_id, v) with rest (the further coordinate) and far (distances to all pivots)."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("v"), dim).astype(float)
            rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))
            far = pa.FixedSizeListArray.from_arrays(pa.array(distances(vectors, rest, pivots).ravel()), len(pivots)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(rest), far], names=["vec_id", "v", "rest", "far"])

    return rows.where(F.size("v") == dim).mapInArrow(run, "vec_id bigint, v array<bigint>, rest double, far array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def best_in(queries: tuple, vec_ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, norm: float, k: int, held: list) -> int:
    """Merge the candidates' best into ``held`` (per query: scores, ids); returns how many inner products it took."""
    query_ids, query_vectors, query_far, query_norms = queries
    done = 0
    slack = 1e-6 * (norm**2 + 1)
    for i, own in enumerate(query_ids):
        low = np.zeros(len(vec_ids))
        for p in range(far.shape[1]):
            np.maximum(low, np.abs(far[:, p] - query_far[i, p]), out=low)
        bound = (query_norms[i] ** 2 + norm**2 - low**2) / 2 + slack
        scores, ids = held[i]
        if len(scores) == k:  # only what may still reach the k-th best
            some = np.flatnonzero(bound >= scores[-1])
            order = some[np.argsort(-bound[some])]
        else:
            order = np.argsort(-bound)
        at, step = 0, STEP
        while at < len(order) and (len(scores) < k or bound[order[at]] >= scores[-1]):
            part = order[at : at + step]
            at, step = at + step, min(2 * step, 4096)
            part = part[vec_ids[part] != own]
            got = vectors[part] @ query_vectors[i]
            done += len(part)
            scores, ids = np.concatenate([scores, got]), np.concatenate([ids, vec_ids[part]])
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
        held[i] = (scores, ids)
    return done


def top_k(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The ``k`` highest inner products of every query with all other rows: query_id, rank (from 1), vec_id, score.

    ``vectors``: vec_id, embedding. Ties go to the smaller vec_id. Rows that cannot be used (see
    integers()) take no part; equal rows count once; a row with the query's own vec_id is no candidate, and
    neither is one of another length than the query. Fewer candidates give fewer rows, no queries none.
    """
    rows = written(integers(vectors, scale), "topk-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    out = None
    for dim, largest, wanted in rows.groupBy(F.size("v")).agg(F.max(square), F.count_if(F.expr(is_query))).orderBy(F.size("v")).collect():
        if largest >= 2**62:
            raise ValueError("vectors are too long for 64-bit inner products")
        if not wanted:
            continue
        norm = float(np.sqrt(largest)) * (1 + 1e-9)
        pivots = pivots_of(rows, dim)
        candidates = written(pivot_table(rows, pivots, norm), "topk-pivots")
        blocks = -(-wanted // block)
        queries = rows.where(F.size("v") == dim).where(is_query)
        for number in range(blocks):
            some = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == number).toArrow()
            part = _search(candidates, some, pivots, norm, k)
            out = part if out is None else out.union(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # the q in front of a row number: which of several rows with one vec_id asks
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(candidates: DataFrame, queries: pa.Table, pivots: np.ndarray, norm: float, k: int) -> DataFrame:
    dim = pivots.shape[1]
    vectors = matrix(queries.column("v").combine_chunks(), dim)
    exact = vectors.astype(float)
    packed = (queries.column("vec_id").to_numpy(), vectors, distances(exact, np.zeros(len(exact)), pivots), np.sqrt((exact**2).sum(1)))
    shared = candidates.sparkSession.sparkContext.broadcast(packed)  # one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block[0]]
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                some = batch.slice(low, BATCH)
                best_in(block, some.column("vec_id").to_numpy(), matrix(some.column("v"), dim), matrix(some.column("far"), len(pivots)), norm, k, held)
        many = [len(s) for s, _ in held]
        columns = [
            np.repeat(block[0], many),
            np.repeat(np.arange(len(held)), many),
            np.concatenate([i for _, i in held]) if held else np.zeros(0, np.int64),
            np.concatenate([s for s, _ in held]) if held else np.zeros(0, np.int64),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "q", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id bigint, q bigint, vec_id bigint, score bigint")
