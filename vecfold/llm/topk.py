"""Exact top-k by inner product with multi-resolution segment statistics.

The squared distance of two vectors is at least the sum over segments of
``length * (mean gap)^2 + (deviation gap)^2``; with the norms this bounds the inner product from above
by ``sum(length * mean * mean + deviation * deviation)``. Bounds go from few long segments to many
short ones. Per query the best bounds of the coarsest level are computed exactly first; their k-th
score is the level that a bound must reach, and only the survivors of the finest level get an exact score.

Queries and candidates are dealt into tiles of bounded size; every pair of tiles is one row of a
join on the pair's number, whatever the number of queries. A tile pair keeps k rows per query, so
what is merged grows with queries times candidate tiles.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfold.plans.lineage import cut

SCALE = 1024
SEGMENTS = (4, 16)
CANDIDATE_TILE, QUERY_TILE = 8192, 2048
# Queries of a tile that are bounded at once, and pairs that are refined at once.
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 128, 1 << 17
# Whole numbers up to this are exact as doubles, and so are sums of their products.
EXACT = float(1 << 53)


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, means, root of the summed squared deviations) of nearly equal segments."""
    starts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))[:-1]
    lengths = np.diff(np.append(starts, x.shape[1])).astype(float)
    means = np.add.reduceat(x, starts, axis=1) / lengths
    gaps = x - np.repeat(means, lengths.astype(int), axis=1)
    return lengths, means, np.sqrt(np.add.reduceat(gaps * gaps, starts, axis=1))


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are the bounds."""
    lengths, means, gaps = segment_statistics(x, segments)
    return np.hstack([means * np.sqrt(lengths), gaps])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, exact; beyond a long they stop at its ends."""
    if not len(q):
        return np.empty(0, np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(q.tolist(), x.tolist())]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)


def best_of_tile(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, segments=SEGMENTS):
    """(query row, candidate row, score) with the k highest scores per query, ties to smaller ids."""
    if not x.shape[1]:
        levels, sure = [], False
    else:
        sure = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < EXACT
        levels = [(features(q, s), features(x, s)) for s in segments] if sure else []
    found = []
    for at in range(0, len(q), QUERIES_AT_ONCE):
        rows = np.arange(at, min(at + QUERIES_AT_ONCE, len(q)))
        own = q_ids[rows][:, None] == x_ids[None, :]
        if levels:
            bounds = levels[0][0][rows] @ levels[0][1].T
            slack = 1e-9 * np.abs(bounds).max(initial=0) + 1e-6
            bounds[own] = -np.inf
            some = min(k, len(x))
            first = np.argpartition(-bounds, some - 1, axis=1)[:, :some]
            scores = exact_scores(q[np.repeat(rows, some)], x[first.ravel()]).reshape(first.shape).astype(float)
            scores[np.take_along_axis(own, first, axis=1)] = -np.inf
            least = scores.min(axis=1) if some == k else np.full(len(rows), -np.inf)
            i, j = np.nonzero((bounds >= (least - slack)[:, None]) & ~own)
        else:
            i, j = np.nonzero(~own)
        for part in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[part : part + PAIRS_AT_ONCE], j[part : part + PAIRS_AT_ONCE]
            for fine_q, fine_x in levels[1:]:
                bound = np.einsum("ij,ij->i", fine_q[rows[a]], fine_x[b])
                stays = bound >= least[a] - slack
                a, b = a[stays], b[stays]
            found.append((rows[a], b, exact_scores(q[rows[a]], x[b])))
    if not found:
        return (np.empty(0, np.int64),) * 3
    i, j, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((x_ids[j], -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score, i))
    i, j, score = i[order], j[order], score[order]
    starts = np.searchsorted(i, i, side="left")
    top = np.arange(len(i)) - starts < k
    return i[top], j[top], score[top]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, dim``: components scaled and floored, without vectors that hold null or non-finite ones."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False)))
    # a product beyond the doubles stops at their end
    most = 1.7e308
    scaled = F.transform("v", lambda x: F.least(F.greatest(x * SCALE, F.lit(-most)), F.lit(most)))
    return rows.select("vec_id", F.transform(scaled, lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0)).alias("v"), F.size("v").alias("dim"))


def _packed(rows: DataFrame, tile: Column) -> DataFrame:
    """``dim, tile, ids, v``: one row per tile."""

    def pack(group: pa.Table) -> pa.Table:
        vectors = group.column("v").combine_chunks()
        ids = group.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        return pa.table({
            "dim": group.column("dim")[:1], "tile": group.column("tile")[:1],
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "v": pa.array([flat.astype("<f8").tobytes()], pa.binary()),
        })

    dealt = rows.select("dim", tile.alias("tile"), "vec_id", "v")
    return dealt.groupBy("dim", "tile").applyInArrow(pack, "dim int, tile long, ids binary, v binary")


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                dim = batch.column("dim")[row].as_py()
                ids, queries = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i8") for c in ("ids", "q_ids"))
                v, q = (np.frombuffer(batch.column(c)[row].as_buffer(), "<f8") for c in ("v", "q"))
                v, q = v.reshape(len(ids), dim), q.reshape(len(queries), dim)
                i, j, score = best_of_tile(q, queries, v, ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[i]), pa.array(ids[j]), pa.array(score)], ["query_id", "vec_id", "score"]
                )

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query the k highest scores over ``vectors``.

    Both have ``vec_id, embedding``. Vectors that are null or hold null or non-finite components,
    and rows without id, take no part; vectors of another length than the query's are no
    candidates. Rows with the query's id are its own and left out; of queries with one id the
    smallest vector asks. Empty tables give an empty result.
    """
    candidates = cut(usable(vectors))
    asking = cut(usable(queries).groupBy("dim", "vec_id").agg(F.min("v").alias("v")))
    n = max([row["count"] for row in candidates.groupBy("dim").count().collect()], default=0)
    m = max([row["count"] for row in asking.groupBy("dim").count().collect()], default=0)
    tiles, query_tiles = (F.lit(max(1, -(-c // size))).cast("long") for c, size in ((n, CANDIDATE_TILE), (m, QUERY_TILE)))
    # rows are dealt one by one, so repeated rows are spread as well
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), tiles)
    left = _packed(candidates, spread)
    right = _packed(asking, F.pmod(F.xxhash64("vec_id"), query_tiles)).withColumnsRenamed({"tile": "q_tile", "ids": "q_ids", "v": "q"})
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    pairs = left.withColumn("q_tile", every(query_tiles)).join(right.withColumn("tile", every(tiles)), ["dim", "tile", "q_tile"])
    found = pairs.select("dim", "ids", "v", "q_ids", "q").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
