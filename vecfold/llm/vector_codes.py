"""Product codes of vectors: four parts, a codebook of 256 entries per part, Lloyd rounds.

Assignment uses memoised grid cells. The integer points of a part fall into coarse cells of width
``CELL`` per component. For a cell, an entry is dominated when another entry is nearer to every point
of the cell's box (its largest distance to the box is below the entry's smallest); dominated entries
can be neither nearest nor tied, so only the others are kept for the cell, once per cell of a batch,
and exactly evaluated for the cell's points. Ties go to the lower entry.

Spark's part: every round deals the vectors in their partitions (no shuffle), broadcasts the codebook
(``PARTS x ENTRIES`` entries, bounded by construction), and sums the assigned parts per entry with a
map-side combine, so what reaches the driver is ``PARTS x ENTRIES x (part length + 1)`` numbers a round.
Each round's codes are not kept; only the final assignment is written.

Defined results: rows whose vector is null, holds a null or a non-finite component are dropped; so are
rows whose vector's length differs from that of the smallest kept ``vec_id`` (the table's dimension),
which has to be divisible by 4 (else ValueError). Rows with a null ``vec_id`` are kept and ordered last.
Repeated rows are coded alike and both count in the sums. With fewer than 256 rows the codebooks have as
many entries as rows; an empty table gives no rows. Extra columns of the input are carried along;
``code``, ``error`` and ``label_error`` are added last.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.plans.lineage import cut, sized_broadcast

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Width of a coarse cell per component, in floored units. Small cells let the box bounds rule out most
# entries (sf0.1: 1.3 % of entries evaluated exactly at 16, 19 % at 64, all at 256); points that share a
# cell, such as copies, share one bound computation.
CELL = 16
# Beyond this size of a component, squared distances of a part may leave int64; Python integers take over.
SAFE = 1 << 26


def finite(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def floored(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _matrix(values) -> np.ndarray:
    rows = list(values)
    if not rows:
        return np.empty((0, 0), np.int64)
    return np.asarray(np.stack([np.asarray(v, dtype=np.int64) for v in rows]))


def cell_candidates(cells: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Mask (cell, entry) of entries not dominated across each cell's box."""
    out = np.zeros((len(cells), len(book)), bool)
    wide = book.dtype == object
    for a in range(0, len(cells), 256):
        lo = cells[a:a + 256, None, :] * CELL
        hi = lo + (CELL - 1)
        c = book[None, :, :]
        gap = np.maximum(lo - c, 0) + np.maximum(c - hi, 0)
        nearest = (gap * gap).sum(axis=2)
        far = np.maximum((c - lo) * (c - lo), (c - hi) * (c - hi)).sum(axis=2)
        bound = far.min(axis=1, keepdims=True)
        out[a:a + 256] = nearest <= bound if not wide else np.asarray(nearest <= bound, bool)
    return out


def assign_part(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """(entry, squared distance) of every point; entries dominated in a point's cell are never evaluated."""
    n = len(points)
    if n == 0 or len(book) == 0:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), {"cells": 0, "pairs": 0}
    wide = max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)) >= SAFE
    if wide:
        points, book = points.astype(object), book.astype(object)
    cells, inverse = np.unique(np.floor_divide(points, CELL), axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    mask = cell_candidates(cells, book)
    p, e = np.nonzero(mask[inverse])  # by point, then entry ascending
    diff = points[p] - book[e]
    dist = (diff * diff).sum(axis=1)
    order = np.lexsort((e, dist, p))
    first = order[np.r_[True, p[order][1:] != p[order][:-1]]]
    return e[first].astype(np.int64), np.asarray(dist[first]), {"cells": len(cells), "pairs": len(p)}


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    m = x.shape[1] // PARTS
    codes, dists = [], []
    for j in range(PARTS):
        c, d, _ = assign_part(x[:, j * m:(j + 1) * m], books[j])
        codes.append(c)
        dists.append(d)
    return np.stack(codes, axis=1), np.stack(dists, axis=1)


def _sums(books: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = books[0].shape[1]
        n = np.zeros((PARTS, len(books[0])), np.int64)
        s = [np.zeros((len(books[0]), m), object) for _ in range(PARTS)]
        for b in batches:
            x = _matrix(b["v"])
            if not len(x):
                continue
            codes, _ = assign(x, books)
            for j in range(PARTS):
                np.add.at(n[j], codes[:, j], 1)
                part = x[:, j * m:(j + 1) * m].astype(object)
                order = np.argsort(codes[:, j], kind="stable")
                keys, starts = np.unique(codes[order, j], return_index=True)
                s[j][keys] += np.add.reduceat(part[order], starts, axis=0)
        rows = [(j, k, int(n[j, k]), [str(v) for v in s[j][k]]) for j in range(PARTS) for k in np.nonzero(n[j])[0]]
        yield pd.DataFrame(rows, columns=["part", "entry", "n", "s"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"])
            if len(x):
                codes, dists = assign(x, books)
                code = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                error = [int(sum(int(v) for v in row)) for row in dists.tolist()]
            else:
                code, error = [], []
            yield pd.DataFrame({"_k": b["_k"].to_numpy(), "code": code, "error": pd.array(error, dtype="Int64")})

    return run


def books_digest(books: list[np.ndarray]) -> str:
    text = ",".join(str(int(v)) for book in books for entry in book for v in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS):
    """(rows with ``code``, ``error``, ``label_error``; final codebooks as lists of integer arrays)."""
    spark = vectors.sparkSession
    good = vectors.drop("code", "error", "label_error", "_k").filter(finite(F.col(vector)))
    first = good.orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).select(F.size(vector).alias("d")).first()
    if first is None:
        empty = good.withColumn("code", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("long"))
        return empty.withColumn("label_error", F.lit(None).cast("long")).limit(0), []
    d = first["d"]
    if d % PARTS:
        raise ValueError(f"the dimension {d} is not divisible by {PARTS}")
    m = d // PARTS
    keyed = cut(good.filter(F.size(vector) == d).withColumn("_k", F.monotonically_increasing_id()))
    points = keyed.select("_k", floored(F.col(vector)).alias("v"))
    start = keyed.orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector), "_k").select(floored(F.col(vector)).alias("v"))
    seeds = _matrix(r["v"] for r in start.limit(ENTRIES).collect())
    books = [seeds[:, j * m:(j + 1) * m].copy() for j in range(PARTS)]
    for _ in range(rounds):
        parts = points.mapInPandas(_sums(books), "part int, entry int, n long, s array<string>")
        summed = (
            parts.select("part", "entry", "n", F.posexplode("s").alias("i", "s"))
            .groupBy("part", "entry", "i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            .collect()
        )
        for r in summed:
            books[r["part"]][r["entry"], r["i"]] = int(r["s"]) // int(r["n"])
    coded = points.mapInPandas(_codes(books), "_k long, code string, error long")
    out = cut(keyed.join(coded, "_k"))
    by_label = sized_broadcast(out.groupBy(label).agg(F.sum("error").alias("label_error")), 64)
    out = out.join(by_label, out[label].eqNullSafe(by_label[label]), "left").drop(by_label[label])
    return out.drop("_k"), books
