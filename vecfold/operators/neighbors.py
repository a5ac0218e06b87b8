"""Exact distance work over packed blocks of rows.

All-pairs style operators (nearest neighbours, cheapest foreign edge, distance sums) never
produce rows per pair. Rows are packed into blocks of bounded size, one Spark row per block;
blocks meet through equi-joins and a NumPy kernel keeps a reduced state per block:

* pivots, drawn by hash, split each group into cells; a cell of any size is cut into many
  blocks, so a dense region cannot end up in one task;
* triangle and hyperplane bounds tell which cells a block can need, and only those are joined;
* a task streams the partners of a block one at a time, so memory is two blocks (Spark bounds
  Arrow batches by bytes, ``spark.sql.execution.arrow.maxBytesPerBatch``).

When the bounds cannot exclude anything (unstructured high-dimensional data) the work is
quadratic, as it is for every exact method; sample first, as the parameter search does.

Columns are fixed by convention: ``g`` group, ``id`` integer key, ``v`` array<double>.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.plans.lineage import BROADCAST_LIMIT, cut, cut_counted, sized_broadcast

BLOCK_ROWS = 2048
STRIP_ROWS = 256  # rows of a block whose distances to another are held at once
PAIR_NUMBERS = 1 << 19  # numbers of vectors that are subtracted at once
MAX_PIVOTS = 512  # expected number per group
SLACK = 1e-9  # relative safety margin on floating-point bounds


def dump(**arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def load(blob: bytes) -> dict:
    return pickle.loads(blob)


def centred(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both less the mean of ``x``: a common shift of all rows costs no digits."""
    middle = x.mean(0) if len(x) else np.zeros(x.shape[1])
    return x - middle, y - middle


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dense distances through one matrix product (``margin`` bounds the error)."""
    x, y = centred(x, y)
    d2 =(x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(d2, 0.0))


def pair_distances(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact distances of selected pairs, in slices of about 4 MB."""
    step = max(1, PAIR_NUMBERS // max(1, x.shape[1]))
    out = np.empty(len(rows))
    for s in range(0, len(rows), step):
        diff = x[rows[s : s + step]] - y[cols[s : s + step]]
        out[s : s + step] = np.sqrt((diff * diff).sum(1))
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all pairs whose distance may be at most ``within``, a finite radius per row of ``x``.

    Squares are compared, without a table of roots; ``margin`` makes up for the error.
    """
    spare = margin(x, y)
    x, y = centred(x, y)
    d2 = (-2.0 * x) @ y.T
    d2 += (y * y).sum(1)[None, :]
    return np.nonzero(d2 <= ((within + 2 * spare) ** 2 * (1 + SLACK) - (x * x).sum(1))[:, None])


def strips(x: np.ndarray):
    """``(first row, rows)`` of a block in strips, so that a table of distances stays a few MB."""
    for at in range(0, len(x), STRIP_ROWS):
        yield at, x[at : at + STRIP_ROWS]


def margin(x: np.ndarray, y: np.ndarray) -> float:
    """Bound on the error of ``distances`` for these blocks."""
    x, y = centred(x, y)
    size = (x * x).sum(1).max(initial=0.0) + (y * y).sum(1).max(initial=0.0)
    return float(np.sqrt(size * 1e-13))


def _g_field(df: DataFrame) -> T.StructField:
    return T.StructField("g", df.schema["g"].dataType)


def pack(rows: DataFrame, keys: list[str], extras: list[str]) -> DataFrame:
    """One row per ``keys`` with the packed ids, vectors and extra numeric columns.

    The caller keeps key groups at a bounded size.
    """
    schema = T.StructType(
        [rows.schema[k] for k in keys] + [T.StructField("payload", T.BinaryType())]
    )

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        lists = table["v"].combine_chunks()
        sizes = set(lists.value_lengths().to_pylist())
        if len(sizes) > 1 or None in sizes or lists.flatten().null_count:
            shown = ", ".join("null" if s is None else str(s) for s in sorted(sizes, key=str))
            raise ValueError(f"vectors of one size and without nulls are needed; sizes are {shown}")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        mat = flat.reshape(table.num_rows, -1)[order]
        cols = {c: table[c].to_numpy()[order] for c in ["id", *extras]}
        head = {k: table[k].slice(0, 1).combine_chunks() for k in keys}
        return pa.table({**head, "payload": pa.array([dump(x=mat, **cols)], pa.binary())})

    return rows.select(*keys, "id", "v", *extras).groupBy(*keys).applyInArrow(one, schema)


@dataclass
class Index:
    """Packed points of every group, with what is needed to prune partners."""

    blocks: DataFrame  # g, cell, block, payload
    meta: DataFrame  # g, meta: pivots, cells, radius and rows per cell


def group_sizes(points: DataFrame) -> DataFrame:
    return sized_broadcast(points.groupBy("g").agg(F.count(F.lit(1)).alias("_n")), 32)


def chunked(points: DataFrame, sizes: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Adds ``_chunk``, a hash slice of about ``block_rows`` rows of the key group."""
    chunks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("long")
    return points.join(sizes, keys).withColumn("_chunk", F.pmod(F.xxhash64("id"), chunks))


def build_index(points: DataFrame, extras: list[str], block_rows: int = BLOCK_ROWS) -> Index:
    """Pivot cells over ``(g, id, v, *extras)``."""
    sizes, seen = cut_counted(points.groupBy("g").agg(F.count(F.lit(1)).alias("_n")), most=F.max("_n"))
    g_field = _g_field(points)
    if (seen["most"] or 0) <= block_rows:
        return _one_block_each(points, sizes, extras)
    sizes = F.broadcast(sizes) if seen["n"] * 32 <= BROADCAST_LIMIT else sizes

    wanted = F.least(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(MAX_PIVOTS))
    drawn = F.pmod(F.xxhash64("id", F.lit(17)), F.col("_n")) < wanted
    pivots = pack(points.join(sizes, "g").filter((F.col("_n") > block_rows) & drawn), ["g"], [])
    pivots = cut(pivots.withColumnRenamed("payload", "pivots"))

    cell_schema = T.StructType(
        [g_field]
        + [points.schema["id"], T.StructField("v", T.ArrayType(T.DoubleType()))]
        + [points.schema[c] for c in extras]
        + [T.StructField("cell", T.IntegerType()), T.StructField("_d", T.DoubleType())]
    )
    arrow_types = {"id": pa.int64(), "v": pa.list_(pa.float64())}

    def assign(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                g, blob, piv = (batch.column(c)[i] for c in ("g", "payload", "pivots"))
                part = load(blob.as_py())
                x = part.pop("x")
                d = distances(x, load(piv.as_py())["x"] if piv.is_valid else np.zeros((1, x.shape[1])))
                cell = d.argmin(1)
                offsets = np.arange(len(x) + 1, dtype="i4") * x.shape[1]
                cols = {
                    "g": pa.array([g.as_py()] * len(x), g.type),
                    "id": pa.array(part["id"]),
                    "v": pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel())),
                    **{c: pa.array(part[c]) for c in extras},
                    "cell": pa.array(cell.astype("i4")),
                    "_d": pa.array(d[np.arange(len(x)), cell]),
                }
                yield pa.RecordBatch.from_pydict(cols)

    packs = pack(chunked(points, sizes, ["g"], block_rows), ["g", "_chunk"], extras)
    celled = cut(packs.join(pivots, "g", "left").select("g", "payload", "pivots").mapInArrow(assign, cell_schema))

    cells = celled.groupBy("g", "cell").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_d").alias("radius")
    )
    cells = sized_broadcast(cells, 48)

    def describe(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cells, piv = batch["cells"][i].values, batch["pivots"][i]
                order = np.argsort(cells.field("cell").to_numpy())
                arrays = {c: cells.field(c).to_numpy()[order] for c in ("cell", "radius", "_n")}
                drawn = load(piv.as_py()) if piv.is_valid else None
                arrays["pivots"] = drawn["x"][arrays["cell"]] if drawn else None
                arrays["pivot_id"] = drawn["id"][arrays["cell"]] if drawn else np.empty(0, "i8")
                yield pa.RecordBatch.from_pydict(
                    {"g": batch["g"].slice(i, 1), "meta": pa.array([dump(**arrays)], pa.binary())}
                )

    # a group's cells, at most one per pivot, are one row, so that its pivots travel once and not once per cell
    listed = cells.groupBy("g").agg(F.collect_list(F.struct("cell", "radius", "_n")).alias("cells"))
    meta = listed.join(pivots, "g", "left").select("g", "cells", "pivots").mapInArrow(
        describe, T.StructType([g_field, T.StructField("meta", T.BinaryType())])
    )
    blocks = pack(
        chunked(celled, cells.select("g", "cell", "_n"), ["g", "cell"], block_rows),
        ["g", "cell", "_chunk"],
        extras,
    ).select("g", "cell", (F.col("cell").cast("long") * (1 << 32) + F.col("_chunk")).alias("block"), "payload")
    return Index(cut(blocks), cut(meta))


def _one_block_each(points: DataFrame, sizes: DataFrame, extras: list[str]) -> Index:
    """Groups that all fit into a block need no pivots: one cell that nothing rules out."""
    open_cell = dump(
        cell=np.zeros(1, "i4"), radius=np.full(1, np.inf), _n=np.zeros(1, "i8"), pivots=None,
        pivot_id=np.empty(0, "i8"),
    )
    blocks = pack(points, ["g"], extras).select(
        "g", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("block"), "payload"
    )
    return Index(cut(blocks), sizes.select("g", F.lit(open_cell).alias("meta")))


def to_cells(x: np.ndarray, meta: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots and lower bounds on the distance to any point of each cell."""
    pivots = meta["pivots"]
    if pivots is None:
        pivots = np.zeros((len(meta["cell"]), x.shape[1]))
    d = distances(x, pivots)
    lower = d - meta["radius"][None, :]
    if len(pivots) > 1:
        near = d.argmin(1)
        gap = distances(pivots, pivots)[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d[np.arange(len(x)), near][:, None] ** 2) / (2.0 * gap)
        lower = np.maximum(lower, np.where(gap > 0, plane, 0.0))
    return d, np.maximum(lower - margin(x, pivots) * 4, 0.0)


def part_of(batch: pa.RecordBatch, i: int) -> dict:
    """Arrays of a block row: its payload and, when there is one, its state of this round."""
    part = load(batch["payload"][i].as_py())
    if "state" in batch.schema.names:
        part.update(load(batch["state"][i].as_py()))
    return part


def needed_cells(blocks: DataFrame, meta: DataFrame, bound: Callable) -> DataFrame:
    """``(g, block, cell, lower)``: the cells that can hold a partner for some row of a block.

    ``bound(part, d, meta)`` gives each row's radius beyond which no partner is needed;
    a negative radius asks for nothing.
    """
    schema = T.StructType(
        [
            _g_field(blocks),
            T.StructField("block", T.LongType()),
            T.StructField("cell", T.IntegerType()),
            T.StructField("lower", T.DoubleType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, info = part_of(batch, i), load(batch["meta"][i].as_py())
                d, lower = to_cells(part["x"], info)
                reach = bound(part, d, info)
                hit = lower <= (reach * (1 + SLACK))[:, None]
                keep = np.flatnonzero(hit.any(0))
                least = np.where(hit, lower, np.inf).min(0)[keep]
                yield pa.RecordBatch.from_pydict(
                    {
                        "g": pa.array([batch["g"][i].as_py()] * len(keep), batch["g"].type),
                        "block": pa.array([batch["block"][i].as_py()] * len(keep), pa.int64()),
                        "cell": pa.array(info["cell"][keep].astype("i4")),
                        "lower": pa.array(least),
                    }
                )

    shown = [c for c in ("g", "block", "payload", "state") if c in blocks.columns]
    return blocks.select(*shown).join(meta, "g").mapInArrow(run, schema)


TILE_MOST = 16  # own blocks that one task holds at most
TASK_PAIRS = 512  # about how many pairs of blocks a task of a sliced stream compares


def per_tile_of(blocks: int) -> int:
    return int(min(TILE_MOST, max(1, np.ceil(np.sqrt(blocks)))))


def slices_of(own: DataFrame, others: DataFrame | None = None) -> int:
    """Into how many slices the partners of a tile are cut, so that a task has about ``TASK_PAIRS`` pairs of blocks."""
    def counted(blocks):
        return blocks.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()

    mine = counted(own)
    most = (mine if others is None else counted(others))[1] or 0  # partners are of the same group
    return max(1, -(-per_tile_of(mine[0] or 0) * most // TASK_PAIRS))


def tiled(own: DataFrame, pairs: DataFrame, others: DataFrame, slices: int = 1) -> DataFrame:
    """Rows of ``stream``: each own block once a slice and each (tile, partner) once, dealt by tile and slice and sorted.

    ``tile`` numbers both. A partner row carries the partner's payload and the list of (own block, lower) of its tile that
    need it; no row per pair carries a payload.
    """
    data = [c for c in ("payload", "state") if c in own.columns]
    keys, seen = cut_counted(own.select("g", "block"))
    n_tiles = max(1, int(np.ceil(seen["n"] / per_tile_of(seen["n"]))))
    keys = keys.withColumn("tile", F.pmod(F.xxhash64("g", "block"), F.lit(n_tiles)).cast("int"))
    tiles = F.broadcast(keys) if seen["n"] * 48 <= BROADCAST_LIMIT else keys
    part = F.pmod(F.xxhash64("g", "other", F.lit(5)), F.lit(slices)).cast("int")
    numbered = F.col("tile") * slices + (part if slices > 1 else F.lit(0))
    wanted = pairs.join(tiles, ["g", "block"]).withColumn("tile", numbered).groupBy("tile", "g", "other").agg(
        F.min("lower").alias("lower"), F.collect_list(F.struct("block", "lower")).alias("targets")
    )
    theirs = others.select("g", F.col("block").alias("other"), *data)
    partners = wanted.join(theirs, ["g", "other"]).select(
        "tile", "g", F.lit(-1).cast("long").alias("block"), F.lit(1).alias("order"), "other", "lower", "targets", *data
    )
    targets_type = partners.schema["targets"].dataType
    mine = tiles
    if slices > 1:
        every = F.explode(F.sequence(F.col("tile") * slices, F.col("tile") * slices + (slices - 1)))
        mine = tiles.select("g", "block", every.alias("tile"))
    rows = own.join(mine, ["g", "block"]).select(
        "tile", "g", "block", F.lit(0).alias("order"), F.lit(-1).cast("long").alias("other"), F.lit(-1.0).alias("lower"),
        F.lit(None).cast(targets_type).alias("targets"), *data,
    ).unionByName(partners)
    # four places a task, as places by hash often coincide
    return rows.repartition(4 * n_tiles * slices, "tile").sortWithinPartitions("tile", "order", "lower", "other", "block")


def stream(
    own: DataFrame, pairs: DataFrame, others: DataFrame, kernel: Callable, schema: T.StructType, slices: int = 1
) -> DataFrame:
    """Runs ``kernel`` over each block of ``own`` and its partner blocks.

    ``pairs`` is ``(g, block, other, lower)``. ``kernel(part, g)`` is built per own block and
    has ``feed(part, lower)`` and ``finish() -> dict of arrays``.

    Own blocks are dealt into tiles of about the root of their number (at most ``TILE_MOST``), one
    task per tile. The pairs of a tile are grouped by partner before any payload moves, so a partner
    block travels once per tile that needs it, not once per pair: with P own blocks that all meet, each
    block is shipped about sqrt(P) times. In a tile, partners arrive ordered by the least ``lower`` of
    the tile's blocks that need them, and each of those blocks is fed with its own ``lower``. Kernels
    are therefore exact in any order of ``lower`` and use it only to skip work; kernels that need their
    partners in a fixed order (cluster by cluster) give every pair the partner's number as ``lower``.

    With ``slices`` the partners of a tile are dealt to that many tasks, and each of these finishes its own
    kernel: the caller joins the rows that come of one block. A task's work then stays the same as the blocks
    grow in number.
    """
    rows = tiled(own, pairs, others, slices)
    names = [f.name for f in schema.fields]

    def emit(kernel_state, g):
        cols = kernel_state.finish()
        size = len(next(iter(cols.values())))
        cols = {"g": pa.array([g.as_py()] * size, g.type), **cols}
        return pa.RecordBatch.from_pydict({n: cols[n] for n in names})

    def run(batches):
        tile, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch["tile"][i].as_py()
                if t != tile:
                    for state, g in held.values():
                        yield emit(state, g)
                    tile, held = t, {}
                g = batch["g"][i]
                part = part_of(batch, i)
                if not batch["order"][i].as_py():
                    held[(g.as_py(), batch["block"][i].as_py())] = (kernel(part), g)
                    continue
                for target in batch["targets"][i].as_py():
                    held[(g.as_py(), target["block"])][0].feed(part, target["lower"])
        for state, g in held.values():
            yield emit(state, g)

    return rows.mapInArrow(run, schema)


class _Nearest:
    """The ``k`` nearest rows of each own row, by (distance, id)."""

    def __init__(self, part, k, skip_self):
        self.x, self.id, self.k, self.skip_self = part["x"], part["id"], k, skip_self
        n = len(self.id)
        self.kth = np.full(n, np.inf)
        self.row = np.empty(0, "i8")
        self.dist, self.nid, self.mult = np.empty(0), np.empty(0, "i8"), np.empty(0)

    def feed(self, part, lower):
        if lower > self.kth.max() * (1 + SLACK):
            return
        y, yid = part["x"], part["id"]
        k = min(self.k, len(yid))
        found = []
        for at, x in strips(self.x):
            kth = self.kth[at : at + len(x)]
            if np.isfinite(kth).all():
                rows, cols = close_pairs(x, y, kth)
                if self.skip_self:
                    others = self.id[rows + at] != yid[cols]
                    rows, cols = rows[others], cols[others]
                if len(rows) <= 4 * k * len(x):  # else the lists are still far from their end
                    found.append((rows + at, cols))
                    continue
            approx = distances(x, y)
            if self.skip_self:
                approx[self.id[at : at + len(x), None] == yid[None, :]] = np.inf
            cutoff = np.minimum(np.partition(approx, k - 1, axis=1)[:, k - 1], kth)
            rows, cols = np.nonzero((approx <= (cutoff + margin(x, y))[:, None]) & np.isfinite(approx))
            found.append((rows + at, cols))
        rows, cols = (np.concatenate(c) for c in zip(*found))
        if not len(rows):
            return
        dist = pair_distances(self.x, y, rows, cols)
        mult = part["mult"] if "mult" in part else np.ones(len(yid))
        row = np.concatenate([self.row, rows])
        dist = np.concatenate([self.dist, dist])
        nid = np.concatenate([self.nid, yid[cols]])
        mult = np.concatenate([self.mult, mult[cols].astype(float)])
        order = np.lexsort((nid, dist, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.dist = row[keep], dist[order][keep]
        self.nid, self.mult = nid[order][keep], mult[order][keep]
        last = rank[keep] == self.k - 1
        self.kth[self.row[last]] = self.dist[last]

    def finish(self):
        offsets = pa.array(np.searchsorted(self.row, np.arange(len(self.id) + 1)).astype("i4"))
        return {
            "id": pa.array(self.id),
            "nbr": pa.ListArray.from_arrays(offsets, pa.array(self.nid)),
            "dist": pa.ListArray.from_arrays(offsets, pa.array(self.dist)),
            "nbr_mult": pa.ListArray.from_arrays(offsets, pa.array(self.mult)),
        }


def _knn_schema(df: DataFrame) -> T.StructType:
    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    return T.StructType(
        [
            _g_field(df),
            T.StructField("id", T.LongType()),
            T.StructField("nbr", longs),
            T.StructField("dist", doubles),
            T.StructField("nbr_mult", doubles),
        ]
    )


def _reach(part, d, meta, k, own_rows):
    """Upper bound on each row's k-th neighbour distance."""
    enough = meta["_n"] >= k + 1
    if meta["pivots"] is None or not enough.any():
        reach = np.full(len(d), np.inf)
    else:
        reach = (d + meta["radius"][None, :])[:, enough].min(1)
    if own_rows and len(d) > k:
        near = [np.partition(distances(x, part["x"]), k, axis=1)[:, k] + margin(x, part["x"]) for _, x in strips(part["x"])]
        reach = np.minimum(reach, np.concatenate(near))
    return reach


def _partners(needed: DataFrame, blocks: DataFrame) -> DataFrame:
    theirs = blocks.select("g", "cell", F.col("block").alias("other"))
    return needed.join(theirs, ["g", "cell"]).select("g", "block", "other", "lower")


def _nearest_lists(own: DataFrame, pairs: DataFrame, others: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Neighbour lists of all own rows; those of several slices are merged."""
    slices = slices_of(own, None if others is own else others)
    found = stream(own, pairs, others, lambda p: _Nearest(p, k, skip_self), _knn_schema(own), slices)
    if slices == 1:
        return cut(found)
    near = F.flatten(F.collect_list(F.arrays_zip("dist", "nbr", "nbr_mult")))
    merged = cut(found).groupBy("g", "id").agg(F.slice(F.array_sort(near), 1, k).alias("_x"))
    return cut(merged.select("g", "id", *[F.col(f"_x.{c}").alias(c) for c in ("nbr", "dist", "nbr_mult")]))


def knn(index: Index, k: int) -> DataFrame:
    """``(g, id, nbr, dist, nbr_mult)``: k nearest other rows, sorted by (distance, id)."""
    needed = needed_cells(index.blocks, index.meta, lambda p, d, m: _reach(p, d, m, k, True))
    pairs = _partners(needed, index.blocks)
    return _nearest_lists(index.blocks, pairs, index.blocks, k, True)


def nearest_rows(queries: DataFrame, index: Index, k: int = 1) -> DataFrame:
    """Like ``knn`` for query rows ``(g, id, v)`` against indexed rows."""
    packs = pack(
        chunked(queries, group_sizes(queries), ["g"], BLOCK_ROWS), ["g", "_chunk"], []
    ).withColumnRenamed("_chunk", "block")
    packs = cut(packs)
    needed = needed_cells(packs, index.meta, lambda p, d, m: _reach(p, d, m, k, False))
    pairs = _partners(needed, index.blocks)
    return _nearest_lists(packs, pairs, index.blocks, k, False)


def core_distance(count_self: bool, k: int | None = None):
    """Column: distance to the k-th nearest row, copies of the row included.

    ``k`` as a literal, or the column ``min_samples``. Where a group has fewer rows, its
    farthest neighbour found is taken.
    """
    need = F.col("min_samples") if k is None else F.lit(k)
    start = F.col("mult") if count_self else F.col("mult") - 1
    walked = F.aggregate(
        F.arrays_zip("dist", "nbr_mult"),
        F.struct(start.cast("double").alias("seen"), F.lit(0.0).alias("d")),
        lambda acc, x: F.when(acc["seen"] >= need, acc).otherwise(
            F.struct((acc["seen"] + x["nbr_mult"]).alias("seen"), x["dist"].alias("d"))
        ),
    )
    return walked["d"]
