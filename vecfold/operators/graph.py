"""Forests, components and exact spanning trees as edge tables, in parallel for every group.

Columns by convention: ``g`` group; vertices ``id``; edges ``(g, a, b, w)`` with ``a < b``. All
choices between edges use the total order ``(w, a, b)``, so equal weights cannot form a cycle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.operators.neighbors import (
    Index, SLACK, distances, dump, load, margin, needed_cells, pair_distances, part_of, stream,
    slices_of, strips, _partners,
)
from vecfold.plans.lineage import bucketed, cut, cut_counted


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def roots_counted(links: DataFrame) -> tuple[DataFrame, int]:
    """``(g, id, root)`` for a forest ``(g, id, parent)`` whose roots point to themselves.

    Pointer jumping, three steps per job: the number of jobs is the logarithm of the depth. A
    row is settled once its new parent is seen to point to itself. Also counts the non-roots.
    """
    apart = F.sum((F.col("id") != F.col("parent")).cast("long"))
    now, seen = cut_counted(links.select("g", "id", "parent"), below=apart)
    if not seen["below"]:
        return now.withColumnRenamed("parent", "root"), 0
    while True:
        one = now.select("g", F.col("id").alias("parent"), F.col("parent").alias("_one"))
        two = now.select("g", F.col("id").alias("_one"), F.col("parent").alias("_two"))
        jumped = now.join(one, ["g", "parent"]).join(two, ["g", "_one"])
        now, seen = cut_counted(
            jumped.select("g", "id", "_one", F.col("_two").alias("parent")),
            moved=F.sum((F.col("_one") != F.col("parent")).cast("long")),
            below=apart,
        )
        now = now.select("g", "id", "parent")
        if not seen["moved"]:
            return now.withColumnRenamed("parent", "root"), seen["below"] or 0


def roots(links: DataFrame) -> DataFrame:
    return roots_counted(links)[0]


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(g, id, root)``: connected components, named by their lowest id.

    Every vertex hooks to its lowest neighbour if that is lower, trees collapse to their roots,
    and edges are contracted until none are left; each round at least halves what is left.
    """
    hooks = [vertices.select("g", "id", F.col("id").alias("parent"))]
    live, seen = cut_counted(edges.select("g", F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    merged = []
    while seen["n"]:
        both = live.unionByName(live.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("g", F.col("u").alias("id")).agg(F.min("v").alias("_v"))
        found = roots(low.select("g", "id", F.least("id", "_v").alias("parent")))
        merged.append(found.filter(F.col("id") != F.col("root")).select("g", "id", F.col("root").alias("parent")))
        live = relabel_edges(live, found, ["u", "v"]).distinct()
        live, seen = cut_counted(live)
    if not merged:
        return hooks[0].withColumnRenamed("parent", "root")
    return roots(with_links(vertices, merged))


def with_links(vertices: DataFrame, merged: list[DataFrame]) -> DataFrame:
    """Forest over all vertices from the links recorded when vertices were merged away."""
    links = union_all(merged).withColumnRenamed("parent", "_p")
    return vertices.select("g", "id").join(links, ["g", "id"], "left").select(
        "g", "id", F.coalesce("_p", "id").alias("parent")
    )


def relabel_edges(edges: DataFrame, found: DataFrame, ends: list[str]) -> DataFrame:
    """Edge ends replaced by their roots (ends without one stay); inner edges are dropped."""
    for end in ends:
        names = found.select("g", F.col("id").alias(end), F.col("root").alias("_r"))
        kept = [F.coalesce("_r", end).alias(c) if c == end else F.col(c) for c in edges.columns]
        edges = edges.join(names, ["g", end], "left").select(*kept)
    return edges.filter(F.col(ends[0]) != F.col(ends[1]))


def hook(best: DataFrame) -> DataFrame:
    """Links ``(g, id, parent)`` from each component's chosen edge ``best = (w, a, b, other)``.

    Two components that chose the same edge form the only possible cycle; the lower one is root.
    """
    theirs = best.select("g", F.col("id").alias("_o"), F.col("best.a").alias("_a"), F.col("best.b").alias("_b"))
    mine = best.select("g", "id", F.col("best.other").alias("_o"), F.col("best.a").alias("a"), F.col("best.b").alias("b"))
    same = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("id") < F.col("_o"))
    return mine.join(theirs, ["g", "_o"], "left").select(
        "g", "id", F.when(F.coalesce(same, F.lit(False)), F.col("id")).otherwise(F.col("_o")).alias("parent")
    )


def _ends(u, v):
    return F.least(u, v).alias("a"), F.greatest(u, v).alias("b")


def _state(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per block, the arrays of this round in the order of the block's ids."""
    schema = T.StructType(
        [rows.schema["g"], rows.schema["block"], T.StructField("state", T.BinaryType())]
    )

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        state = dump(**{c: table[c].to_numpy()[order] for c in columns})
        head = {k: table[k].slice(0, 1).combine_chunks() for k in ("g", "block")}
        return pa.table({**head, "state": pa.array([state], pa.binary())})

    return rows.select("g", "block", "id", *columns).groupBy("g", "block").applyInArrow(one, schema)


class _Foreign:
    """The lightest edge from each component of a block to any other component."""

    def __init__(self, part):
        self.x, self.id, self.core, self.comp = part["x"], part["id"], part["core"], part["comp"]
        self.names, self.local = np.unique(self.comp, return_inverse=True)
        self.limit = np.full(len(self.names), -np.inf)
        np.maximum.at(self.limit, self.local, part["limit"])
        self.active = part["floor"] <= part["limit"]
        self.best = [np.empty(0, "i8"), np.empty(0), np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")]

    def feed(self, part, lower):
        reach = np.where(self.active, self.limit[self.local], -np.inf)
        if lower > reach.max() * (1 + SLACK):
            return
        found = []
        for at, x in strips(self.x):
            own = slice(at, at + len(x))
            if lower > reach[own].max() * (1 + SLACK):
                continue
            spare = margin(x, part["x"]) + SLACK * np.where(np.isfinite(reach[own]), np.abs(reach[own]), 0.0)
            approx = np.maximum(distances(x, part["x"]), np.maximum(self.core[own, None], part["core"][None, :]))
            hit = (approx <= (reach[own] + spare)[:, None]) & (self.comp[own, None] != part["comp"][None, :])
            # no row needs more than its own lightest candidates
            light = np.where(hit, approx, np.inf).min(1)
            hit &= approx <= (light + spare)[:, None]
            rows, cols = np.nonzero(hit)
            found.append((rows + at, cols))
        if not found:
            return
        rows, cols = (np.concatenate(c) for c in zip(*found))
        if not len(rows):
            return
        w = np.maximum(
            pair_distances(self.x, part["x"], rows, cols), np.maximum(self.core[rows], part["core"][cols])
        )
        u, v = self.id[rows], part["id"][cols]
        new = [self.local[rows], w, np.minimum(u, v), np.maximum(u, v), part["comp"][cols]]
        merged = [np.concatenate(p) for p in zip(self.best, new)]
        order = np.lexsort((merged[3], merged[2], merged[1], merged[0]))
        comp = merged[0][order]
        first = np.ones(len(comp), bool)
        first[1:] = comp[1:] != comp[:-1]
        self.best = [m[order][first] for m in merged]
        self.limit[self.best[0]] = np.minimum(self.limit[self.best[0]], self.best[1])

    def finish(self):
        local, w, a, b, other = self.best
        return {
            "id": pa.array(self.names[local]), "w": pa.array(w), "a": pa.array(a), "b": pa.array(b),
            "other": pa.array(other),
        }


def _pivot_limits(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """``(g, id, limit)``: an upper bound per component, from the pivots as known foreign rows."""
    schema = T.StructType(
        [blocks.schema["g"], T.StructField("id", T.LongType()), T.StructField("limit", T.DoubleType())]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, info = part_of(batch, i), load(batch["meta"][i].as_py())
                if info["pivots"] is None or batch["pstate"][i].as_py() is None:
                    continue
                known = load(batch["pstate"][i].as_py())
                at = np.searchsorted(known["id"], info["pivot_id"])
                core, comp = known["core"][at], known["comp"][at]
                w = np.maximum(distances(part["x"], info["pivots"]), np.maximum(part["core"][:, None], core[None, :]))
                w += margin(part["x"], info["pivots"])
                w[part["comp"][:, None] == comp[None, :]] = np.inf
                names, local = np.unique(part["comp"], return_inverse=True)
                least = np.full(len(names), np.inf)
                np.minimum.at(least, local, w.min(1))
                yield pa.RecordBatch.from_pydict(
                    {"g": pa.array([batch["g"][i].as_py()] * len(names), batch["g"].type),
                     "id": pa.array(names), "limit": pa.array(least)}
                )

    return blocks.select("g", "block", "payload", "state").join(meta, "g").mapInArrow(run, schema).groupBy(
        "g", "id"
    ).agg(F.min("limit").alias("limit"))


def _vertex_blocks(index: Index) -> DataFrame:
    schema = T.StructType(
        [index.blocks.schema["g"], T.StructField("id", T.LongType()), T.StructField("block", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = load(batch["payload"][i].as_py())["id"]
                yield pa.RecordBatch.from_pydict(
                    {"g": pa.array([batch["g"][i].as_py()] * len(ids), batch["g"].type), "id": pa.array(ids),
                     "block": pa.array(np.full(len(ids), batch["block"][i].as_py()))}
                )

    return index.blocks.select("g", "block", "payload").mapInArrow(run, schema)


def _pivot_rows(index: Index) -> DataFrame:
    schema = T.StructType([index.meta.schema["g"], T.StructField("id", T.LongType())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = load(batch["meta"][i].as_py())["pivot_id"]
                yield pa.RecordBatch.from_pydict(
                    {"g": pa.array([batch["g"][i].as_py()] * len(ids), batch["g"].type),
                     "id": pa.array(ids, pa.int64())}
                )

    return index.meta.mapInArrow(run, schema)


def _search(blocks: DataFrame, index: Index, slices: int) -> DataFrame:
    """Lightest foreign edge per component, exact among rows whose lists cannot rule it out."""

    def bound(part, d, info):
        return np.where(part["floor"] <= part["limit"], part["limit"], -1.0)

    pairs = _partners(needed_cells(blocks, index.meta, bound), index.blocks)
    longs = [T.StructField(c, T.LongType()) for c in ("a", "b", "other")]
    schema = T.StructType(
        [blocks.schema["g"], T.StructField("id", T.LongType()), T.StructField("w", T.DoubleType()), *longs]
    )
    return stream(blocks, pairs, blocks, _Foreign, schema, slices)


def placed_vertices(index: Index, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(g, id, core, floor)`` rows with their block, and those of them that are pivots."""
    rows = rows.select("g", "id", "core", "floor")
    vertices = cut(_vertex_blocks(index).join(rows, ["g", "id"]))
    return vertices, cut(_pivot_rows(index).join(rows.select("g", "id", "core"), ["g", "id"]))


@dataclass
class Fixed:
    """The packed vectors of an index, written once bucketed by ``(g, block)``."""

    payload: DataFrame
    buckets: int
    slices: int


def fixed_blocks(index: Index) -> Fixed:
    """Buckets from the number of blocks (about four blocks each), so a bucket stays a few blocks."""
    blocks, seen = cut_counted(index.blocks.select("g", "cell", "block", "payload"))
    buckets = int(max(1, min(4096, seen["n"] // 4)))
    return Fixed(bucketed(blocks, ["g", "block"], buckets), buckets, slices_of(blocks))


def foreign_edges(
    index: Index, vertices: DataFrame, pivots: DataFrame, named: DataFrame, known: DataFrame | None = None,
    fixed: Fixed | None = None,
) -> DataFrame:
    """``(g, id, best)``: the lightest edge of each component ``comp`` to any other.

    ``named`` is ``(g, id, comp)``. ``known`` are lightest edges found elsewhere; rows whose
    ``floor`` is above the component's best known weight are not searched again.
    """
    limits = _limits(index, vertices, pivots, named, known, fixed)
    rows = vertices.join(named, ["g", "id"]).join(limits, ["g", "comp"], "left").withColumn(
        "limit", F.coalesce("limit", F.lit(float("inf")))
    )
    state = _state(rows, ["core", "floor", "comp", "limit"])
    if fixed is None:
        blocks = cut(index.blocks.select("g", "cell", "block", "payload").join(state, ["g", "block"]))
        slices = slices_of(index.blocks)
    else:
        slices = fixed.slices
        # only the state of this round is written; it meets the vectors bucket by bucket
        blocks = fixed.payload.join(bucketed(state, ["g", "block"], fixed.buckets), ["g", "block"])
    found = _search(blocks, index, slices).select("g", "id", F.struct("w", "a", "b", "other").alias("best"))
    if known is not None:
        found = found.unionByName(known)
    return found.groupBy("g", "id").agg(F.min("best").alias("best"))


def spanning_tree(index: Index, cores: DataFrame, lists: DataFrame | None = None, k: int = 0) -> DataFrame:
    """``(g, a, b, w)``: minimum spanning tree under mutual reachability.

    ``cores`` is ``(g, id, core)``. ``lists`` are the ``k`` neighbours of ``knn``: a component
    merges along a listed edge as long as that edge is lighter than anything its rows could
    have left out. Only components for which the lists are not enough search the packed blocks,
    within the radius of their best known edge.
    """
    cores = cut(cores.select("g", "id", "core"))
    alone = cut(index.blocks.groupBy("g").count().filter("count = 1").select("g"))
    inside = _inside_blocks(index.blocks.join(alone, "g", "left_semi"), cores.join(alone, "g", "left_semi"))
    cores = cut(cores.join(alone, "g", "left_anti"))
    shape = cores.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("k")).first()
    wanted = shape["n"] - shape["k"]
    if not wanted:
        return inside
    lists = lists.join(alone, "g", "left_anti") if lists is not None else None
    if lists is None:
        floors = cores.select("g", "id", F.col("core").alias("floor"))
        live = None
    else:
        live, floors = _listed_edges(lists, cores, k)
    comps = cut(floors.select("g", F.col("id"), "floor"))
    tree, merged, done = [], [], 0

    while live is not None and done < wanted:
        best = _lightest(live)
        safe = best.join(comps, ["g", "id"]).filter(F.col("best.w") < F.col("floor"))
        step, n = _merge(safe.select("g", "id", "best"), comps, tree, merged)
        if not n:
            break
        done += n
        live = _contract(live, step)
        comps = _comp_floors(comps, step)

    if done < wanted:
        vertices, pivots = placed_vertices(index, cores.join(floors, ["g", "id"]))
        fixed = fixed_blocks(index)
    while done < wanted:
        names = roots(with_links(cores, merged)) if merged else cores.select("g", "id", F.col("id").alias("root"))
        named = names.select("g", "id", F.col("root").alias("comp"))
        known = _lightest(live) if live is not None else None
        best = foreign_edges(index, vertices, pivots, named, known, fixed)
        step, n = _merge(best, comps, tree, merged)
        if not n:
            raise RuntimeError("spanning tree search found no edge for an open component")
        done += n
        live = _contract(live, step) if live is not None else None
        comps = _comp_floors(comps, step)
    return cut(union_all([inside, *tree]))


def tree_inside(x: np.ndarray, ids: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (the lower id first) and weights of the spanning tree of one block's rows."""
    n = len(ids)
    best, free = np.full(n, np.inf), np.ones(n, bool)
    low, high = np.full(n, np.iinfo("i8").max), np.full(n, np.iinfo("i8").max)
    at, ends, weights = 0, [], []
    for _ in range(n - 1):
        free[at] = False
        diff = x - x[at]
        w = np.maximum(np.sqrt((diff * diff).sum(1)), np.maximum(core, core[at]))
        # edges in the order (w, a, b), so that the tree is the one of the block search
        a, b = np.minimum(ids, ids[at]), np.maximum(ids, ids[at])
        tied = (w == best) & ((a < low) | ((a == low) & (b < high)))
        closer = free & ((w < best) | tied)
        best[closer], low[closer], high[closer] = w[closer], a[closer], b[closer]
        near = np.flatnonzero(free & (best == np.where(free, best, np.inf).min()))
        at = int(near[np.lexsort((high[near], low[near]))[0]])
        ends.append((low[at], high[at]))
        weights.append(best[at])
    ends = np.sort(np.array(ends, "i8").reshape(-1, 2), axis=1)
    return ends, np.array(weights, float)


def _inside_blocks(single: DataFrame, cores: DataFrame) -> DataFrame:
    """Spanning trees of the groups that are a single block, grown inside the block."""
    state = _state(cores.withColumn("block", F.lit(0).cast("long")), ["core"]).drop("block")
    schema = T.StructType(
        [cores.schema["g"], T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("w", T.DoubleType())]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = part_of(batch, i)
                n = len(part["id"])
                ends, weights = tree_inside(part["x"], part["id"], part["core"])
                yield pa.RecordBatch.from_pydict(
                    {"g": pa.array([batch["g"][i].as_py()] * (n - 1), batch["g"].type), "a": pa.array(ends[:, 0]),
                     "b": pa.array(ends[:, 1]), "w": pa.array(weights)}
                )

    n = int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = single.join(state, "g").repartition(n, "g")
    return cut(packed.select("g", "payload", "state").mapInArrow(run, schema))


def _listed_edges(lists: DataFrame, cores: DataFrame, k: int):
    """Listed edges between single vertices, and the weight below which a list is complete.

    A list shorter than ``k`` holds all other rows of its group.
    """
    rows = lists.join(cores, ["g", "id"])
    cutoff = F.greatest(F.element_at("dist", -1), F.col("core"))
    floors = rows.select(
        "g", "id", F.when(F.size("dist") >= k, cutoff).otherwise(float("inf")).alias("floor")
    )
    flat = rows.select("g", "id", "core", F.explode(F.arrays_zip("nbr", "dist")).alias("x")).select(
        "g", "id", "core", F.col("x.nbr").alias("nbr"), F.col("x.dist").alias("dist")
    )
    theirs = cores.select("g", F.col("id").alias("nbr"), F.col("core").alias("_core"))
    edges = flat.join(theirs, ["g", "nbr"]).select(
        "g", *_ends("id", "nbr"), F.greatest("dist", "core", "_core").alias("w")
    )
    # an edge may be listed from both ends
    edges = edges.groupBy("g", "a", "b").agg(F.min("w").alias("w"))
    return cut(edges.select("*", F.col("a").alias("u"), F.col("b").alias("v"))), cut(floors)


def _lightest(live: DataFrame) -> DataFrame:
    """The lightest listed edge per component: ``(g, id, best)``."""
    one = live.select("g", F.col("u").alias("id"), F.struct("w", "a", "b", F.col("v").alias("other")).alias("best"))
    two = live.select("g", F.col("v").alias("id"), F.struct("w", "a", "b", F.col("u").alias("other")).alias("best"))
    return one.unionByName(two).groupBy("g", "id").agg(F.min("best").alias("best"))


def _merge(best: DataFrame, comps: DataFrame, tree: list, merged: list):
    """Merge components along their chosen edges; returns the renaming and the edges added."""
    best, seen = cut_counted(best)
    if not seen["n"]:
        return None, 0
    edges = best.select("g", F.col("best.a").alias("a"), F.col("best.b").alias("b"), F.col("best.w").alias("w"))
    tree.append(edges.distinct())
    # components that are only pointed at are roots of their own
    ends = comps.select("g", "id").join(hook(best), ["g", "id"], "left").select(
        "g", "id", F.coalesce("parent", "id").alias("parent")
    )
    step, n = roots_counted(ends)
    merged.append(step.filter(F.col("id") != F.col("root")).select("g", "id", F.col("root").alias("parent")))
    return step, n


def _contract(live: DataFrame, step: DataFrame) -> DataFrame:
    """Listed edges between merged components; of parallel edges only the lightest stays."""
    edges = relabel_edges(live, step, ["u", "v"])
    u, v = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    kept = edges.select("g", u, v, F.struct("w", "a", "b").alias("e")).groupBy("g", "u", "v").agg(F.min("e").alias("e"))
    return cut(kept.select("g", "e.a", "e.b", "e.w", "u", "v"))


def _comp_floors(comps: DataFrame, step: DataFrame) -> DataFrame:
    return cut(
        comps.join(step, ["g", "id"]).groupBy("g", F.col("root").alias("id")).agg(F.min("floor").alias("floor"))
    )


def _limits(
    index: Index, vertices: DataFrame, pivots: DataFrame, named: DataFrame, known: DataFrame | None, fixed: Fixed | None = None
) -> DataFrame:
    """``(g, comp, limit)``: weight of some foreign edge, listed or to a pivot."""
    rows = vertices.join(named, ["g", "id"])
    state = _state(rows, ["core", "comp"])
    if fixed is None:
        blocks = index.blocks.select("g", "block", "payload").join(state, ["g", "block"])
    else:
        blocks = fixed.payload.select("g", "block", "payload").join(bucketed(state, ["g", "block"], fixed.buckets), ["g", "block"])
    per_g = pivots.join(named, ["g", "id"])
    schema = T.StructType([per_g.schema["g"], T.StructField("pstate", T.BinaryType())])

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy())
        blob = dump(**{c: table[c].to_numpy()[order] for c in ("id", "core", "comp")})
        return pa.table({"g": table["g"].slice(0, 1).combine_chunks(), "pstate": pa.array([blob], pa.binary())})

    # at most one row per pivot in each group
    pstate = per_g.select("g", "id", "core", "comp").groupBy("g").applyInArrow(one, schema)
    limits = _pivot_limits(blocks, index.meta.join(pstate, "g", "left"))
    if known is not None:
        listed = known.select("g", "id", F.col("best.w").alias("limit"))
        limits = limits.unionByName(listed).groupBy("g", "id").agg(
            F.min("limit").alias("limit")
        )
    return cut(limits.withColumnRenamed("id", "comp"))
