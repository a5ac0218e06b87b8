"""Distance kernels hold few MB, and full neighbour lists are met without tables of distances."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from vecfold.operators import neighbors as N


def test_pair_distances_hold_a_few_mb():
    rng = np.random.default_rng(1)
    x, rows, cols = rng.normal(size=(2048, 64)), rng.integers(0, 2048, 60_000), rng.integers(0, 2048, 60_000)
    tracemalloc.start()
    found = N.pair_distances(x, x, rows, cols)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    assert np.allclose(found, np.linalg.norm(x[rows] - x[cols], axis=1))


def test_full_lists_need_no_table_of_distances(monkeypatch):
    rng = np.random.default_rng(2)
    parts = [{"x": rng.integers(0, 4, (300, 5)).astype(float) + 1e6, "id": np.arange(300) + 300 * i} for i in range(4)]
    calls, dense = [], N.distances
    monkeypatch.setattr(N, "distances", lambda x, y: calls.append(1) or dense(x, y))
    kernel = N._Nearest(parts[0], 6, True)
    for part in parts:
        kernel.feed(part, 0.0)
    x, ids = (np.concatenate([p[c] for p in parts]) for c in ("x", "id"))
    for i in range(300):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        near = np.lexsort((ids, d))[:6]
        mine = kernel.row == i
        assert kernel.nid[mine].tolist() == ids[near].tolist() and kernel.dist[mine].tolist() == d[near].tolist()
    apart = {"x": parts[0]["x"] + 50.0, "id": np.arange(300) + 9000}
    calls.clear()
    kernel.feed(apart, 0.0)
    assert not calls and kernel.nid.max() < 1200


def test_meta_holds_each_cell_with_its_pivot(spark):
    points = spark.range(600).select(
        (F.col("id") % 2).alias("g"), "id", F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("v")
    )
    index = N.build_index(points, [], block_rows=32)
    for row in index.meta.collect():
        info = N.load(row["meta"])
        assert info["cell"].tolist() == sorted(info["cell"].tolist()) and info["_n"].sum() == 300
        assert len(info["pivots"]) == len(info["cell"]) == len(info["pivot_id"])
        assert (info["pivots"][:, 0] == info["pivot_id"]).all()
