"""The toxicity fit holds few bytes per entry of its matrix."""

from __future__ import annotations

import tracemalloc

import numpy as np

from vecfold.llm import toxicity


def test_toxicity_fit_holds_few_bytes_an_entry():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60_000, 1500).astype(np.uint32)) for _ in range(1000)]
    label = (np.arange(1000) % 2).astype(float)
    entries, own = sum(map(len, sets)), [s.tobytes() for s in sets]
    tracemalloc.start()
    bias, weights = toxicity.fit_rows(own, [None] * 1000, label, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weights is not None and peak < 45 * entries
    x = toxicity.Rows(own, np.arange(60_000, dtype=np.uint32))
    w, r = rng.normal(size=60_000), rng.normal(size=1000)
    assert np.allclose(x.dot(w), [w[s].sum() for s in sets])
    back = np.zeros(60_000)
    for s, v in zip(sets, r):
        back[s] += v
    assert np.allclose(x.back(r), back)
