"""Plain in-memory definitions that the Spark operators are tested against."""

from __future__ import annotations

import numpy as np

SMALLEST = 1e-12


def pairwise(x):
    x = np.asarray(x, float)
    out = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        diff = x[i][None, :] - x
        out[i] = np.sqrt((diff * diff).sum(1))
    return out


def cores(d, k):
    return np.sort(d, axis=1)[:, min(k, len(d)) - 1]


def mutual(d, core):
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def prim_weight(m):
    n = len(m)
    best, inside, total = m[0].copy(), np.zeros(n, bool), 0.0
    inside[0] = True
    for _ in range(n - 1):
        best_out = np.where(inside, np.inf, best)
        j = int(best_out.argmin())
        total += best_out[j]
        inside[j] = True
        best = np.minimum(best, m[j])
    return total


def hdbscan(x, min_samples, min_cluster_size):
    """Labels by (size descending, lowest row), and outlier scores."""
    d = pairwise(x)
    m = mutual(d, cores(d, min_samples))
    n = len(m)
    comp = np.arange(n)
    state = {i: (1, None, [i]) for i in range(n)}  # size, cluster, pending rows
    parent, form, points = {}, {}, {}
    iu, ju = np.triu_indices(n, 1)
    w_all = m[iu, ju]
    next_id = 0
    for w in np.unique(w_all):
        hits = np.flatnonzero(w_all == w)
        links = {}

        def find(c):
            while links.get(c, c) != c:
                c = links[c]
            return c

        touched = set()
        for h in hits:
            a, b = find(comp[iu[h]]), find(comp[ju[h]])
            touched |= {comp[iu[h]], comp[ju[h]]}
            if a != b:
                links[max(a, b)] = min(a, b)
        groups = {}
        for c in touched:
            groups.setdefault(find(c), []).append(c)
        for root, cs in groups.items():
            if len(cs) < 2:
                continue
            size = sum(state[c][0] for c in cs)
            clusters = [state[c][1] for c in cs if state[c][1] is not None]
            pending = [p for c in cs for p in state[c][2]]
            if len(clusters) == 1:
                mine = clusters[0]
            elif len(clusters) >= 2 or size >= min_cluster_size:
                mine, next_id = next_id, next_id + 1
                form[mine], points[mine] = w, []
                for c in clusters:
                    parent[c] = mine
            else:
                mine = None
            if mine is not None:
                points[mine] += [(p, w) for p in pending]
                pending = []
            for c in cs:
                comp[comp == c] = root
                if c != root:
                    del state[c]
            state[root] = (size, mine, pending)
    labels, scores = np.full(n, -1), np.ones(n)
    kids = {c: [k for k in form if parent.get(k) == c] for c in form}
    inv = lambda w: 1.0 / max(w, SMALLEST)
    size, best, chosen, low = {}, {}, {}, {}
    for c in sorted(form, key=lambda c: (form[c], c)):
        size[c] = len(points[c]) + sum(size[k] for k in kids[c])
        low[c] = min([form[c]] + [low[k] for k in kids[c]])
        below = sum(best[k] for k in kids[c])
        if c not in parent:
            chosen[c], best[c] = False, below
            continue
        out = inv(form[parent[c]])
        mass = sum(inv(w) - out for _, w in points[c]) + sum(size[k] for k in kids[c]) * (inv(form[c]) - out)
        chosen[c] = mass >= below
        best[c] = max(mass, below)
    for c in form:
        top, at = None, c
        while True:
            if chosen[at]:
                top = at
            if at not in parent:
                break
            at = parent[at]
        for p, w in points[c]:
            labels[p] = -1 if top is None else top
            scores[p] = 1.0 - max(low[c], SMALLEST) / max(w, SMALLEST)
    order = sorted(
        {l for l in labels if l >= 0}, key=lambda l: (-(labels == l).sum(), np.flatnonzero(labels == l)[0])
    )
    renamed = {l: i for i, l in enumerate(order)}
    return np.array([renamed.get(l, -1) for l in labels]), scores


def dbcv(x, labels):
    """Copies of a row are joined to it by edges of weight zero."""
    x, labels = np.asarray(x, float), np.asarray(labels)
    names = np.unique(labels)
    if len(names) < 2:
        return -1.0
    dim, n = x.shape[1], len(x)
    inner, core, sparse = {}, np.zeros(n), {}
    for c in names:
        idx = np.flatnonzero(labels == c)
        if len(idx) < 2:
            continue
        d = pairwise(x[idx])
        for i in range(len(idx)):
            others = np.delete(d[i], i)
            core[idx[i]] = 0.0 if (others == 0).any() else ((others ** -dim).sum() / (len(idx) - 1)) ** (-1.0 / dim)
        reps = {}
        for i in idx:
            reps.setdefault(tuple(x[i]), []).append(i)
        first = sorted(v[0] for v in reps.values())
        m = mutual(pairwise(x[first]), core[first])
        edges, inside = [], [0]
        while len(inside) < len(first):
            out = [j for j in range(len(first)) if j not in inside]
            w, a, b = min((m[a, b], a, b) for a in inside for b in out)
            edges.append((w, first[a], first[b]))
            inside.append(b)
        degree = {i: int(len(reps[tuple(x[i])]) > 1) for i in first}
        for _, a, b in edges:
            degree[a] += 1
            degree[b] += 1
        mine = [i for i in first if degree[i] > 1] or first
        inner[c] = mine
        between = [w for w, a, b in edges if a in mine and b in mine] or [w for w, _, _ in edges] or [0.0]
        sparse[c] = max(between)
    total = 0.0
    for c in inner:
        apart = min(
            max(np.sqrt(((x[a] - x[b]) ** 2).sum()), core[a], core[b])
            for o in inner if o != c for a in inner[c] for b in inner[o]
        )
        top = max(apart, sparse[c])
        total += (labels == c).sum() / n * ((apart - sparse[c]) / top if top > 0 else 0.0)
    return total
