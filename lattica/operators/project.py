"""Projections, medoids and graph clusterings of codebook-sized inputs, and principal components of any number of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(samples: DataFrame, n: int) -> DataFrame:
    """The first n columns of U S of the samples, not centred: (sample_id, p).

    Partitions add up their Gram matrices (components squared, not rows), so one pass gives the axes
    and another projects. The sign of an axis makes its largest component positive.
    """
    dims = samples.select(F.max(F.size("x"))).first()[0]

    def gram(batches):
        g = np.zeros((dims, dims))
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1)
            g += x.T @ x if len(x) else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(dims * dims), pa.int32()), pa.array(g.ravel())], names=["k", "v"])

    rows = samples.select("x").mapInArrow(gram, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    values, vectors = np.linalg.eigh(np.array([r["v"] for r in rows]).reshape(dims, dims))
    axes = vectors[:, np.argsort(-values, kind="stable")[:n]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def project(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.array((x @ axes).tolist() if len(x) else [], pa.list_(pa.float64()))], names=["sample_id", "p"])

    return samples.select(F.col("sample_id").cast("long").alias("sample_id"), "x").mapInArrow(project, "sample_id long, p array<double>")


def _pairwise(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def stress(x: np.ndarray, y: np.ndarray) -> float:
    i, j = np.triu_indices(len(x), 1)
    a, b = _pairwise(x)[i, j], _pairwise(y)[i, j]
    keep = a > 0
    return float(((a - b)[keep] ** 2 / a[keep]).sum() / a[keep].sum())


def sammon(x: np.ndarray, dims: int = 2, rate: float = 1.0, least: float = 0.01, shrink: float = 0.95, rounds: int = 20) -> np.ndarray:
    """Positions whose distances follow those of x: gradient steps on the stress from the first
    components. A round that does not lower the stress is undone and halves its step."""
    y = x[:, :dims].astype(float).copy()
    a = _pairwise(x)
    np.fill_diagonal(a, 1)
    a[a == 0] = 1e-12
    best, total = stress(x, y), a.sum()
    while rate > least:
        step = rate
        for _ in range(rounds):
            b = _pairwise(y)
            np.fill_diagonal(b, 1)
            b[b == 0] = 1e-12
            pull = (a - b) / (a * b)
            np.fill_diagonal(pull, 0)
            move = (pull[:, :, None] * (y[:, None, :] - y[None, :, :])).sum(axis=1) * len(x) / total
            trial = y + step * move
            if (s := stress(x, trial)) < best:
                y, best = trial, s
            else:
                step /= 2
        rate *= shrink
    return y


def k_medoids(x: np.ndarray, k: int, seed: int, restarts: int = 20, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(medoid rows, labels): nearest medoid, then the member with the least sum of distances, until
    nothing changes; the best of seeded restarts. Ties go to the smaller row."""
    if not 0 < k <= len(x):
        raise ValueError("between one and all rows can be medoids")
    d, rng, best = _pairwise(x), np.random.default_rng(seed), None
    for _ in range(restarts):
        m = np.sort(rng.choice(len(x), k, replace=False))
        for _ in range(rounds):
            label = d[:, m].argmin(axis=1)
            new = np.sort([(mine := np.flatnonzero(label == c))[d[np.ix_(mine, mine)].sum(axis=1).argmin()] if (label == c).any() else m[c] for c in range(k)])
            if (new == m).all():
                break
            m = new
        label = d[:, m].argmin(axis=1)
        cost = float(d[np.arange(len(x)), m[label]].sum())
        if best is None or cost < best[0] - 1e-12:
            best = (cost, m, label)
    return best[1], best[2]


def betweenness(n: int, edges: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Number of shortest paths through each edge, shared among equal ones, over unordered pairs of nodes."""
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out = dict.fromkeys(edges, 0.0)
    for s in range(n):
        hop, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in near[v]:
                if u not in hop:
                    hop[u] = hop[v] + 1
                    paths[u] = 0.0
                    order.append(u)
                if hop[u] == hop[v] + 1:
                    paths[u] += paths[v]
        load = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in near[u]:
                if hop[v] == hop[u] - 1:
                    c = paths[v] / paths[u] * (1 + load[u])
                    load[v] += c
                    out[min(u, v), max(u, v)] += c / 2
    return out


def labels_of(n: int, edges) -> np.ndarray:
    """Connected components, numbered by their smallest node."""
    low = np.arange(n)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return np.unique(low, return_inverse=True)[1]


def cut_by_betweenness(n: int, edges: set[tuple[int, int]], remove: int) -> np.ndarray:
    """Labels after taking out the edge of highest betweenness ``remove`` times; ties by the smaller pair."""
    left = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    for _ in range(min(remove, len(left))):
        load = betweenness(n, left)
        left.remove(min(left, key=lambda e: (-round(load[e], 9), e)))
    return labels_of(n, left)


def multilevel_modularity(n: int, weights: dict[tuple[int, int], float]) -> np.ndarray:
    """Greedy merging, then modules collapse into nodes, again until their number no longer shrinks."""
    from .cluster import greedy_modularity

    label, w, size = np.arange(n), dict(weights), n
    while True:
        step = greedy_modularity(size, w)
        label = step[label]
        new: dict[tuple[int, int], float] = {}
        for (a, b), v in w.items():
            e = (int(step[a]), int(step[b]))
            new[e] = new.get(e, 0.0) + v
        w, now = new, int(step.max()) + 1
        if now == size:
            return label
        size = now
