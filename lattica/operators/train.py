"""Training. A batch epoch is a DataFrame aggregate and scales with the samples; online training
is sequential by nature and runs as a numpy kernel, one task for each run."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions import vector as V
from . import assign
from .assign import cng, matrix, small
from .reshape import numbered


def weighted_means(moved: DataFrame) -> DataFrame:
    """``moved(neuron_id, h, x)`` to (neuron_id, w): means weighted by h, by position."""
    part = moved.select("neuron_id", "h", F.posexplode("x").alias("pos", "v")).groupBy("neuron_id", "pos").agg((F.sum(F.col("h") * F.col("v")) / F.sum("h")).alias("v"))
    return gathered(part, "neuron_id")


def gathered(part: DataFrame, key: str) -> DataFrame:
    """``part(key, pos, v)`` to (key, w)."""
    return part.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("w"))


def moments(samples: DataFrame, codebook: DataFrame, dist: assign.Distance, pull, x: str = "x") -> DataFrame:
    """(neuron_id, n, s): sums over samples of a weight, and of the weight times the vector, for each
    neuron. ``pull(distances)`` gives the weights as a matrix of samples by neurons.

    Sums are made where the samples lie, one row a neuron and task, so samples are never exchanged."""
    held = samples.sparkSession.sparkContext.broadcast(assign.neurons(codebook))
    arrays = [f.name for f in samples.schema if isinstance(f.dataType, T.ArrayType)]

    def run(batches):
        book = held.value
        n = s = None
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                got = {c: matrix(part.column(c)) for c in arrays}
                at = np.flatnonzero(np.logical_and.reduce([ok for _, ok in got.values()]))
                if not len(at):
                    continue
                v = {c: m[at] for c, (m, _) in got.items()}
                h = pull(dist(v, book))
                sums = h.T @ v[x]
                n, s = (h.sum(axis=0), sums) if n is None else (n + h.sum(axis=0), s + sums)
        if n is not None:
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(book["neuron_id"][some]), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.float64()))], names=["neuron_id", "n", "s"])

    parts = samples.mapInArrow(run, "neuron_id long, n double, s array<double>")
    return parts.select("neuron_id", "n", F.posexplode("s").alias("pos", "s")).groupBy("neuron_id", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _first(d: np.ndarray) -> np.ndarray:
    h = np.zeros_like(d)
    h[np.arange(len(d)), d.argmin(axis=1)] = 1
    return h


def cell_sums(samples: DataFrame, codebook: DataFrame) -> DataFrame:
    """(bmu, pos, n, s): counts and sums of the samples of each best neuron; one pass over the samples."""
    return moments(samples.select("x"), codebook.select("neuron_id", "w"), assign.euclid(), _first).withColumnRenamed("neuron_id", "bmu")


def som_epoch(samples: DataFrame, codebook: DataFrame, hop: Column, width: float) -> DataFrame:
    """One batch SOM epoch: each neuron becomes the mean of samples weighted by a Gaussian of the
    hops to their best neuron. ``hop`` over x0, y0 (best) and x1, y1."""
    at0 = codebook.select(F.col("neuron_id").alias("bmu"), F.col("gx").alias("x0"), F.col("gy").alias("y0"))
    at1 = codebook.select("neuron_id", F.col("gx").alias("x1"), F.col("gy").alias("y1"))
    moved = cell_sums(samples, codebook).join(small(at0), "bmu").join(small(at1)).withColumn("h", V.gauss(hop, F.lit(width)))
    part = moved.groupBy("neuron_id", "pos").agg((F.sum(F.col("h") * F.col("s")) / F.sum(F.col("h") * F.col("n"))).alias("v"))
    return gathered(part, "neuron_id")


def ng_epoch(samples: DataFrame, codebook: DataFrame, width: float) -> DataFrame:
    """One batch neural gas epoch: weights exp(-k / width) by each neuron's rank k from 0."""

    def pull(d):
        return np.exp(-assign._ranks(np.argsort(d, axis=1, kind="stable")) / width)

    part = moments(samples.select("x"), codebook.select("neuron_id", "w"), assign.euclid(), pull)
    return gathered(part.select("neuron_id", "pos", (F.col("s") / F.col("n")).alias("v")), "neuron_id")


def kmeans_step(samples: DataFrame, centres: DataFrame) -> DataFrame:
    """New centres; a centre without samples stays."""
    mean = gathered(cell_sums(samples, centres).select(F.col("bmu").alias("neuron_id"), "pos", (F.col("s") / F.col("n")).alias("v")), "neuron_id")
    return centres.select("neuron_id", "w").join(mean.withColumnRenamed("w", "m"), "neuron_id", "left").select("neuron_id", F.coalesce("m", "w").alias("w"))


def wmc_epoch(samples: DataFrame, weights: DataFrame, codebook: DataFrame, history: DataFrame | None, alpha: float, beta: float, pull) -> tuple[DataFrame, DataFrame]:
    """One batch epoch of a network with contexts over spatial weights: ``codebook(neuron_id, w, c)``
    with weights and contexts moved to the pulled means, and the samples' best neurons.

    The context of a sample merges weight and context of its neighbours' last best neurons
    (``history``; none at first, where contexts count nothing). Neurons that nothing pulls stay."""
    if history is None:
        best = assign.nearest(samples.select("sample_id", "x"), codebook.select("neuron_id", "w"), assign.euclid())
        history = best.select("sample_id", "neuron_id").where("neuron_id is not null")
    context = assign.merge_context(weights, history, codebook, beta).withColumnRenamed("src", "sample_id")
    seen = samples.select("sample_id", "x").join(context, "sample_id")
    dist = assign.mixed(("x", "w", 1 - alpha), ("context", "c", alpha))
    mean = lambda x: gathered(moments(seen.select("x", "context"), codebook.select("neuron_id", "w", "c"), dist, pull, x).select("neuron_id", "pos", (F.col("s") / F.col("n")).alias("v")), "neuron_id")
    new = codebook.join(mean("x").withColumnRenamed("w", "nw"), "neuron_id", "left").join(mean("context").withColumnRenamed("w", "nc"), "neuron_id", "left")
    new = new.select("neuron_id", F.coalesce("nw", "w").alias("w"), F.coalesce("nc", "c").alias("c"))
    best = assign.nearest(seen, new, dist).select("sample_id", "neuron_id")
    return new, best


def wmc_fit(samples: DataFrame, weights: DataFrame, codebook: DataFrame, widths: list[float], alpha: float = 0.4, beta: float = 0.25, hops: np.ndarray | None = None) -> DataFrame:
    """Trains weights and contexts over spatial weights, an epoch for each of ``widths``: by ranks as a
    neural gas, or by Gaussians of ``hops`` between neurons (in the order of neuron_id) as a map."""
    from .graph import cut

    book = cut(codebook.select("neuron_id", "w", F.transform("w", lambda v: F.lit(0.0)).alias("c")))
    history = None
    for width in widths:
        if hops is None:
            pull = lambda d, width=width: np.exp(-assign._ranks(np.argsort(d, axis=1, kind="stable")) / width)
        else:
            pull = lambda d, width=width: np.exp(-0.5 * (hops[d.argmin(axis=1)] / width) ** 2)
        book, history = (cut(t) for t in wmc_epoch(samples, weights, book, history, alpha, beta, pull))
    return book


def kmeans(samples: DataFrame, centres: DataFrame, rounds: int = 1000, delta: float = 1e-5) -> DataFrame:
    """Lloyd's iterations until no centre moves more than ``delta``; an error where ``rounds`` do not suffice."""
    from .graph import cut

    centres = cut(centres.select("neuron_id", "w"))
    for _ in range(rounds):
        new = cut(kmeans_step(samples, centres))
        moved = new.join(centres.withColumnRenamed("w", "old"), "neuron_id").agg(F.max(V.euclid("w", "old"))).first()[0]
        centres = new
        if moved <= delta:
            return centres
    raise RuntimeError(f"k-means did not settle in {rounds} rounds")


# ---------------------------------------------------------------- online kernels

def hops(kind: str, nx: int, ny: int) -> np.ndarray:
    """All hop distances of a grid: rect, toroid, hex or hex_toroid; neuron = x * ny + y."""
    x, y = np.divmod(np.arange(nx * ny), ny)
    x0, x1, y0, y1 = x[:, None], x[None, :], y[:, None], y[None, :]
    dx, dy, up = abs(x0 - x1), abs(y0 - y1), y1 > y0

    def hexd(dx, dy, up):
        half = np.where(up == (x0 % 2 == 0), dx // 2, -(-dx // 2))
        return dx + dy - np.minimum(dy, half)

    if kind == "rect":
        return dx + dy
    if kind == "toroid":
        return np.minimum(dx, nx - dx) + np.minimum(dy, ny - dy)
    if kind == "hex":
        return hexd(dx, dy, up)
    return np.minimum.reduce([hexd(a, b, u) for a in (dx, nx - dx) for b, u in ((dy, up), (ny - dy, ~up))])


def drawn(rng, x: np.ndarray, steps: int, order: np.ndarray | None) -> np.ndarray:
    """Which row of ``x`` each step learns: ``order`` if it is given, else random ones."""
    return rng.integers(0, len(x), steps) if order is None else order


def run_som(x: np.ndarray, seed: int, steps: int, grid: tuple[str, int, int], width=(10.0, 1.0), rate=(1.0, 0.0), order: np.ndarray | None = None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    h = hops(*grid).astype(float)
    w = x[rng.integers(0, len(x), len(h))].copy()
    for i, k in enumerate(drawn(rng, x, steps, order)):
        t = i / steps
        d = w - x[k]
        b = int(np.einsum("ij,ij->i", d, d).argmin())
        s = width[0] + (width[1] - width[0]) * t
        w -= (np.exp(-0.5 * (h[b] / s) ** 2) * (rate[0] + (rate[1] - rate[0]) * t))[:, None] * d
    return w


def run_ng(x: np.ndarray, seed: int, steps: int, neurons: int, range_=(25.0, 0.01), rate=(0.5, 0.005), geo: np.ndarray | None = None, l: int = 0, order: np.ndarray | None = None) -> np.ndarray:  # noqa: E741
    """Neural gas; with ``geo`` (mask of coordinate columns) and ``l`` in the order of contextual neural gas."""
    rng = np.random.default_rng(seed)
    w = x[rng.integers(0, len(x), neurons)].copy()
    for i, k in enumerate(drawn(rng, x, steps, order)):
        t = i / steps
        d = x[k] - w
        if geo is None:
            near = np.argsort((d * d).sum(axis=1), kind="stable")
        else:
            near = np.argsort((d[:, geo] ** 2).sum(axis=1), kind="stable")
            f = (d[near[:l]][:, ~geo] ** 2).sum(axis=1)
            near = np.concatenate((near[:l][np.argsort(f, kind="stable")], near[l:]))
        lam, eps = range_[0] * (range_[1] / range_[0]) ** t, rate[0] * (rate[1] / rate[0]) ** t
        w[near] += (eps * np.exp(-np.arange(neurons) / lam))[:, None] * d[near]
    return w


def run_gng(x: np.ndarray, seed: int, steps: int, most: int | None = None, lr_b=0.05, lr_n=0.0005, age_max=90, every=300, alpha=0.5, beta=0.0005, order: np.ndarray | None = None, edges: bool = False):
    """Growing neural gas: weights, and with ``edges`` also the pairs of neurons that are joined.

    A neuron is put in after every ``every`` steps, the first step included, without limit or up to ``most``."""
    rng = np.random.default_rng(seed)
    w = x[rng.integers(0, len(x), 2)].astype(float)
    err, age = np.zeros(2), np.full((2, 2), -1)  # -1: not joined
    for t, k in enumerate(drawn(rng, x, steps, order)):
        d = np.sqrt(((w - x[k]) ** 2).sum(axis=1))
        first, second = np.argsort(d, kind="stable")[:2]
        age[first, second] = age[second, first] = 0
        err[first] += d[first]
        age[age >= 0] += 1
        near = np.flatnonzero(age[first] >= 0)
        w[first] += lr_b * (x[k] - w[first])
        w[near] += lr_n * (x[k] - w[near])
        age[age > age_max] = -1
        held = (age >= 0).any(axis=1)
        if not held.all():
            w, err, age = w[held], err[held], age[np.ix_(held, held)]
        if t % every == 0 and (most is None or len(w) < most):
            q = int(err.argmax())
            near = np.flatnonzero(age[q] >= 0)
            if len(near):
                f = int(near[err[near].argmax()])
                w = np.vstack([w, (w[q] + w[f]) / 2])
                age = np.pad(age, (0, 1), constant_values=-1)
                age[q, f] = age[f, q] = -1
                age[q, -1] = age[-1, q] = age[f, -1] = age[-1, f] = 0
                err[q] *= 1 - alpha
                err = np.append(err, (err[q] + err[f]) / 2)
        err *= 1 - beta
    return (w, np.argwhere(np.triu(age) >= 0)) if edges else w


def run_growing_som(x: np.ndarray, seed: int, steps: int, start=(2, 2), every: int = 100, most: int = 500, rate=(0.5, 0.02), width: float = 1.0, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A rectangular map that grows: after ``every`` steps for each unit, a row or column is put between
    the unit hit most and its most distant neighbour. Returns (positions, w); stops growing at ``most``."""
    rng = np.random.default_rng(seed)
    grid = x[rng.integers(0, len(x), start[0] * start[1])].reshape(*start, -1).copy()
    hits, since = np.zeros(start, int), 0
    for i, k in enumerate(drawn(rng, x, steps, order)):
        d = x[k] - grid
        a, b = np.unravel_index((d * d).sum(axis=2).argmin(), hits.shape)
        hits[a, b] += 1
        gx, gy = np.indices(hits.shape)
        h = np.exp(-0.5 * ((abs(gx - a) + abs(gy - b)) / width) ** 2) * (rate[0] + (rate[1] - rate[0]) * i / steps)
        grid += h[:, :, None] * d
        since += 1
        if since >= every * hits.size and hits.size < most:
            a, b = np.unravel_index(hits.argmax(), hits.shape)
            near = [(a + s, b + t) for s, t in ((-1, 0), (0, -1), (0, 1), (1, 0)) if 0 <= a + s < hits.shape[0] and 0 <= b + t < hits.shape[1]]
            c, e = max(near, key=lambda n: ((grid[n] - grid[a, b]) ** 2).sum())
            axis, at = (0, max(a, c)) if a != c else (1, max(b, e))
            mid = (np.take(grid, at - 1, axis) + np.take(grid, at, axis)) / 2
            grid = np.insert(grid, at, mid, axis)
            hits, since = np.zeros(grid.shape[:2], int), 0
    gx, gy = np.indices(hits.shape)
    return np.stack([gx.ravel(), gy.ravel()], axis=1), grid.reshape(hits.size, -1)


def run_temporal(series: np.ndarray, seed: int, epochs: int, grid: tuple[str, int, int], kind: str, leak: float = 0.5, width=(3.0, 0.5), rate=(0.5, 0.02)) -> np.ndarray:
    """Maps of a series in its order. ``tkm``: the unit of greatest leaky potential wins and units move
    to the sample. ``rsom``: each unit keeps a leaky difference to the inputs, the shortest wins, and
    units move along their own difference."""
    if kind not in ("tkm", "rsom"):
        raise ValueError("kind is tkm or rsom")
    rng = np.random.default_rng(seed)
    h = hops(*grid).astype(float)
    w = series[rng.integers(0, len(series), len(h))].copy()
    for e in range(epochs):
        y = np.zeros_like(w)
        v = np.zeros(len(w))
        for i, x in enumerate(series):
            t = (e + i / len(series)) / epochs
            if kind == "tkm":
                v = leak * v - 0.5 * ((x - w) ** 2).sum(axis=1)
                b, move = int(v.argmax()), x - w
            else:
                y = (1 - leak) * y + leak * (x - w)
                b, move = int((y * y).sum(axis=1).argmin()), y
            s = width[0] + (width[1] - width[0]) * t
            w = w + (np.exp(-0.5 * (h[b] / s) ** 2) * (rate[0] + (rate[1] - rate[0]) * t))[:, None] * move
    return w


def run_merge(series: np.ndarray, seed: int, epochs: int, neurons: int, alpha: float = 0.5, beta: float = 0.5, grid: tuple[str, int, int] | None = None, range_=(10.0, 0.1), rate=(0.5, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """Weights and contexts of a merge network over a series: the context of a step merges weight and
    context of the last winner. Neural gas by ranks, or a map by hops if ``grid`` is given."""
    rng = np.random.default_rng(seed)
    h = hops(*grid).astype(float) if grid else None
    w = series[rng.integers(0, len(series), neurons if h is None else len(h))].copy()
    c = np.zeros_like(w)
    for e in range(epochs):
        last = None
        for i, x in enumerate(series):
            t = (e + i / len(series)) / epochs
            d = np.sqrt(((w - x) ** 2).sum(axis=1))
            ctx = None if last is None else (1 - beta) * w[last] + beta * c[last]
            if ctx is not None:
                d = (1 - alpha) * d + alpha * np.sqrt(((c - ctx) ** 2).sum(axis=1))
            lam, eps = range_[0] * (range_[1] / range_[0]) ** t, rate[0] * (rate[1] / rate[0]) ** t
            order = np.argsort(d, kind="stable")
            if h is None:
                g = np.empty(len(w))
                g[order] = np.exp(-np.arange(len(w)) / lam)
            else:
                g = np.exp(-0.5 * (h[order[0]] / lam) ** 2)
            last = int(order[0])
            w = w + (eps * g)[:, None] * (x - w)
            if ctx is not None:
                c = c + (eps * g)[:, None] * (ctx - c)
    return w, c


MODEL = "run int, neuron_id long, w array<double>, position array<long>, joined array<long>"


def model(w: np.ndarray, position: np.ndarray | None = None, edges: np.ndarray | None = None) -> dict:
    """A trained network: weights, grid positions where it has them, and the neurons joined to each."""
    joined = None
    if edges is not None:
        joined = [[] for _ in w]
        for a, b in edges.tolist():
            joined[a].append(b)
            joined[b].append(a)
    return {"w": w, "position": None if position is None else position.tolist(), "joined": joined}


def fit(samples: DataFrame, kernel, seeds: list[int], steps: int) -> DataFrame:
    """Runs ``kernel(matrix, seed, order)`` once for each seed, in parallel tasks: (run, neuron_id, w,
    position, joined), the last two where the kernel gives a ``model`` with them.

    Online training is sequential, so a run is one task; but it reads only what its steps draw.
    Each of its ``steps`` draws is a row of the whole table, found by its number: ``order`` says
    which row of the matrix a step learns. So any number of samples may be trained on, and a run
    holds at most ``steps`` of them. Rows without a whole vector are never drawn; no rows, no model.
    """
    spark = samples.sparkSession
    whole = samples.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))).select("sample_id", "x")
    numbers = numbered(whole, [F.xxhash64("sample_id"), F.col("sample_id")], "at")
    n = numbers.count()
    if not n:
        return spark.createDataFrame([], MODEL)
    draws = [(s, t, k) for s in seeds for t, k in enumerate(np.random.default_rng([s, 1]).integers(0, n, steps).tolist())]
    asked = spark.createDataFrame(pd.DataFrame(draws, columns=["run", "t", "at"]), "run int, t long, at long")
    asked = asked.groupBy("run", "at").agg(F.collect_list("t").alias("ts"))
    rows = numbers.join(small(asked, most_rows=len(draws) + 1), "at").select("run", "at", "x", "ts")

    def one(key, table):
        at, xs, ts = table["at"].to_numpy(), matrix(table["x"])[0], table["ts"].to_pylist()
        by = np.argsort(at, kind="stable")
        order = np.empty(steps, np.int64)
        for i, k in enumerate(by.tolist()):
            order[ts[k]] = i
        got = kernel(xs[by], key[0].as_py(), order)
        got = got if isinstance(got, dict) else model(got)
        m = len(got["w"])
        none = [None] * m
        return pa.table({
            "run": pa.array([key[0].as_py()] * m, pa.int32()), "neuron_id": pa.array(range(m), pa.int64()), "w": pa.array(got["w"].tolist(), pa.list_(pa.float64())),
            "position": pa.array(got["position"] or none, pa.list_(pa.int64())), "joined": pa.array(got["joined"] or none, pa.list_(pa.int64())),
        })

    return rows.groupBy("run").applyInArrow(one, MODEL)


__all__ = ["cng", "fit", "kmeans", "kmeans_step", "model", "ng_epoch", "run_gng", "run_growing_som", "run_merge", "run_ng", "run_som", "run_temporal", "som_epoch", "wmc_epoch", "wmc_fit"]
