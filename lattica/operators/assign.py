"""Nearest-neuron search and ranking.

A codebook is small by construction (tens to hundreds of neurons); its rows and bytes are checked
before it is broadcast. Searches by numpy run where the samples lie, batch by batch, and exchange
nothing; a search by any Column expression exchanges one struct a sample.

A sample without a vector, or with a null in it, has null results; a vector of another length than
the neurons' is an error. Ties go to the smaller neuron_id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MOST_NEURONS = 100_000
MOST_BYTES = 256 << 20


def small(codebook: DataFrame, most_rows: int = MOST_NEURONS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The table with a broadcast hint, if its rows and bytes are few enough for one."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in codebook.columns))))), F.lit(0))
    rows, held = codebook.limit(most_rows + 1).agg(F.count("*"), size).first()
    if rows > most_rows or held > most_bytes:
        raise ValueError(f"a table to broadcast has at most {most_rows} rows and {most_bytes} bytes, not {rows} and {held}")
    return F.broadcast(codebook)


# ---------------------------------------------------------------- distances of a batch to all neurons

Distance = Callable[[dict, dict], np.ndarray]


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, without cancellation."""
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of {a.shape[1]} and neurons of {b.shape[1]} components")
    return np.stack([((a - v) ** 2).sum(axis=1) for v in b], axis=1) if len(b) else np.zeros((len(a), 0))


def euclid(x: str = "x", w: str = "w") -> Distance:
    return lambda s, n: np.sqrt(_between(s[x], n[w]))


def mixed(*parts: tuple[str, str, float]) -> Distance:
    """A weighted sum of Euclidean distances: (sample's column, neuron's column, weight) each."""
    return lambda s, n: sum(f * np.sqrt(_between(s[x], n[w])) for x, w, f in parts)


def augmented(*parts: tuple[str, str, float]) -> Distance:
    """The Euclidean distance of vectors put together, each scaled by its factor."""
    return lambda s, n: np.sqrt(sum(f * f * _between(s[x], n[w]) for x, w, f in parts))


def matrix(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, and which rows have a vector without nulls; the others are rows of zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    wide = pc.list_value_length(v)
    kinds = set(wide.drop_null().unique().to_pylist())
    if len(kinds) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(kinds)}")
    ok = np.asarray(v.is_valid())
    width = kinds.pop() if kinds else 0
    out = np.zeros((len(v), width))
    if width:
        out[ok] = v.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    ok = ok & ~np.isnan(out).any(axis=1)
    out[~ok] = 0
    return out, ok


def neurons(codebook: DataFrame, most_bytes: int = MOST_BYTES) -> dict[str, np.ndarray]:
    """The codebook's columns as arrays in the order of neuron_id, after a check of its size."""
    small(codebook, most_bytes=most_bytes)
    rows = sorted(codebook.collect(), key=lambda r: r["neuron_id"])
    return {c: np.array([r[c] for r in rows], np.int64 if c == "neuron_id" else float) for c in codebook.columns}


def over(samples: DataFrame, codebook: DataFrame, work, schema: str | T.StructType, ignore: set[int] = frozenset()) -> DataFrame:
    """``work(batch, vectors, ok, neurons)`` on every batch of samples: a RecordBatch of ``schema``.
    ``vectors`` has a matrix for each array column, ``ok`` says which rows have all of them.
    Neurons in ``ignore`` take no part."""
    held = neurons(codebook)
    take = ~np.isin(held["neuron_id"], list(ignore))
    held = samples.sparkSession.sparkContext.broadcast({c: v[take] for c, v in held.items()})
    arrays = [f.name for f in samples.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]

    def run(batches):
        book = held.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                got = {c: matrix(part.column(c)) for c in arrays}
                ok = np.logical_and.reduce([k for _, k in got.values()]) if got else np.ones(part.num_rows, bool)
                yield from work(part, {c: m for c, (m, _) in got.items()}, ok, book)

    return samples.mapInArrow(run, schema)


def nearest(samples: DataFrame, codebook: DataFrame, dist: Distance, ignore: set[int] = frozenset()) -> DataFrame:
    """``samples`` with neuron_id and dist of the best neuron; null without a whole vector or a neuron."""
    schema = T.StructType([*samples.schema, T.StructField("neuron_id", T.LongType()), T.StructField("dist", T.DoubleType())])

    def work(b, x, ok, book):
        ids, d = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
        if len(book["neuron_id"]):
            at = np.flatnonzero(ok)
            near = dist({c: m[at] for c, m in x.items()}, book) if len(at) else np.zeros((0, 1))
            k = near.argmin(axis=1)
            ids[at], d[at] = book["neuron_id"][k], near[np.arange(len(at)), k]
        else:
            ok = np.zeros(b.num_rows, bool)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, mask=~ok), pa.array(d, mask=~ok)], names=[*b.schema.names, "neuron_id", "dist"])

    return over(samples, codebook, work, schema, ignore)


def bmu_euclid(samples: DataFrame, codebook: DataFrame, x: str = "x", w: str = "w", ignore: set[int] = frozenset()) -> DataFrame:
    """``samples`` with the best neuron by Euclidean distance."""
    return nearest(samples, codebook.select("neuron_id", w), euclid(x, w), ignore)


def pairs(samples: DataFrame, codebook: DataFrame, dist: Column) -> DataFrame:
    """Every (sample, neuron) with ``dist`` over their columns; neurons are broadcast."""
    return samples.join(small(codebook)).withColumn("dist", dist)


def bmu(samples: DataFrame, codebook: DataFrame, dist: Column, key: str = "sample_id", ignore: set[int] = frozenset()) -> DataFrame:
    """The best neuron of each sample by any distance expression, as a partial aggregate; a sample
    whose distances are all null is left out."""
    book = codebook.where(~F.col("neuron_id").isin(list(ignore))) if ignore else codebook
    best = F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "neuron_id"))).alias("b")
    return pairs(samples, book, dist).groupBy(key).agg(best).where("b is not null").select(key, F.col("b.neuron_id").alias("neuron_id"), F.col("b.dist").alias("dist"))


def _order_rows(b, at, book, rank, d, key) -> pa.RecordBatch:
    """(key, neuron_id, dist, rank) of the samples ``at``, whose neurons' ranks and distances are matrices."""
    n, m = rank.shape
    who = b.column(key).take(pa.array(np.repeat(at, m)))
    return pa.RecordBatch.from_arrays([who, pa.array(np.tile(book["neuron_id"], n)), pa.array(d.ravel()), pa.array((rank + 1).ravel().astype(np.int32))], names=[key, "neuron_id", "dist", "rank"])


def _ranks(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    return out


def ranked(samples: DataFrame, codebook: DataFrame, dist: Distance | Column, key: str = "sample_id", most: int | None = None) -> DataFrame:
    """(key, neuron_id, dist, rank): every neuron's rank, from 1, for each sample, or the first ``most``."""
    if isinstance(dist, Column):
        order = Window.partitionBy(key).orderBy("dist", "neuron_id")
        out = pairs(samples, codebook, dist).withColumn("rank", F.row_number().over(order))
        return out.where(F.col("rank") <= most) if most else out

    def work(b, x, ok, book):
        at = np.flatnonzero(ok)
        d = dist({c: m[at] for c, m in x.items()}, book)
        yield _order_rows(b, at, book, _ranks(np.argsort(d, axis=1, kind="stable")), d, key)

    out = over(samples, codebook, work, T.StructType([samples.schema[key], *_RANKED]))
    return out.where(F.col("rank") <= most) if most else out


_RANKED = [T.StructField("neuron_id", T.LongType()), T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())]


def geosom(samples: DataFrame, codebook: DataFrame, radius: int) -> DataFrame:
    """(sample_id, neuron_id, dist): the best neuron by features among those within ``radius`` hops of
    the best by place, on a rectangular grid."""

    def work(b, x, ok, book):
        at = np.flatnonzero(ok)
        near = _between(x["g"][at], book["g"]).argmin(axis=1)
        hops = abs(book["gx"][:, None] - book["gx"]) + abs(book["gy"][:, None] - book["gy"])
        d = np.where(hops[near] <= radius, np.sqrt(_between(x["f"][at], book["f"])), np.inf)
        k = d.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([b.column("sample_id").take(pa.array(at)), pa.array(book["neuron_id"][k]), pa.array(d[np.arange(len(at)), k])], names=["sample_id", "neuron_id", "dist"])

    schema = T.StructType([samples.schema["sample_id"], *_RANKED[:2]])
    return over(samples.select("sample_id", "f", "g"), codebook.select("neuron_id", "gx", "gy", "f", "g"), work, schema)


def cng(samples: DataFrame, codebook: DataFrame, l: int) -> DataFrame:  # noqa: E741
    """All neurons in the order of contextual neural gas: the ``l`` nearest by place in the order
    of features, then the others in the order of place. ``dist`` is the feature distance."""
    if l < 1 or l > codebook.count():
        raise ValueError("l must lie between 1 and the number of neurons")

    def work(b, x, ok, book):
        at = np.flatnonzero(ok)
        place = np.argsort(_between(x["g"][at], book["g"]), axis=1, kind="stable")
        d = np.sqrt(_between(x["f"][at], book["f"]))
        first = np.sort(place[:, :l], axis=1)  # by neuron, so that ties go to the smaller
        inner = np.take_along_axis(first, np.argsort(np.take_along_axis(d, first, axis=1), axis=1, kind="stable"), axis=1)
        yield _order_rows(b, at, book, _ranks(np.concatenate((inner, place[:, l:]), axis=1)), d, "sample_id")

    return over(samples.select("sample_id", "f", "g"), codebook.select("neuron_id", "f", "g"), work, T.StructType([samples.schema["sample_id"], *_RANKED]))


def merge_context(weights: DataFrame, history: DataFrame, codebook: DataFrame, beta: float) -> DataFrame:
    """Context of each src: the weighted mean over its neighbours of (1 - beta) w + beta c of the
    neuron each had last; null where the weights sum to zero. ``weights(src, dst, w)``,
    ``history(sample_id, neuron_id)``, ``codebook(neuron_id, w, c)``."""
    mixed_ = codebook.select("neuron_id", F.zip_with("w", "c", lambda a, b: (1 - beta) * a + beta * b).alias("m"))
    n = weights.join(history.withColumnRenamed("sample_id", "dst"), "dst").join(small(mixed_), "neuron_id")
    part = n.select("src", F.col("w").alias("weight"), F.posexplode("m").alias("pos", "v"))
    mean = part.groupBy("src", "pos").agg((F.sum(F.col("weight") * F.col("v")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("v"))
    return mean.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("context"))


def same_model(a: DataFrame, b: DataFrame) -> DataFrame:
    """(same): whether two codebooks have the same rows, repeated rows counted."""
    b = b.select(*a.columns)
    differ = a.exceptAll(b).select(F.lit(1).alias("d")).union(b.exceptAll(a).select(F.lit(1).alias("d")))
    return differ.agg((F.count("*") == 0).alias("same"))
