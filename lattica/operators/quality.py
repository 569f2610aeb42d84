"""Map quality, from assignments, ranks and codebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .assign import small
from .graph import cut
from .reshape import numbered


def mean_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.avg("dist").alias("mean_qe"))


def squared_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum(F.col("dist") * F.col("dist")).alias("sum_sq"))


def two_best(ranked: DataFrame) -> DataFrame:
    """(sample_id, first, second) from ``ranked``."""
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.col("neuron_id")))
    return ranked.where("rank <= 2").groupBy("sample_id").agg(pick(1).alias("first"), pick(2).alias("second"))


def positions(codebook: DataFrame, suffix: str) -> DataFrame:
    return codebook.select(F.col("neuron_id").alias("n" + suffix), F.col("gx").alias("x" + suffix), F.col("gy").alias("y" + suffix))


def topographic_error(best: DataFrame, codebook: DataFrame, hop: Column) -> DataFrame:
    """Share of samples whose two best neurons are not adjacent. ``hop`` over x0, y0, x1, y1."""
    a, b = small(positions(codebook, "0")), small(positions(codebook, "1"))
    far = best.join(a, F.col("first") == F.col("n0")).join(b, F.col("second") == F.col("n1"))
    return far.agg(F.avg((hop > 1).cast("double")).alias("topo_error"))


def neuron_pairs(codebook: DataFrame, hop: Column) -> DataFrame:
    """(n0, n1, hops, dist) of all ordered pairs of neurons, n0 < n1."""
    a = codebook.select(*positions(codebook, "0").columns and [F.col("neuron_id").alias("n0"), F.col("gx").alias("x0"), F.col("gy").alias("y0"), F.col("w").alias("w0")])
    b = codebook.select(F.col("neuron_id").alias("n1"), F.col("gx").alias("x1"), F.col("gy").alias("y1"), F.col("w").alias("w1"))
    return a.join(small(b), F.col("n0") < F.col("n1")).select("n0", "n1", hop.cast("double").alias("hops"), V.euclid("w0", "w1").alias("dist"))


def topographic_correlation(pairs: DataFrame, method: str = "pearson") -> DataFrame:
    if method == "pearson":
        return pairs.agg(F.corr("hops", "dist").alias("corr"))

    # the mean rank of equal values: rows are numbered over ranges, so that no task sorts all of them
    for c in ("hops", "dist"):
        placed = cut(numbered(pairs, [c], "_k"))
        ranks = placed.groupBy(c).agg((F.min("_k") + 1 + (F.count("*") - 1) / 2).alias("_r"))
        pairs = placed.join(ranks, c).withColumnRenamed("_r", "_" + c).drop("_k")
    return pairs.agg(F.corr("_hops", "_dist").alias("corr"))


def hit_entropy(assigned: DataFrame) -> DataFrame:
    hits = assigned.groupBy("neuron_id").agg(F.count("*").alias("n"))
    total = hits.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return hits.join(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def class_counts(assigned: DataFrame, codebook: DataFrame, label: str) -> DataFrame:
    """Samples of each class on each neuron; neurons without samples are kept with a null class."""
    hits = assigned.groupBy("neuron_id", label).agg(F.count("*").alias("hits"))
    return codebook.select("neuron_id").join(hits, "neuron_id", "left").select("neuron_id", label, F.coalesce("hits", F.lit(0)).alias("hits"))


def adjacent(pairs: DataFrame) -> DataFrame:
    """Both directions of adjacent neuron pairs: (neuron_id, other, dist)."""
    near = pairs.where("hops = 1")
    return near.select(F.col("n0").alias("neuron_id"), F.col("n1").alias("other"), "dist").union(near.select("n1", "n0", "dist"))


def d_matrix(pairs: DataFrame) -> DataFrame:
    return adjacent(pairs).groupBy("neuron_id").agg(F.avg("dist").alias("d"))


def neighbour_stats(pairs: DataFrame) -> DataFrame:
    return adjacent(pairs).groupBy("neuron_id").agg(F.avg("dist").alias("mean"), F.percentile("dist", 0.5).alias("median"), F.coalesce(F.var_samp("dist"), F.lit(0.0)).alias("variance"), F.min("dist").alias("least"), F.max("dist").alias("most"))


def u_matrix(codebook: DataFrame, hop: Column) -> DataFrame:
    """(ux, uy, value) over (2X-1) x (2Y-1) cells of a rectangular grid: unit means, edge
    distances, and on diagonals the mean of both diagonal distances."""
    pairs = neuron_pairs(codebook, hop)
    at0, at1 = small(positions(codebook, "0")), small(positions(codebook, "1"))
    spots = pairs.join(at0, "n0").join(at1, "n1")
    units = d_matrix(pairs).join(positions(codebook, "0").withColumnRenamed("n0", "neuron_id"), "neuron_id").select((2 * F.col("x0")).alias("ux"), (2 * F.col("y0")).alias("uy"), F.col("d").alias("value"))
    dx, dy = F.abs(F.col("x0") - F.col("x1")), F.abs(F.col("y0") - F.col("y1"))
    between = spots.where((dx <= 1) & (dy <= 1)).groupBy((F.col("x0") + F.col("x1")).alias("ux"), (F.col("y0") + F.col("y1")).alias("uy")).agg(F.avg("dist").alias("value"))
    return units.union(between)
