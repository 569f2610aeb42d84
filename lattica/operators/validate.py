"""Cluster validity, internal and external. Input: (sample_id, x, cluster)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from . import blocks
from .assign import small


def means(df: DataFrame, *keys: str) -> DataFrame:
    """Mean vector and size of each group, by partial aggregates over positions."""
    part = df.select(*keys, F.posexplode("x").alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return part.groupBy(*keys).agg(ordered.alias("m"), F.first("n").alias("n"))


def to_means(df: DataFrame) -> DataFrame:
    return df.join(small(means(df, "cluster")), "cluster").withColumn("d", V.euclid("x", "m"))


def wcss(df: DataFrame) -> DataFrame:
    return to_means(df).agg(F.sum(F.col("d") * F.col("d")).alias("wcss"))


def bcss(df: DataFrame) -> DataFrame:
    """Squared distances of cluster means to the whole mean, weighted by the clusters' shares."""
    total = means(df.withColumn("one", F.lit(1)), "one").select(F.col("m").alias("t"), F.col("n").alias("all"))
    c = means(df, "cluster").join(F.broadcast(total))
    return c.agg(F.sum(F.col("n") / F.col("all") * F.pow(V.euclid("m", "t"), F.lit(2.0))).alias("bcss"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    s = to_means(df).groupBy("cluster").agg(F.avg("d").alias("s")).join(means(df, "cluster"), "cluster")
    a = s.select(F.col("cluster").alias("a"), F.col("s").alias("sa"), F.col("m").alias("ma"))
    b = s.select(F.col("cluster").alias("b"), F.col("s").alias("sb"), F.col("m").alias("mb"))
    worst = a.join(small(b), F.col("a") != F.col("b")).groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / V.euclid("ma", "mb")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def _sums(df: DataFrame) -> DataFrame:
    """For each sample and cluster: sum of distances, pairs without the sample itself, extremes."""

    def work(q, o):
        d = blocks.distances(q["x"], o["x"])
        same = q["sample_id"][:, None] == o["sample_id"][None, :]
        out = {k: [] for k in ("sample_id", "own", "cluster", "total", "n", "least", "most")}
        for c in np.unique(o["cluster"]):
            at = o["cluster"] == c
            mask = ~same[:, at]
            dd = d[:, at]
            out["sample_id"] += q["sample_id"].tolist()
            out["own"] += q["cluster"].tolist()
            out["cluster"] += [int(c)] * len(d)
            out["total"] += np.where(mask, dd, 0).sum(axis=1).tolist()
            out["n"] += mask.sum(axis=1).tolist()
            out["least"] += np.where(mask, dd, np.inf).min(axis=1, initial=np.inf).tolist()
            out["most"] += np.where(mask, dd, 0).max(axis=1, initial=0).tolist()
        return out

    part = blocks.by_blocks(df, ["sample_id", "x", "cluster"], work, "sample_id long, own int, cluster int, total double, n long, least double, most double")
    return part.groupBy("sample_id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def silhouette(df: DataFrame) -> DataFrame:
    """Mean of (b - a) / max(a, b); 0 for a sample alone in its cluster."""
    s = _sums(df).where("n > 0").withColumn("mean", F.col("total") / F.col("n"))
    each = s.groupBy("sample_id").agg(F.min(F.when(F.col("own") == F.col("cluster"), F.col("mean"))).alias("a"), F.min(F.when(F.col("own") != F.col("cluster"), F.col("mean"))).alias("b"))
    return each.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def dunn(df: DataFrame) -> DataFrame:
    own = F.col("own") == F.col("cluster")
    return _sums(df).agg((F.min(F.when(~own, F.col("least"))) / F.max(F.when(own, F.col("most")))).alias("dunn"))


def connectivity(df: DataFrame, k: int) -> DataFrame:
    """Sum of 1/j over the j-th neighbours (j up to k) that lie in another cluster."""
    near = blocks.knn(df, "x", k)
    a = df.select(F.col("sample_id").alias("src"), F.col("cluster").alias("ca"))
    b = df.select(F.col("sample_id").alias("dst"), F.col("cluster").alias("cb"))
    both = near.join(a, "src").join(b, "dst")
    return both.agg(F.sum(F.when(F.col("ca") != F.col("cb"), 1 / F.col("rank")).otherwise(0.0)).alias("connectivity"))


def contingency(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count("*").alias("n"))


def nmi(df: DataFrame, u: str, v: str) -> DataFrame:
    """I(u, v) / sqrt(H(u) H(v)), natural logarithms."""
    t = contingency(df, u, v)
    total = t.agg(F.sum("n").alias("t"))
    ent = lambda c: t.groupBy(c).agg(F.sum("n").alias("n")).join(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))).alias("h" + c))
    a, b = (t.groupBy(c).agg(F.sum("n").alias("n" + c)) for c in ("u", "v"))
    i = t.join(a, "u").join(b, "v").join(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / F.col("nu") / F.col("nv"))).alias("i"))
    return i.join(ent("u")).join(ent("v")).select((F.col("i") / F.sqrt(F.col("hu") * F.col("hv"))).alias("nmi"))


def adjusted_rand(df: DataFrame, u: str, v: str) -> DataFrame:
    t = contingency(df, u, v)
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = t.agg(two("n").alias("s"), F.sum("n").alias("t"))
    a, b = (t.groupBy(c).agg(F.sum("n").alias("n")).agg(two("n").alias("s" + c)) for c in ("u", "v"))
    x = F.col("su") * F.col("sv") / (F.col("t") * (F.col("t") - 1) / 2)
    return cells.join(a).join(b).select(((F.col("s") - x) / ((F.col("su") + F.col("sv")) / 2 - x)).alias("ari"))


def heterogeneity(df: DataFrame) -> DataFrame:
    """Sum of squares of each cluster over the number of attributes."""
    return to_means(df).groupBy("cluster").agg((F.sum(F.col("d") * F.col("d")) / F.first(F.size("x"))).alias("ssd"))


def summary(df: DataFrame) -> DataFrame:
    n = df.agg(F.countDistinct("cluster").alias("clusters"))
    mean = to_means(df).agg(F.avg("d").alias("mean_qe"))
    return n.join(wcss(df)).join(bcss(df)).join(mean).join(davies_bouldin(df)).join(silhouette(df)).join(dunn(df))
