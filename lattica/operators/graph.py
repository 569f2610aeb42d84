"""Graphs as edge tables: reachability, distances, modularity, spanning trees.

Loops cut their lineage by ``checkpoint`` to the folder that the session names.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> None:
    """Names a checkpoint folder of its own in a session without executors of its own, as in tests; a
    cluster's session must name one that its machines share."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lattica-"))


def cut(df: DataFrame) -> DataFrame:
    shared(df.sparkSession)
    return df.checkpoint()


def hebbian(best: DataFrame) -> DataFrame:
    """Edges between each sample's two best neurons, with counts: (a, b, cnt), a < b."""
    return best.groupBy(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b")).agg(F.count("*").alias("cnt"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def symmetrize(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def is_undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_anti").agg((F.count("*") == 0).alias("undirected"))


def _least(links: DataFrame, parts: int = 64) -> DataFrame:
    """``links(a, b)`` with m, the least b of each a. The links of a frequent a are dealt into parts by a
    hash of b, so that no task gets all of them."""
    dealt = links.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(parts)))
    low = dealt.groupBy("a", "_s").agg(F.min("b").alias("_m"))
    both = low.select("a", "_s").join(low.groupBy("a").agg(F.min("_m").alias("m")), "a")
    return dealt.join(both, ["a", "_s"]).drop("_s")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id reachable.

    Large-star and small-star steps by turns, until links no longer change: larger neighbours of a node
    are linked to its least one, then a node and its smaller neighbours are. The rounds grow with the
    logarithm of the longest path, and a hub's links are dealt into parts."""
    every = nodes(edges)
    links = cut(symmetrize(edges).where("src > dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    seen = None
    for _ in range(most_rounds):
        both = links.union(links.select("b", "a"))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        near = _least(cut(large))
        small = near.select("a", F.col("m").alias("b")).union(near.select(F.col("b").alias("a"), F.col("m").alias("b")))
        links = cut(small.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            low = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
            return every.join(low, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def shortest(edges: DataFrame, start: int) -> DataFrame:
    """(id, dist) over ``edges(src, dst, w)``, w >= 0, for every node reached; a round per hop."""
    seen = cut(edges.sparkSession.createDataFrame([(start, 0.0)], "id long, dist double"))
    front = seen
    while not front.isEmpty():
        step = front.join(edges, front["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        better = cut(step.join(seen, "id", "left").where("dist is null or new < dist").select("id", F.col("new").alias("dist")))
        seen = cut(seen.join(better, "id", "left_anti").union(better))
        front = better
    return seen


def hops(edges: DataFrame, start: int) -> DataFrame:
    found = shortest(symmetrize(edges).withColumn("w", F.lit(1.0)), start)
    return found.select("id", F.col("dist").cast("long").alias("hops"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Q of ``edges(src, dst, w)`` in both directions under ``membership(id, module)``."""
    a = membership.select(F.col("id").alias("src"), F.col("module").alias("ma"))
    b = membership.select(F.col("id").alias("dst"), F.col("module").alias("mb"))
    e = edges.join(a, "src").join(b, "dst")
    per = e.groupBy("ma").agg(F.sum(F.when(F.col("ma") == F.col("mb"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("tot"))
    all_ = e.agg(F.sum("w").alias("m2"))
    return per.join(F.broadcast(all_)).agg(F.sum(F.col("inner") / F.col("m2") - (F.col("tot") / F.col("m2")) ** 2).alias("q"))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest (a, b, w) by Boruvka rounds; ties by (w, a, b)."""
    e = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")))
    label = cut(nodes(edges).withColumn("component", F.col("id")))
    tree = None
    while True:
        la, lb = (label.select(F.col("id").alias(k), F.col("component").alias("c" + k)) for k in ("a", "b"))
        open_ = cut(e.join(la, "a").join(lb, "b").where("ca <> cb"))
        if open_.isEmpty():
            return tree if tree is not None else e.limit(0)
        both = open_.select(F.col("ca").alias("c"), "a", "b", "w", "ca", "cb").union(open_.select("cb", "a", "b", "w", "ca", "cb"))
        best = cut(both.groupBy("c").agg(F.min(F.struct("w", "a", "b", "ca", "cb")).alias("e")).select("e.*").distinct())
        picked = best.select("a", "b", "w")
        tree = cut(picked if tree is None else tree.union(picked))
        joined = components(best.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))).select(F.col("id").alias("component"), F.col("component").alias("n"))
        label = cut(label.join(joined, "component", "left").select("id", F.coalesce("n", "component").alias("component")))
