"""The driver's tables in the roles of samples, codebooks, weights and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vec(spark, d) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), x.alias("x"), F.slice(x, 3, 62).alias("f"), F.slice(x, 1, 2).alias("g"), "label")


def codebook(spark, d, n: int = 25, side: int = 5) -> DataFrame:
    """n neurons on a grid: the means of all vectors whose number has the same remainder."""
    i = F.col("neuron_id")
    part = vec(spark, d).select((F.col("sample_id") % n).alias("neuron_id"), F.posexplode("x").alias("pos", "v")).groupBy("neuron_id", "pos").agg(F.avg("v").alias("v"))
    w = part.groupBy("neuron_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("w"))
    return w.select(i, F.floor(i / side).cast("int").alias("gx"), (i % side).cast("int").alias("gy"), "w", F.slice("w", 3, 62).alias("f"), F.slice("w", 1, 2).alias("g"))


def clusters(spark, d) -> DataFrame:
    return vec(spark, d).select("sample_id", "x", F.col("label").alias("cluster"))


def values(spark, d) -> DataFrame:
    """One attribute of each vector: its third component."""
    return vec(spark, d).select(F.col("sample_id").alias("id"), F.element_at("f", 1).alias("v"))


def trade(spark, d) -> DataFrame:
    """Order lines between nations of customer and supplier, both directions added."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("a"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    n = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = n.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n").union(n.select("b", "a", "n"))
    return both.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("w"))


def regions(spark, d) -> DataFrame:
    """Nations of one region, without themselves."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    a, b = n.withColumnRenamed("k", "src"), n.withColumnRenamed("k", "dst")
    return a.join(F.broadcast(b), "n_regionkey").where("src <> dst").select("src", "dst")


def cells(spark, n: int = 12, m: int = 9) -> DataFrame:
    return spark.range(n * m).select("id", F.floor(F.col("id") / m).cast("long").alias("i"), (F.col("id") % m).alias("j"))


def parts(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("px"), F.col("p_retailprice").alias("py"))


VEC = """vec AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS x, (embedding::DOUBLE[])[3:64] AS f, (embedding::DOUBLE[])[1:2] AS g, label FROM embeddings)"""
CB = VEC + """, cw AS (SELECT neuron_id, list(v ORDER BY pos) AS w FROM (SELECT sample_id % 25 AS neuron_id, pos, avg(v) AS v FROM (SELECT sample_id, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM vec) GROUP BY ALL) GROUP BY neuron_id),
cb AS (SELECT neuron_id, neuron_id // 5 AS gx, neuron_id % 5 AS gy, w, w[3:64] AS f, w[1:2] AS g FROM cw)"""
ASSIGN = CB + """, r AS (SELECT sample_id, label, neuron_id, list_distance(vec.x, cb.w) AS dist, row_number() OVER (PARTITION BY sample_id ORDER BY list_distance(vec.x, cb.w), neuron_id) AS rank FROM vec, cb)"""
PAIRS = CB + """, np AS (SELECT a.neuron_id AS n0, b.neuron_id AS n1, (abs(a.gx-b.gx)+abs(a.gy-b.gy))::DOUBLE AS hops, list_distance(a.w, b.w) AS dist, a.gx AS x0, a.gy AS y0, b.gx AS x1, b.gy AS y1 FROM cb a JOIN cb b ON a.neuron_id < b.neuron_id),
adj AS (SELECT n0 AS neuron_id, dist FROM np WHERE hops = 1 UNION ALL SELECT n1, dist FROM np WHERE hops = 1)"""
KNN = VEC + """, knn AS (SELECT src, dst, dist, rank FROM (SELECT a.sample_id AS src, b.sample_id AS dst, list_distance(a.g, b.g) AS dist, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.g, b.g), b.sample_id) AS rank FROM vec a JOIN vec b ON a.sample_id <> b.sample_id) WHERE rank <= 5),
val AS (SELECT sample_id AS id, f[1] AS v FROM vec), z AS (SELECT id, v - (SELECT avg(v) FROM val) AS z FROM val)"""
TRADE = """t0 AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
trade AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, sum(n)::DOUBLE AS w FROM (SELECT a AS src, b AS dst, n FROM t0 UNION ALL SELECT b, a, n FROM t0) GROUP BY ALL)"""
REGIONS = """reg AS (SELECT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"""
CELLS = """cells AS (SELECT range AS id, range // 9 AS i, range % 9 AS j FROM range(108))"""
MEANS = VEC + """, e AS (SELECT sample_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM vec), mv AS (SELECT label, pos, avg(v) AS v, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT label, list(v ORDER BY pos) AS m, any_value(n) AS n FROM mv GROUP BY label),
tot AS (SELECT list(v ORDER BY pos) AS t FROM (SELECT pos, avg(v) AS v FROM e GROUP BY pos)), dm AS (SELECT sample_id, label, list_distance(x, m) AS d FROM vec JOIN m USING (label))"""
SUMS = VEC + """, pr AS (SELECT a.sample_id, a.label AS own, b.label AS other, list_distance(a.x, b.x) AS d FROM vec a JOIN vec b ON a.sample_id <> b.sample_id)"""
