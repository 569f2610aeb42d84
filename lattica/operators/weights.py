"""Spatial weights as edge tables (src, dst, w), lags and spatial autocorrelation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut
from .reshape import numbered


#: Ids in an array of ``radius_groups`` at most, so that no row grows with the copies of a point.
MEMBERS = 1024


def radius_groups(points: DataFrame, radius: float, sources: DataFrame | None = None) -> DataFrame:
    """``radius_pairs`` before points of equal coordinates are told apart: (src, dst, dist, lo, hi), dst an
    array of ids at one place, lo and hi the least and greatest of it; ``members`` makes pairs of it.
    ``sources`` are the points whose rows are wanted, where they have more columns to keep. Points meet in cells a little wider than the radius, so each is compared with the places of nine cells only, and
    rounding at a border loses none. The nine copies must not be broadcast: Spark takes them for one."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.floor(F.col(c) / (radius * (1 + 1e-6))).cast("long")
    own = points if sources is None else sources
    more = [c for c in own.columns if c not in ("id", "px", "py")]
    a = own.select(F.col("id").alias("src"), F.col("px").alias("ax"), F.col("py").alias("ay"), cell("px").alias("cx"), cell("py").alias("cy"), *more)
    places = points.groupBy("px", "py").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 0)
    some = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / MEMBERS).cast("int")), lambda k: F.slice("ids", k * MEMBERS + 1, MEMBERS))
    b = places.select("px", "py", F.explode(some).alias("dst"))
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    b = b.select("dst", F.array_min("dst").alias("lo"), F.array_max("dst").alias("hi"), F.col("px").alias("bx"), F.col("py").alias("by"), cell("px").alias("x"), cell("py").alias("y"), step.alias("s"))
    b = b.select("dst", "lo", "hi", "bx", "by", (F.col("x") + F.col("s.i")).alias("cx"), (F.col("y") + F.col("s.j")).alias("cy"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    met = a.repartition(parts, "cx", "cy").join(b.repartition(parts, "cx", "cy").hint("merge"), ["cx", "cy"]).where("src <> lo OR src <> hi")
    return met.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= radius).select("src", "dst", "dist", "lo", "hi", *more)


def members(groups: DataFrame) -> DataFrame:
    """(src, dst, ...) for each other id in the arrays dst of ``radius_groups``."""
    return groups.drop("lo", "hi").withColumn("dst", F.explode("dst")).where("src <> dst")


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Pairs of ``points(id, px, py)`` within ``radius``: (src, dst, dist)."""
    return members(radius_groups(points, radius))


def inverse_distance(pairs: DataFrame, power: float) -> DataFrame:
    """w = 1 / dist^power; a zero distance counts as the smallest positive one."""
    low = pairs.where("dist > 0").agg(F.min("dist")).first()[0] or 1.0
    d = F.when(F.col("dist") == 0, F.lit(low)).otherwise(F.col("dist"))
    return pairs.select("src", "dst", (1 / F.pow(d, F.lit(power))).alias("w"))


def row_normalize(w: DataFrame) -> DataFrame:
    return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def row_normalize_radius(points: DataFrame, radius: float) -> DataFrame:
    """``row_normalize`` of the positive distances of ``radius_pairs``, as (src, dst, w) for ``members``. Rows
    are summed before places are told apart, then the points meet again with their sums, so no pair is
    exchanged."""
    groups = radius_groups(points, radius).where("dist > 0")
    itself = F.when(F.col("src").between(F.col("lo"), F.col("hi")) & F.array_contains("dst", F.col("src")), F.size(F.filter("dst", lambda k: k == F.col("src")))).otherwise(0)
    sums = groups.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("dist") * (F.size("dst") - itself)).alias("total"))
    again = radius_groups(points, radius, points.join(sums.hint("merge"), "id")).where("dist > 0")
    return again.select("src", "dst", (F.col("dist") / F.col("total")).alias("w"))


def lattice(points: DataFrame, rook: bool, identity: bool = False) -> DataFrame:
    """Contiguity of unit cells ``points(id, i, j)``: shared sides (rook) or also corners (queen), and
    with ``identity`` each cell beside itself."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b or identity) and (not rook or not (a and b))]
    s = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    out = points.select(F.col("id").alias("src"), "i", "j", s.alias("s")).select("src", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
    return out.join(points.select(F.col("id").alias("dst"), "i", "j"), ["i", "j"]).select("src", "dst")


def lag(w: DataFrame, values: DataFrame, order: int = 1) -> DataFrame:
    """Weighted sums over neighbours, once or twice: ``w(src, dst, w)``, ``values(id, v)`` to (id, v)."""
    if order not in (1, 2):
        raise ValueError("lags are 1 or 2")
    for _ in range(order):
        values = w.join(values.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return values


def lag_vectors(w: DataFrame, samples: DataFrame) -> DataFrame:
    """``samples(sample_id, x)`` with the weighted sum of their neighbours' vectors appended to each; zeros
    without neighbours."""
    part = w.join(samples.select(F.col("sample_id").alias("dst"), F.posexplode("x").alias("pos", "v")), "dst")
    sums = part.groupBy("src", "pos").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    lags = sums.groupBy(F.col("src").alias("sample_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("_lag"))
    zeros = F.transform("x", lambda v: F.lit(0.0))
    return samples.join(lags, "sample_id", "left").select("sample_id", F.concat("x", F.coalesce("_lag", zeros)).alias("x"))


def _centred(values: DataFrame) -> DataFrame:
    return values.join(F.broadcast(values.agg(F.avg("v").alias("_m")))).select("id", (F.col("v") - F.col("_m")).alias("z"))


def _cross(w: DataFrame, z: DataFrame) -> DataFrame:
    return w.join(z.select(F.col("id").alias("src"), F.col("z").alias("zi")), "src").join(z.select(F.col("id").alias("dst"), F.col("z").alias("zj")), "dst")


def morans_i(w: DataFrame, values: DataFrame) -> DataFrame:
    z = _centred(values)
    n = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    s = _cross(w, z).agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("c"), F.sum("w").alias("s"))
    return s.join(n).select((F.col("n") / F.col("zz") * F.col("c") / F.col("s")).alias("i"))


def morans_i_stats(w: DataFrame, values: DataFrame) -> DataFrame:
    """I, its expectation, variance under randomisation, z and the two-sided p = 2 (1 - Phi(|z|))."""
    z = _centred(values)
    m = z.agg(F.count("*").alias("n"), (F.sum(F.pow("z", F.lit(4.0))) / F.count("*") / F.pow(F.avg(F.col("z") * F.col("z")), F.lit(2.0))).alias("s3")).first()
    both = w.where("src <> dst").select("src", "dst", "w").union(w.where("src <> dst").select(F.col("dst"), F.col("src"), "w"))
    pair = both.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    s1 = pair.agg(F.sum(F.col("w") * F.col("w")) / 2).first()[0]
    s2 = both.groupBy("src").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    total = w.where("src <> dst").agg(F.sum("w")).first()[0]
    n, s3 = m["n"], m["s3"]
    s4 = (n * n - 3 * n + 3) * s1 - n * s2 + 3 * total**2
    s5 = (n * n - n) * s1 - 2 * n * s2 + 6 * total**2
    e = -1.0 / (n - 1)
    var = (n * s4 - s3 * s5) / ((n - 1) * (n - 2) * (n - 3) * total**2) - e * e
    i = morans_i(w, values).first()[0]
    score = (i - e) / math.sqrt(var)
    return values.sparkSession.createDataFrame([(i, e, var, score, math.erfc(abs(score) / math.sqrt(2)))], "i double, e double, var double, z double, p double")


def local_morans_i(w: DataFrame, values: DataFrame) -> DataFrame:
    z = _centred(values)
    m2 = z.agg(F.avg(F.col("z") * F.col("z")).alias("m2"))
    part = _cross(w, z).groupBy(F.col("src").alias("id"), "zi").agg(F.sum(F.col("w") * F.col("zj")).alias("s"))
    return part.join(F.broadcast(m2)).select("id", (F.col("zi") / F.col("m2") * F.col("s")).alias("i"))


def morans_i_monte_carlo(w: DataFrame, values: DataFrame, reps: int, seed: int) -> DataFrame:
    """Moran's I against ``reps`` seeded permutations of the values: i, mean, var, z, one-sided p.

    A permutation is the order of a hash. All are numbered together, over ranges of (rep, hash), so a
    permutation is no single task."""
    spark = values.sparkSession
    m = values.agg(F.avg("v"), F.var_pop("v"), F.count("*")).first()
    placed = cut(numbered(values, [F.col("id")], "at"))
    grid = placed.join(F.broadcast(spark.range(reps).withColumnRenamed("id", "rep"))).withColumn("_h", F.md5(F.concat_ws(":", "id", "rep", F.lit(seed))))
    dealt = numbered(grid.select("rep", "_h", "id", "v"), [F.col("rep"), F.col("_h"), F.col("id")], "_k")
    dealt = dealt.select("rep", (F.col("_k") - F.col("rep") * m[2]).alias("at"), (F.col("v") - m[0]).alias("z"))
    perm = dealt.join(placed.select("at", "id"), "at")
    a, b = (perm.select("rep", F.col("id").alias(k), F.col("z").alias("z" + k)) for k in ("src", "dst"))
    each = w.join(a, "src").join(b, ["rep", "dst"]).groupBy("rep").agg((F.sum(F.col("w") * F.col("zsrc") * F.col("zdst")) / F.sum("w") / m[1]).alias("p"))
    i = morans_i(w, values).first()[0]
    out = each.agg(F.avg("p").alias("mean"), F.var_samp("p").alias("var"), F.avg((F.col("p") >= i).cast("double")).alias("ge"), F.avg((F.col("p") <= i).cast("double")).alias("le"))
    p = F.when(F.lit(i) > F.col("mean"), F.col("ge")).when(F.lit(i) < F.col("mean"), F.col("le")).otherwise(0.0)
    return out.select(F.lit(i).alias("i"), "mean", "var", ((F.lit(i) - F.col("mean")) / F.sqrt("var")).alias("z"), p.alias("p"))


def power(w: DataFrame, exponent: float) -> DataFrame:
    """(1 / w)^exponent of each entry."""
    return w.withColumn("w", F.pow(1 / F.col("w"), F.lit(exponent)))


def k_per_row(w: DataFrame, k: int, largest: bool = False) -> DataFrame:
    """The k entries of each row with the smallest (or largest) weights; ties by dst."""
    order = F.col("w").desc() if largest else F.col("w")
    return w.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(order, "dst"))).where(F.col("_r") <= k).drop("_r")


def local_morans_i_monte_carlo(w: DataFrame, values: DataFrame, reps: int, seed: int) -> DataFrame:
    """Local I against ``reps`` draws of other samples as neighbours, with replacement:
    (id, i, mean, sd, z, p), p one-sided with (1 + extremes) / (1 + reps).

    A neighbour is drawn by its place in a dense numbering, so a draw is an equi-join and no row
    meets all others; the rows are edges times ``reps``, spread by (src, rep).
    """
    z = _centred(values)
    m = z.agg(F.avg(F.col("z") * F.col("z")), F.count("*")).first()
    placed = numbered(z, [F.col("id")], "at")
    draws = w.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "src", "dst", "rep", F.lit(seed))), 1, 13), 16, 10).cast("long")
    draws = draws.withColumn("at", drawn % m[1])
    got = draws.select("src", "rep", "w", "at").join(placed.select("at", "z"), "at").groupBy("src", "rep").agg(F.sum(F.col("w") * F.col("z")).alias("s"))
    each = got.join(z.select(F.col("id").alias("src"), F.col("z").alias("zi")), "src").select(F.col("src").alias("id"), (F.col("zi") / m[0] * F.col("s")).alias("p"))
    both = each.join(local_morans_i(w, values), "id")
    out = both.groupBy("id", "i").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"), F.count_if(F.col("p") >= F.col("i")).alias("ge"), F.count_if(F.col("p") <= F.col("i")).alias("le"))
    p = (F.least("ge", "le") + 1) / (1 + reps)
    return out.select("id", "i", "mean", "sd", ((F.col("i") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("z"), p.alias("p"))
