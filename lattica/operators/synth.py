"""Synthetic data sets with known structure, seeded."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .assign import small


def _lattice(spark: SparkSession, n: int, m: int) -> DataFrame:
    return spark.range(n * m).select("id", F.floor(F.col("id") / m).alias("i"), (F.col("id") % m).alias("j"))


def squareville(spark: SparkSession) -> DataFrame:
    """11 x 21 points in steps of a tenth; the middle nine rows have value 0, the others 10."""
    band = F.when(F.col("j") < 6, 0).when(F.col("j") < 15, 1).otherwise(2)
    return _lattice(spark, 11, 21).select("id", (F.col("i") / 10).alias("x"), (F.col("j") / 10).alias("y"), F.when(band == 1, 0.0).otherwise(10.0).alias("value"), band.alias("class"))


def two_planes(spark: SparkSession) -> DataFrame:
    """40 x 20 points in steps of 0.05; z is -1 left of zero and 1 elsewhere."""
    x = (F.col("i") - 20) / 20
    return _lattice(spark, 40, 20).select("id", x.alias("x"), (F.col("j") / 20).alias("y"), F.when(F.col("i") < 20, -1.0).otherwise(1.0).alias("z"))


def surface(spark: SparkSession, n: int = 21) -> DataFrame:
    p = _lattice(spark, n, n).select("id", (F.col("i") * 6 / (n - 1) - 3).alias("x"), (F.col("j") * 6 / (n - 1) - 3).alias("y"))
    return p.withColumn("z", _surface(F.col("x"), F.col("y")))


def u(name: str, seed: int) -> F.Column:
    """A uniform number of [0, 1) that depends on ``id``, the seed and the name alone, and so neither on
    partitions nor on the engine: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(name))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def normal(name: str, seed: int) -> F.Column:
    """A standard normal number, by the transform of Box and Muller."""
    return F.sqrt(-2 * F.ln(1 - u(name + "1", seed))) * F.cos(2 * math.pi * u(name + "2", seed))


def uniform(spark: SparkSession, n: int, columns: list[str], seed: int) -> DataFrame:
    """Points of the unit square, or of more dimensions."""
    return spark.range(n).select("id", *(u(c, seed).alias(c) for c in columns))


def circles(spark: SparkSession, n: int, rings: int, seed: int) -> DataFrame:
    """Points of a disc of radius 1/2 around (1/2, 1/2): class is the ring, value its parity."""
    r, a = 0.5 * F.sqrt(u("r", seed)), 2 * math.pi * u("a", seed)
    ring = F.least(F.floor(r / (0.5 / rings)), F.lit(rings - 1)).cast("int")
    return spark.range(n).select("id", (0.5 + r * F.cos(a)).alias("x"), (0.5 + r * F.sin(a)).alias("y"), (ring % 2).cast("double").alias("value"), ring.alias("class"))


def strips(spark: SparkSession, n: int, widths: list[float], noise: list[float], height: float, seed: int, equal: bool = False) -> DataFrame:
    """Vertical strips of the given widths: value 1 in even and 0 in odd ones, with uniform noise of the
    strip's width of noise. A point's strip is drawn by width, or any alike if ``equal``."""
    ends = np.cumsum(widths)
    at = u("c", seed) * (len(widths) if equal else float(ends[-1]))
    c = F.least(F.floor(at).cast("int"), F.lit(len(widths) - 1)) if equal else F.aggregate(F.array(*(F.lit(float(e)) for e in ends[:-1])), F.lit(0), lambda k, e: k + (at >= e).cast("int"))
    p = spark.range(n).withColumn("class", c)
    of = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), F.col("class") + 1)
    value = F.when(F.col("class") % 2 == 0, 1.0).otherwise(0.0) + of(noise) * (u("v", seed) - 0.5)
    return p.select("id", (of(ends - widths) + of(widths) * u("x", seed)).alias("x"), (height * u("y", seed)).alias("y"), value.alias("value"), "class")


def density_strips(spark: SparkSession, n: int, k: int, ratio: float, noise: float, width: float, height: float, seed: int) -> DataFrame:
    """k equal strips: even ones have a share ``ratio`` of n / k points and value 0, odd ones the other
    share and value 1 with uniform noise."""
    counts = [math.ceil((ratio if i % 2 == 0 else 1 - ratio) * n / k) for i in range(k)]
    ends = np.cumsum(counts)
    c = F.aggregate(F.array(*(F.lit(int(e)) for e in ends[:-1])), F.lit(0), lambda s, e: s + (F.col("id") >= e).cast("int")) if k > 1 else F.lit(0)
    p = spark.range(int(ends[-1])).withColumn("class", c)
    value = F.when(F.col("class") % 2 == 0, 0.0).otherwise(1.0 + noise * (u("v", seed) - 0.5))
    return p.select("id", ((F.col("class") + u("x", seed)) * (width / k)).alias("x"), (height * u("y", seed)).alias("y"), value.alias("value"), "class")


def diamond(spark: SparkSession, n: int, seed: int, equal: bool = False) -> DataFrame:
    """The unit square with a diamond, class 0 and value 0, between four corners of value 1, classes
    1 to 4. With ``equal`` each class is as likely: a point is drawn in the shape of its class."""
    x, y = u("x", seed), u("y", seed)
    if equal:
        c = F.floor(5 * u("c", seed)).cast("int")
        fold = x + y > 1  # a triangle's points by folding the square
        tx, ty = 0.5 * F.when(fold, 1 - x).otherwise(x), 0.5 * F.when(fold, 1 - y).otherwise(y)
        px = F.when(c == 0, 0.5 + (x - y) / 2).when(c.isin(2, 4), 1 - tx).otherwise(tx)
        py = F.when(c == 0, (x + y) / 2).when(c.isin(3, 4), 1 - ty).otherwise(ty)
    else:
        px, py = x, y
        c = F.when(x + y < 0.5, 1).when(y + 1 - x < 0.5, 2).when(1 - y + x < 0.5, 3).when(2 - x - y < 0.5, 4).otherwise(0)
    return spark.range(n).select("id", px.alias("x"), py.alias("y"), F.when(c == 0, 0.0).otherwise(1.0).alias("value"), c.alias("class"))


def space_time_cube(spark: SparkSession, n: int, space: float, time: float, seed: int) -> DataFrame:
    """Points (x, y, z), z the time: four clusters of value 0, left or right of a gap in x and before or
    after a gap in z, classes 1 to 4; all others have value 1 and class 0."""
    p = uniform(spark, n, ["x", "y", "z"], seed)
    side = F.when(F.col("x") < 0.5 - space, 0).when(F.col("x") > 0.5 + space, 1)
    when = F.when(F.col("z") < 0.5 - time, 0).when(F.col("z") > 0.5 + time, 2)
    c = F.coalesce(1 + side + when, F.lit(0))
    return p.select("*", F.when(c == 0, 1.0).otherwise(0.0).alias("s"), c.alias("class"))


def l_shape(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Three classes on a ground of 2 x 1: an L of value 1 (class 0) in a rest of 0 (class 1), and a bar of
    value 1 on the right (class 2)."""
    x, y = u("x", seed), u("y", seed)
    c = F.when(x > 0.75, 2).when(x > 0.5, 1).when((x < 0.25) | (y <= 0.5), 0).otherwise(1)
    return spark.range(n).select("id", (2 * x).alias("x"), y.alias("y"), F.when(c == 1, 0.0).otherwise(1.0).alias("value"), c.alias("class"))


def t_shape(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Three classes on a ground of 6 x 5: a C (class 0) around a lying T (class 2), both of value 1, in a
    rest of 0 (class 1)."""
    p = spark.range(n).select("id", (6 * u("x", seed)).alias("x"), (5 * u("y", seed)).alias("y"))
    x, y = F.col("x"), F.col("y")
    c = F.when((x < 1) | ((x < 4) & ((y < 1) | (y > 4))), 0).when((x > 5) | ((x > 2) & (y > 2) & (y < 3)), 2).otherwise(1)
    return p.select("*", F.when(c == 1, 0.0).otherwise(1.0).alias("value"), c.alias("class"))


def half_noise(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Two halves of n points: the left of value 0 (class 0), the right of random value (class 1)."""
    c = F.floor(F.col("id") / n).cast("int")
    x = 0.5 * u("x", seed) + 0.5 * c
    return spark.range(2 * n).select("id", x.alias("x"), u("y", seed).alias("y"), F.when(c == 1, u("v", seed)).otherwise(0.0).alias("value"), c.alias("class"))


def spread_squares(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Four squares of n points that spread in value alone (0), in space alone (1), in neither (2), in both (3)."""
    c = F.floor(F.col("id") / n).cast("int")
    wide, loose = c.isin(1, 3), c.isin(0, 3)
    x = F.when(wide, u("x", seed)).otherwise(0.5) + c.isin(1, 2).cast("int")
    y = F.when(wide, u("y", seed)).otherwise(0.5) + c.isin(2, 3).cast("int")
    return spark.range(4 * n).select("id", x.alias("x"), y.alias("y"), F.when(loose, u("v", seed)).otherwise(0.5).alias("value"), c.alias("class"))


def _surface(x, y) -> F.Column:
    return x * x * F.exp(-x * x - (y + 1) * (y + 1)) - (0.2 * x - x * x * x - y * y * y * y * y) * F.exp(-x * x - y * y)


def random_surface(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Random points of the surface over [-2, 2]^2, z with normal noise in proportion to it."""
    p = spark.range(n).select("id", (4 * u("x", seed) - 2).alias("x"), (4 * u("y", seed) - 2).alias("y"))
    return p.withColumn("z", _surface(F.col("x"), F.col("y")) * (1 + normal("e", seed)))


def mixture_density(spark: SparkSession, n: int, means: list[tuple[float, float]], covariances: list, seed: int) -> DataFrame:
    """Random points of [-2, 2]^2 with the greatest density of some bivariate normal distributions."""
    p = spark.range(n).select("id", (4 * u("x", seed) - 2).alias("x"), (4 * u("y", seed) - 2).alias("y"))
    dens = []
    for (mx, my), ((a, b), (_, d)) in zip(means, covariances, strict=True):
        det = a * d - b * b
        dx, dy = F.col("x") - mx, F.col("y") - my
        dens.append(F.exp(-(d * dx * dx - 2 * b * dx * dy + a * dy * dy) / (2 * det)) / (2 * math.pi * math.sqrt(det)))
    return p.withColumn("value", F.greatest(*dens) if len(dens) > 1 else dens[0])


def mixture(spark: SparkSession, n: int, means: list[tuple[float, float]], covariances: list, seed: int) -> DataFrame:
    """n points of each bivariate normal distribution; value is 1 for the point nearest to its mean, 0 for
    the farthest, and falls with the distance."""
    c = F.floor(F.col("id") / n).cast("int")
    of = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), F.col("class") + 1)
    low = [np.linalg.cholesky(np.array([[a, b], [b, d]])) for (a, b), (_, d) in covariances]
    p = spark.range(n * len(means)).select("id", c.alias("class"), normal("x", seed).alias("e"), normal("y", seed).alias("f"))
    dx, dy = of([m[0, 0] for m in low]) * F.col("e"), of([m[1, 0] for m in low]) * F.col("e") + of([m[1, 1] for m in low]) * F.col("f")
    p = p.select("id", (of([m[0] for m in means]) + dx).alias("x"), (of([m[1] for m in means]) + dy).alias("y"), F.sqrt(dx * dx + dy * dy).alias("d"), "class")
    ends = p.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return p.join(F.broadcast(ends)).select("id", "x", "y", ((F.col("hi") - F.col("d")) / (F.col("hi") - F.col("lo"))).alias("value"), "class")


def squareville_gradient(spark: SparkSession) -> DataFrame:
    """The points of ``squareville`` with value x in the outer bands and 1 - x in the middle one."""
    p = squareville(spark)
    return p.withColumn("value", F.when(F.col("class") == 1, 1 - F.col("x")).otherwise(F.col("x")))


def outliers(spark: SparkSession, seed: int, n: int = 400, each: int = 5) -> DataFrame:
    """The square [-1, 1]^2 in two triangles: class 0 of value 1 below the diagonal, class 1 of value -1
    above. Then ``each`` of both classes far away in space, and ``each`` of both far away in value (-10, 10)."""
    i = F.col("id")
    kind = F.when(i < n, 0).when(i < n + 2 * each, 1).otherwise(2)
    x, y = 2 * u("x", seed) - 1, 2 * u("y", seed) - 1
    second = F.floor((i - n) / each) % 2 == 1
    c = F.when(kind == 0, (y >= x).cast("int")).otherwise(second.cast("int"))
    far = F.when(c == 0, 10.0).otherwise(-10.0)
    # a value outlier lies in its class's triangle: the point or its mirror
    px = F.when(kind == 1, u("x", seed) + far).when((kind == 2) & ((y >= x) != (c == 1)), y).otherwise(x)
    py = F.when(kind == 1, u("y", seed) + far).when((kind == 2) & ((y >= x) != (c == 1)), x).otherwise(y)
    value = F.when(kind == 2, -far).when(c == 0, 1.0).otherwise(-1.0)
    return spark.range(n + 4 * each).select("id", px.alias("x"), py.alias("y"), value.alias("value"), c.alias("class"))


def squares(spark: SparkSession, n: int, side: int, seed: int) -> DataFrame:
    """Points in side x side squares, each a cluster with its own value."""
    p = uniform(spark, n, ["x", "y"], seed)
    c = (F.floor(F.col("x") * side) * side + F.floor(F.col("y") * side)).cast("int")
    return p.select("*", F.pmod(c * 7, F.lit(side * side)).cast("double").alias("value"), c.alias("cluster"))


def voronoi_regions(spark: SparkSession, side: int, regions: int, noise: float, seed: int) -> DataFrame:
    """side x side cells, each in the region of its nearest seed (the smaller index at equal
    distance), with the region's value plus uniform noise: (id, i, j, value, class)."""
    seeds = spark.range(regions).select(F.col("id").cast("int").alias("k"), (side * u("sx", seed)).alias("sx"), (side * u("sy", seed)).alias("sy"))
    d = (F.col("i") - F.col("sx")) * (F.col("i") - F.col("sx")) + (F.col("j") - F.col("sy")) * (F.col("j") - F.col("sy"))
    near = _lattice(spark, side, side).join(small(seeds)).groupBy("id", "i", "j").agg(F.min(F.struct(d.alias("d"), "k"))["k"].alias("class"))
    return near.select("id", "i", "j", (F.col("class") + noise * (u("v", seed) - 0.5)).alias("value"), "class")


def mackey_glass(n: int, tau: float = 17, a: float = 0.2, b: float = 0.1, x0: float = 1.2, step: float = 1.0, variation: float = 0.0, seed: int = 0) -> np.ndarray:
    """n + 1 values of dx/dt = a x(t - tau) / (1 + x(t - tau)^10) - b x, by Runge-Kutta with the delayed value
    held in a step; the first is moved by up to half of ``variation``. With L = tau / step steps, the
    delayed value is 0 for L steps and then the value of L - 2 steps ago: the ring of L values that
    holds the past has its first place used once only."""
    x = np.full(n + 1, x0 + variation * (np.random.default_rng(seed).random() - 0.5))
    held = math.floor(tau / step)
    for t in range(n):
        late = x[t - held + 2] if tau and t >= held else 0.0
        f = lambda v, late=late: a * late / (1 + late**10) - b * v
        k1 = step * f(x[t])
        k2 = step * f(x[t] + k1 / 2)
        k3 = step * f(x[t] + k2 / 2)
        k4 = step * f(x[t] + k3)
        x[t + 1] = x[t] + k1 / 6 + k2 / 3 + k3 / 3 + k4 / 6
    return x
