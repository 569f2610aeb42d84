"""Polygons, contiguity and regions. A polygon is one closed ring, an array of (x, y) structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assign import small
from .graph import components, cut, nodes, symmetrize


def square_cells(cells: DataFrame, side: float = 1.0) -> DataFrame:
    """``cells(id, i, j)`` as squares: (id, ring)."""
    corner = lambda a, b: F.struct(((F.col("i") + a) * side).cast("double").alias("x"), ((F.col("j") + b) * side).cast("double").alias("y"))
    return cells.select("id", F.array(*(corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))).alias("ring"))


def hex_cells(cells: DataFrame, side: float = 1.0) -> DataFrame:
    """``cells(id, i, j)`` as hexagons in columns, odd columns half a cell lower."""
    h = 3**0.5 / 2 * side
    cx = F.col("i") * 1.5 * side
    cy = (F.col("j") * 2 + F.pmod(F.col("i"), F.lit(2))) * h
    at = [(-0.5 * side, -h), (0.5 * side, -h), (side, 0.0), (0.5 * side, h), (-0.5 * side, h), (-side, 0.0), (-0.5 * side, -h)]
    return cells.select("id", F.array(*(F.struct((cx + a).alias("x"), (cy + b).alias("y")) for a, b in at)).alias("ring"))


def centroids(polygons: DataFrame) -> DataFrame:
    """(id, cx, cy) by area, from the cross products of consecutive corners."""
    a = F.slice("ring", F.lit(1), F.size("ring") - 1)
    b = F.slice("ring", F.lit(2), F.size("ring") - 1)
    parts = F.zip_with(a, b, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    total = lambda f: F.aggregate(F.col("_p"), F.lit(0.0), lambda s, v: s + f(v))
    out = polygons.withColumn("_p", parts)
    area = total(lambda v: v["c"])
    return out.select("id", (total(lambda v: v["c"] * v["sx"]) / (3 * area)).alias("cx"), (total(lambda v: v["c"] * v["sy"]) / (3 * area)).alias("cy"))


def _segments(polygons: DataFrame, p: str) -> DataFrame:
    a = F.slice("ring", F.lit(1), F.size("ring") - 1)
    b = F.slice("ring", F.lit(2), F.size("ring") - 1)
    s = polygons.select("id", F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("s"))
    return s.select(F.col("id").alias(p), *(F.col(f"s.{e}.{c}").alias(p + e + c) for e in "ab" for c in "xy"))


def _turn(ax, ay, bx, by, cx, cy):
    c = F.col
    return F.signum((c(bx) - c(ax)) * (c(cy) - c(ay)) - (c(by) - c(ay)) * (c(cx) - c(ax)))


def contiguity(polygons: DataFrame, rook: bool) -> DataFrame:
    """Neighbours (src, dst) of a coverage (polygons that do not overlap): a shared point (queen), or
    a shared border of positive length (rook).

    Border segments meet in cells as large as the longest of them, so each lies in at most four,
    and only segments of one cell are compared.
    """
    s = _segments(polygons, "p")
    span = F.greatest(F.abs(F.col("pax") - F.col("pbx")), F.abs(F.col("pay") - F.col("pby")))
    size = s.agg(F.max(span)).first()[0] or 1.0
    low = lambda p, c: F.least(f"{p}a{c}", f"{p}b{c}")
    high = lambda p, c: F.greatest(f"{p}a{c}", f"{p}b{c}")
    grid = lambda v: F.floor(v / size).cast("long")

    def dealt(p):
        out = _segments(polygons, p)
        out = out.withColumn("cx", F.explode(F.sequence(grid(low(p, "x")), grid(high(p, "x")))))
        return out.withColumn("cy", F.explode(F.sequence(grid(low(p, "y")), grid(high(p, "y")))))

    both = dealt("p").join(dealt("q"), ["cx", "cy"]).where("p <> q")
    t1, t2 = (_turn("pax", "pay", "pbx", "pby", f"q{e}x", f"q{e}y") for e in "ab")
    t3, t4 = (_turn("qax", "qay", "qbx", "qby", f"p{e}x", f"p{e}y") for e in "ab")
    over = {c: F.least(high("p", c), high("q", c)) - F.greatest(low("p", c), low("q", c)) for c in "xy"}
    if rook:
        meet = (t1 == 0) & (t2 == 0) & (t3 == 0) & (t4 == 0) & (F.greatest(over["x"], over["y"]) > 0) & (over["x"] >= 0) & (over["y"] >= 0)
    else:
        meet = (t1 * t2 <= 0) & (t3 * t4 <= 0) & (over["x"] >= 0) & (over["y"] >= 0)
    return both.where(meet).select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct()


def points_in(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(point_id, id): points of ``points(point_id, px, py)`` inside polygons, by counting crossings.

    Points and polygons meet in cells as large as the widest polygon.
    """
    ends = {c: [f(F.col(f"ring.{c}")) for f in (F.array_min, F.array_max)] for c in "xy"}
    size = polygons.agg(F.max(F.greatest(*(ends[c][1] - ends[c][0] for c in "xy")))).first()[0] or 1.0
    grid = lambda v: F.floor(v / size).cast("long")
    p = polygons.select("id", "ring", F.explode(F.sequence(*(grid(v) for v in ends["x"]))).alias("cx"), *(grid(v).alias(n) for v, n in zip(ends["y"], ("y0", "y1"), strict=True)))
    p = p.select("id", "ring", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    q = points.select("point_id", "px", "py", grid(F.col("px")).alias("cx"), grid(F.col("py")).alias("cy"))
    x, y = F.col("px"), F.col("py")
    a, b = F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1)
    crossed = F.zip_with(a, b, lambda s, e: ((s["y"] > y) != (e["y"] > y)) & (x < (e["x"] - s["x"]) * (y - s["y"]) / (e["y"] - s["y"]) + s["x"]))
    odd = F.size(F.filter(crossed, lambda v: v)) % 2 == 1
    return q.join(p, ["cx", "cy"]).where(odd).select("point_id", "id").distinct()


def contiguous_parts(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cluster, part): connected parts within each of ``clusters(id, cluster)``; a part is its smallest id."""
    a, b = (clusters.select(F.col("id").alias(k), F.col("cluster").alias("c" + k)) for k in ("src", "dst"))
    inside = edges.select("src", "dst").join(a, "src").join(b, "dst").where("csrc = cdst").select("src", "dst")
    found = components(inside).withColumnRenamed("component", "part")
    return clusters.join(found, "id", "left").select("id", "cluster", F.coalesce("part", "id").alias("part"))


def is_contiguous(parts: DataFrame) -> DataFrame:
    """(cluster, contiguous): whether a cluster is one part."""
    return parts.groupBy("cluster").agg((F.min("part") == F.max("part")).alias("contiguous"))


def within_depth(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """(id, depth) of nodes at 1..depth hops from ``start``."""
    e = symmetrize(edges)
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id long, depth long")
    for k in range(1, depth + 1):
        front = seen.where(F.col("depth") == k - 1)
        new = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = cut(seen.union(new.withColumn("depth", F.lit(k).cast("long"))))
    return seen.where("depth > 0")


def all_hops(edges: DataFrame) -> DataFrame:
    """(src, dst, hops) for all reachable pairs, by one frontier for all sources; for graphs of a codebook's size."""
    e = cut(symmetrize(edges))
    seen = cut(nodes(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("hops")))
    front = seen
    while not front.isEmpty():
        step = front.select("src", F.col("dst").alias("_at"), "hops").join(e.withColumnRenamed("src", "_at"), "_at").select("src", "dst", (F.col("hops") + 1).alias("hops")).distinct()
        front = cut(step.join(seen, ["src", "dst"], "left_anti"))
        seen = cut(seen.union(front))
    return seen


def shortest_path(edges: DataFrame, start: int, end: int) -> DataFrame:
    """(step, id, dist) of a cheapest path over ``edges(src, dst, w)``, w > 0; of equal ones, the one
    whose predecessors have smaller ids, from the end on. No rows if the end is not reached."""
    from .graph import shortest

    dist = shortest(edges, start)
    a = dist.select(F.col("id").alias("src"), F.col("dist").alias("da"))
    b = dist.select(F.col("id").alias("dst"), F.col("dist").alias("db"))
    tight = edges.join(a, "src").join(b, "dst").where(F.abs(F.col("da") + F.col("w") - F.col("db")) <= 1e-9 * (1 + F.col("db")))
    before = cut(tight.groupBy("dst").agg(F.min("src").alias("src")))
    back = cut(dist.where(F.col("id") == end).select(F.lit(0).alias("k"), "id", "dist"))
    front = back
    while not front.isEmpty():
        one = front.join(before, front["id"] == before["dst"]).where(F.col("id") != start).select((F.col("k") + 1).alias("k"), F.col("src").alias("id"))
        front = cut(one.join(dist, "id").select("k", "id", "dist"))
        back = cut(back.union(front))
    last = back.agg(F.max("k").alias("m"))
    return back.join(F.broadcast(last)).select((F.col("m") - F.col("k")).cast("long").alias("step"), "id", "dist")


def circle_layout(ids: DataFrame) -> DataFrame:
    """``ids(id)`` with dense ids 0.. at equal angles of the unit circle: (id, x, y)."""
    n = ids.agg(F.count("*").alias("n"))
    angle = 2 * F.pi() * F.col("id") / F.col("n")
    return ids.join(F.broadcast(n)).select("id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def geo_layout(points: DataFrame, width: float, height: float) -> DataFrame:
    """``points(id, px, py)`` scaled into a frame with the aspect kept, y downwards: (id, x, y)."""
    s = points.agg(*(f(c).alias(n + c) for c in ("px", "py") for n, f in (("lo", F.min), ("hi", F.max))))
    k = F.least(*(F.lit(size) / F.nullif(F.col("hi" + c) - F.col("lo" + c), F.lit(0)) for c, size in (("px", width), ("py", height))))
    return points.join(F.broadcast(s)).select("id", ((F.col("px") - F.col("lopx")) * k).alias("x"), ((F.col("hipy") - F.col("py")) * k).alias("y"))


def edge_weights(edges: DataFrame, style: str) -> DataFrame:
    """``edges(a, b, cnt, f_dist, g_dist)`` to (a, b, w): count, distance, geo or none, by the largest value."""
    if style == "none":
        return edges.select("a", "b", F.lit(1.0).alias("w"))
    c = {"count": "cnt", "distance": "f_dist", "geo": "g_dist"}[style]
    top = edges.agg(F.max(c).cast("double").alias("top"))
    share = F.col(c) / F.col("top")
    return edges.join(F.broadcast(top)).select("a", "b", (share if style == "count" else 1 - share).alias("w"))


def class_spread(best: DataFrame, codebook: DataFrame) -> DataFrame:
    """``best(sample_id, neuron_id, label)``: for each class, the mean squared hops (rectangular) of
    its samples' units to the rounded mean position: (label, spread). Two partial aggregates."""
    at = best.join(small(codebook.select("neuron_id", "gx", "gy")), "neuron_id")
    mid = at.groupBy("label").agg(*(F.floor(F.avg(c) + 0.5).alias("m" + c) for c in ("gx", "gy")))
    hop = reduce(lambda a, b: a + b, (F.abs(F.col(c) - F.col("m" + c)) for c in ("gx", "gy")))
    return at.join(small(mid), "label").groupBy("label").agg(F.avg((hop * hop).cast("double")).alias("spread"))
