"""Exact work on all pairs of rows, in blocks of bounded size.

Rows are dealt into blocks by a hash of their id; a task gets one block of queries and one of
the others, so its memory is bounded by the block size and no pair is written as a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def by_blocks(df: DataFrame, columns: list[str], work, schema: str, block: int = BLOCK) -> DataFrame:
    """``work(query, other)`` on every pair of blocks; each is a dict of numpy arrays by column,
    vectors as matrices. Its dict of lists becomes rows of ``schema``. ``df`` needs sample_id."""
    n = max(1, -(-df.count() // block))
    rows = df.select(*(F.col(c).alias("_" + c) for c in columns)).withColumn("_b", F.pmod(F.xxhash64("_sample_id"), F.lit(n)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    asked = F.transform(every, lambda k: F.struct(F.col("_b").alias("_i"), k.alias("_j"), F.lit(True).alias("_q")))
    other = F.transform(every, lambda k: F.struct(k.alias("_i"), F.col("_b").alias("_j"), F.lit(False).alias("_q")))
    dealt = rows.withColumn("_to", F.explode(F.concat(asked, other))).select(*rows.columns[:-1], "_to.*")
    names = [x.split()[0] for x in schema.split(",")]

    def arrays(t: pa.Table) -> dict:
        out = {}
        for c in columns:
            v = t["_" + c].combine_chunks()
            out[c] = np.array(v.to_pylist()) if not pa.types.is_list(v.type) else np.array(v.to_pylist(), float).reshape(len(v), -1)
        return out

    def run(t):
        a, b = t.filter(t["_q"]), t.filter(pa.compute.invert(t["_q"]))
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.float64()) for c in names}).slice(0, 0).cast(target)
        got = work(arrays(a), arrays(b))
        return pa.table({c: pa.array(got[c]) for c in names}).cast(target)

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    target = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(",")])
    return dealt.groupBy("_i", "_j").applyInArrow(run, schema)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.stack([((a - v) ** 2).sum(axis=1) for v in b], axis=1), 0)) if len(b) else np.zeros((len(a), 0))


def _nearest(q: np.ndarray, qid: np.ndarray, o: np.ndarray, oid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest others of each query, by distance and then id; a row of the same id is none."""
    src, dst, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    by = np.argsort(oid, kind="stable")
    o, oid = o[by], oid[by]
    for i in range(0, len(q), 1024):
        d = distances(q[i : i + 1024], o)
        d[qid[i : i + 1024, None] == oid[None, :]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, best, axis=1)
        ok = np.isfinite(near)
        src.append(np.repeat(qid[i : i + 1024], ok.sum(axis=1)))
        dst.append(oid[best[ok]])
        dist.append(near[ok])
    return np.concatenate(src), np.concatenate(dst), np.concatenate(dist)


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn(df: DataFrame, x: str, k: int, plane_from: int = 4 * BLOCK) -> DataFrame:
    """The k nearest others of each row: (src, dst, dist, rank); ties go to the smaller id, and a
    row is no neighbour of itself, by id. Rows without a whole vector have no neighbours and are none.

    Points of the plane, if there are at least ``plane_from``, meet in cells; vectors of more
    components meet in all pairs of blocks, which is quadratic."""
    rows = df.where(F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)))
    n, least, most = rows.agg(F.count("*"), F.min(F.size(x)), F.max(F.size(x))).first()
    if least == most == 2 and n >= plane_from:
        return knn_plane(rows.select("sample_id", F.col(x)[0].alias("px"), F.col(x)[1].alias("py")), k)

    def work(q, o):
        return dict(zip(("src", "dst", "dist"), _nearest(q[x], q["sample_id"], o[x], o["sample_id"], k), strict=True))

    return _top(by_blocks(rows, ["sample_id", x], work, "src long, dst long, dist double"), k)


def knn_plane(points: DataFrame, k: int, per_cell: int = 256, block: int = 4096) -> DataFrame:
    """``knn`` of ``points(sample_id, px, py)``: each point meets those of its cell and the eight around it.

    A point is done when its k-th neighbour is nearer than the border of these nine cells; the others
    meet again in cells three times as wide. Cells of many points are dealt into blocks of queries
    and others, so a task's memory is bounded; only points that lie so close meet in all pairs of blocks."""
    from .graph import cut

    points = cut(points)
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    none = points.sparkSession.createDataFrame([], "src long, dst long, dist double, rank int")
    if not n:
        return none
    span = max(x1 - x0, y1 - y0)
    side = span / max(1.0, (n / per_cell) ** 0.5) or 1.0
    open_, done = points, none
    while True:
        cx, cy = F.floor((F.col("px") - x0) / side).cast("long"), F.floor((F.col("py") - y0) / side).cast("long")
        asked = open_.withColumn("cx", cx).withColumn("cy", cy)
        ring = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        per = points.groupBy(cx.alias("x"), cy.alias("y")).agg(F.count("*").alias("n")).withColumn("s", ring)
        around = per.groupBy((F.col("x") + F.col("s.i")).alias("cx"), (F.col("y") + F.col("s.j")).alias("cy")).agg(F.sum("n").alias("all"))
        cells = asked.groupBy("cx", "cy").agg(F.count("*").alias("own")).join(around, ["cx", "cy"])
        cells = cut(cells.select("cx", "cy", F.ceil(F.col("own") / block).cast("int").alias("nq"), F.ceil(F.col("all") / block).cast("int").alias("no")))
        part = lambda m: F.pmod(F.xxhash64("sample_id"), F.col(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        names = ["cx", "cy", "bq", "bo", "sample_id", "px", "py", "ask"]
        queries = asked.join(cells, ["cx", "cy"]).withColumn("bq", part("nq")).withColumn("bo", every("no")).withColumn("ask", F.lit(True))
        moved = points.withColumn("s", ring).withColumn("cx", cx + F.col("s.i")).withColumn("cy", cy + F.col("s.j"))
        others = moved.join(cells, ["cx", "cy"]).withColumn("bo", part("no")).withColumn("bq", every("nq")).withColumn("ask", F.lit(False))

        def run(t):
            a, b = t.filter(t["ask"]), t.filter(pa.compute.invert(t["ask"]))
            both = [(np.stack([v["px"].to_numpy(), v["py"].to_numpy()], axis=1), v["sample_id"].to_numpy()) for v in (a, b)]
            return pa.table(dict(zip(("src", "dst", "dist"), map(pa.array, _nearest(*both[0], *both[1], k)), strict=True)))

        met = queries.select(*names).union(others.select(*names)).groupBy("cx", "cy", "bq", "bo").applyInArrow(run, "src long, dst long, dist double")
        found = cut(_top(met, k))
        if side >= span:
            return done.union(found)
        low = lambda p, o: F.pmod(F.col(p) - F.lit(o), F.lit(side)) + side
        border = F.least(*(v for p, o in (("px", x0), ("py", y0)) for v in (low(p, o), 3 * side - low(p, o))))
        last = found.groupBy(F.col("src").alias("sample_id")).agg(F.max("dist").alias("far"), F.count("*").alias("c"))
        judged = cut(open_.join(last, "sample_id", "left").withColumn("ok", (F.col("c") == k) & (F.col("far") < border * (1 - 1e-12))))
        done = done.union(found.join(judged.where("ok").select(F.col("sample_id").alias("src")), "src", "left_semi"))
        open_ = judged.where("ok is null or not ok").select("sample_id", "px", "py")
        if open_.isEmpty():
            return done
        side *= 3
