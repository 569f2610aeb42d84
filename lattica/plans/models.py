"""Trained models, clusterings and generators. Only the lattices have SQL; the others are tested by properties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import assign, cluster, graph, synth, train, weights
from ..streaming import temporal
from . import tables as T
from .oracle import fifth, hop, r6, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def samples(spark, d):
    return T.vec(spark, d).select("sample_id", "x")


STEPS = 100_000


def flagship(spark, d):
    book = train.fit(samples(spark, d), lambda x, seed, order: train.run_som(x, seed, STEPS, ("hex", 12, 8), order=order), [1], STEPS).select("neuron_id", "w")
    book = graph.cut(book)
    out = assign.bmu_euclid(samples(spark, d), book)
    return out.groupBy("neuron_id").agg(F.count("*").alias("hits"), F.avg("dist").alias("mean_qe"))


def _fit(name, kernel, steps=STEPS):
    query(name)(lambda spark, d: train.fit(samples(spark, d), lambda x, seed, order: kernel(x, seed, steps, order), [1, 2, 3, 4], steps).select("run", "neuron_id", "w", *(["joined"] if name == "gng_fit" else [])))


_fit("som_fit", lambda x, seed, steps, order: train.run_som(x, seed, steps, ("hex", 12, 8), order=order))
_fit("ng_fit", lambda x, seed, steps, order: train.run_ng(x, seed, steps, 25, order=order))
_fit("cng_fit", lambda x, seed, steps, order: train.run_ng(x, seed, steps, 25, geo=np.arange(x.shape[1]) < 2, l=5, order=order))
_fit("gng_fit", lambda x, seed, steps, order: train.model(*(lambda w, e: (w, None, e))(*train.run_gng(x, seed, steps, order=order, edges=True))))


def rows_of(spark, d, book, *vectors):
    """(neuron_id, pos, a column of each vector), rounded."""
    named = F.arrays_zip(*vectors)
    out = book.select(F.col("neuron_id").cast("long").alias("neuron_id"), F.posexplode(named).alias("pos", "v"))
    return out.select("neuron_id", (F.col("pos") + 1).cast("long").alias("pos"), *(r6(F.col("v")[c]).alias(c) for c in vectors))


@query("kmeans", f"""WITH RECURSIVE {T.CB}, k AS (SELECT 0 AS it, neuron_id, w, true AS moved FROM cb UNION ALL
SELECT it + 1, neuron_id, coalesce(m, w) AS w, bool_or(coalesce(list_distance(m, w), 0) > 1e-5) OVER () FROM (SELECT any_value(it) OVER () AS it, k.neuron_id, k.w, n.m FROM k LEFT JOIN
(SELECT neuron_id, list(v ORDER BY pos) AS m FROM (SELECT neuron_id, pos, avg(v) AS v FROM (SELECT neuron_id, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM
(SELECT sample_id, any_value(x) AS x, min({{'d': list_distance(x, w), 'n': neuron_id}}).n AS neuron_id FROM vec, k GROUP BY sample_id)) GROUP BY ALL) GROUP BY neuron_id) n ON n.neuron_id = k.neuron_id WHERE k.moved))
SELECT neuron_id, generate_subscripts(w, 1) AS pos, round(unnest(w), 6) AS w FROM k WHERE it = (SELECT max(it) FROM k)""")
def kmeans(spark, d):
    return rows_of(spark, d, train.kmeans(samples(spark, d), T.codebook(spark, d)), "w")


def _epochs(widths) -> str:
    """SQL of batch epochs of a 5 x 5 map."""
    parts = [f"WITH {T.CB}, e AS (SELECT sample_id, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM vec), c0 AS (SELECT neuron_id, w FROM cb)"]
    for k, width in enumerate(widths, 1):
        parts.append(f"b{k} AS (SELECT sample_id, min({{'d': list_distance(x, w), 'n': neuron_id}}).n AS bmu FROM vec, c{k - 1} GROUP BY sample_id)")
        parts.append(f"s{k} AS (SELECT bmu, pos, count(*) AS n, sum(v) AS s FROM e JOIN b{k} USING (sample_id) GROUP BY ALL)")
        parts.append(f"m{k} AS (SELECT o.neuron_id, pos, sum(exp(-0.5 * ((abs(o.gx - i.gx) + abs(o.gy - i.gy)) / {width}) ** 2) * s) / sum(exp(-0.5 * ((abs(o.gx - i.gx) + abs(o.gy - i.gy)) / {width}) ** 2) * n) AS v FROM s{k} JOIN cb i ON i.neuron_id = bmu, cb o GROUP BY ALL)")
        parts.append(f"c{k} AS (SELECT neuron_id, list(v ORDER BY pos) AS w FROM m{k} GROUP BY neuron_id)")
    return ",\n".join(parts) + f"\nSELECT neuron_id, pos, round(v, 6) AS w FROM m{len(widths)}"


@query("som_batch_fit", _epochs((3.0, 1.5, 0.75)))
def som_batch_fit(spark, d):
    """Batch epochs with a narrowing kernel: training that scales with the samples."""
    book = T.codebook(spark, d).select("neuron_id", "gx", "gy", "w")
    for width in (3.0, 1.5, 0.75):
        new = train.som_epoch(samples(spark, d), book, hop(), width)
        book = graph.cut(book.drop("w").join(new, "neuron_id"))
    return rows_of(spark, d, book, "w")


def _contexts(widths, by_rank: bool) -> str:
    """SQL of batch epochs with contexts over the five nearest neighbours."""
    parts = [f"WITH {T.KNN.replace(T.VEC, T.CB)}, c0 AS (SELECT neuron_id, w, list_transform(w, lambda v: 0.0::DOUBLE) AS c FROM cb)", "h0 AS (SELECT sample_id, min({'d': list_distance(x, w), 'n': neuron_id}).n AS neuron_id FROM vec, c0 GROUP BY sample_id)"]
    for k, width in enumerate(widths, 1):
        p = k - 1
        parts.append(f"t{k} AS (SELECT src, list(v ORDER BY pos) AS t FROM (SELECT src, pos, avg(v) AS v FROM (SELECT src, unnest(w) * 0.75 + unnest(c) * 0.25 AS v, generate_subscripts(w, 1) AS pos FROM knn JOIN h{p} ON sample_id = dst JOIN c{p} USING (neuron_id)) GROUP BY ALL) GROUP BY src)")
        parts.append(f"d{k} AS (SELECT sample_id, x, t, neuron_id, 0.6 * list_distance(x, w) + 0.4 * list_distance(t, c) AS d FROM vec JOIN t{k} ON src = sample_id, c{p})")
        if by_rank:
            parts.append(f"p{k} AS (SELECT x, t, neuron_id, exp(-(row_number() OVER (PARTITION BY sample_id ORDER BY d, neuron_id) - 1) / {width}::DOUBLE) AS h FROM d{k})")
        else:
            parts.append(f"p{k} AS (SELECT any_value(x) AS x, any_value(t) AS t, o.neuron_id, exp(-0.5 * ((abs(o.gx - i.gx) + abs(o.gy - i.gy)) / {width}::DOUBLE) ** 2) AS h FROM (SELECT sample_id, any_value(x) AS x, any_value(t) AS t, min({{'d': d, 'n': neuron_id}}).n AS bmu FROM d{k} GROUP BY sample_id) b JOIN cb i ON i.neuron_id = bmu, cb o GROUP BY sample_id, o.neuron_id, o.gx, o.gy, i.gx, i.gy)")
        parts.append(f"m{k} AS (SELECT neuron_id, pos, sum(h * v) / sum(h) AS w, sum(h * u) / sum(h) AS c FROM (SELECT neuron_id, h, unnest(x) AS v, unnest(t) AS u, generate_subscripts(x, 1) AS pos FROM p{k}) GROUP BY ALL)")
        parts.append(f"c{k} AS (SELECT neuron_id, list(w ORDER BY pos) AS w, list(c ORDER BY pos) AS c FROM m{k} GROUP BY neuron_id)")
        parts.append(f"h{k} AS (SELECT sample_id, min({{'d': 0.6 * list_distance(x, w) + 0.4 * list_distance(t, c), 'n': neuron_id}}).n AS neuron_id FROM vec JOIN t{k} ON src = sample_id, c{k} GROUP BY sample_id)")
    return ",\n".join(parts) + f"\nSELECT neuron_id, pos, round(w, 6) AS w, round(c, 6) AS c FROM m{len(widths)}"


GAS, MAP = (8.0, 4.0, 2.0, 1.0, 0.5, 0.25), (2.0, 1.0, 0.5)


@query("wmc_fit", _contexts(GAS, True))
def wmc_fit(spark, d):
    """A neural gas with contexts over five nearest neighbours, trained in six batch epochs."""
    return rows_of(spark, d, train.wmc_fit(samples(spark, d), fifth(spark, d), T.codebook(spark, d), list(GAS)), "w", "c")


@query("wmc_som_fit", _contexts(MAP, False))
def wmc_som_fit(spark, d):
    """A map with contexts over five nearest neighbours."""
    return rows_of(spark, d, train.wmc_fit(samples(spark, d), fifth(spark, d), T.codebook(spark, d), list(MAP), hops=train.hops("rect", 5, 5)), "w", "c")


MERGED = """WITH RECURSIVE e AS (SELECT event_id, user_id AS series, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
n AS (SELECT list(round(a * i / 5, 6) ORDER BY i) AS w FROM (SELECT avg(value) AS a FROM events), range(1, 10) r(i)), b AS (SELECT w, list_reverse(w) AS c FROM n),
s AS (SELECT event_id, series, k, list_transform(w, lambda x: abs(x - v)) AS d FROM e, b WHERE k = 1 UNION ALL
SELECT e.event_id, e.series, e.k, list_transform(range(1, 10), lambda i: 0.5 * abs(w[i] - e.v) + 0.5 * abs(c[i] - (0.5 * w[p] + 0.5 * c[p]))) FROM (SELECT series, k, list_position(d, list_min(d)) AS p FROM s) l JOIN e ON e.series = l.series AND e.k = l.k + 1, b)
SELECT event_id, series, list_position(d, list_min(d))::BIGINT - 1 AS neuron_id FROM s"""


def merged_neurons(events):
    """Nine weights in steps of a fifth of the mean, and the same in reverse as contexts."""
    mean = events.where("value is not null").agg(F.avg("value")).first()[0] or 0.0
    w = np.array([round(mean * i / 5, 6) for i in range(1, 10)])[:, None]
    return w, w[::-1].copy()


@query("msom_assign", MERGED)
def msom_assign(spark, d):
    events = T.read(spark, d, "events")
    e = events.select(F.col("user_id").alias("series"), "ts", "event_id", F.col("value").alias("v")).where("v is not null")
    return temporal.assign_series(e, *merged_neurons(events))


# ---------------------------------------------------------------- clustering of a codebook, one task each

def problem(spark, d, work, schema):
    """``work(ids, vectors, positions)`` on the 25-neuron codebook in one task."""
    book = T.codebook(spark, d).select("neuron_id", "w", "gx", "gy").withColumn("one", F.lit(1))

    def run(t):
        rows = sorted(zip(t["neuron_id"].to_pylist(), t["w"].to_pylist(), t["gx"].to_pylist(), t["gy"].to_pylist(), strict=True))
        got = work([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2:] for r in rows]))
        return pa.table({x.split()[0]: got[x.split()[0]] for x in schema.split(", ")})

    return book.groupBy("one").applyInArrow(run, schema)


def _merges(linkage: str, connected: bool) -> str:
    """SQL of agglomeration: a table of the distances between what is left, merged by recursion."""
    first = "list_distance(a.w, b.w)" if linkage != "ward" else "list_distance(a.w, b.w) ** 2 / 2"
    ok = "abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1" if connected else "true"
    new = {"single": "least(da, db)", "complete": "greatest(da, db)", "average": "(sa * da + sb * db) / (sa + sb)", "ward": "((sa + sr) * da + (sb + sr) * db - sr * c) / (sa + sb + sr)"}[linkage]
    return f"""WITH RECURSIVE {T.CB}, t AS (SELECT 0 AS it, a.neuron_id AS a, b.neuron_id AS b, {first} AS d, {ok} AS ok, 1 AS na, 1 AS nb, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::DOUBLE AS c FROM cb a JOIN cb b ON a.neuron_id < b.neuron_id
UNION ALL SELECT it + 1, a, b, d, ok, na, nb, l, r, c FROM (
WITH m AS (SELECT a AS l, b AS r, d AS c, na AS sa, nb AS sb, it FROM t WHERE ok ORDER BY d, a, b LIMIT 1),
o AS (SELECT a AS x, b AS y, d, ok, na AS nx, nb AS ny FROM t WHERE a IS NOT NULL),
s AS (SELECT x, y, d, ok, nx, ny FROM o UNION ALL SELECT y, x, d, ok, ny, nx FROM o),
n AS (SELECT f.y AS a, 25 + m.it AS b, f.d AS da, g.d AS db, f.ok OR g.ok AS ok, f.ny AS sr, m.* FROM m JOIN s f ON f.x = m.l JOIN s g ON g.x = m.r AND g.y = f.y)
SELECT m.it, o.x AS a, o.y AS b, o.d, o.ok, o.nx AS na, o.ny AS nb, m.l, m.r, m.c FROM m JOIN o ON o.x NOT IN (m.l, m.r) AND o.y NOT IN (m.l, m.r)
UNION ALL SELECT it, a, b, {new}, ok, sr, sa + sb, l, r, c FROM n
UNION ALL SELECT it, NULL, NULL, NULL, false, NULL, NULL, l, r, c FROM m WHERE NOT EXISTS (SELECT 1 FROM n)))
SELECT DISTINCT it - 1 AS age, l AS left_id, r AS right_id, round(c, 6) AS cost FROM t WHERE it > 0"""


def _hac(name, linkage, connected=False):
    def work(ids, x, pos):
        m = cluster.tree(x, linkage, cluster.grid_edges(pos) if connected else None)
        return {"age": pa.array(range(len(m)), pa.int32()), "left_id": pa.array([a for a, _, _ in m], pa.int64()), "right_id": pa.array([b for _, b, _ in m], pa.int64()), "cost": pa.array([round(c, 6) for _, _, c in m], pa.float64())}

    query(name, _merges(linkage, connected))(lambda spark, d: problem(spark, d, work, "age int, left_id long, right_id long, cost double"))


for _l in cluster.LINKAGES:
    _hac(f"hac_{_l}", _l)
_hac("hac_constrained", "ward", True)


def _cut(k: int) -> str:
    """SQL of the clusters that are left of the 25 neurons when k are: each follows its merges up."""
    return _merges("ward", False).replace("SELECT DISTINCT it - 1 AS age, l AS left_id, r AS right_id, round(c, 6) AS cost FROM t WHERE it > 0", f""", g AS (SELECT DISTINCT it - 1 AS age, l, r FROM t WHERE it BETWEEN 1 AND {25 - k}),
up AS (SELECT neuron_id, neuron_id AS node FROM cb UNION ALL SELECT up.neuron_id, 25 + g.age FROM up JOIN g ON node IN (g.l, g.r)),
top AS (SELECT neuron_id, max(node) AS node FROM up GROUP BY neuron_id)
SELECT neuron_id, dense_rank() OVER (ORDER BY first) - 1 AS cluster_id FROM (SELECT neuron_id, min(neuron_id) OVER (PARTITION BY node) AS first FROM top)""")


def _labels(name, label, sql=None):
    def work(ids, x, pos):
        return {"neuron_id": pa.array(ids, pa.int64()), "cluster_id": pa.array(label(x, pos).tolist(), pa.int64())}

    query(name, sql)(lambda spark, d: problem(spark, d, work, "neuron_id long, cluster_id long"))


_labels("cut_tree", lambda x, pos: cluster.cut_tree(len(x), cluster.tree(x, "ward"), 5), _cut(5))
_labels("skater", lambda x, pos: cluster.cut_edges(x, cluster.spanning(x, cluster.grid_edges(pos)), 5, 2))
_labels("redcap", lambda x, pos: cluster.cut_edges(x, cluster.merge_edges(x, cluster.grid_edges(pos), "ward"), 5))


@query("greedy_modularity", f"""WITH RECURSIVE {T.TRADE}, e AS (SELECT src, dst, w / (SELECT sum(w) FROM trade WHERE src <> dst) AS w FROM trade WHERE src <> dst), k AS (SELECT src, sum(w) AS k FROM e GROUP BY src),
t AS (SELECT 0 AS it, src AS a, dst AS b, w AS s, i.k AS ka, j.k AS kb, NULL::BIGINT AS l, NULL::BIGINT AS r FROM e JOIN k i USING (src) JOIN k j ON j.src = dst WHERE e.src < e.dst
UNION ALL SELECT it + 1, least(a, b), greatest(a, b), sum(s), max(CASE WHEN a < b THEN ka ELSE kb END), max(CASE WHEN a < b THEN kb ELSE ka END), any_value(l), any_value(r) FROM (
WITH m AS (SELECT a AS l, b AS r, ka + kb AS km, it FROM t WHERE a <> b AND 2 * s - 2 * ka * kb > 0 ORDER BY 2 * s - 2 * ka * kb DESC, a, b LIMIT 1)
SELECT m.it, CASE WHEN a = r THEN l ELSE a END AS a, CASE WHEN b = r THEN l ELSE b END AS b, s, CASE WHEN a IN (m.l, m.r) THEN km ELSE ka END AS ka, CASE WHEN b IN (m.l, m.r) THEN km ELSE kb END AS kb, m.l, m.r FROM m, (SELECT a, b, s, ka, kb FROM t) x WHERE NOT (a = m.l AND b = m.r)
UNION ALL SELECT it, -1, -1, 0, 0, 0, l, r FROM m) GROUP BY it, least(a, b), greatest(a, b)),
g AS (SELECT DISTINCT it, l, r FROM t WHERE it > 0), up AS (SELECT src AS id, src AS node FROM k UNION ALL SELECT id, l FROM up JOIN g ON r = node),
top AS (SELECT id, min(node) AS node FROM up GROUP BY id)
SELECT id, (dense_rank() OVER (ORDER BY node) - 1)::BIGINT AS module FROM top""")
def greedy_modularity(spark, d):
    t = T.trade(spark, d).withColumn("one", F.lit(1))

    def run(table):
        e = {(a, b): w for a, b, w in zip(table["src"].to_pylist(), table["dst"].to_pylist(), table["w"].to_pylist(), strict=True) if a != b}
        ids = sorted({v for k in e for v in k})
        at = {v: i for i, v in enumerate(ids)}
        label = cluster.greedy_modularity(len(ids), {(at[a], at[b]): w for (a, b), w in e.items()})
        return pa.table({"id": pa.array(ids, pa.int64()), "module": pa.array(label.tolist(), pa.int64())})

    return t.groupBy("one").applyInArrow(run, "id long, module long")


@query("morans_i_monte_carlo", f"""WITH {T.KNN}, pl AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM val), m AS (SELECT var_pop(v) AS var, avg(v) AS mean FROM val),
p AS (SELECT rep, v - mean AS z, row_number() OVER (PARTITION BY rep ORDER BY md5(id || ':' || rep || ':7'), id) AS k FROM val, range(99) r(rep), m), q AS (SELECT rep, id, z FROM p JOIN pl USING (k)),
e AS (SELECT a.rep, sum(0.2 * a.z * b.z) / sum(0.2) / any_value(var) AS p FROM knn JOIN q a ON a.id = src JOIN q b ON b.id = dst AND b.rep = a.rep, m GROUP BY a.rep),
o AS (SELECT sum(0.2 * a.z * b.z) / sum(0.2) / any_value(var) AS i FROM knn JOIN z a ON a.id = src JOIN z b ON b.id = dst, m),
s AS (SELECT any_value(i) AS i, avg(p) AS mean, var_samp(p) AS var, avg((p >= i)::INT) AS ge, avg((p <= i)::INT) AS le FROM e, o)
SELECT round(i, 6) AS i, round(mean, 6) AS mean, round(var, 6) AS var, round((i - mean) / sqrt(var), 6) AS z, round(CASE WHEN i > mean THEN ge WHEN i < mean THEN le ELSE 0 END, 6) AS p FROM s""")
def monte_carlo(spark, d):
    return rounded(weights.morans_i_monte_carlo(fifth(spark, d), T.values(spark, d), 99, 7), "i", "mean", "var", "z", "p")


# ---------------------------------------------------------------- lattices and series

@query("squareville", "SELECT range AS id, round(range // 21 / 10.0::DOUBLE, 6) AS x, round(range % 21 / 10.0::DOUBLE, 6) AS y, CASE WHEN range % 21 BETWEEN 6 AND 14 THEN 0.0 ELSE 10.0 END::DOUBLE AS value, CASE WHEN range % 21 < 6 THEN 0 WHEN range % 21 < 15 THEN 1 ELSE 2 END AS class FROM range(231)")
def squareville(spark, d):
    return rounded(synth.squareville(spark), "x", "y")


@query("two_planes", "SELECT range AS id, round((range // 20 - 20) / 20.0::DOUBLE, 6) AS x, round(range % 20 / 20.0::DOUBLE, 6) AS y, CASE WHEN range // 20 < 20 THEN -1.0 ELSE 1.0 END::DOUBLE AS z FROM range(800)")
def two_planes(spark, d):
    return rounded(synth.two_planes(spark), "x", "y")


@query("surface", "WITH p AS (SELECT range AS id, range // 21 * 6 / 20.0::DOUBLE - 3 AS x, range % 21 * 6 / 20.0::DOUBLE - 3 AS y FROM range(441)) SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(x * x * exp(-x * x - (y + 1) * (y + 1)) - (0.2 * x - x ** 3 - y ** 5) * exp(-x * x - y * y), 6) AS z FROM p")
def surface(spark, d):
    return rounded(synth.surface(spark), "x", "y", "z")


@query("mackey_glass", """WITH RECURSIVE r AS (SELECT 0 AS t, 1.2::DOUBLE AS x, []::DOUBLE[] AS h UNION ALL
SELECT t + 1, x + k1 / 6 + k2 / 3 + k3 / 3 + (late - 0.1 * (x + k3)) / 6, list_append(CASE WHEN len(h) < 15 THEN h ELSE h[2:] END, x)
FROM (SELECT *, late - 0.1 * (x + k2 / 2) AS k3 FROM (SELECT *, late - 0.1 * (x + k1 / 2) AS k2 FROM (SELECT *, late - 0.1 * x AS k1 FROM
(SELECT *, CASE WHEN t < 17 THEN 0 ELSE 0.2 * h[1] / (1 + h[1] ** 10) END AS late FROM r WHERE t < 5000))))) SELECT t::BIGINT AS t, round(x, 6) AS x FROM r""")
def mackey_glass(spark, d):
    """One series is one recurrence; it is made in one task."""
    def run(batches):
        for _ in batches:
            x = synth.mackey_glass(5_000)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x)], names=["t", "x"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "t long, x double").select("t", r6("x").alias("x"))
