"""Queries over regions, matrices, projections and exchange formats."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import assign, cluster, graph, palette, project, region, reshape, train, validate, weights
from ..sources import shape
from ..streaming import stateful
from . import tables as T
from .models import MERGED, merged_neurons, problem, samples
from .oracle import assigned, fifth, hop, r6, rounded, vector_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def grid_cells(spark):
    return T.cells(spark)


def rook(spark):
    return weights.lattice(grid_cells(spark), True)


# ---------------------------------------------------------------- matrices and rows

ENTRIES = "en AS (SELECT sample_id AS i, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM vec)"


@query("add_constant", f"WITH {T.VEC} SELECT sample_id, len(x)::BIGINT + 1 AS n, 1.5::DOUBLE AS last FROM vec")
def add_constant(spark, d):
    return reshape.add_constant(samples(spark, d), 1.5).select("sample_id", F.size("x").cast("long").alias("n"), F.element_at("x", -1).alias("last"))


@query("concatenate", f"WITH {T.VEC} SELECT sample_id, len(f)::BIGINT + len(g) AS n, round(g[1], 6) AS first, round(f[62], 6) AS last FROM vec")
def concatenate(spark, d):
    return reshape.concatenate(T.vec(spark, d), ["g", "f"]).select("sample_id", F.size("x").cast("long").alias("n"), r6(F.element_at("x", 1)).alias("first"), r6(F.element_at("x", -1)).alias("last"))


@query("design_matrix", f"WITH {T.VEC} SELECT sample_id, round(x[6], 6) AS y, 1.0::DOUBLE AS x0, round(x[1], 6) AS x1, round(x[3], 6) AS x2 FROM vec")
def design_matrix(spark, d):
    return reshape.design(samples(spark, d), 5, [0, 2]).select("sample_id", r6("y").alias("y"), *(r6(F.col("x")[i]).alias(f"x{i}") for i in range(3)))


@query("transpose", f"WITH {T.VEC}, {ENTRIES} SELECT j::BIGINT AS i, i AS j, round(v, 6) AS v FROM en")
def transpose(spark, d):
    return rounded(reshape.transpose(reshape.entries(samples(spark, d), "sample_id", "x")), "v")


@query("pick_rows", f'WITH {T.VEC} SELECT k."at", sample_id, round(x[1], 6) AS v FROM vec JOIN (VALUES (0::BIGINT, 7), (1, 3), (2, 7), (3, 0)) k("at", id) ON id = sample_id')
def pick_rows(spark, d):
    return reshape.pick_rows(samples(spark, d), "sample_id", [7, 3, 7, 0]).select("at", "sample_id", r6(F.col("x")[0]).alias("v"))


@query("random_rows", f"WITH {T.VEC} SELECT sample_id FROM vec ORDER BY md5(sample_id || ':11'), sample_id LIMIT 50")
def random_rows(spark, d):
    return reshape.random_rows(samples(spark, d), "sample_id", 50, 11).select("sample_id")


@query("cluster_index", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS cluster_id FROM customer")
def cluster_index(spark, d):
    return reshape.cluster_index(T.read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "cluster_id")


@query("clusters_to_samples", f"WITH {T.ASSIGN} SELECT sample_id, neuron_id % 3 AS cluster_id FROM r WHERE rank = 1 AND neuron_id < 20")
def clusters_to_samples(spark, d):
    c = T.codebook(spark, d).where("neuron_id < 20").select("neuron_id", (F.col("neuron_id") % 3).alias("cluster_id"))
    return reshape.to_samples(assigned(spark, d), c)


@query("grid_insert_row", f"WITH {T.CB}, n AS (SELECT gx + CASE WHEN gx >= 2 THEN 1 ELSE 0 END AS gx, gy, w[1] AS v FROM cb UNION ALL SELECT 2, a.gy, (a.w[1] + b.w[1]) / 2 FROM cb a JOIN cb b ON a.gy = b.gy AND a.gx = 1 AND b.gx = 2) SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, round(v, 6) AS v FROM n")
def grid_insert_row(spark, d):
    return reshape.insert_units(T.codebook(spark, d), "gx", 2).select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), r6(F.col("w")[0]).alias("v"))


@query("grid_extent", f"WITH {T.PAIRS} SELECT max(hops)::BIGINT AS diameter, (SELECT max(gx) - min(gx) + 1 FROM cb)::BIGINT AS nx, (SELECT max(gy) - min(gy) + 1 FROM cb)::BIGINT AS ny FROM np")
def grid_extent(spark, d):
    cb = T.codebook(spark, d)
    a, b = (cb.select(F.col("gx").alias(f"x{i}"), F.col("gy").alias(f"y{i}")) for i in (0, 1))
    far = a.join(assign.small(b)).agg(F.max(hop()).cast("long").alias("diameter"))
    return far.join(cb.agg(*((F.max(c) - F.min(c) + 1).cast("long").alias(n) for c, n in (("gx", "nx"), ("gy", "ny")))))


@query("grid_neighbors", f"WITH {T.PAIRS} SELECT n0 AS src, n1 AS dst FROM np WHERE hops = 1 UNION ALL SELECT n1, n0 FROM np WHERE hops = 1")
def grid_neighbors(spark, d):
    return weights.lattice(T.codebook(spark, d).select(F.col("neuron_id").alias("id"), F.col("gx").alias("i"), F.col("gy").alias("j")), True)


# ---------------------------------------------------------------- weights

NEAR = f"{T.KNN}, wt AS (SELECT src, dst, dist AS w FROM knn)"


def near(spark, d):
    from .oracle import neighbours

    return neighbours(spark, d).select("src", "dst", F.col("dist").alias("w"))


@query("weight_power", f"WITH {NEAR} SELECT src, dst, round((1 / w) ** 2, 4) AS w FROM wt WHERE w > 0.001")
def weight_power(spark, d):
    return weights.power(near(spark, d).where("w > 0.001"), 2.0).withColumn("w", F.round("w", 4))


@query("k_smallest_weights", f"WITH {NEAR} SELECT src, dst, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS r FROM wt) WHERE r <= 2")
def k_smallest(spark, d):
    return rounded(weights.k_per_row(near(spark, d), 2), "w")


@query("k_largest_weights", f"WITH {NEAR} SELECT src, dst, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM wt) WHERE r <= 2")
def k_largest(spark, d):
    return rounded(weights.k_per_row(near(spark, d), 2, True), "w")


@query("local_morans_monte_carlo", f"""WITH {T.KNN}, pl AS (SELECT id, z, row_number() OVER (ORDER BY id) - 1 AS k FROM z), m AS (SELECT avg(z * z) AS m2, count(*) AS n FROM z),
e AS (SELECT src, rep, sum(0.2 * pl.z) AS s FROM knn, range(49) r(rep), m, pl WHERE pl.k = ('0x' || substring(md5(src || ':' || dst || ':' || rep || ':5'), 1, 13))::BIGINT % n GROUP BY ALL),
p AS (SELECT src AS id, z / m2 * s AS p FROM e JOIN z ON id = src, m), o AS (SELECT src AS id, any_value(a.z) / any_value(m2) * sum(0.2 * b.z) AS i FROM knn JOIN z a ON a.id = src JOIN z b ON b.id = dst, m GROUP BY src)
SELECT id, round(i, 6) AS i, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd, round((i - avg(p)) / nullif(stddev_samp(p), 0), 6) AS z, round((least(count(*) FILTER (p >= i), count(*) FILTER (p <= i)) + 1) / 50.0::DOUBLE, 6) AS p FROM p JOIN o USING (id) GROUP BY id, i""")
def local_monte_carlo(spark, d):
    return rounded(weights.local_morans_i_monte_carlo(fifth(spark, d), T.values(spark, d), 49, 5), "i", "mean", "sd", "z", "p")


# ---------------------------------------------------------------- regions and graphs

@query("polygon_queen", f"WITH {T.CELLS} SELECT a.id AS src, b.id AS dst FROM cells a JOIN cells b ON greatest(abs(a.i - b.i), abs(a.j - b.j)) = 1")
def polygon_queen(spark, d):
    return region.contiguity(region.square_cells(grid_cells(spark)), False)


@query("polygon_rook", f"WITH {T.CELLS} SELECT a.id AS src, b.id AS dst FROM cells a JOIN cells b ON abs(a.i - b.i) + abs(a.j - b.j) = 1")
def polygon_rook(spark, d):
    return region.contiguity(region.square_cells(grid_cells(spark)), True)


@query("hex_cell_corners", f"WITH {T.CELLS} SELECT id, k, round(i * 1.5::DOUBLE + CASE k WHEN 2 THEN 1.0 WHEN 5 THEN -1.0 WHEN 1 THEN 0.5 WHEN 3 THEN 0.5 ELSE -0.5 END::DOUBLE, 6) AS x, round((j * 2 + i % 2) * sqrt(3) / 2 + CASE WHEN k IN (2, 5) THEN 0.0 WHEN k IN (3, 4) THEN sqrt(3) / 2 ELSE -sqrt(3) / 2 END, 6) AS y FROM cells, (SELECT range AS k FROM range(7))")
def hex_corners(spark, d):
    at = region.hex_cells(grid_cells(spark)).select("id", F.posexplode("ring").alias("k", "p"))
    return at.select("id", F.col("k").cast("long").alias("k"), (r6("p.x") + 0.0).alias("x"), (r6("p.y") + 0.0).alias("y"))


@query("polygon_centroids", f"WITH {T.CELLS} SELECT id, i + 0.5::DOUBLE AS cx, j + 0.5::DOUBLE AS cy FROM cells")
def polygon_centroids(spark, d):
    return rounded(region.centroids(region.square_cells(grid_cells(spark))), "cx", "cy")


@query("points_in_polygons", "SELECT p_partkey AS point_id, (floor((p_size % 12) + 0.25) * 9 + floor(p_retailprice % 9 + 0.000001))::BIGINT AS id FROM part")
def points_in_polygons(spark, d):
    p = T.parts(spark, d).select(F.col("id").alias("point_id"), (F.col("px") % 12 + 0.25).alias("px"), (F.col("py") % 9 + 0.000001).alias("py"))
    return region.points_in(p, region.square_cells(grid_cells(spark)))


def bands(spark):
    return grid_cells(spark).select("id", (F.floor(F.col("j") / 3) % 2).alias("cluster"))


#: Connected parts of the bands, by reachability inside of each.
PARTS = f"""WITH RECURSIVE {T.CELLS}, b AS (SELECT id, i, j, (j // 3) % 2 AS cluster FROM cells), l AS (SELECT x.id AS src, y.id AS dst FROM b x JOIN b y ON abs(x.i - y.i) + abs(x.j - y.j) = 1 AND x.cluster = y.cluster),
reach AS (SELECT id, id AS node FROM b UNION SELECT reach.id, dst FROM reach JOIN l ON src = node), parts AS (SELECT id, cluster, min(node) AS part FROM reach JOIN b USING (id) GROUP BY ALL)"""


@query("contiguous_parts", PARTS + " SELECT id, cluster, part FROM parts")
def contiguous_parts(spark, d):
    return region.contiguous_parts(rook(spark), bands(spark))


@query("is_contiguous", PARTS + " SELECT cluster, min(part) = max(part) AS contiguous FROM parts GROUP BY cluster")
def is_contiguous(spark, d):
    return region.is_contiguous(contiguous_parts(spark, d))


@query("compact_clusters", PARTS + " SELECT count(*) FILTER (contiguous) AS n FROM (SELECT cluster, min(part) = max(part) AS contiguous FROM parts GROUP BY cluster)")
def compact_clusters(spark, d):
    return is_contiguous(spark, d).agg(F.count_if("contiguous").alias("n"))


@query("within_depth", f"WITH {T.CELLS} SELECT a.id, abs(a.i - 5) + abs(a.j - 4) AS depth FROM cells a WHERE abs(a.i - 5) + abs(a.j - 4) BETWEEN 1 AND 3")
def within_depth(spark, d):
    return region.within_depth(rook(spark), 49, 3)


@query("all_hops", f"WITH {T.CELLS} SELECT a.id AS src, b.id AS dst, abs(a.i - b.i) + abs(a.j - b.j) AS hops FROM cells a, cells b")
def all_hops(spark, d):
    return region.all_hops(rook(spark))


@query("shortest_path", "SELECT range AS step, CASE WHEN range <= 8 THEN range ELSE 8 + 9 * (range - 8) END AS id, round((3.0 * least(range, 8) + 2.0 * greatest(range - 8, 0))::DOUBLE, 6) AS dist FROM range(20)")
def shortest_path(spark, d):
    e = rook(spark).withColumn("w", F.when(F.abs(F.col("src") - F.col("dst")) == 9, 2.0).otherwise(3.0))
    return rounded(region.shortest_path(e, 0, 107), "dist")


@query("circle_layout", "SELECT n_nationkey::BIGINT AS id, round(cos(2 * pi() * n_nationkey / 25), 6) + 0.0 AS x, round(sin(2 * pi() * n_nationkey / 25), 6) + 0.0 AS y FROM nation")
def circle_layout(spark, d):
    return region.circle_layout(T.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))).select("id", (r6("x") + 0.0).alias("x"), (r6("y") + 0.0).alias("y"))


@query("geo_layout", "WITH s AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS e, least(400.0::DOUBLE / (max(p_size) - min(p_size)), 300.0::DOUBLE / (max(p_retailprice) - min(p_retailprice))) AS k FROM part) SELECT p_partkey AS id, round((p_size - a) * k, 6) AS x, round((e - p_retailprice) * k, 6) AS y FROM part, s")
def geo_layout(spark, d):
    return rounded(region.geo_layout(T.parts(spark, d), 400.0, 300.0), "x", "y")


TWO = f"{T.ASSIGN}, two AS (SELECT sample_id, min(neuron_id) FILTER (rank = 1) AS first, min(neuron_id) FILTER (rank = 2) AS second FROM r WHERE rank <= 2 GROUP BY sample_id), hb AS (SELECT least(first, second) AS a, greatest(first, second) AS b, count(*) AS cnt FROM two GROUP BY ALL), he AS (SELECT hb.*, list_distance(p.w, q.w) AS f_dist, list_distance(p.g, q.g) AS g_dist FROM hb JOIN cb p ON p.neuron_id = a JOIN cb q ON q.neuron_id = b)"


def hebbian(spark, d):
    r = assign.ranked(samples(spark, d), T.codebook(spark, d).select("neuron_id", "w"), assign.euclid(), most=2)
    two = r.groupBy("sample_id").agg(*(F.min(F.when(F.col("rank") == k, F.col("neuron_id"))).alias(n) for k, n in ((1, "first"), (2, "second"))))
    at = T.codebook(spark, d)
    a, b = (at.select(F.col("neuron_id").alias(k), F.col("w").alias("w" + k), F.col("g").alias("g" + k)) for k in ("a", "b"))
    e = graph.hebbian(two).join(assign.small(a), "a").join(assign.small(b), "b")
    return e.select("a", "b", "cnt", V.euclid("wa", "wb").alias("f_dist"), V.euclid("ga", "gb").alias("g_dist"))


for _style, _sql in (("count", "cnt / max(cnt) OVER ()::DOUBLE"), ("distance", "1 - f_dist / max(f_dist) OVER ()"), ("geo", "1 - g_dist / max(g_dist) OVER ()")):
    query(f"edge_weights_{_style}", f"WITH {TWO} SELECT a, b, round({_sql}, 6) AS w FROM he")(lambda spark, d, s=_style: rounded(region.edge_weights(hebbian(spark, d), s), "w"))


@query("class_spread", f"WITH {T.ASSIGN}, p AS (SELECT label, gx, gy FROM r JOIN cb USING (neuron_id) WHERE rank = 1), m AS (SELECT label, floor(avg(gx) + 0.5) AS mx, floor(avg(gy) + 0.5) AS my FROM p GROUP BY label) SELECT label, round(avg((abs(gx - mx) + abs(gy - my)) ** 2), 6) AS spread FROM p JOIN m USING (label) GROUP BY label")
def class_spread(spark, d):
    best = assigned(spark, d).select("sample_id", "neuron_id").join(T.vec(spark, d).select("sample_id", "label"), "sample_id")
    return rounded(region.class_spread(best.select("sample_id", "neuron_id", "label"), T.codebook(spark, d)), "spread")


# ---------------------------------------------------------------- statistics

@query("cluster_means", f"WITH {T.MEANS} SELECT label AS cluster, pos::BIGINT AS pos, round(v, 6) AS v FROM mv")
def cluster_means(spark, d):
    return vector_rows(validate.means(T.clusters(spark, d), "cluster"), "cluster", "m").withColumn("cluster", F.col("cluster").cast("int"))


@query("sum_of_squares", f"WITH {T.MEANS} SELECT round(sum(list_distance(x, t) ** 2), 6) AS ss FROM vec, tot")
def sum_of_squares(spark, d):
    return rounded(validate.wcss(samples(spark, d).withColumn("cluster", F.lit(0))).withColumnRenamed("wcss", "ss"), "ss")


@query("qe_by_neuron", f"WITH {T.ASSIGN} SELECT neuron_id, round(avg(dist), 6) AS qe FROM r WHERE rank = 1 GROUP BY neuron_id")
def qe_by_neuron(spark, d):
    return assigned(spark, d).groupBy("neuron_id").agg(r6(F.avg("dist")).alias("qe"))


@query("box_plot", "SELECT p_brand, round(min(p_retailprice), 6) AS lo, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(quantile_cont(p_retailprice, 0.5), 6) AS q2, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, round(max(p_retailprice), 6) AS hi, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY p_brand")
def box_plot(spark, d):
    """Quartiles by percentile, which counts distinct values before it interpolates."""
    q = F.expr("percentile(p_retailprice, array(0.25, 0.5, 0.75))")
    s = T.read(spark, d, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), q.alias("q"), F.max("p_retailprice").alias("hi"), F.avg("p_retailprice").alias("mean"))
    return s.select("p_brand", r6("lo").alias("lo"), *(r6(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3)), r6("hi").alias("hi"), r6("mean").alias("mean"))


@query("color_distinct", "SELECT p_partkey AS id, (dense_rank() OVER (ORDER BY p_size) - 1)::BIGINT AS class_idx FROM part")
def color_distinct(spark, d):
    return palette.distinct_classes(T.parts(spark, d).select("id", F.col("px").alias("v")))


@query("color_kmeans")
def color_kmeans(spark, d):
    return palette.kmeans_classes(T.parts(spark, d).select("id", F.col("py").alias("v")), 5)


@query("color_palette", f"WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey AS id, {palette.palette('blues', 7)}[least(floor((p_retailprice - lo) / ((hi - lo) / 7)), 6)::INT + 1] AS rgb FROM part, s")
def color_palette(spark, d):
    """Equal classes of prices in the colours of a sequential ramp."""
    from ..operators import color

    c = color.equal_classes(T.parts(spark, d).select("id", F.col("py").alias("v")), 7)
    return c.select("id", palette.colour(F.col("class_idx"), palette.palette("blues", 7)).alias("rgb"))


# ---------------------------------------------------------------- projections and clusterings

@query("pca")
def pca(spark, d):
    return project.pca(samples(spark, d), 2).select("sample_id", r6(F.col("p")[0]).alias("p1"), r6(F.col("p")[1]).alias("p2"))


@query("sammon")
def sammon(spark, d):
    def work(ids, x, pos):
        y = project.sammon(x)
        return {"neuron_id": pa.array(ids, pa.int64()), "px": pa.array(y[:, 0]), "py": pa.array(y[:, 1])}

    return problem(spark, d, work, "neuron_id long, px double, py double")


@query("k_medoids")
def k_medoids(spark, d):
    def work(ids, x, pos):
        m, label = project.k_medoids(x, 4, 3)
        return {"neuron_id": pa.array(ids, pa.int64()), "medoid": pa.array([ids[m[c]] for c in label], pa.int64())}

    return problem(spark, d, work, "neuron_id long, medoid long")


@query("edge_betweenness_clusters")
def edge_betweenness(spark, d):
    def work(ids, x, pos):
        label = project.cut_by_betweenness(len(x), {(min(e), max(e)) for e in cluster.grid_edges(pos)}, 8)
        return {"neuron_id": pa.array(ids, pa.int64()), "cluster_id": pa.array(label.tolist(), pa.int64())}

    return problem(spark, d, work, "neuron_id long, cluster_id long")


@query("multilevel_modularity")
def multilevel(spark, d):
    t = T.trade(spark, d).withColumn("one", F.lit(1))

    def run(table):
        e = {(a, b): w for a, b, w in zip(table["src"].to_pylist(), table["dst"].to_pylist(), table["w"].to_pylist(), strict=True) if a != b}
        ids = sorted({v for k in e for v in k})
        at = {v: i for i, v in enumerate(ids)}
        label = project.multilevel_modularity(len(ids), {(at[a], at[b]): w for (a, b), w in e.items()})
        return pa.table({"id": pa.array(ids, pa.int64()), "module": pa.array(label.tolist(), pa.int64())})

    return t.groupBy("one").applyInArrow(run, "id long, module long")


def _grown(x, seed, order):
    position, w = train.run_growing_som(x, seed, len(order), order=order)
    return train.model(w, position)


query("growing_som_fit")(lambda spark, d: train.fit(samples(spark, d), _grown, [1, 2], 20_000).select("run", "neuron_id", "w", "position"))


def _over_series(name, kernel):
    """Trains a network on the events of each user, in their order, which is what these networks learn."""

    def run(spark, d):
        def work(key, table):
            t = table.sort_by([("ts", "ascending"), ("event_id", "ascending")])
            w = kernel(t["value"].to_numpy()[:, None])
            return pa.table({"series": pa.array([key[0].as_py()] * len(w), pa.int64()), "neuron_id": pa.array(range(len(w)), pa.int64()), "w": pa.array(w.tolist(), pa.list_(pa.float64()))})

        events = T.read(spark, d, "events").select(F.col("user_id").cast("long").alias("series"), "ts", "event_id", "value").where("value is not null")
        return events.groupBy("series").applyInArrow(work, "series long, neuron_id long, w array<double>")

    query(name)(run)


_over_series("tkm_fit", lambda s: train.run_temporal(s, 1, 3, ("rect", 5, 5), "tkm"))
_over_series("rsom_fit", lambda s: train.run_temporal(s, 1, 3, ("rect", 5, 5), "rsom"))
_over_series("mng_fit", lambda s: np.concatenate(train.run_merge(s, 1, 3, 25), axis=1))
_over_series("msom_fit", lambda s: np.concatenate(train.run_merge(s, 1, 3, 25, grid=("rect", 5, 5)), axis=1))


# ---------------------------------------------------------------- generators



# ---------------------------------------------------------------- formats and streams

def shared(spark, name: str) -> str:
    graph.shared(spark)
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{held.rstrip('/')}/lattica/{name}-{uuid.uuid4().hex}"


@query("shapefile_roundtrip", f"WITH {T.CELLS} SELECT id, 5::BIGINT AS corners, i::DOUBLE AS i, j::DOUBLE AS j FROM cells")
def shapefile_roundtrip(spark, d):
    at = shared(spark, "shape")
    cells = region.square_cells(grid_cells(spark)).join(grid_cells(spark), "id")
    shape.write_shapefile(cells.select("id", F.lit("polygon").alias("kind"), F.array("ring").alias("rings"), F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j")), f"{at}/cells", ["i", "j"])
    got = shape.read_shapefiles(spark, at)
    return got.select("id", F.size(F.col("rings")[0]).cast("long").alias("corners"), F.col("attrs")["i"].alias("i"), F.col("attrs")["j"].alias("j"))


@query("somlib_roundtrip", f"WITH {T.CB} SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, round(w[1], 6) AS v FROM cb")
def somlib_roundtrip(spark, d):
    at = shared(spark, "somlib")
    shape.somlib_lines(T.codebook(spark, d)).select("value").write.text(at)
    return shape.read_somlib_weights(spark, at).select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), r6(F.col("w")[0]).alias("v"))


@query("gml_lines", f"WITH {TWO} SELECT unnest(['graph [', 'directed 0', ']']) AS value UNION ALL SELECT 'node [ id ' || neuron_id || ' ]' FROM cb UNION ALL SELECT 'edge [ source ' || a || ' target ' || b || ' ]' FROM hb")
def gml_lines(spark, d):
    e = hebbian(spark, d)
    return shape.gml_lines(T.codebook(spark, d).select(F.col("neuron_id").alias("id")), e).select("value")


@query("msom_stream", MERGED)
def msom_stream(spark, d):
    """Events read as a stream, all that is there, into a table in the shared folder."""
    at = shared(spark, "stream")
    events = T.read(spark, d, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet").where("value is not null")
    rows = source.select(F.col("user_id").alias("series"), "ts", "event_id", F.col("value").alias("v"))
    out = stateful.merge_stream(rows, *merged_neurons(events))
    run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
