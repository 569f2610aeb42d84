"""Queries whose results SQL can express: each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import assign, blocks, color, frame, graph, quality, train, validate, weights
from . import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


def vector_rows(df, key: str, vector: str = "w"):
    return df.select(F.col(key).cast("long").alias(key), F.posexplode(vector).alias("pos", "v")).select(key, (F.col("pos") + 1).cast("long").alias("pos"), r6("v").alias("v"))


def hop() -> F.Column:
    return V.rect_dist("x0", "y0", "x1", "y1")

# ---------------------------------------------------------------- tables and scaling

PRICES = ["p_size", "p_retailprice"]


def part(spark, d):
    return T.read(spark, d, "part").select("p_partkey", *PRICES)


def scaled(chain):
    def run(spark, d):
        p = part(spark, d)
        return rounded(frame.Scaler(PRICES, chain).fit(p).transform(p), *PRICES)

    return run


query("zscore_columns", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice FROM part")(scaled(["zscore"]))
query("scale01_columns", "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS p_size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")(scaled(["scale01"]))
query("log_sqrt_transforms", "SELECT p_partkey, round(sqrt(ln(1 + p_size)), 6) AS p_size, round(sqrt(ln(1 + p_retailprice)), 6) AS p_retailprice FROM part")(scaled(["log1", "sqrt"]))


@query("inverse_transform", "SELECT p_partkey, round(p_size::DOUBLE, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def inverse_transform(spark, d):
    p = part(spark, d)
    s = frame.Scaler(PRICES, ["log1", "zscore"]).fit(p)
    return rounded(s.inverse(s.transform(p)), *PRICES)


@query("geo_scale01", "WITH s AS (SELECT min(p_size) AS a, min(p_retailprice) AS b, greatest((max(p_size) - min(p_size))::DOUBLE, max(p_retailprice) - min(p_retailprice)) AS r FROM part) SELECT p_partkey, round((p_size - a) / r, 6) AS p_size, round((p_retailprice - b) / r, 6) AS p_retailprice FROM part, s")
def geo_scale01(spark, d):
    return rounded(frame.geo_scale01(part(spark, d), PRICES), *PRICES)


@query("geo_zscore", "WITH s AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b, sqrt(var_samp(p_size) + var_samp(p_retailprice)) AS r FROM part) SELECT p_partkey, round((p_size - a) / r, 6) AS p_size, round((p_retailprice - b) / r, 6) AS p_retailprice FROM part, s")
def geo_zscore(spark, d):
    return rounded(frame.geo_zscore(part(spark, d), PRICES), *PRICES)


@query("complete_cases", "SELECT event_id, user_id, value FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
def complete_cases(spark, d):
    return frame.complete_cases(T.read(spark, d, "events").select("event_id", "user_id", "value"))


@query("column_summary", "SELECT 'l_quantity' AS name, round(min(l_quantity), 6) AS lo, round(avg(l_quantity), 6) AS mean, round(max(l_quantity), 6) AS hi, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem UNION ALL SELECT 'l_extendedprice', round(min(l_extendedprice), 6), round(avg(l_extendedprice), 6), round(max(l_extendedprice), 6), round(stddev_samp(l_extendedprice), 6) FROM lineitem")
def column_summary(spark, d):
    return rounded(frame.summary(T.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), "lo", "mean", "hi", "sd")


@query("subset_columns", f"WITH {T.VEC} SELECT sample_id, round(x[2], 6) AS a, round(x[1], 6) AS b FROM vec")
def subset_columns(spark, d):
    return T.vec(spark, d).select("sample_id", r6(F.element_at("x", 2)).alias("a"), r6(F.element_at("x", 1)).alias("b"))


# ---------------------------------------------------------------- distances and best neurons

@query("pairwise_distance", f"WITH {T.CB} SELECT a.neuron_id AS a, b.neuron_id AS b, round(list_distance(a.w, b.w), 6) AS dist FROM cb a, cb b WHERE a.neuron_id <> b.neuron_id")
def pairwise_distance(spark, d):
    c = T.codebook(spark, d)
    other = c.select(F.col("neuron_id").alias("b"), F.col("w").alias("wb"))
    return c.join(assign.small(other), F.col("neuron_id") != F.col("b")).select(F.col("neuron_id").alias("a"), "b", r6(V.euclid("w", "wb")).alias("dist"))


BEST = "SELECT sample_id, neuron_id, round(dist, 6) AS dist FROM (SELECT sample_id, neuron_id, {e} AS dist, row_number() OVER (PARTITION BY sample_id ORDER BY {e}, neuron_id) AS k FROM vec, cb) WHERE k = 1"


@query("bmu_assign", f"WITH {T.CB} " + BEST.format(e="list_distance(vec.x, cb.w)"))
def bmu_assign(spark, d):
    out = assign.bmu_euclid(T.vec(spark, d).select("sample_id", "x"), T.codebook(spark, d).select("neuron_id", "w"))
    return rounded(out.select("sample_id", "neuron_id", "dist"), "dist")


def _named(spark, d):
    return T.codebook(spark, d).select("neuron_id", F.col("f").alias("wf"), F.col("g").alias("wg"))


@query("bmu_weighted", f"WITH {T.CB} " + BEST.format(e="(0.7 * list_distance(vec.f, cb.f) + 0.3 * list_distance(vec.g, cb.g))"))
def bmu_weighted(spark, d):
    dist = assign.mixed(("f", "wf", 0.7), ("g", "wg", 0.3))
    return rounded(assign.nearest(T.vec(spark, d).select("sample_id", "f", "g"), _named(spark, d), dist).select("sample_id", "neuron_id", "dist"), "dist")


@query("bmu_augmented", f"WITH {T.CB} " + BEST.format(e="list_distance(list_concat(vec.f, [2 * vec.g[1], 2 * vec.g[2]]), list_concat(cb.f, [2 * cb.g[1], 2 * cb.g[2]]))"))
def bmu_augmented(spark, d):
    dist = V.euclid(V.augmented("f", "g", 2.0), V.augmented("wf", "wg", 2.0))
    return rounded(assign.bmu(T.vec(spark, d).select("sample_id", "f", "g"), _named(spark, d), dist), "dist")


@query("bmu_geosom", f"WITH {T.CB}, near AS (SELECT sample_id, vec.f AS f, gx, gy FROM (SELECT sample_id, neuron_id, row_number() OVER (PARTITION BY sample_id ORDER BY list_distance(vec.g, cb.g), neuron_id) AS k FROM vec, cb) q JOIN vec USING (sample_id) JOIN cb USING (neuron_id) WHERE k = 1) SELECT sample_id, neuron_id, round(dist, 6) AS dist FROM (SELECT sample_id, neuron_id, list_distance(near.f, cb.f) AS dist, row_number() OVER (PARTITION BY sample_id ORDER BY list_distance(near.f, cb.f), neuron_id) AS k FROM near JOIN cb ON abs(near.gx - cb.gx) + abs(near.gy - cb.gy) <= 1) WHERE k = 1")
def bmu_geosom(spark, d):
    return rounded(assign.geosom(T.vec(spark, d), T.codebook(spark, d), 1), "dist")


@query("bmu_cng", f"WITH {T.CB}, a AS (SELECT sample_id, neuron_id, list_distance(vec.f, cb.f) AS df, list_distance(vec.g, cb.g) AS dg, row_number() OVER (PARTITION BY sample_id ORDER BY list_distance(vec.g, cb.g), neuron_id) AS rg FROM vec, cb) SELECT sample_id, neuron_id, row_number() OVER (PARTITION BY sample_id ORDER BY rg > 5, CASE WHEN rg <= 5 THEN df ELSE dg END, neuron_id) AS rank FROM a")
def bmu_cng(spark, d):
    return assign.cng(T.vec(spark, d), T.codebook(spark, d), 5).select("sample_id", "neuron_id", F.col("rank").cast("long").alias("rank"))


def ranks(spark, d):
    return assign.ranked(T.vec(spark, d).select("sample_id", "x"), T.codebook(spark, d).select("neuron_id", "w"), assign.euclid())


@query("rank_neurons", f"WITH {T.ASSIGN} SELECT sample_id, neuron_id, rank FROM r")
def rank_neurons(spark, d):
    return ranks(spark, d).select("sample_id", "neuron_id", F.col("rank").cast("long").alias("rank"))


TWO = T.ASSIGN + ", two AS (SELECT sample_id, max(neuron_id) FILTER (rank = 1) AS first, max(neuron_id) FILTER (rank = 2) AS second FROM r WHERE rank <= 2 GROUP BY sample_id)"


@query("bmu_second", f"WITH {TWO} SELECT sample_id, first, second FROM two")
def bmu_second(spark, d):
    return quality.two_best(ranks(spark, d))


# ---------------------------------------------------------------- map quality

def assigned(spark, d):
    return assign.bmu_euclid(T.vec(spark, d).select("sample_id", "x", "label"), T.codebook(spark, d).select("neuron_id", "w"))


@query("mean_qe", f"WITH {T.ASSIGN} SELECT round(avg(dist), 6) AS mean_qe FROM r WHERE rank = 1")
def mean_qe(spark, d):
    return rounded(quality.mean_error(assigned(spark, d)), "mean_qe")


@query("sum_sq_qe", f"WITH {T.ASSIGN} SELECT round(sum(dist * dist), 6) AS sum_sq FROM r WHERE rank = 1")
def sum_sq_qe(spark, d):
    return rounded(quality.squared_error(assigned(spark, d)), "sum_sq")


@query("topo_error", f"WITH {TWO} SELECT round(avg(CASE WHEN abs(a.gx - b.gx) + abs(a.gy - b.gy) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS topo_error FROM two JOIN cb a ON a.neuron_id = first JOIN cb b ON b.neuron_id = second")
def topo_error(spark, d):
    return rounded(quality.topographic_error(quality.two_best(ranks(spark, d)), T.codebook(spark, d), hop()), "topo_error")


@query("topo_corr_pearson", f"WITH {T.PAIRS} SELECT round(corr(hops, dist), 6) AS corr FROM np")
def topo_corr_pearson(spark, d):
    return rounded(quality.topographic_correlation(quality.neuron_pairs(T.codebook(spark, d), hop())), "corr")


@query("topo_corr_spearman", f"WITH {T.PAIRS}, k AS (SELECT rank() OVER (ORDER BY hops) + (count(*) OVER (PARTITION BY hops) - 1) / 2.0 AS a, rank() OVER (ORDER BY dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2.0 AS b FROM np) SELECT round(corr(a::DOUBLE, b::DOUBLE), 6) AS corr FROM k")
def topo_corr_spearman(spark, d):
    return rounded(quality.topographic_correlation(quality.neuron_pairs(T.codebook(spark, d), hop()), "spearman"), "corr")


@query("hit_entropy", f"WITH {T.ASSIGN}, h AS (SELECT neuron_id, count(*) / (SELECT count(*) FROM vec)::DOUBLE AS p FROM r WHERE rank = 1 GROUP BY neuron_id) SELECT round(-sum(p * log2(p)), 6) AS entropy FROM h")
def hit_entropy(spark, d):
    return rounded(quality.hit_entropy(assigned(spark, d)), "entropy")


@query("class_dist", f"WITH {T.ASSIGN}, h AS (SELECT neuron_id, label, count(*) AS hits FROM r WHERE rank = 1 GROUP BY ALL) SELECT cb.neuron_id, label, coalesce(hits, 0)::BIGINT AS hits FROM cb LEFT JOIN h USING (neuron_id)")
def class_dist(spark, d):
    return quality.class_counts(assigned(spark, d), T.codebook(spark, d), "label").withColumn("hits", F.col("hits").cast("long"))


@query("d_matrix", f"WITH {T.PAIRS} SELECT neuron_id, round(avg(dist), 6) AS d FROM adj GROUP BY neuron_id")
def d_matrix(spark, d):
    return rounded(quality.d_matrix(quality.neuron_pairs(T.codebook(spark, d), hop())), "d")


@query("u_matrix", f"WITH {T.PAIRS} SELECT (2 * gx)::BIGINT AS ux, (2 * gy)::BIGINT AS uy, round(avg(dist), 6) AS value FROM adj JOIN cb USING (neuron_id) GROUP BY ALL UNION ALL SELECT (x0 + x1)::BIGINT, (y0 + y1)::BIGINT, round(avg(dist), 6) FROM np WHERE abs(x0 - x1) <= 1 AND abs(y0 - y1) <= 1 GROUP BY ALL")
def u_matrix(spark, d):
    u = quality.u_matrix(T.codebook(spark, d), hop())
    return u.select(F.col("ux").cast("long").alias("ux"), F.col("uy").cast("long").alias("uy"), r6("value").alias("value"))


@query("component_plane", f"WITH {T.CB} SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, round(w[4], 6) AS value FROM cb")
def component_plane(spark, d):
    return T.codebook(spark, d).select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), r6(F.element_at("w", 4)).alias("value"))


@query("neighbor_stats", f"WITH {T.PAIRS} SELECT neuron_id, round(avg(dist), 6) AS mean, round(median(dist), 6) AS median, round(coalesce(var_samp(dist), 0), 6) AS variance, round(min(dist), 6) AS least, round(max(dist), 6) AS most FROM adj GROUP BY neuron_id")
def neighbor_stats(spark, d):
    return rounded(quality.neighbour_stats(quality.neuron_pairs(T.codebook(spark, d), hop())), "mean", "median", "variance", "least", "most")


# ---------------------------------------------------------------- weights and autocorrelation

RADIUS = "rp AS (SELECT a.p_partkey AS src, b.p_partkey AS dst, sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2) AS dist FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND b.p_size BETWEEN a.p_size - 3 AND a.p_size + 3 WHERE sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2) <= 3.0)"


@query("radius_join", f"WITH {RADIUS} SELECT src, dst, round(dist, 6) AS dist FROM rp")
def radius_join(spark, d):
    return weights.members(rounded(weights.radius_groups(T.parts(spark, d), 3.0), "dist"))


@query("inverse_distance", f"WITH {RADIUS} SELECT src, dst, round(1 / pow(CASE WHEN dist = 0 THEN (SELECT min(dist) FROM rp WHERE dist > 0) ELSE dist END, 2.0), 6) AS w FROM rp")
def inverse_distance(spark, d):
    return weights.members(rounded(weights.inverse_distance(weights.radius_groups(T.parts(spark, d), 3.0), 2.0), "w"))


def neighbours(spark, d):
    return blocks.knn(T.vec(spark, d).select("sample_id", "g"), "g", 5)


def fifth(spark, d):
    return neighbours(spark, d).select("src", "dst", F.lit(0.2).alias("w"))


@query("knn", f"WITH {T.KNN} SELECT src, dst, round(dist, 6) AS dist, rank FROM knn")
def knn(spark, d):
    return rounded(neighbours(spark, d), "dist").withColumn("rank", F.col("rank").cast("long"))


@query("row_normalize", f"WITH {RADIUS} SELECT src, dst, round(dist / sum(dist) OVER (PARTITION BY src), 6) AS w FROM rp WHERE dist > 0")
def row_normalize(spark, d):
    return weights.members(rounded(weights.row_normalize_radius(T.parts(spark, d), 3.0), "w"))


@query("lattice_rook", f"WITH {T.CELLS} SELECT a.id AS src, b.id AS dst FROM cells a JOIN cells b ON abs(a.i - b.i) + abs(a.j - b.j) = 1")
def lattice_rook(spark, d):
    return weights.lattice(T.cells(spark), True)


@query("lattice_queen", f"WITH {T.CELLS} SELECT a.id AS src, b.id AS dst FROM cells a JOIN cells b ON greatest(abs(a.i - b.i), abs(a.j - b.j)) = 1")
def lattice_queen(spark, d):
    return weights.lattice(T.cells(spark), False)


@query("lag1", f"WITH {T.KNN} SELECT src AS id, round(sum(0.2 * v), 6) AS v FROM knn JOIN val ON dst = id GROUP BY src")
def lag1(spark, d):
    return rounded(weights.lag(fifth(spark, d), T.values(spark, d)), "v")


@query("lag2", f"WITH {T.KNN}, l1 AS (SELECT src AS id, sum(0.2 * v) AS v FROM knn JOIN val ON dst = id GROUP BY src) SELECT src AS id, round(sum(0.2 * v), 6) AS v FROM knn JOIN l1 ON dst = id GROUP BY src")
def lag2(spark, d):
    return rounded(weights.lag(fifth(spark, d), T.values(spark, d), 2), "v")


CROSS = T.KNN + ", cr AS (SELECT src, dst, 0.2::DOUBLE AS w, a.z AS zi, b.z AS zj FROM knn JOIN z a ON a.id = src JOIN z b ON b.id = dst)"


@query("morans_i", f"WITH {CROSS} SELECT round((SELECT count(*) / sum(z * z) FROM z) * sum(w * zi * zj) / sum(w), 6) AS i FROM cr")
def morans_i(spark, d):
    return rounded(weights.morans_i(fifth(spark, d), T.values(spark, d)), "i")


@query("morans_i_stats", f"""WITH {CROSS}, b AS (SELECT src, dst, w FROM cr UNION ALL SELECT dst, src, w FROM cr), p AS (SELECT sum(w) AS w FROM b GROUP BY src, dst),
q AS (SELECT (SELECT count(*)::DOUBLE FROM z) AS n, (SELECT (sum(z ** 4) / count(*)) / ((sum(z * z) / count(*)) ** 2) FROM z) AS s3, (SELECT sum(w * w) / 2 FROM p) AS s1, (SELECT sum(w * w) FROM (SELECT sum(w) AS w FROM b GROUP BY src)) AS s2, (SELECT sum(w) FROM cr) AS t, (SELECT (SELECT count(*) / sum(z * z) FROM z) * sum(w * zi * zj) / sum(w) FROM cr) AS i),
v AS (SELECT i, -1 / (n - 1) AS e, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * t * t) - s3 * ((n * n - n) * s1 - 2 * n * s2 + 6 * t * t)) / ((n - 1) * (n - 2) * (n - 3) * t * t) - 1 / ((n - 1) * (n - 1)) AS var FROM q)
SELECT round(i, 6) AS i, round(e, 6) AS e, round(var, 6) AS var, round((i - e) / sqrt(var), 6) AS z FROM v""")
def morans_i_stats(spark, d):
    return rounded(weights.morans_i_stats(fifth(spark, d), T.values(spark, d)).drop("p"), "i", "e", "var", "z")


@query("local_morans_i", f"WITH {CROSS} SELECT src AS id, round(any_value(zi) / (SELECT avg(z * z) FROM z) * sum(w * zj), 6) AS i FROM cr GROUP BY src")
def local_morans_i(spark, d):
    return rounded(weights.local_morans_i(fifth(spark, d), T.values(spark, d)), "i")


# ---------------------------------------------------------------- validity

def _valid(name, f, sql, *columns):
    query(name, sql)(lambda spark, d: rounded(f(T.clusters(spark, d)), *columns))


_valid("wcss", validate.wcss, f"WITH {T.MEANS} SELECT round(sum(d * d), 6) AS wcss FROM dm", "wcss")
_valid("bcss", validate.bcss, f"WITH {T.MEANS} SELECT round(sum(n / (SELECT count(*) FROM vec)::DOUBLE * list_distance(m, t) ** 2), 6) AS bcss FROM m, tot", "bcss")
DB = "s AS (SELECT label, avg(d) AS s FROM dm GROUP BY label), w AS (SELECT a.label, max((a.s + b.s) / list_distance(ma.m, mb.m)) AS r FROM s a JOIN s b ON a.label <> b.label JOIN m ma ON ma.label = a.label JOIN m mb ON mb.label = b.label GROUP BY a.label)"
_valid("davies_bouldin", validate.davies_bouldin, f"WITH {T.MEANS}, {DB} SELECT round(avg(r), 6) AS davies_bouldin FROM w", "davies_bouldin")
SIL = "sa AS (SELECT sample_id, own, other, avg(d) AS d FROM pr GROUP BY ALL), sb AS (SELECT sample_id, min(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM sa GROUP BY sample_id)"
_valid("silhouette", validate.silhouette, f"WITH {T.SUMS}, {SIL} SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sb", "silhouette")
_valid("dunn", validate.dunn, f"WITH {T.SUMS} SELECT round(min(d) FILTER (own <> other) / max(d) FILTER (own = other), 6) AS dunn FROM pr", "dunn")
_valid("connectivity", lambda c: validate.connectivity(c, 5), f"WITH {T.VEC}, k AS (SELECT a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.x, b.x), b.sample_id) AS rank FROM vec a JOIN vec b ON a.sample_id <> b.sample_id) SELECT round(sum(CASE WHEN la <> lb THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS connectivity FROM k WHERE rank <= 5", "connectivity")
_valid("heterogeneity", validate.heterogeneity, f"WITH {T.MEANS} SELECT label AS cluster, round(sum(d * d) / 64, 6) AS ssd FROM dm GROUP BY label", "ssd")
_valid("cluster_summary", validate.summary, f"WITH {T.MEANS}, {DB}, pr AS (SELECT a.sample_id, a.label AS own, b.label AS other, list_distance(a.x, b.x) AS d FROM vec a JOIN vec b ON a.sample_id <> b.sample_id), {SIL} SELECT (SELECT count(DISTINCT label) FROM vec) AS clusters, (SELECT round(sum(d * d), 6) FROM dm) AS wcss, (SELECT round(sum(n / (SELECT count(*) FROM vec)::DOUBLE * list_distance(m, t) ** 2), 6) FROM m, tot) AS bcss, (SELECT round(avg(d), 6) FROM dm) AS mean_qe, (SELECT round(avg(r), 6) FROM w) AS davies_bouldin, (SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) FROM sb) AS silhouette, (SELECT round(min(d) FILTER (own <> other) / max(d) FILTER (own = other), 6) FROM pr) AS dunn", "wcss", "bcss", "mean_qe", "davies_bouldin", "silhouette", "dunn")
TAB = "t AS (SELECT label AS u, neuron_id AS v, count(*) AS n FROM r WHERE rank = 1 GROUP BY ALL), tot AS (SELECT sum(n)::DOUBLE AS t FROM t), tu AS (SELECT u, sum(n)::DOUBLE AS n FROM t GROUP BY u), tv AS (SELECT v, sum(n)::DOUBLE AS n FROM t GROUP BY v)"


@query("nmi", f"WITH {T.ASSIGN}, {TAB} SELECT round((SELECT sum(t.n / tot.t * ln(t.n * tot.t / tu.n / tv.n)) FROM t JOIN tu USING (u) JOIN tv USING (v), tot) / sqrt((SELECT -sum(n / t * ln(n / t)) FROM tu, tot) * (SELECT -sum(n / t * ln(n / t)) FROM tv, tot)), 6) AS nmi")
def nmi(spark, d):
    return rounded(validate.nmi(assigned(spark, d), "label", "neuron_id"), "nmi")


@query("adjusted_rand", f"WITH {T.ASSIGN}, {TAB}, s AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM t) AS s, (SELECT sum(n * (n - 1) / 2) FROM tu) AS a, (SELECT sum(n * (n - 1) / 2) FROM tv) AS b, t AS t FROM tot) SELECT round((s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM s")
def adjusted_rand(spark, d):
    return rounded(validate.adjusted_rand(assigned(spark, d), "label", "neuron_id"), "ari")


# ---------------------------------------------------------------- graphs

@query("hebbian_graph", f"WITH {TWO} SELECT least(first, second) AS a, greatest(first, second) AS b, count(*) AS cnt FROM two GROUP BY ALL")
def hebbian_graph(spark, d):
    return graph.hebbian(quality.two_best(ranks(spark, d)))


@query("graph_nodes", f"WITH {T.REGIONS} SELECT src AS id FROM reg UNION SELECT dst FROM reg")
def graph_nodes(spark, d):
    return graph.nodes(T.regions(spark, d))


@query("symmetrize", f"WITH {T.KNN} SELECT src, dst FROM knn UNION SELECT dst, src FROM knn")
def symmetrize(spark, d):
    return graph.symmetrize(neighbours(spark, d))


@query("is_undirected", f"WITH {T.KNN} SELECT count(*) = 0 AS undirected FROM (SELECT src, dst FROM knn EXCEPT SELECT dst, src FROM knn)")
def is_undirected(spark, d):
    return graph.is_undirected(neighbours(spark, d))


@query("components", "SELECT n_nationkey::BIGINT AS id, (min(n_nationkey) OVER (PARTITION BY n_regionkey))::BIGINT AS component FROM nation")
def components(spark, d):
    return graph.components(T.regions(spark, d))


def rook(spark):
    return weights.lattice(T.cells(spark), True)


@query("hop_distance", f"WITH {T.CELLS} SELECT id, (i + j)::BIGINT AS hops FROM cells")
def hop_distance(spark, d):
    return graph.hops(rook(spark), 0)


@query("shortest_dists", f"WITH {T.CELLS} SELECT id, round((2.0 * i + 3.0 * j)::DOUBLE, 6) AS dist FROM cells")
def shortest_dists(spark, d):
    w = F.when(F.abs(F.col("src") - F.col("dst")) == 9, 2.0).otherwise(3.0)
    return rounded(graph.shortest(rook(spark).withColumn("w", w), 0), "dist")


@query("modularity", f"WITH {T.TRADE}, e AS (SELECT w, a.n_regionkey AS ma, b.n_regionkey AS mb FROM trade JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey), c AS (SELECT ma, sum(CASE WHEN ma = mb THEN w ELSE 0 END) AS i, sum(w) AS t FROM e GROUP BY ma) SELECT round(sum(i / m - (t / m) ** 2), 6) AS q FROM c, (SELECT sum(w) AS m FROM e)")
def modularity(spark, d):
    n = T.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("module"))
    return rounded(graph.modularity(T.trade(spark, d), n), "q")


@query("mst_weight", "SELECT round(107.0 + 11.0, 6)::DOUBLE AS weight, 107::BIGINT AS edges")
def mst_weight(spark, d):
    """The lattice again: steps along j cost 1, along i cost 2; the tree takes 96 of the first, 11 of the second."""
    w = F.when(F.abs(F.col("src") - F.col("dst")) == 9, 2.0).otherwise(1.0)
    return graph.spanning_tree(rook(spark).withColumn("w", w)).agg(r6(F.sum("w")).alias("weight"), F.count("*").alias("edges"))


# ---------------------------------------------------------------- scalar functions and classes

STEPS = "s AS (SELECT range / 10.0::DOUBLE AS x FROM range(11))"


@query("decay_curves", f"WITH {STEPS} SELECT round(x, 6) AS x, round((1.0 - 10.0) * x + 10.0, 6) AS linear, round(10.0 * pow(0.1, x), 6) AS power, round(1 / (1 + exp(-x * 8.0 + 4.0)), 6) AS sigmoid FROM s")
def decay_curves(spark, d):
    s = spark.range(11).select((F.col("id") / 10).alias("x"))
    return s.select(r6("x").alias("x"), r6(V.linear_decay("x", 10.0, 1.0)).alias("linear"), r6(V.power_decay("x", 10.0, 1.0)).alias("power"), r6(V.sigmoid_decay("x", 8.0)).alias("sigmoid"))


@query("kernel_values", f"WITH {STEPS} SELECT round(x, 6) AS x, round(exp(-0.5 * (x / 0.4) ** 2), 6) AS gauss, CASE WHEN x <= 0.4 THEN 1.0 ELSE 0.0 END::DOUBLE AS bubble, round(greatest(1 - x * 1.5, 0.0), 6) AS linear FROM s")
def kernel_values(spark, d):
    s = spark.range(11).select((F.col("id") / 10).alias("x"))
    return s.select(r6("x").alias("x"), r6(V.gauss("x", F.lit(0.4))).alias("gauss"), V.bubble("x", F.lit(0.4)).alias("bubble"), r6(V.linear_kernel("x", F.lit(1.5))).alias("linear"))


def balances(spark, d):
    return T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))


@query("color_equal", "SELECT c_custkey AS id, least(floor((c_acctbal - min(c_acctbal) OVER ()) / ((max(c_acctbal) OVER () - min(c_acctbal) OVER ()) / 7)), 6)::INT AS class_idx FROM customer")
def color_equal(spark, d):
    return color.equal_classes(balances(spark, d), 7)


@query("color_quantile", "WITH k AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rk, count(*) OVER () AS n FROM customer) SELECT id, " + " + ".join(f"(rk > floor(n / 7.0 * {c} + 0.5))::INT" for c in range(1, 7)) + " AS class_idx FROM k")
def color_quantile(spark, d):
    return color.quantile_classes(balances(spark, d), 7)


GRID = "g AS (SELECT a.range AS n0, b.range AS n1, a.range // 6 AS x0, a.range % 6 AS y0, b.range // 6 AS x1, b.range % 6 AS y1 FROM range(48) a, range(48) b)"
HEXSQL = "({dx} + {dy} - least({dy}, CASE WHEN ({up}) = (x0 % 2 = 0) THEN floor({dx} / 2.0) ELSE ceil({dx} / 2.0) END))"


def grid_pairs(spark):
    a = spark.range(48).select(F.col("id").alias("n0"), F.floor(F.col("id") / 6).cast("int").alias("x0"), (F.col("id") % 6).cast("int").alias("y0"))
    b = a.select(F.col("n0").alias("n1"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return a.join(F.broadcast(b))


def _grid(name, dist, sql):
    query(name, f"WITH {GRID} SELECT n0, n1, ({sql})::BIGINT AS dist FROM g")(lambda spark, d: grid_pairs(spark).select("n0", "n1", dist().cast("long").alias("dist")))


_grid("grid_dist_rect", hop, "abs(x0 - x1) + abs(y0 - y1)")
_grid("grid_dist_toroid", lambda: V.toroid_dist("x0", "y0", "x1", "y1", 8, 6), "least(abs(x0 - x1), 8 - abs(x0 - x1)) + least(abs(y0 - y1), 6 - abs(y0 - y1))")
_grid("grid_dist_hex", lambda: V.hex_dist("x0", "y0", "x1", "y1"), HEXSQL.format(dx="abs(x0 - x1)", dy="abs(y0 - y1)", up="y1 > y0"))
_grid("grid_dist_hex_toroid", lambda: V.hex_toroid_dist("x0", "y0", "x1", "y1", 8, 6), "least(" + ", ".join(HEXSQL.format(dx=a, dy=b, up=u) for a in ("abs(x0 - x1)", "(8 - abs(x0 - x1))") for b, u in (("abs(y0 - y1)", "y1 > y0"), ("(6 - abs(y0 - y1))", "NOT (y1 > y0)"))) + ")")

# ---------------------------------------------------------------- one step of training

LONG = ", e AS (SELECT sample_id, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM vec)"


@query("batch_som_epoch", f"WITH {T.ASSIGN}{LONG}, h AS (SELECT a.neuron_id AS bmu, b.neuron_id, exp(-0.5 * ((abs(a.gx - b.gx) + abs(a.gy - b.gy)) / 1.5) ** 2) AS h FROM cb a, cb b) SELECT h.neuron_id, pos, round(sum(h * v) / sum(h), 6) AS v FROM e JOIN r USING (sample_id) JOIN h ON r.neuron_id = bmu WHERE rank = 1 GROUP BY ALL")
def batch_som_epoch(spark, d):
    return vector_rows(train.som_epoch(T.vec(spark, d).select("sample_id", "x"), T.codebook(spark, d), hop(), 1.5), "neuron_id")


@query("batch_ng_epoch", f"WITH {T.ASSIGN}{LONG} SELECT neuron_id, pos, round(sum(exp(-(rank - 1) / 4.0::DOUBLE) * v) / sum(exp(-(rank - 1) / 4.0::DOUBLE)), 6) AS v FROM e JOIN r USING (sample_id) GROUP BY ALL")
def batch_ng_epoch(spark, d):
    return vector_rows(train.ng_epoch(T.vec(spark, d).select("sample_id", "x"), T.codebook(spark, d), 4.0), "neuron_id")


@query("kmeans_step", f"WITH {T.ASSIGN}{LONG}, m AS (SELECT neuron_id, pos, avg(v) AS v FROM e JOIN r USING (sample_id) WHERE rank = 1 GROUP BY ALL), c AS (SELECT neuron_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM cb) SELECT c.neuron_id, c.pos, round(coalesce(v, w), 6) AS v FROM c LEFT JOIN m USING (neuron_id, pos)")
def kmeans_step(spark, d):
    return vector_rows(train.kmeans_step(T.vec(spark, d).select("sample_id", "x"), T.codebook(spark, d)), "neuron_id")


CONTEXT = T.KNN.replace(T.VEC, T.ASSIGN) + ", cx AS (SELECT src, generate_subscripts(w, 1) AS pos, unnest(w) AS v FROM knn JOIN r ON r.sample_id = dst AND r.rank = 1 JOIN cb USING (neuron_id)), ct AS (SELECT src, pos, 0.75 * avg(v) AS v FROM cx GROUP BY ALL)"


def contexts(spark, d):
    """Contexts with beta 1/4 and neuron contexts of zero."""
    cb = T.codebook(spark, d).select("neuron_id", "w", F.transform("w", lambda v: F.lit(0.0)).alias("c"))
    return assign.merge_context(fifth(spark, d), assigned(spark, d).select("sample_id", "neuron_id"), cb, 0.25)


@query("wmc_context", f"WITH {CONTEXT} SELECT src, pos, round(v, 6) + 0.0 AS v FROM ct")
def wmc_context(spark, d):
    return vector_rows(contexts(spark, d), "src", "context").withColumn("v", F.col("v") + 0.0)  # no -0


@query("wmc_assign", f"WITH {CONTEXT}, cl AS (SELECT src, list(v ORDER BY pos) AS c FROM ct GROUP BY src), q AS (SELECT sample_id, neuron_id, 0.6 * list_distance(x, w) + 0.4 * list_distance(c, list_transform(w, lambda v: 0.0::DOUBLE)) AS dist FROM vec JOIN cl ON src = sample_id, cb) SELECT sample_id, neuron_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY dist, neuron_id) AS k FROM q) WHERE k = 1")
def wmc_assign(spark, d):
    s = T.vec(spark, d).select("sample_id", "x").join(contexts(spark, d).withColumnRenamed("src", "sample_id"), "sample_id")
    cb = T.codebook(spark, d).select("neuron_id", "w", F.transform("w", lambda v: F.lit(0.0)).alias("c"))
    return rounded(assign.nearest(s, cb, assign.mixed(("x", "w", 0.6), ("context", "c", 0.4))).select("sample_id", "neuron_id", "dist"), "dist")
